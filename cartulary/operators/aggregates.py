"""Facets, counts, freshness and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACET_VALUES = 200


def facet(docs: DataFrame, field: str, most: int = FACET_VALUES) -> DataFrame:
    """(value, n) of an array field; the first ``most`` values in order."""
    return docs.select(F.explode(field).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy("value").limit(most)


def top(facets: DataFrame, most: int) -> DataFrame:
    return facets.orderBy(F.desc("n"), "value").limit(most)


def histogram(rows: DataFrame, field: str, values: tuple[str, ...]) -> DataFrame:
    """(value, n) of every listed value, zeros included."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], "value string")
    counts = rows.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    return every.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("kind").agg(F.count("*").alias("n"))


def freshness(docs: DataFrame) -> DataFrame:
    return docs.groupBy("kind").agg(F.max("updated_at").alias("updated_at"))


def source_metrics(runs: DataFrame) -> DataFrame:
    """Per source: runs, last run, last error, errors since the last success, sweeps and totals.

    runs: (source, run_at, error, swept, received, ..., written), a row for each run. An error at the very time of the last
    success comes before it. Sources are few: what is joined is a row a source, and counts are partial sums before they meet.
    """
    failed = F.col("error").isNotNull()
    good = runs.groupBy(F.col("source").alias("_source")).agg(F.max(F.when(~failed, F.col("run_at"))).alias("_good"))
    both = runs.join(good, F.col("source").eqNullSafe(F.col("_source")), "left")  # a row a source
    totals = [c for c in ("received", "invalid", "out_of_region", "duplicates", "suppressed", "unchanged", "written") if c in runs.columns]
    return both.groupBy("source").agg(
        F.count("*").alias("runs"),
        F.max("run_at").alias("last_run_at"),
        F.substring(F.max_by("error", F.when(failed, F.col("run_at"))), 1, 500).alias("last_error"),
        F.count_if(failed & (F.col("_good").isNull() | (F.col("run_at") > F.col("_good")))).alias("consecutive_errors"),
        F.count_if("swept").alias("sweeps"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals),
    )


def rejected(metrics: DataFrame) -> DataFrame:
    """What did not get in: invalid, outside the region or suppressed."""
    return metrics.withColumn("rejected", F.col("invalid") + F.col("out_of_region") + F.col("suppressed"))
