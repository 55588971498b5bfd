"""Row numbers within keys where one key can hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import scratch


def numbered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """rows with their number, from 0, within their key in an order (ties: any order).

    Rows are dealt to ranges of (key, order), so a hot key spreads over many tasks; each range numbers its own rows, and a key
    that goes on from earlier ranges adds their counts. Only such keys need that: at most one a range, so what is broadcast
    has no more rows than there are ranges. The dealt rows are written, so that counts and numbers see the same ranges.
    """
    dealt = rows.repartitionByRange(F.col(key).asc(), *order).sortWithinPartitions(F.col(key).asc(), *order)
    dealt = dealt.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(key).alias("key"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    path = f"{scratch(rows.sparkSession)}/dealt"
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    counts = dealt.groupBy("key", "part").agg(F.count("*").alias("n"))
    several = counts.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select("key")
    split = counts.join(several, counts["key"].eqNullSafe(several["key"]), "left_semi")
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begin = split.select(F.col("key").alias("_key"), F.col("part").alias("_part"), before.alias("before")).where("before is not null")
    own = F.row_number().over(Window.partitionBy("part", "key").orderBy("at")) - 1
    out = dealt.withColumn("own", own).join(F.broadcast(begin), (F.col("part") == F.col("_part")) & F.col("key").eqNullSafe(F.col("_key")), "left")
    return out.select("row.*", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias(name))
