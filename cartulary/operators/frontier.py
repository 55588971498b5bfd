"""The crawl frontier as a table, with whole-table transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..schema import TABLES, conform
from .ranking import numbered

PENDING, TAKEN, DONE, ERROR = "pending", "in_progress", "done", "error"


def rows(urls: DataFrame, now: int) -> DataFrame:
    """Frontier rows of (url, depth, default_city); of one url the shallowest."""
    first = Window.partitionBy("url").orderBy("depth", F.asc_nulls_last("default_city"))
    new = urls.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    new = new.withColumns({"id": ids.frontier_id("url"), "host": text.host_of("url"), "status": F.lit(PENDING), "priority": F.col("depth").cast("long"), "discovered_at": F.lit(now), "updated_at": F.lit(now)})
    return conform(new, TABLES["frontier"])


def add(frontier: DataFrame, urls: DataFrame, now: int) -> DataFrame:
    """Known urls stay as they are."""
    return frontier.unionByName(rows(urls, now).join(frontier.select("id"), "id", "left_anti"))


def claim_order():
    return [F.asc("priority"), F.asc("discovered_at"), F.asc("url")]


def next_up(frontier: DataFrame, n: int) -> DataFrame:
    return frontier.where(F.col("status") == PENDING).orderBy(*claim_order()).limit(n)


def _change(frontier: DataFrame, keys: DataFrame, status, now: int) -> DataFrame:
    """Rows with these ids get a status; others stay. keys: (id[, new_status])."""
    keys = keys.select(F.col("id").alias("_id"), (F.col(status) if status == "new_status" else F.lit(status)).alias("_new")).distinct()
    out = frontier.join(keys, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    out = out.withColumns({"status": F.when(hit, F.col("_new")).otherwise(F.col("status")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})
    return out.drop("_id", "_new")


def claim(frontier: DataFrame, n: int, now: int) -> tuple[DataFrame, DataFrame]:
    """(claimed rows, frontier with them in progress)."""
    got = next_up(frontier, n)
    return got, _change(frontier, got, TAKEN, now)


def finish(frontier: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """results: (url, new_status); unknown urls change nothing."""
    return _change(frontier, results.withColumn("id", ids.frontier_id("url")), "new_status", now)


def requeue_stale(frontier: DataFrame, now: int, most: int = 1000) -> DataFrame:
    stale = frontier.where(F.col("status") == TAKEN).orderBy("updated_at", "url").limit(most)
    return _change(frontier, stale, PENDING, now)


def reseed(frontier: DataFrame, seeds: DataFrame, now: int) -> DataFrame:
    """Seeds are pending again, new ones are added; other finished urls stay finished."""
    known = _change(frontier, seeds.withColumn("id", ids.frontier_id("url")), PENDING, now)
    return add(known, seeds.select("url", F.lit(0).alias("depth"), "default_city"), now)


def queue(frontier: DataFrame, urls: DataFrame, now: int) -> DataFrame:
    """Added, or pending again if known."""
    return add(_change(frontier, urls.withColumn("id", ids.frontier_id("url")), PENDING, now), urls, now)


def pending(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count_if(F.col("status") == PENDING).alias("n"))


def schedule(urls: DataFrame, gap: float = 1.0, special: dict[str, float] | None = None) -> DataFrame:
    """urls with start_after in seconds: one request of a host per gap, in claim order."""
    gaps = F.lit(gap)
    for host, g in (special or {}).items():
        gaps = F.when(F.col("host") == host, F.lit(g)).otherwise(gaps)
    return numbered(urls, "host", claim_order(), "_n").withColumn("start_after", F.col("_n") * gaps).drop("_n")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls that no robots rule forbids; rules: (host, prefix, allow), the longest matching prefix wins, allow on ties.

    Hosts without rules are allowed.
    """
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/"))
    hit = urls.withColumn("_path", F.when(path == "", "/").otherwise(path)).join(rules.withColumnRenamed("host", "_host"), (F.col("host") == F.col("_host")) & F.startswith(F.col("_path"), F.col("prefix")))
    verdict = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), F.col("allow").cast("int"))).alias("_ok"))
    return urls.join(verdict.where("not _ok"), "url", "left_anti")
