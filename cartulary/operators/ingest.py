"""The ingest plan: gate, backfill, finalize, dedupe, suppress, detect changes.

One DataFrame carries every received document with a reason column, so that the written rows and the
counters come from the same plan. Nothing is collected but the counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, ids, text
from ..region import Region
from ..schema import DOCUMENT, EXTRAS, KINDS, TABLES, conform, struct
from . import cover
from . import gazetteer as gaz

COUNTERS = ("received", "invalid", "out_of_region", "duplicates", "suppressed", "unchanged", "written")


def gate(docs: DataFrame, region: Region) -> DataFrame:
    """docs with reason: invalid (coordinates or title) or out_of_region, else null."""
    valid = geo.is_valid("lat", "lng") & F.coalesce(text.ws_trim("title") != "", F.lit(False))
    return cover.inside(docs, region, "_in").withColumn("reason", F.when(~valid, "invalid").when(~F.col("_in"), "out_of_region")).drop("_in")


def backfill(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """City where blank and county where null from the nearest gazetteer row; exact points at its very centre become city."""
    out = gaz.nearest(docs, gazetteer)
    centre = (F.col("geo_precision") == "exact") & (F.col("near.distance") < 1.0)
    out = out.withColumns(
        {
            "city": F.coalesce(F.when(text.ws_trim("city") != "", F.col("city")), F.col("near.name")),
            "county": F.coalesce("county", "near.county"),
            "geo_precision": F.when(centre, "city").otherwise(F.col("geo_precision")),
        }
    )
    return out.drop("near")


def finalize(docs: DataFrame, now: int) -> DataFrame:
    """Normalised text and tags, the time of indexing, and last the content hash of the kind's columns."""
    out = docs.withColumns(
        {
            "title": text.collapse_ws("title"),
            "summary": text.truncate_chars(text.collapse_ws(F.coalesce("summary", F.lit(""))), text.SUMMARY_CHARS),
            "body": text.truncate_chars(text.collapse_ws(F.coalesce("body", F.lit(""))), text.BODY_CHARS),
            "categories": text.dedupe_lower(F.coalesce("categories", F.array().cast("array<string>"))),
            "tags": text.dedupe_lower(F.coalesce("tags", F.array().cast("array<string>"))),
            "indexed_at": F.lit(now).cast("long"),
            "id": F.coalesce("id", ids.stable_id(F.col("source"), "source_id")),
        }
    )
    hashed = F.lit(None).cast("string")
    for kind in KINDS:
        cols = struct(f"{kind}s").names
        hashed = F.when(F.col("kind") == kind, ids.content_hash(cols)).otherwise(hashed)
    return out.withColumn("content_hash", hashed)


def last_of_each(docs: DataFrame, seq: str = "_seq") -> DataFrame:
    """docs with reason duplicates on all but the last of each id in arrival order; other reasons stand."""
    w = Window.partitionBy("id", F.col("reason").isNull()).orderBy(F.desc(seq))
    again = F.col("reason").isNull() & (F.row_number().over(w) > 1)
    return docs.withColumn("reason", F.when(again, "duplicates").otherwise(F.col("reason")))


def suppress(docs: DataFrame, suppressions: DataFrame) -> DataFrame:
    """reason suppressed where the id is withdrawn. An unreadable table fails the batch: nothing slips through."""
    gone = suppressions.select(F.col("doc_id").alias("_gone")).distinct()
    out = docs.join(gone, docs["id"] == F.col("_gone"), "left")
    return out.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_gone").isNotNull(), "suppressed").otherwise(F.col("reason"))).drop("_gone")


def detect_changes(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """reason unchanged where the stored row of the same kind and id has the same content hash. Reads three columns."""
    old = stored.select(F.col("kind").alias("_kind"), F.col("id").alias("_id"), F.col("content_hash").alias("_old"))
    out = docs.join(old, (docs["id"] == F.col("_id")) & (docs["kind"] == F.col("_kind")), "left")
    same = F.col("reason").isNull() & F.col("_id").isNotNull() & F.col("_old").eqNullSafe(F.col("content_hash"))
    return out.withColumn("reason", F.when(same, "unchanged").otherwise(F.col("reason"))).drop("_kind", "_id", "_old")


def plan(docs: DataFrame, region: Region, gazetteer: DataFrame, suppressions: DataFrame, stored: DataFrame, now: int) -> DataFrame:
    """Every received document with its reason; null: to be written. docs needs _seq, its arrival order."""
    seq = F.col("_seq") if "_seq" in docs.columns else F.monotonically_increasing_id()
    docs = conform(docs.withColumn("_seq", seq), f"{DOCUMENT}, _seq BIGINT")
    return detect_changes(suppress(last_of_each(finalize(backfill(gate(docs, region), gazetteer), now)), suppressions), stored)


def stats(planned: DataFrame) -> DataFrame:
    """One row of counters; received is the sum of the others."""
    one = lambda name: F.count_if(F.col("reason") == name).alias(name)
    return planned.agg(F.count("*").alias("received"), *map(one, COUNTERS[1:-1]), F.count_if(F.col("reason").isNull()).alias("written"))


def merge_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))


def route(planned: DataFrame) -> dict[str, DataFrame]:
    """What is to be written, by table."""
    out = planned.where("reason is null")
    return {f"{k}s": conform(out.where(F.col("kind") == k), TABLES[f"{k}s"]) for k in EXTRAS}
