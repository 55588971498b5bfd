"""Schemas of the stored tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ENVELOPE = (
    "id STRING, kind STRING, title STRING, summary STRING, body STRING, url STRING, source STRING, source_id STRING, "
    "categories ARRAY<STRING>, tags ARRAY<STRING>, lat DOUBLE, lng DOUBLE, city STRING, county STRING, address STRING, "
    "geo_precision STRING, updated_at BIGINT, indexed_at BIGINT, content_hash STRING"
)
EXTRAS = {
    "place": "phone STRING, website STRING, opening_hours STRING, cuisine ARRAY<STRING>, price_level STRING, osm_type STRING, osm_id BIGINT, wikidata_id STRING",
    "event": "start_time BIGINT, end_time BIGINT, venue_name STRING, organizer STRING, price STRING",
    "article": "published_at BIGINT, author STRING, site_name STRING, lang STRING, word_count BIGINT",
}
TABLES = {
    **{f"{k}s": f"{ENVELOPE}, {v}" for k, v in EXTRAS.items()},
    "submissions": (
        "id STRING, status STRING, request STRING, target_kind STRING, title STRING, description STRING, url STRING, address STRING, city STRING, lat DOUBLE, "
        "lng DOUBLE, categories ARRAY<STRING>, existing_id STRING, contact STRING, submitted_at BIGINT, updated_at BIGINT, reviewed_at BIGINT, review_note STRING, apply_note STRING"
    ),
    "postings": "id STRING, kind STRING, doc STRING, term STRING, attr INT, pos INT, stamp BIGINT, block BIGINT",
    "frontier": "id STRING, url STRING, host STRING, status STRING, depth INT, priority BIGINT, default_city STRING, discovered_at BIGINT, updated_at BIGINT",
    "geocache": "id STRING, key STRING, status STRING, lat DOUBLE, lng DOUBLE, updated_at BIGINT",
    "suppressions": "id STRING, doc_id STRING, reason STRING, updated_at BIGINT",
    "cursors": "id STRING, source STRING, value STRING, updated_at BIGINT",
    "gazetteer": "ord INT, name STRING, aliases ARRAY<STRING>, lat DOUBLE, lng DOUBLE, county STRING, default_radius_m INT",
    "metrics": "source STRING, run_at BIGINT, error STRING, swept BOOLEAN, received BIGINT, invalid BIGINT, out_of_region BIGINT, duplicates BIGINT, suppressed BIGINT, unchanged BIGINT, written BIGINT",
}
KINDS = ("place", "event", "article")
PRECISIONS = ("exact", "address", "city", "region")
#: Any document, before it is routed to its kind's table.
DOCUMENT = ", ".join([ENVELOPE, *EXTRAS.values()])


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES.get(name, name))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], struct(name))


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly these columns in this order: missing ones null, others cast."""
    from pyspark.sql import functions as F

    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl)))
