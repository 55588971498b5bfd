"""Addresses that were looked up before, found or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..region import Region
from ..schema import TABLES, conform

HIT, MISS = "hit", "miss"


def lookup(docs: DataFrame, cache: DataFrame, region: Region, address: str = "address") -> DataFrame:
    """docs with geo_lat, geo_lng and geo_known: known misses are known without coordinates; a hit must lie in the region."""
    known = cache.select(F.col("id").alias("_g"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), "status").withColumnRenamed("status", "_status")
    out = docs.withColumn("_key", ids.geocache_id(text.geocode_key(address))).join(known, F.col("_key") == F.col("_g"), "left")
    ok = (F.col("_status") == HIT) & region.inside("_lat", "_lng")
    return out.withColumns({"geo_lat": F.when(ok, F.col("_lat")), "geo_lng": F.when(ok, F.col("_lng")), "geo_known": F.col("_g").isNotNull()}).drop("_g", "_key", "_lat", "_lng", "_status")


def missing(docs: DataFrame, cache: DataFrame, address: str = "address") -> DataFrame:
    """Distinct address keys that nobody looked up yet."""
    keys = docs.select(text.geocode_key(address).alias("key")).where("key <> ''").distinct()
    return keys.withColumn("id", ids.geocache_id("key")).join(cache.select("id"), "id", "left_anti")


def put(results: DataFrame, region: Region, now: int) -> DataFrame:
    """Cache rows of (key, lat, lng); outside the region or without coordinates is a miss. Failed lookups are not passed in."""
    ok = region.inside("lat", "lng")
    out = results.withColumns({"status": F.when(ok, HIT).otherwise(MISS), "lat": F.when(ok, F.col("lat")), "lng": F.when(ok, F.col("lng")), "id": ids.geocache_id("key"), "updated_at": F.lit(now)})
    return conform(out, TABLES["geocache"])
