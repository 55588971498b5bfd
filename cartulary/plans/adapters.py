"""The star-schema test tables seen as places, events, articles and the rest, in Spark and in DuckDB SQL.

The tables have no coordinates; both sides derive the same ones from a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..region import City, Region
from ..schema import ENVELOPE, conform

BOX = (36.992426, -109.060253, 41.003444, -102.041524)
SPAN = (4.011018, 7.018729)
DENVER = (39.7392, -104.9903)
NOW = 1_767_225_600
RING = ((37.2, -108.9), (40.8, -107.5), (39.9, -102.4), (38.1, -103.3))
JAGGED = 50_000  # vertices of a ring with a ragged edge


def jagged() -> list[tuple[float, float]]:
    """A diamond whose edge goes in and out at every vertex."""
    c = lambda i: 1.0 - 4.0 * i / JAGGED if 2 * i < JAGGED else 4.0 * i / JAGGED - 3.0
    size = lambda i: 1.0 + (i * 7919 % 101) / 1010.0
    return [(39.0 + 1.5 * c(i) * size(i), -105.5 + 2.5 * c((i + JAGGED // 4) % JAGGED) * size(i)) for i in range(JAGGED)]


_SQL_C = lambda i: f"(CASE WHEN 2 * {i} < {JAGGED} THEN 1.0::DOUBLE - 4.0::DOUBLE * {i} / {JAGGED} ELSE 4.0::DOUBLE * {i} / {JAGGED} - 3.0::DOUBLE END)"
SQL_JAGGED = (
    f"ring AS (SELECT i, 39.0::DOUBLE + 1.5::DOUBLE * {_SQL_C('i')} * (1.0::DOUBLE + (i * 7919 % 101) / 1010.0::DOUBLE) AS y, -105.5::DOUBLE + 2.5::DOUBLE * {_SQL_C(f'((i + {JAGGED // 4}) % {JAGGED})')} * (1.0::DOUBLE + (i * 7919 % 101) / 1010.0::DOUBLE) AS x FROM range({JAGGED}) AS r(i)), "
    f"edges AS (SELECT a.y AS ya, a.x AS xa, b.y AS yb, b.x AS xb FROM ring a JOIN ring b ON b.i = (a.i + {JAGGED - 1}) % {JAGGED})"
)
REGION = Region("Testland", "tl", BOX, (City("Denver", *DENVER),), RING)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> Column:
    """Seconds of a zoneless timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def lat(key: str | Column, scale: float = 1.0) -> Column:
    k = (F.col(key) if isinstance(key, str) else key).cast("long")
    return (k * 7919) % 10007 / F.lit(10007.0) * F.lit(SPAN[0] * scale) + F.lit(BOX[0])


def lng(key: str | Column, scale: float = 1.0) -> Column:
    k = (F.col(key) if isinstance(key, str) else key).cast("long")
    return (k * 104729) % 10009 / F.lit(10009.0) * F.lit(SPAN[1] * scale) + F.lit(BOX[1])


def sql_lat(key: str, scale: float = 1.0) -> str:
    return f"((CAST({key} AS BIGINT) * 7919) % 10007 / 10007.0::DOUBLE * {SPAN[0] * scale!r}::DOUBLE + {BOX[0]!r}::DOUBLE)"


def sql_lng(key: str, scale: float = 1.0) -> str:
    return f"((CAST({key} AS BIGINT) * 104729) % 10009 / 10009.0::DOUBLE * {SPAN[1] * scale!r}::DOUBLE + ({BOX[1]!r})::DOUBLE)"


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(2 * 6371008.8::DOUBLE * asin(sqrt({x})))"


def sql_id(ns: str, key: str) -> str:
    return f"substr(sha256('{ns}' || chr(0) || CAST({key} AS VARCHAR)), 1, 16)"


def places(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """Suppliers and customers as places; every third has no city, every fourth no county."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = F.broadcast(nation.select("n_nationkey", "n_name", "r_name"))
    one = lambda t, k, name, nk, cat: table(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(k).cast("long").alias("k"), F.col(name).alias("title"), F.col(nk).alias("nk"), cat.alias("cat"))
    both = one("supplier", "s_suppkey", "s_name", "s_nationkey", F.lit("supplier")).union(one("customer", "c_custkey", "c_name", "c_nationkey", F.lower("c_mktsegment")))
    out = both.join(nation, F.col("nk") == F.col("n_nationkey"))
    out = out.withColumns(
        {
            "id": ids.stable_id(F.col("source"), "k"), "kind": F.lit("place"), "source_id": F.col("k").cast("string"), "summary": F.concat_ws(" ", "title", "cat"), "body": F.lit(""), "lat": lat("k", scale), "lng": lng("k", scale),
            "categories": F.array("cat", F.lit("customer or supplier")), "tags": F.array("r_name"), "city": F.when(F.col("k") % 3 != 0, F.col("n_name")), "county": F.when(F.col("k") % 4 != 0, F.col("r_name")), "geo_precision": F.lit("exact"), "updated_at": F.col("k") + 1_700_000_000,
        }
    )
    return conform(out, f"{ENVELOPE}, k BIGINT")


def sql_places(scale: float = 1.0) -> str:
    one = lambda t, k, name, nk, cat: f"SELECT '{t}' AS source, CAST({k} AS BIGINT) AS k, {name} AS title, {nk} AS nk, {cat} AS cat, {sql_id(t, k)} AS id FROM {t}"
    both = f"{one('supplier', 's_suppkey', 's_name', 's_nationkey', chr(39) + 'supplier' + chr(39))} UNION ALL {one('customer', 'c_custkey', 'c_name', 'c_nationkey', 'lower(c_mktsegment)')}"
    return (
        f"places AS (SELECT p.*, {sql_lat('k', scale)} AS lat, {sql_lng('k', scale)} AS lng, CASE WHEN k % 3 <> 0 THEN n_name END AS city, CASE WHEN k % 4 <> 0 THEN r_name END AS county, k + 1700000000 AS updated_at "
        f"FROM ({both}) p JOIN nation ON nk = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("name"), F.array().cast("array<string>").alias("aliases"), lat("n_nationkey").alias("lat"), lng("n_nationkey").alias("lng"), F.col("r_name").alias("county"), F.lit(12000).alias("default_radius_m"))


SQL_GAZETTEER = f"gazetteer AS (SELECT n_nationkey AS ord, n_name AS name, {sql_lat('n_nationkey')} AS lat, {sql_lng('n_nationkey')} AS lng, r_name AS county FROM nation JOIN region ON n_regionkey = r_regionkey)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = epoch("ts")
    out = e.withColumns({"id": ids.stable_id("events", "event_id"), "kind": F.lit("event"), "title": F.col("event_type"), "lat": lat("user_id"), "lng": lng("user_id"), "start_time": at, "updated_at": at, "source": F.lit("events")})
    return conform(out, f"{ENVELOPE}, start_time BIGINT, k BIGINT")


SQL_EVENTS = f"places_e AS (SELECT {sql_id('events', 'event_id')} AS id, event_type AS title, {sql_lat('user_id')} AS lat, {sql_lng('user_id')} AS lng, CAST(floor(epoch(ts)) AS BIGINT) AS start_time FROM events)"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    out = d.withColumns(
        {
            "id": ids.stable_id("documents", "doc_id"), "kind": F.lit("article"), "title": F.substring("text", 1, 60), "body": F.col("text"), "url": F.concat(F.lit("https://a.example/"), (F.col("n_chars") % 50).cast("string")),
            "lat": lat("doc_id"), "lng": lng("doc_id"), "updated_at": F.col("doc_id") + 1_700_000_000, "k": F.col("doc_id"), "categories": F.array("source", "lang"),
        }
    )
    return conform(out, f"{ENVELOPE}, lang STRING, k BIGINT")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as places with short titles."""
    p = table(spark, sf_dir, "part")
    out = p.withColumns({"id": ids.stable_id("part", "p_partkey"), "kind": F.lit("place"), "title": F.col("p_name"), "lat": lat("p_partkey"), "lng": lng("p_partkey"), "updated_at": F.lit(0), "k": F.col("p_partkey"), "categories": F.array(F.lower("p_type"), F.lower("p_brand"))})
    return conform(out, f"{ENVELOPE}, k BIGINT")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as submissions."""
    o = table(spark, sf_dir, "orders")
    request = F.element_at(F.array(*map(F.lit, ("add", "update", "remove", "correction"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    at = epoch("o_orderdate")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), status.alias("status"), request.alias("request"), at.alias("submitted_at"), F.when(F.col("o_orderkey") % 5 == 0, "tried").alias("apply_note"), F.lit(None).cast("string").alias("review_note"), at.alias("updated_at"), F.lit(None).cast("long").alias("reviewed_at"))


SQL_SUBMISSIONS = (
    "submissions AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, "
    "['add', 'update', 'remove', 'correction'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS request, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS submitted_at, CASE WHEN o_orderkey % 5 = 0 THEN 'tried' END AS apply_note, o_orderkey FROM orders)"
)


