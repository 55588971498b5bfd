"""The engine's own queries over the test tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, ids, text
from ..operators import aggregates, cover, frontier, geocache, ingest, predicates, search
from ..operators import gazetteer as gaz
from ..operators import store as stores
from ..operators import submissions as subs
from ..region import synonym_pairs
from ..schema import TABLES, conform
from ..sources import base as sources
from ..sources import landing, osm, web, wiki
from ..streaming import ratelimit
from . import adapters as a
from . import api
from .adapters import BOX, DENVER, NOW, REGION, RING, SQL_EVENTS, SQL_GAZETTEER, SQL_SUBMISSIONS, sql_haversine, sql_id, sql_lat, sql_lng, sql_places, table

QUERIES = {}
ORACLE = {}
LAT0, LNG0 = DENVER
DLAT, DLNG = f"{LAT0}::DOUBLE", f"({LNG0})::DOUBLE"
WIDE = 1.2
WORDS = r"regexp_extract_all(lower(translate({0}, '" + text.FOLD_FROM + "', '" + text.FOLD_TO + r"')), '[\p{{L}}\p{{N}}]+')"
INSIDE = f"lat BETWEEN {BOX[0]}::DOUBLE AND {BOX[2]}::DOUBLE AND lng BETWEEN ({BOX[1]})::DOUBLE AND ({BOX[3]})::DOUBLE"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _polygon(lat: str, lng: str) -> str:
    parts = []
    for (ya, xa), (yb, xb) in zip(RING, [RING[-1], *RING[:-1]], strict=True):
        parts.append(f"CASE WHEN (({ya}::DOUBLE > {lat}) <> ({yb}::DOUBLE > {lat})) AND {lng} < ({xb!r}::DOUBLE - ({xa!r})::DOUBLE) * ({lat} - {ya}::DOUBLE) / ({yb}::DOUBLE - {ya}::DOUBLE) + ({xa!r})::DOUBLE THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


# ---------------------------------------------------------------- geometry


@query(f"WITH {sql_places()} SELECT id, CAST(round({sql_haversine('lat', 'lng', DLAT, DLNG)}) AS BIGINT) AS distance_m FROM places")
def geo_haversine(spark, d):
    return search.by_distance(a.places(spark, d), DENVER, None).select("id", "distance_m")


@query(f"WITH {sql_places()} SELECT id FROM places WHERE {sql_haversine('lat', 'lng', DLAT, DLNG)} <= 60000")
def geo_radius(spark, d):
    return a.places(spark, d).where(predicates.near(DENVER, 60_000)).select("id")


@query(ORACLE["geo_radius"])
def stored_near(spark, d):
    """The same circle over a stored table: only the parts along the curve that meet it are read."""
    store = stores.Store(spark, stores.scratch(spark))
    store.upsert("places", a.places(spark, d))
    return store.read("places", geo.circle_boxes(DENVER, 60_000)).where(predicates.near(DENVER, 60_000)).select("id")


@query(f"WITH {sql_places(WIDE)} SELECT id FROM places WHERE {INSIDE}")
def geo_bbox(spark, d):
    return a.places(spark, d, WIDE).where(geo.in_bbox("lat", "lng", BOX)).select("id")


@query(f"WITH {sql_places(WIDE)} SELECT id FROM places WHERE {INSIDE} AND {_polygon('lat', 'lng')}")
def geo_polygon(spark, d):
    return predicates.base(a.places(spark, d, WIDE), REGION).select("id")


@query(
    f"WITH {sql_places(WIDE)}, {a.SQL_JAGGED} SELECT id FROM (SELECT id, k, source, count(*) AS n FROM places JOIN edges ON (ya > lat) <> (yb > lat) AND lng < (xb - xa) * (lat - ya) / (yb - ya) + xa GROUP BY ALL) WHERE n % 2 = 1"
)
def geo_ring(spark, d):
    """A ring of 50 000 vertices: points meet their strip, and only those near the border test edges."""
    return cover.in_ring(a.places(spark, d, WIDE), a.jagged(), "inside").where("inside").select("id")


_GRID = geo.grid_for(BOX, 75.0)
_TILE = f"(least({_GRID[1] - 1}, greatest(0, CAST(floor((lat - {BOX[0]}::DOUBLE) / {(BOX[2] - BOX[0]) / _GRID[1]!r}::DOUBLE) AS BIGINT))) * {_GRID[0]} + least({_GRID[0] - 1}, greatest(0, CAST(floor((lng - ({BOX[1]})::DOUBLE) / {(BOX[3] - BOX[1]) / _GRID[0]!r}::DOUBLE) AS BIGINT))))"


@query(f"WITH {sql_places()} SELECT id, {_TILE} AS tile FROM places")
def geo_tile_assign(spark, d):
    return a.places(spark, d).select("id", geo.tile_of("lat", "lng", BOX, *_GRID).alias("tile"))


@query(f"WITH {sql_places()} SELECT {_TILE} AS tile, count(*) AS n FROM places GROUP BY 1")
def geo_tile_counts(spark, d):
    return geo_tile_assign(spark, d).groupBy("tile").agg(F.count("*").alias("n"))


@query(f"SELECT s_suppkey, c_custkey FROM supplier, customer WHERE {sql_haversine(sql_lat('s_suppkey'), sql_lng('s_suppkey'), sql_lat('c_custkey'), sql_lng('c_custkey'))} <= 20000")
def geo_radius_join(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", a.lat("s_suppkey").alias("lat"), a.lng("s_suppkey").alias("lng"))
    c = table(spark, d, "customer").select("c_custkey", a.lat("c_custkey").alias("r_lat"), a.lng("c_custkey").alias("r_lng"))
    return geo.radius_join(c.withColumnsRenamed({"r_lat": "lat", "r_lng": "lng"}), s.withColumnsRenamed({"lat": "r_lat", "lng": "r_lng"}), 20_000, BOX[2]).select("s_suppkey", "c_custkey")


_NEAREST = f"near AS (SELECT p.id, arg_min(struct_pack(name := g.name, county := g.county, d := {sql_haversine('p.lat', 'p.lng', 'g.lat', 'g.lng')}), struct_pack(d := {sql_haversine('p.lat', 'p.lng', 'g.lat', 'g.lng')}, o := g.ord)) AS n FROM places p, gazetteer g GROUP BY p.id)"


@query(f"WITH {sql_places()}, {SQL_GAZETTEER}, {_NEAREST} SELECT id, n.name AS near_city, CAST(round(n.d) AS BIGINT) AS near_m FROM near")
def nearest_city(spark, d):
    out = gaz.nearest(a.places(spark, d), a.gazetteer(spark, d))
    return out.select("id", F.col("near.name").alias("near_city"), F.round("near.distance").cast("long").alias("near_m"))


@query(
    f"WITH {sql_places()}, {SQL_GAZETTEER}, {_NEAREST}, hits AS (SELECT places.*, CAST(round({sql_haversine('lat', 'lng', DLAT, DLNG)}) AS BIGINT) AS distance_m FROM places WHERE {INSIDE} AND {_polygon('lat', 'lng')} AND {sql_haversine('lat', 'lng', DLAT, DLNG)} <= 80000) "
    "SELECT id, title, coalesce(city, n.name) AS city, distance_m FROM (SELECT * FROM hits ORDER BY distance_m, id LIMIT 20) JOIN near USING (id)"
)
def find_nearby(spark, d):
    hits = search.by_distance(predicates.base(a.places(spark, d), REGION), DENVER, 80_000)
    page = search.page(hits, [F.asc("distance_m"), F.asc("id")], 20)
    return gaz.nearest(page, a.gazetteer(spark, d)).select("id", "title", F.coalesce("city", "near.name").alias("city"), "distance_m")


# ---------------------------------------------------------------- gazetteer


def _names(spark, d):
    g = a.gazetteer(spark, d)
    forms = F.array(F.lower("name"), F.concat(F.lit(" "), F.replace("name", F.lit("_"), F.lit("-")), F.lit("!")), F.substring("name", 1, 5), F.concat(F.lit("natlon "), F.col("ord").cast("string")), F.concat("name", F.lit(" north")), F.lit("Chicago"), F.lit(""))
    return g.select(F.col("ord").alias("k"), F.posexplode(forms).alias("form", "name")).select(F.concat_ws("-", "k", "form").alias("id"), "name")


_NORM = "trim(regexp_replace(lower(translate({0}, '" + text.FOLD_FROM + "', '" + text.FOLD_TO + r"')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_SQL_NAMES = "names AS (SELECT ord || '-' || (i - 1) AS id, forms[i] AS name FROM (SELECT ord, [lower(name), ' ' || replace(name, '_', '-') || '!', substr(name, 1, 5), 'natlon ' || ord, name || ' north', 'Chicago', ''] AS forms, unnest(range(1, 8)) AS i FROM gazetteer))"
_SQL_RANKED = (
    f"ranked AS (SELECT n.id, g.name AS city, g.ord, q, gn, CASE WHEN q = gn THEN 0 WHEN strlen(gn) >= 4 AND (starts_with(gn, q) OR starts_with(q, gn)) THEN 1 WHEN levenshtein(q, gn) <= CASE WHEN strlen(q) >= 8 THEN 2 WHEN strlen(q) >= 5 THEN 1 ELSE -1 END THEN 2 END AS stage "
    f"FROM (SELECT *, {_NORM.format('name')} AS q FROM names) n, (SELECT *, {_NORM.format('name')} AS gn FROM gazetteer) g WHERE q <> '')"
)


@query(
    f"WITH {SQL_GAZETTEER}, {_SQL_NAMES}, {_SQL_RANKED} SELECT id, city, stage FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage, CASE stage WHEN 1 THEN -strlen(gn) WHEN 2 THEN levenshtein(q, gn) ELSE 0 END, CASE WHEN stage = 1 THEN -ord ELSE ord END) AS rn FROM ranked WHERE stage IS NOT NULL) WHERE rn = 1"
)
def resolve_names(spark, d):
    return gaz.resolve(_names(spark, d), a.gazetteer(spark, d)).select("id", "city", "stage")


@query(f"WITH {SQL_GAZETTEER} SELECT name, levenshtein({_NORM.format('name')}, 'natoin 17') AS edits FROM gazetteer ORDER BY 2, 1 LIMIT 5")
def suggest_names(spark, d):
    return gaz.suggest(a.gazetteer(spark, d), "Natoin_17").select("name", F.col("edits").cast("long").alias("edits"))


@query(f"WITH {SQL_GAZETTEER} SELECT name FROM gazetteer WHERE lower(county) = 'middle east'")
def county_lookup(spark, d):
    return gaz.in_county(a.gazetteer(spark, d), " Middle  East County").select("name")


@query("SELECT DISTINCT r_name AS county FROM region JOIN nation ON n_regionkey = r_regionkey")
def county_names(spark, d):
    return gaz.counties(a.gazetteer(spark, d))


@query(f"WITH {SQL_GAZETTEER} SELECT row_number() OVER (ORDER BY county NULLS LAST, name) AS n, name, county FROM gazetteer")
def locales(spark, d):
    w = Window.orderBy(F.asc_nulls_last("county"), "name")  # a gazetteer: bounded
    return a.gazetteer(spark, d).select(F.row_number().over(w).cast("long").alias("n"), "name", "county")


# ---------------------------------------------------------------- text


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def norm_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize("text").alias("norm"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed FROM documents")
def collapse_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collapse_ws("text").alias("collapsed"))


def _sql_truncate(c: str, n: int) -> str:
    head = f"substr({c}, 1, {n - 1})"
    before = rf"regexp_extract({head}, '(?s)^(.*) [^ ]*$', 1)"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE CASE WHEN contains({head}, ' ') AND strlen({before}) > {(n - 1) * 4 // 5} THEN {before} ELSE {head} END || '…' END"


@query(f"SELECT doc_id, {_sql_truncate('c', 600)} AS summary, {_sql_truncate('c', 20)} AS label FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def truncate(spark, d):
    c = text.collapse_ws("text")
    return table(spark, d, "documents").select("doc_id", text.truncate_chars(c, 600).alias("summary"), text.truncate_chars(c, 20).alias("label"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([lower(trim(x)) FOR x IN [p_type, p_brand, p_name]])), '|') AS tags FROM part")
def dedupe_lower(spark, d):
    tags = text.dedupe_lower(F.array("p_type", F.concat(F.lit(" "), "p_brand", F.lit("  ")), F.upper("p_type"), "p_name", F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(tags), "|").alias("tags"))


@query(f"SELECT c_custkey, {sql_id('customer', 'c_custkey')} AS id, 'f' || {sql_id('frontier', 'c_name')} AS frontier_id FROM customer")
def stable_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", ids.stable_id("customer", "c_custkey").alias("id"), ids.frontier_id("c_name").alias("frontier_id"))


@query("""SELECT p_partkey, substr(sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || ',"p_type":"' || p_type || '","site":null}'), 1, 32) AS content_hash FROM part""")
def content_hash(spark, d):
    p = table(spark, d, "part").withColumns({"site": F.lit(None).cast("string"), "updated_at": F.current_timestamp()})
    return p.select("p_partkey", ids.content_hash(["p_name", "p_brand", "p_type", "p_size", "site", "updated_at"]).alias("content_hash"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN -1 WHEN 0 THEN e - 3600 ELSE e END AS at FROM (SELECT o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS e FROM orders)")
def schema_dates(spark, d):
    day = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, F.concat(day, F.lit("T00:00:00+01:00"))).when(k == 1, F.concat(day, F.lit("T00:00:00"))).when(k == 2, day).otherwise(F.concat(F.lit("on "), day))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(text.schema_date(said), F.lit(-1)).alias("at"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS at FROM events")
def fmt_ts(spark, d):
    return table(spark, d, "events").select("event_id", text.fmt_ts(a.epoch("ts")).alias("at"))


@query(
    "SELECT event_id, CASE WHEN s < 60 THEN 'just now' ELSE n || ' ' || u || CASE WHEN n = 1 THEN '' ELSE 's' END || ' ago' END AS ago FROM (SELECT *, s // CASE u WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 ELSE 2592000 END AS n FROM (SELECT *, CASE WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' WHEN s < 2592000 THEN 'day' ELSE 'month' END AS u "
    "FROM (SELECT event_id, greatest(0, 1706600000 - CAST(floor(epoch(ts)) AS BIGINT)) AS s FROM events)))"
)
def rel_time(spark, d):
    return table(spark, d, "events").select("event_id", text.ago(a.epoch("ts"), 1_706_600_000).alias("ago"))


@query("SELECT o_orderkey, CASE WHEN m < 1000 THEN m || ' m' ELSE (m + 50) // 1000 || '.' || (m + 50) // 100 % 10 || ' km' END AS label FROM (SELECT o_orderkey, (o_orderkey * 37) % 25000 AS m FROM orders)")
def distance_label(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.distance_label((F.col("o_orderkey") * 37) % 25000).alias("label"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count("text").alias("words"))


@query("SELECT c_custkey, lower(c_name || ', ' || c_mktsegment) AS key FROM customer")
def geocode_keys(spark, d):
    said = F.concat(F.lit(" ,"), "c_name", F.lit(",   "), "c_mktsegment", F.lit(" , "))
    return table(spark, d, "customer").select("c_custkey", text.geocode_key(said).alias("key"))


@query("SELECT p_partkey, replace(p_name || '~' || p_brand, ' ', '+') AS q FROM (SELECT p_partkey, p_name, replace(p_brand, '#', '%23') AS p_brand FROM part)")
def form_encode(spark, d):
    return table(spark, d, "part").select("p_partkey", text.form_encode(F.concat("p_name", F.lit("~"), "p_brand")).alias("q"))


@query("SELECT p_partkey, p_name || ' — ' || lower(p_type) || CASE WHEN p_size % 2 = 0 THEN ' in ' || p_brand ELSE '' END || '.' AS line FROM part")
def describe_places(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.describe(F.col("p_name"), F.array(F.lower("p_type")), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).alias("line"))


@query("SELECT p_partkey, array_to_string([replace(trim(x), '_', ' ') FOR x IN string_split(replace(p_name, ' ', '_ ; ') || ';;' || p_type, ';') IF trim(x) <> ''], '|') AS parts FROM part")
def split_semis(spark, d):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("_ ; ")), F.lit(";;"), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.split_semis(raw), "|").alias("parts"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages")
def hosts(spark, d):
    return table(spark, d, "pages").select("page_id", text.host_of("url").alias("host"))


# ---------------------------------------------------------------- aggregates


@query(f"WITH {sql_places()} SELECT value, n FROM (SELECT unnest([cat, 'customer or supplier']) AS value, count(*) AS n FROM places GROUP BY 1) ORDER BY value LIMIT 200")
def facet_categories(spark, d):
    return aggregates.facet(a.places(spark, d), "categories")


@query("SELECT value, n FROM (SELECT unnest([lower(p_type), lower(p_brand)]) AS value, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, value LIMIT 20")
def top_categories(spark, d):
    return aggregates.top(a.parts(spark, d).select(F.explode("categories").alias("value")).groupBy("value").agg(F.count("*").alias("n")), 20)


@query(f"WITH {SQL_SUBMISSIONS} SELECT value, count(id) AS n FROM (SELECT unnest(['pending', 'approved', 'applied', 'rejected']) AS value) LEFT JOIN submissions ON status = value GROUP BY value")
def status_histogram(spark, d):
    return aggregates.histogram(a.submissions(spark, d), "status", subs.STATUSES)


@query("SELECT 'place' AS kind, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'event', count(*) FROM events UNION ALL SELECT 'article', count(*) FROM documents")
def doc_counts(spark, d):
    return aggregates.counts(search.union_kinds({"place": a.places(spark, d), "event": a.events(spark, d), "article": a.articles(spark, d)}, ["place", "event", "article"]))


@query("SELECT 'place' AS kind, 1700000000 + greatest((SELECT max(s_suppkey) FROM supplier), (SELECT max(c_custkey) FROM customer)) AS updated_at UNION ALL SELECT 'event', max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events UNION ALL SELECT 'article', 1700000000 + max(doc_id) FROM documents")
def freshness(spark, d):
    return aggregates.freshness(search.union_kinds({"place": a.places(spark, d), "event": a.events(spark, d), "article": a.articles(spark, d)}, ["place", "event", "article"]))


@query(
    "WITH r AS (SELECT event_type AS source, ts, event_id, event_type = 'error' OR value > 40 AS bad FROM events), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts, event_id) AS grp FROM r) "
    "SELECT source, count(*) AS runs, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_run_at, count(CASE WHEN bad AND grp = top THEN 1 END) AS consecutive_errors FROM (SELECT *, max(grp) OVER (PARTITION BY source) AS top FROM g) GROUP BY source"
)
def source_metrics(spark, d):
    e = table(spark, d, "events").withColumn("run_at", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    bad = (F.col("event_type") == "error") | (F.col("value") > 40)
    runs = e.select(F.col("event_type").alias("source"), "run_at", F.when(bad, "failed").alias("error"), F.lit(False).alias("swept"))
    return aggregates.source_metrics(runs).select("source", "runs", F.floor(F.col("last_run_at") / 1_000_000).alias("last_run_at"), "consecutive_errors")


# ---------------------------------------------------------------- ingest


def _received(spark, d):
    """Places over a wider box; keys repeat from suppliers to customers, a tenth has no title."""
    p = a.places(spark, d, WIDE)
    return p.withColumns({"id": F.concat(F.lit("p"), F.col("k").cast("string")), "title": F.when(F.col("k") % 10 == 3, F.lit("  ")).otherwise(F.col("title")), "_seq": F.col("k") * 2 + F.when(F.col("source") == "customer", 1).otherwise(0)})


_SQL_RECEIVED = f"{sql_places(WIDE)}, received AS (SELECT 'p' || k AS id, source, k, lat, lng, city, county, CASE WHEN k % 10 = 3 THEN '  ' ELSE title END AS title, k * 2 + CASE WHEN source = 'customer' THEN 1 ELSE 0 END AS seq FROM places)"
_SQL_GATED = f"gated AS (SELECT *, CASE WHEN trim(title) = '' THEN 'invalid' WHEN NOT ({INSIDE} AND {_polygon('lat', 'lng')}) THEN 'out_of_region' END AS reason FROM received)"
_SQL_DEDUPED = "deduped AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY id, reason IS NULL ORDER BY seq DESC) > 1 THEN 'duplicates' ELSE reason END AS reason) FROM gated)"
_SQL_SUPPRESSED = "suppressed AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND k % 7 = 0 THEN 'suppressed' ELSE reason END AS reason) FROM deduped)"
_SQL_PLANNED = f"{_SQL_RECEIVED}, {_SQL_GATED}, {_SQL_DEDUPED}, {_SQL_SUPPRESSED}, planned AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND k % 3 <> 0 AND k % 5 <> 0 THEN 'unchanged' ELSE reason END AS reason) FROM suppressed)"


@query(f"WITH {_SQL_RECEIVED}, {_SQL_GATED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM gated GROUP BY 1")
def gate_stats(spark, d):
    return ingest.gate(_received(spark, d), REGION).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {sql_places()}, {SQL_GAZETTEER}, {_NEAREST} SELECT id, coalesce(city, n.name) AS city, coalesce(county, n.county) AS county, CASE WHEN n.d < 1 THEN 'city' ELSE 'exact' END AS geo_precision FROM places JOIN near USING (id)")
def backfill(spark, d):
    return ingest.backfill(a.places(spark, d), a.gazetteer(spark, d)).select("id", "city", "county", "geo_precision")


@query(f"WITH {_SQL_RECEIVED}, {_SQL_GATED}, {_SQL_DEDUPED} SELECT id, source FROM deduped WHERE reason IS NULL")
def batch_dedupe(spark, d):
    return ingest.last_of_each(ingest.gate(_received(spark, d), REGION)).where("reason is null").select("id", "source")


def _withdrawn(spark, d):
    return _received(spark, d).where("k % 7 = 0").select(F.col("id").alias("doc_id"))


@query(f"WITH {_SQL_RECEIVED}, {_SQL_GATED}, {_SQL_DEDUPED}, {_SQL_SUPPRESSED} SELECT id FROM suppressed WHERE reason = 'suppressed'")
def suppress_anti(spark, d):
    gated = ingest.last_of_each(ingest.gate(_received(spark, d), REGION))
    return ingest.suppress(gated, _withdrawn(spark, d)).where("reason = 'suppressed'").select("id")


def _planned(spark, d):
    """A batch against what a first cycle stored: a third was never stored, a fifth changed since."""
    g, none = a.gazetteer(spark, d), spark.createDataFrame([], "kind string, id string, content_hash string")
    first = ingest.plan(_received(spark, d).withColumn("kind", F.lit("place")), REGION, g, _withdrawn(spark, d), none, NOW)
    number = F.substring("id", 2, 20).cast("long")
    stored = first.where("reason is null").where(number % 3 != 0).select("kind", "id", F.when(number % 5 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"))
    return ingest.plan(_received(spark, d), REGION, g, _withdrawn(spark, d), stored, NOW + 60)


@query(f"WITH {_SQL_PLANNED} SELECT id FROM planned WHERE reason IS NULL")
def change_detect(spark, d):
    return _planned(spark, d).where("reason is null").select("id")


@query(f"WITH {_SQL_PLANNED} SELECT count(*) AS received, " + ", ".join(f"count(CASE WHEN reason = '{c}' THEN 1 END) AS {c}" for c in ingest.COUNTERS[1:-1]) + ", count(*) - count(reason) AS written FROM planned")
def ingest_stats(spark, d):
    return ingest.stats(_planned(spark, d))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_name END AS name FROM part WHERE p_partkey % 9 <> 0")
def keyed_merge(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    out = stores.merge(p, p.where("id % 4 = 0").select("id", F.lit("new").alias("name")))
    return out.join(p.where("id % 9 = 0").select("id"), "id", "left_anti")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 7 <> 0")
def keyed_delete(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return stores.without(p, p.where("id % 7 = 0").select("id").union(p.selectExpr("-id")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 <> 0 THEN 'new' END ELSE p_name END AS name, p_size AS size FROM part UNION ALL SELECT -1 - p_partkey, 'added', -1 FROM part WHERE p_partkey % 50 = 0")
def keyed_update(spark, d):
    """Only the columns of an update change, to null too; new keys are added."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    changes = p.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 != 0, "new").alias("name"))
    return stores.patched(p, changes.union(p.where("id % 50 = 0").select(-1 - F.col("id"), F.lit("added")))).withColumn("size", F.coalesce("size", F.lit(-1).cast("int")))


def _stored(spark, d, *kinds):
    """A store of parts (and documents), written in several batches."""
    store = stores.Store(spark, stores.scratch(spark))
    parts = a.parts(spark, d)
    store.upsert("places", parts.where("k % 3 > 0"))
    store.upsert("places", parts.where("k % 3 = 0 or k % 10 = 0"))
    if "article" in kinds:
        store.upsert("articles", a.articles(spark, d))
    return store


@query(f"SELECT {sql_id('part', 'p_partkey')} AS id, CASE WHEN p_partkey % 8 = 0 THEN 'Changed' WHEN p_partkey % 4 = 0 THEN 'New' ELSE p_name END AS title, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey END AS k FROM part WHERE p_partkey % 9 <> 0 OR p_partkey % 8 = 0")
def stored_merge(spark, d):
    """A table after batches that add, replace, delete and change rows: what its runs say together."""
    store, parts = _stored(spark, d), a.parts(spark, d)
    store.upsert("places", parts.where("k % 4 = 0").withColumn("title", F.lit("New")).withColumn("source_id", F.col("k").cast("string")))
    store.upsert("places", parts.where("k % 4 > 0 or k % 8 = 0").withColumn("source_id", F.col("k").cast("string")))
    store.delete("places", parts.where("k % 9 = 0").select("id"))
    store.update("places", parts.where("k % 8 = 0").select("id", F.lit("Changed").alias("title"), F.lit(None).cast("string").alias("source_id")))
    return store.read("places").select("id", "title", F.col("source_id").cast("long").alias("k"))


@query(f"SELECT {sql_id('part', 'p_partkey')} AS id, CASE WHEN p_partkey % 7 = 0 THEN 'new' ELSE 'changed' END AS what FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0")
def stored_changes(spark, d):
    """New and changed documents of a batch, found by the keys of its ids alone."""
    store, parts = stores.Store(spark, stores.scratch(spark)), a.parts(spark, d).withColumn("content_hash", F.col("title"))
    store.upsert("places", parts.where("k % 7 > 0"))
    batch = parts.withColumn("content_hash", F.when(F.col("k") % 5 == 0, "other").otherwise(F.col("content_hash")))
    old = store.keys("places", batch).select("id", F.col("content_hash").alias("old"))
    out = batch.join(old, "id", "left").where("not old <=> content_hash")
    return out.select("id", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("what"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 11 = 0")
def exists_probe(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return stores.exists(p, p.where("id % 11 = 0").union(p.select(-F.col("id") - 1)))


@query("SELECT 3 * count(*) AS received, 3 * count(CASE WHEN event_type = 'error' THEN 1 END) AS invalid, CAST(0 AS BIGINT) AS out_of_region, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS suppressed, CAST(0 AS BIGINT) AS unchanged, 3 * count(CASE WHEN event_type <> 'error' THEN 1 END) AS written FROM events")
def stats_merge(spark, d):
    bad = (F.col("event_type") == "error").cast("long")
    zero = {c: F.lit(0).cast("long") for c in ingest.COUNTERS}
    one = table(spark, d, "events").select(*(c.alias(n) for n, c in (zero | {"received": F.lit(1).cast("long"), "invalid": bad, "written": 1 - bad}).items()))
    return ingest.merge_stats(one.union(one).union(one))


@query("SELECT source, CAST(invalid + out_of_region + suppressed AS BIGINT) AS rejected FROM (SELECT event_type AS source, sum(user_id) AS invalid, count(*) AS out_of_region, sum(event_id % 3) AS suppressed FROM events GROUP BY 1)")
def rejected_total(spark, d):
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.sum("user_id").alias("invalid"), F.count("*").alias("out_of_region"), F.sum(F.col("event_id") % 3).alias("suppressed"))
    return aggregates.rejected(m).select("source", "rejected")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE 0 END AS at FROM events")
def cursor_read(spark, d):
    """A whole number of a JSON cursor, zero where the cursor is malformed."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("{"), "props"))
    return table(spark, d, "events").withColumn("v", raw).select("event_id", sources.cursor_int("v", "k").alias("at"))


@query(f"WITH {sql_places()} SELECT id FROM places WHERE {_TILE} IN (52, 53, 0)")
def tile_scan(spark, d):
    """A slice of three tiles that wraps at the end of the sweep."""
    p = a.places(spark, d).withColumn("tile", geo.tile_of("lat", "lng", BOX, *_GRID))
    return sources.slice_of(p, "tile", 52, 3, _GRID[0] * _GRID[1]).select("id")


@query(ORACLE["tile_scan"])
def tile_folders(spark, d):
    """The same slice from rows that landed in folders by tile; only its folders are read."""
    path = f"{stores.scratch(spark)}/tiles"
    landing.land(a.places(spark, d).select("id", "lat", "lng"), path, geo.tile_of("lat", "lng", BOX, *_GRID))
    n = _GRID[0] * _GRID[1]
    return landing.landed(spark, path, "id STRING", [(52 + k) % n for k in range(3)]).select("id")


_POINTS = sources.grid_points(BOX, 75.0)[:25]


@query(
    f"WITH pts AS (SELECT unnest({[list(p) for p in _POINTS]}::DOUBLE[][]) AS p), c AS (SELECT doc_id, {sql_lat('doc_id')} AS lat, {sql_lng('doc_id')} AS lng FROM documents) SELECT DISTINCT doc_id AS pageid FROM c, pts WHERE {sql_haversine('lat', 'lng', 'p[1]', 'p[2]')} <= 10000"
)
def grid_scan(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("pageid"), a.lat("doc_id").alias("lat"), a.lng("doc_id").alias("lon"))
    return wiki.hits_near(c, _POINTS).select("pageid")


@query("SELECT p_partkey AS pageid, lower(p_type) || CASE WHEN p_size % 2 = 0 THEN '' ELSE ';' || lower(p_brand) END AS categories FROM part")
def type_labels(spark, d):
    """Labels of a page's types in claim order; the label of every second brand is unknown."""
    p = table(spark, d, "part")
    pages = p.select(F.col("p_partkey").alias("pageid"), F.col("p_name").alias("title"), F.lit("").alias("extract"), F.lit("").alias("fullurl"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("wikibase_item"))
    brand = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "?").otherwise(""))
    types = p.select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("entity_id"), F.posexplode(F.array("p_type", brand)).alias("pos", "type_id"))
    labels = p.select(F.explode(F.array("p_type", "p_brand")).alias("type_id")).distinct().withColumn("label", F.col("type_id"))
    return wiki.labelled(pages, types, labels).select("pageid", F.array_join("categories", ";").alias("categories"))


@query("SELECT c_custkey, CASE WHEN length(c_name || ' ') - 1 <= 12 THEN c_name ELSE substr(c_name, 1, 12) || '…' END AS label, substr(c_mktsegment, 1, 5) AS field FROM customer")
def form_fields(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", text.short(F.concat(F.lit(" "), "c_name", F.lit(" ")), 12).alias("label"), text.form_field(F.concat(F.lit("  "), "c_mktsegment"), 5).alias("field"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'place' WHEN 1 THEN 'event' WHEN 2 THEN 'article' ELSE 'none' END AS kind FROM events")
def kind_names(spark, d):
    said = F.element_at(F.array(*map(F.lit, (" Places", "event", "ARTICLES ", "song", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.coalesce(text.kind_of(said), F.lit("none")).alias("kind"))


@query("SELECT doc_id, CASE WHEN len(p) = 0 THEN '' ELSE " + _sql_truncate("p[1]", 500) + r""" AS lead FROM (SELECT doc_id, [trim(regexp_replace(x, '\s+', ' ', 'g')) FOR x IN string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) IF trim(x) <> ''] AS p FROM documents)""".replace(" AS lead", " END AS lead", 1))
def first_paragraphs(spark, d):
    doubled = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return table(spark, d, "documents").select("doc_id", text.first_paragraph(doubled).alias("lead"))


@query("SELECT error, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'title_short' WHEN c_custkey % 7 = 1 THEN 'description_short' WHEN c_custkey % 7 = 2 THEN 'url_scheme' WHEN c_custkey % 7 = 3 THEN 'coordinates_half' WHEN c_custkey % 7 = 4 THEN 'outside_region' WHEN c_custkey % 7 = 5 THEN 'kind_unknown' ELSE 'accepted' END AS error FROM customer) GROUP BY error")
def submission_validate(spark, d):
    k = F.col("c_custkey") % 7
    pick = lambda n, bad, good: F.when(k == n, F.lit(bad)).otherwise(good if not isinstance(good, str) else F.lit(good))
    drafts = table(spark, d, "customer").select(
        pick(0, "x", F.col("c_name")).alias("title"), pick(1, "abc", "a long description").alias("description"), pick(2, "ftp://x.example/", "https://x.example/").alias("url"), F.when(k == 3, "").when(k == 4, "10").otherwise("39.0").alias("lat"), F.lit("-105.0").alias("lng"),
        pick(5, "song", "Events").alias("target_kind"), F.lit("a,b").alias("categories"), F.lit("add").alias("request"), *(F.lit("").alias(c) for c in ("address", "city", "existing_id", "contact")),
    )
    return subs.validate(drafts, REGION, NOW).groupBy(F.coalesce("error", F.lit("accepted")).alias("error")).agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'indexed; website queued' ELSE 'no coordinates, known address or known town to place it by' END WHEN 2 THEN 'removed and withdrawn' ELSE 'website queued' END AS note, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 THEN 'approved' ELSE 'applied' END AS status FROM orders WHERE o_orderstatus = 'F'")
def submission_apply(spark, d):
    """What all approved submissions lead to."""
    s = a.submissions(spark, d).where("status = 'approved'")
    k = F.col("id").cast("long")
    batch = conform(s.withColumns({"lat": F.when(k % 3 == 0, F.lit(39.0)), "lng": F.when(k % 3 == 0, F.lit(-105.0)), "url": F.concat(F.lit("https://x.example/"), "id"), "target_kind": F.lit("place"), "existing_id": F.col("id"), "title": F.col("id"), "description": F.lit("text")}), TABLES["submissions"])
    none = spark.createDataFrame([], TABLES["geocache"])
    done = subs.apply(batch, REGION, a.gazetteer(spark, d), none, NOW)
    return done.submissions.select("id", F.col("apply_note").alias("note"), "status")


# ---------------------------------------------------------------- search


def _catalog(spark, d):
    """The public queries' tables: places, events and articles of the test data."""
    none = lambda n: spark.createDataFrame([], TABLES[n])
    tables = {"place": conform(a.places(spark, d), TABLES["places"]), "event": conform(a.events(spark, d), TABLES["events"]), "article": conform(a.articles(spark, d), TABLES["articles"])}
    return api.Catalog(spark, replace(REGION, polygon=None), tables, a.gazetteer(spark, d), none("submissions"), none("metrics"))


@query(f"WITH {sql_places()} SELECT id, kind FROM (SELECT id, 'place' AS kind FROM places WHERE cat = 'machinery' AND lower(county) = 'asia' AND {INSIDE} ORDER BY id LIMIT 50)")
def search_region(spark, d):
    return api.search_region(_catalog(spark, d), None, ["places"], county="Asia", categories=["Machinery"], limit=50).select("id", "kind")


@query(f"WITH {SQL_EVENTS} SELECT id, starts_at FROM (SELECT id, strftime(to_timestamp(start_time)::TIMESTAMP, '%Y-%m-%d %H:%M') || ' UTC' AS starts_at FROM places_e WHERE start_time >= 1705000000 AND title = 'purchase' AND {INSIDE} ORDER BY start_time, id LIMIT 30)")
def search_events(spark, d):
    return api.search_events(_catalog(spark, d), 1_705_000_000, query="purchase", limit=30).select("id", "starts_at")


@query(f"WITH {sql_places()}, {SQL_GAZETTEER}, n AS (SELECT lat, lng FROM gazetteer WHERE name = 'NATION_7') SELECT p.id, CAST(round({sql_haversine('p.lat', 'p.lng', 'n.lat', 'n.lng')}) AS BIGINT) AS distance_m FROM places p, n WHERE {sql_haversine('p.lat', 'p.lng', 'n.lat', 'n.lng')} <= 90000 ORDER BY 2, 1 LIMIT 50")
def nearby_by_name(spark, d):
    return api.find_nearby(_catalog(spark, d), near="nation 7", radius_m=90_000, limit=50).select("id", "distance_m")


@query(f"WITH {sql_places()}, {SQL_EVENTS} SELECT part, id FROM (SELECT 0 AS part, id FROM places WHERE {INSIDE} ORDER BY id LIMIT 15) UNION ALL SELECT part, id FROM (SELECT 1 AS part, id FROM places_e WHERE {INSIDE} ORDER BY id LIMIT 15)")
def browse(spark, d):
    return api.browse(_catalog(spark, d), None, ["place", "event"]).select("part", "id")


@query(f"WITH {SQL_EVENTS} SELECT id, title, start_time FROM places_e WHERE start_time BETWEEN 1704500000 AND 1705500000 AND {INSIDE} ORDER BY start_time, id LIMIT 50")
def events_window(spark, d):
    e = a.events(spark, d).where(geo.in_bbox("lat", "lng", BOX)).where(predicates.between("start_time", 1_704_500_000, 1_705_500_000))
    return search.page(e, [F.asc("start_time"), F.asc("id")], 50).select("id", "title", "start_time")


@query(f"SELECT {sql_id('customer', 'c_custkey')} AS id, c_name AS title FROM customer WHERE c_custkey = 42")
def get_document(spark, d):
    return a.places(spark, d).where(F.col("id") == ids.stable_id_of("customer", "42")).select("id", "title")


@query(f"WITH {sql_places()} SELECT id FROM places WHERE cat IN ('supplier', 'machinery') AND lower(county) IN ('asia', 'europe')")
def filter_any_of(spark, d):
    p = a.places(spark, d)
    return p.where(predicates.all_of([predicates.any_of(p, "categories", ["Machinery ", "", "supplier"]), predicates.any_of(p, "county", ["asia", "Europe"]), predicates.any_of(p, "city", [])])).select("id")


@query(
    f"SELECT {sql_id('part', 'p_partkey')} AS id, CAST((list_contains(t, 'small') OR list_contains(c, 'small'))::INT + (list_contains(t, 'ring'))::INT AS BIGINT) AS words FROM (SELECT p_partkey, {WORDS.format('p_name')} AS t, list_concat({WORDS.format('p_type')}, {WORDS.format('p_brand')}) AS c FROM part) WHERE list_contains(t, 'small') OR list_contains(t, 'ring') OR list_contains(c, 'small')"
)
def text_exact(spark, d):
    """Terms of four letters allow no edits; the last one also matches as a prefix."""
    return search.search(a.parts(spark, d), "the small ring", REGION.stop_words).where("exact > 0").select("id", F.col("exact").alias("words"))


@query(
    f"SELECT id FROM (SELECT {sql_id('part', 'p_partkey')} AS id, list_position({WORDS.format('p_name')}, 'widget') IS NOT NULL AND list_position({WORDS.format('p_name')}, 'widget') > 0 AS hit FROM part) WHERE hit"
)
def text_typo(spark, d):
    """One edit away from the only word of its length; no stop word, no synonym."""
    return search.search(a.parts(spark, d), "wiget", ()).select("id")


@query(f"SELECT id FROM (SELECT {sql_id('part', 'p_partkey')} AS id, regexp_matches(lower(p_name || ' ' || p_type || ' ' || p_brand), '(^|[^a-z0-9])(giz|red[a-z]*)') AS hit FROM part WHERE true) WHERE id IN (SELECT {sql_id('part', 'p_partkey')} FROM part WHERE regexp_matches(lower(p_name || ' ' || p_type || ' ' || p_brand), '(^|[^a-z0-9])giz') OR regexp_matches(lower(p_name || ' ' || p_type), '(^|[^a-z0-9])red([^a-z0-9]|$)'))")
def text_prefix(spark, d):
    return search.search(a.parts(spark, d), "red giz", ()).select("id")


@query(ORACLE["text_typo"])
def stored_typo(spark, d):
    """The same from a stored index, where typos meet by equality on deletions."""
    store = _stored(spark, d)
    return search.search(search.narrow(store.read("places")), "wiget", (), None, store.index(["place"])).select("id")


@query(ORACLE["text_prefix"])
def stored_prefix(spark, d):
    store = _stored(spark, d)
    return search.search(search.narrow(store.read("places")), "red giz", (), None, store.index(["place"])).select("id")


_SYN = {"ring": ["hot gear", "bolt"]}


@query(f"SELECT {sql_id('part', 'p_partkey')} AS id FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'hot gear') OR contains(p_name, 'bolt')")
def text_synonyms(spark, d):
    return search.search(a.parts(spark, d), "ring zzzz", (), _SYN).select("id")


@query(f"SELECT {sql_id('part', 'p_partkey')} AS id, row_number() OVER (ORDER BY {sql_id('part', 'p_partkey')}) AS n FROM part WHERE p_name = 'small ring' QUALIFY n <= 20")
def search_ranked(spark, d):
    """The documents with both words side by side, best first."""
    close = search.search(a.parts(spark, d), "small ring", ()).where("words = 2 and proximity = 1")
    page = search.page(close, search.rank_order(), 20)
    return page.select("id", F.row_number().over(Window.orderBy(*search.rank_order())).cast("long").alias("n"))


@query(f"SELECT {sql_id('part', 'p_partkey')} AS id, row_number() OVER (ORDER BY {sql_id('part', 'p_partkey')}) AS n FROM part WHERE p_name = 'small ring' QUALIFY n <= 20")
def stored_top(spark, d):
    """The best page from the blocks of a stored index that can reach it."""
    store = _stored(spark, d, "article")
    hits, _ = search.top(search.narrow(search.union_kinds({k: store.read(f"{k}s") for k in ("place", "article")}, ["place", "article"])), store.index(["place", "article"]), "small ring", 20, distinct=True)
    page = search.page(hits, search.rank_order(), 20).where("words = 2 and proximity = 1 and kind = 'place'")
    return page.select("id", F.row_number().over(Window.orderBy(*search.rank_order())).cast("long").alias("n"))


@query(
    "WITH g AS (SELECT n_regionkey AS k, lower(n_name) AS name FROM nation UNION SELECT n_regionkey, lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 100 + p_size, lower(p_brand) FROM part) "
    "SELECT DISTINCT a.name AS term, b.name AS synonym FROM g AS a JOIN g AS b ON a.k = b.k AND a.name <> b.name"
)
def synonym_map(spark, d):
    """Groups of names that mean the same: nations with their region, brands that come in one size."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    groups = n.groupBy("n_regionkey").agg(F.concat(F.collect_list("n_name"), F.array(F.concat(F.lit(" "), F.first("r_name")), F.lit(" "))).alias("names")).select("names")
    brands = table(spark, d, "part").groupBy("p_size").agg(F.collect_set("p_brand").alias("names")).select("names")
    return synonym_pairs(groups.union(brands)).select("term", F.explode("synonyms").alias("synonym"))


@query(f"WITH {sql_places()}, {SQL_EVENTS} SELECT kind, id FROM (SELECT 'place' AS kind, id, lat, lng FROM places UNION ALL SELECT 'event', id, lat, lng FROM places_e) WHERE {sql_haversine('lat', 'lng', DLAT, DLNG)} <= 40000 ORDER BY kind, id LIMIT 100")
def federated_union(spark, d):
    both = search.union_kinds({"place": a.places(spark, d), "event": a.events(spark, d)}, ["place", "event", "place"])
    return search.page(both.where(predicates.near(DENVER, 40_000)), [F.asc("kind"), F.asc("id")], 100).select("kind", "id")


@query(f"SELECT url, arg_min({sql_id('documents', 'doc_id')}, struct_pack(a := -doc_id, b := {sql_id('documents', 'doc_id')})) AS id FROM (SELECT doc_id, 'https://a.example/' || n_chars % 50 AS url FROM documents) GROUP BY url")
def article_distinct(spark, d):
    """Of articles with one url the newest, all else equal."""
    return search.distinct_articles(search.search(a.articles(spark, d), None)).select("url", "id")


@query(f"WITH {sql_places()} SELECT id FROM places ORDER BY updated_at DESC, id LIMIT 15 OFFSET 30")
def paging(spark, d):
    return search.page(a.places(spark, d), [F.desc("updated_at"), F.asc("id")], 15, 30).select("id")


@query(f"WITH {SQL_EVENTS} SELECT term, kind, count(*) AS n FROM (SELECT unnest({WORDS.format('title')}) AS term, 'event' AS kind FROM places_e) GROUP BY ALL UNION ALL SELECT term, kind, count(*) FROM (SELECT unnest(list_concat({WORDS.format('p_name')}, {WORDS.format('p_type')}, {WORDS.format('p_brand')})) AS term, 'place' AS kind FROM part) GROUP BY ALL")
def inverted_index(spark, d):
    docs = search.union_kinds({"event": a.events(spark, d), "place": a.parts(spark, d)}, ["event", "place"])
    return search.postings(docs).groupBy("term", "kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- crawl and moderation


def _frontier(spark, d):
    p = table(spark, d, "pages").select("url", (F.col("page_id") % 4).cast("int").alias("depth"), F.lit(None).cast("string").alias("default_city"))
    return frontier.rows(p.where("depth < 3"), 1000), p


@query("SELECT url, CAST(min(depth) AS BIGINT) AS priority, CAST(CASE WHEN min(depth) < 3 THEN 1000 ELSE 2000 END AS BIGINT) AS discovered_at FROM (SELECT url, page_id % 4 AS depth FROM pages) GROUP BY url")
def frontier_add(spark, d):
    known, every = _frontier(spark, d)
    return frontier.add(known, every, 2000).select("url", "priority", "discovered_at")


@query("SELECT url, CASE WHEN row_number() OVER (ORDER BY priority, url) <= 40 THEN 'in_progress' ELSE 'pending' END AS status FROM (SELECT url, min(page_id % 4) AS priority FROM pages WHERE page_id % 4 < 3 GROUP BY url)")
def frontier_claim(spark, d):
    return frontier.claim(_frontier(spark, d)[0], 40, 3000)[1].select("url", "status")


_STATES = "(SELECT url, min(page_id % 4) AS depth, CASE WHEN length(url) % 3 = 0 THEN 'done' WHEN length(url) % 3 = 1 THEN 'error' ELSE 'pending' END AS status FROM pages WHERE page_id % 4 < 3 GROUP BY url)"


def _finished(spark, d):
    known, every = _frontier(spark, d)
    n = F.length("url") % 3
    results = every.select("url").distinct().where(n < 2).select("url", F.when(n == 0, "done").otherwise("error").alias("new_status"))
    return frontier.finish(known, results, 4000), every


@query(f"SELECT url, status, CAST(CASE WHEN status = 'pending' THEN 1000 ELSE 4000 END AS BIGINT) AS updated_at FROM {_STATES}")
def frontier_finish(spark, d):
    return _finished(spark, d)[0].select("url", "status", "updated_at")


@query(f"SELECT count(*) FILTER (status = 'pending') AS n FROM {_STATES}")
def frontier_pending(spark, d):
    return frontier.pending(_finished(spark, d)[0])


@query(
    f"WITH s AS {_STATES}, seeds AS (SELECT DISTINCT url FROM pages WHERE length(url) % 5 = 0) SELECT url, CASE WHEN seeds.url IS NOT NULL THEN 'pending' ELSE status END AS status, CAST(depth AS INTEGER) AS depth FROM s LEFT JOIN seeds USING (url) "
    "UNION ALL SELECT url, 'pending', 0 FROM seeds WHERE url NOT IN (SELECT url FROM s)"
)
def frontier_reseed(spark, d):
    """Seeds are pending again or new; what else is finished stays so."""
    known, every = _finished(spark, d)
    return frontier.reseed(known, every.where(F.length("url") % 5 == 0).select("url", "default_city").distinct(), 5000).select("url", "status", "depth")


@query(
    "WITH s AS (SELECT url, row_number() OVER (ORDER BY min(page_id % 4), url) <= 60 AS taken FROM pages WHERE page_id % 4 < 3 GROUP BY url), r AS (SELECT url FROM s WHERE taken ORDER BY url LIMIT 25) "
    "SELECT s.url, CASE WHEN taken AND r.url IS NULL THEN 'in_progress' ELSE 'pending' END AS status FROM s LEFT JOIN r USING (url)"
)
def frontier_requeue(spark, d):
    """Of 60 claimed urls the 25 that were taken first go back."""
    return frontier.requeue_stale(frontier.claim(_frontier(spark, d)[0], 60, 3000)[1], 9000, 25).select("url", "status")


@query("SELECT url, CAST(row_number() OVER (PARTITION BY host ORDER BY priority, url) - 1 AS DOUBLE) AS start_after FROM (SELECT url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, min(page_id % 4) AS priority FROM pages WHERE page_id % 4 < 3 GROUP BY ALL)")
def host_schedule(spark, d):
    return frontier.schedule(_frontier(spark, d)[0]).select("url", "start_after")


@query("SELECT DISTINCT url FROM pages WHERE page_id % 4 < 3 AND NOT (regexp_matches(url, '^https?://[^/]+/en/') AND NOT regexp_matches(url, '^https?://[^/]+/en/1'))")
def robots_gate(spark, d):
    known = _frontier(spark, d)[0]
    rules = known.select("host").distinct().crossJoin(spark.createDataFrame([("/en/", False), ("/en/1", True)], "prefix string, allow boolean"))
    return frontier.allowed(known, rules).select("url")


@query(f"WITH {SQL_SUBMISSIONS} SELECT id, submitted_at FROM submissions WHERE status = 'approved' AND apply_note IS NULL ORDER BY submitted_at, id LIMIT 50")
def submission_queue(spark, d):
    return subs.waiting(a.submissions(spark, d)).select("id", "submitted_at")


@query(
    f"WITH {SQL_SUBMISSIONS} SELECT id, CASE o_orderkey % 6 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'pending' ELSE status END AS status, CASE WHEN o_orderkey % 6 > 2 THEN apply_note END AS apply_note, "
    f"CASE WHEN o_orderkey % 6 = 0 THEN 'said' END AS review_note, CASE WHEN o_orderkey % 6 > 2 THEN submitted_at ELSE {NOW} END AS updated_at FROM submissions"
)
def submission_transition(spark, d):
    """A review sets status and note and clears what applying said; unknown decisions change nothing."""
    s = a.submissions(spark, d)
    k = F.col("id").cast("long") % 6
    said = s.select("id", F.when(k == 0, "approve").when(k == 1, "reject").when(k == 2, "pending").otherwise("later").alias("decision"), F.when(k == 0, "said").otherwise(" ").alias("note"))
    return subs.review(s, said, NOW).select("id", "status", "apply_note", "review_note", "updated_at")


@query(f"WITH {SQL_SUBMISSIONS} SELECT id, status, request, submitted_at FROM submissions WHERE status = 'pending' AND request = 'remove' ORDER BY submitted_at DESC, id LIMIT {subs.LIST_PAGE} OFFSET 10")
def submission_list(spark, d):
    return subs.listing(a.submissions(spark, d), "pending", "remove", 10).select("id", "status", "request", "submitted_at")


@query("SELECT request, needs, count(*) AS n FROM (SELECT ['add', 'update', 'remove', 'correction'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS request, o_orderkey % 4 <> 0 AS needs FROM orders) GROUP BY ALL")
def submission_requests(spark, d):
    s = a.submissions(spark, d)
    return s.select(subs.parse(F.upper("request"), subs.REQUESTS).alias("request"), subs.needs_existing("request").alias("needs")).groupBy("request", "needs").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN {sql_lat('c_custkey', WIDE)} <= {BOX[2]} AND {sql_lng('c_custkey', WIDE)} <= {BOX[3]} AND {_polygon(sql_lat('c_custkey', WIDE), sql_lng('c_custkey', WIDE))} THEN 'hit' ELSE 'miss' END AS status FROM customer")
def geocode_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("address"))
    known = c.where("c_custkey % 3 <> 0").select(text.geocode_key("address").alias("key"), a.lat("c_custkey", WIDE).alias("lat"), a.lng("c_custkey", WIDE).alias("lng"))
    got = geocache.lookup(c, geocache.put(known, REGION, NOW), REGION)
    return got.select("c_custkey", F.when(F.col("geo_lat").isNotNull(), "hit").when(F.col("geo_known"), "miss").alias("status"))


def _facts(spark, d):
    return web.facts(table(spark, d, "pages").select("page_id", "url", "html", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("default_city")))


@query("SELECT url, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, d):
    return _facts(spark, d).select("url", "title")


@query()
def page_links(spark, d):
    """Resolved links of every page; joining relative links is not SQL. Tested against fixtures."""
    return web.next_links(_facts(spark, d))


@query()
def crawl_documents(spark, d):
    """Documents of all pages, placed by a default town. Tested against fixtures."""
    pages = _facts(spark, d).withColumn("default_city", F.lit("NATION_3"))
    none = spark.createDataFrame([], "id string, key string, status string, lat double, lng double, updated_at long")
    return web.to_docs(pages, REGION, a.gazetteer(spark, d), none, NOW).select("id", "kind", "title", "url", "geo_precision", "word_count")


@query(
    f"SELECT {sql_id('osm', "'node/' || p_partkey")} AS id, p_name AS title, lower(p_type) AS categories, CASE WHEN p_size % 2 = 0 THEN 'outdoor seating' ELSE '' END AS tags, {sql_lat('p_partkey')} AS lat, "
    "CASE WHEN p_size % 3 = 0 THEN 'Town' END AS city, 'node/' || p_partkey AS source_id, CASE WHEN p_size % 5 = 0 THEN '12' || p_size END AS phone FROM part WHERE p_partkey % 10 <> 0"
)
def osm_places(spark, d):
    """Parts as map elements: a tenth has no coordinates."""
    p = table(spark, d, "part")
    size = F.col("p_size")
    tags = F.create_map(F.lit("name"), F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("  "))), F.lit("amenity"), F.lower("p_type"), F.lit("outdoor_seating"), F.when(size % 2 == 0, "yes").otherwise("no"), F.lit("addr:city"), F.when(size % 3 == 0, " Town ").otherwise(" "), F.lit("contact:phone"), F.when(size % 5 == 0, F.concat(F.lit("12"), size.cast("string"))))
    e = p.select(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 != 0, a.lat("p_partkey")).alias("lat"), a.lng("p_partkey").alias("lon"), F.lit(None).cast("struct<lat: double, lon: double>").alias("center"), tags.alias("tags"))
    out = osm.to_places(e, NOW)
    return out.select("id", "title", F.array_join("categories", ";").alias("categories"), F.array_join("tags", ";").alias("tags"), "lat", "city", "source_id", "phone")


@query(
    rf"SELECT {sql_id('wikipedia', 'doc_id')} AS id, 'article' AS kind, CAST(doc_id AS VARCHAR) AS source_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words, 'https://en.wikipedia.org/?curid=' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'museum' ELSE 'song' END AS categories FROM documents "
    rf"UNION ALL SELECT {sql_id('wikipedia', "'place:' || doc_id")}, 'place', 'place:' || doc_id, 0, 'https://en.wikipedia.org/?curid=' || doc_id, 'museum' FROM documents WHERE doc_id % 3 = 0"
)
def wiki_documents(spark, d):
    """Documents as encyclopedia pages; every third is a museum."""
    doc = table(spark, d, "documents")
    hits = doc.select(F.col("doc_id").alias("pageid"), a.lat("doc_id").alias("lat"), a.lng("doc_id").alias("lon"))
    pages = doc.select(F.col("doc_id").alias("pageid"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("extract"), F.lit(None).cast("string").alias("fullurl"), F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("wikibase_item"))
    types = doc.select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("entity_id"), F.lit(0).alias("pos"), F.when(F.col("doc_id") % 3 == 0, "T1").otherwise("T2").alias("type_id"))
    labels = spark.createDataFrame([("T1", "Museum"), ("T2", "song")], wiki.LABELS)
    out = wiki.to_docs(hits, pages, types, labels, NOW)
    return out.select("id", "kind", "source_id", F.coalesce("word_count", F.lit(0)).cast("long").alias("words"), "url", F.array_join("categories", ";").alias("categories"))


@query()
def rate_limit(spark, d):
    """Requests of users against a budget. Each answer depends on earlier ones; tested against a loop."""
    e = table(spark, d, "events")
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6
    return ratelimit.limit(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("id"), at.alias("at")), 2, 6 * 3600)
