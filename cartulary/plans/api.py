"""The public queries over one catalog of tables.

Each begins with the region filter, pushes kinds, facets, times and bounding boxes to the scans, and ends
in one TakeOrderedAndProject. Only answers of at most a page reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import aggregates, predicates, search
from ..operators import gazetteer as gaz
from ..operators import submissions as subs
from ..region import Region
from . import arguments as args

NEARBY_RADIUS_M, POINT_RADIUS_M, PLACE_RADIUS_M, BROWSE_ROWS = 5_000, 10_000, 5_000, 15


@dataclass(frozen=True)
class Anchor:
    lat: float
    lng: float
    radius_m: float
    label: str
    via: str


@dataclass
class Catalog:
    """The tables that queries read. index: the stored index of some kinds, if there is one; near: a kind's documents from the parts that meet some boxes."""

    spark: SparkSession
    region: Region
    tables: dict[str, DataFrame]
    gazetteer: DataFrame
    submissions: DataFrame | None = None
    metrics: DataFrame | None = None
    index: Callable[[list[str]], search.Index] | None = None
    near: Callable[[str, list], DataFrame] | None = None
    lookup: Callable[[str, str], DataFrame] | None = None

    @staticmethod
    def of(store, region: Region) -> Catalog:
        spark = store.spark
        return Catalog(spark, region, {k: store.read(f"{k}s") for k in ("place", "event", "article")}, region.gazetteer(spark), store.read("submissions"), store.read("metrics"), store.index, lambda k, boxes: store.read(f"{k}s", boxes), lambda k, i: store.lookup(f"{k}s", spark.createDataFrame([(i,)], "id string")))

    def docs(self, kinds: list[str], circle: tuple | None = None) -> DataFrame:
        """Documents inside the region. circle (at, metres): from the parts that meet it."""
        tables = self.tables
        if circle and self.near:
            tables = {k: self.near(k, geo.circle_boxes(*circle)) for k in kinds}
        return predicates.base(search.union_kinds(tables, kinds), self.region)

    def found(self, kinds: list[str], query: str | None, where: Column, circle: tuple | None = None) -> DataFrame:
        """Ranked rows, without texts, of the documents of these kinds that satisfy where and match the query."""
        docs = self.docs(kinds, circle).where(where)
        index = None
        if self.index and kinds:
            index = self.index(kinds)
        elif self.terms(query):
            index = search.postings(docs)
        hits = search.search(search.narrow(docs), query, self.region.stop_words, self.region.synonym_map(), index)
        return search.distinct_articles(hits) if "article" in kinds else hits

    def best(self, kinds: list[str], query: str | None, where: Column, rows: int, circle: tuple | None = None) -> DataFrame:
        """The same, but no more than is needed for so many rows by rank: a stored index reads only the blocks that can reach them."""
        if not (self.index and kinds and self.terms(query)):
            return self.found(kinds, query, where, circle)
        docs = search.narrow(self.docs(kinds, circle).where(where))
        return search.top(docs, self.index(kinds), query, rows, self.region.stop_words, self.region.synonym_map(), "article" in kinds)[0]

    def page(self, kinds: list[str], hits: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
        """A page of ranked rows as whole documents: texts are read for its rows only."""
        return search.fill(self.docs(kinds), search.page(hits, order, limit, offset), order, limit)

    def terms(self, query: str | None) -> list[str]:
        return search.query_terms(query or "", list(self.region.stop_words))


# ---------------------------------------------------------------- anchors


def resolve(c: Catalog, name: str) -> Anchor:
    """A gazetteer entry, else the best place of that name, else an error that names the closest entries."""
    one = c.spark.createDataFrame([("q", name)], "id string, name string")
    hit = gaz.resolve(one, c.gazetteer).first()
    if hit:
        return Anchor(hit.lat, hit.lng, float(hit.default_radius_m), hit.city, "gazetteer")
    place = c.page(["place"], c.best(["place"], name, F.lit(True), 1), search.rank_order(), 1).select("title", "lat", "lng").first() if c.terms(name) else None
    if place:
        return Anchor(place.lat, place.lng, float(PLACE_RADIUS_M), place.title, "place")
    close = [r.name for r in gaz.suggest(c.gazetteer, name).collect()]
    raise args.ArgumentError(f"{name!r} is not known in {c.region.name}; closest names: {', '.join(close)}")


def resolve_any(c: Catalog, near: str | None = None, lat: float | None = None, lng: float | None = None) -> Anchor | None:
    """Coordinates win over a name."""
    if (lat is None) != (lng is None):
        raise args.ArgumentError("lat and lng belong together")
    if lat is not None:
        if not (-90 <= lat <= 90 and -180 <= lng <= 180):
            raise args.ArgumentError(f"({lat}, {lng}) is no coordinate")
        if not c.region.contains(lat, lng):
            raise args.ArgumentError(f"({lat}, {lng}) lies outside {c.region.name}")
        return Anchor(lat, lng, float(POINT_RADIUS_M), f"{lat:.4f}, {lng:.4f}", "coordinates")
    return resolve(c, near) if near and near.strip() else None


def label_city(c: Catalog, hits: DataFrame) -> DataFrame:
    """City of the nearest gazetteer row where a hit has none; a blank one stays."""
    out = gaz.nearest(hits, c.gazetteer)
    return out.withColumn("city", F.coalesce("city", "near.name")).drop("near")


def _answer(c: Catalog, page: DataFrame, query: str | None) -> DataFrame:
    return search.shape(label_city(c, page), c.terms(query))


# ---------------------------------------------------------------- queries


def search_region(c: Catalog, query=None, kinds=None, near=None, radius_m=None, city=None, county=None, categories=None, limit=None, offset=0) -> DataFrame:
    """Ranked page over all kinds. near beats city; a city that does not resolve is compared as text."""
    which = args.kinds(kinds, ("place", "event", "article"))
    docs = c.docs(which)
    parts, circle = [], None
    if near and near.strip():
        at = resolve(c, near)
        circle = (at.lat, at.lng), radius_m or at.radius_m
    elif city and city.strip():
        try:
            at = resolve(c, city)
            circle = (at.lat, at.lng), radius_m or at.radius_m
        except args.ArgumentError:
            parts.append(predicates.equals("city", city))
    if circle:
        parts.append(predicates.near(*circle))
    if county and county.strip():
        parts.append(predicates.equals("county", county))
    parts.append(predicates.any_of(docs, "categories", categories))
    n, skip = args.limit(limit), max(0, offset)
    page = c.page(which, c.best(which, query, predicates.all_of(parts), n + skip, circle), search.rank_order(), n, skip)
    return _answer(c, page, query)


def find_nearby(c: Catalog, near=None, lat=None, lng=None, query=None, radius_m=None, kinds=None, categories=None, limit=None, offset=0) -> DataFrame:
    """Everything in the circle, closest first."""
    which = args.kinds(kinds, ("place",))
    at = resolve_any(c, near, lat, lng)
    if at is None:
        raise args.ArgumentError("a place name or coordinates are needed")
    circle = (at.lat, at.lng), radius_m or NEARBY_RADIUS_M
    where = predicates.all_of([predicates.near(*circle), predicates.any_of(c.docs(which), "categories", categories)])
    hits = search.by_distance(c.found(which, query, where, circle), (at.lat, at.lng), None)
    page = c.page(which, hits, [F.asc_nulls_last("distance_m"), F.asc("id")], args.limit(limit), max(0, offset))
    return _answer(c, page, query)


def search_events(c: Catalog, now: int, query=None, near=None, city=None, radius_m=None, starts_after=None, starts_before=None, limit=None, offset=0) -> DataFrame:
    """Events in the window, soonest first."""
    low, high = args.time(starts_after), args.time(starts_before)
    low = now if low is None else low
    if high is not None and high < low:
        raise args.ArgumentError("the window ends before it starts")
    parts = [predicates.between("start_time", low, high)]
    name, circle = near if near and near.strip() else city, None
    if name and name.strip():
        at = resolve(c, name)
        circle = (at.lat, at.lng), radius_m or at.radius_m
        parts.append(predicates.near(*circle))
    page = c.page(["event"], c.found(["event"], query, predicates.all_of(parts), circle), [F.asc("start_time"), F.asc("id")], args.limit(limit), max(0, offset))
    return _answer(c, page, query)


def get_document(c: Catalog, id: str, kind: str) -> DataFrame:
    which = args.kinds([kind], ())
    if c.lookup:
        return predicates.base(c.lookup(which[0], id), c.region)
    return predicates.base(c.tables[which[0]], c.region).where(F.col("id") == id)


def list_locales(c: Catalog, county: str | None = None) -> DataFrame:
    if county is None or not county.strip():
        return gaz.locales(c.gazetteer)
    rows = gaz.locales(gaz.in_county(c.gazetteer, county))
    if rows.isEmpty():
        known = [r.county for r in gaz.counties(c.gazetteer).collect()]
        raise args.ArgumentError(f"no county {county!r}; known: {', '.join(known)}")
    return rows


def describe_region(c: Catalog) -> dict:
    """Bounds, counts, freshness, most frequent categories and names: aggregates only reach the driver."""
    docs = c.docs(["place", "event", "article"])
    r = c.region
    return {
        "name": r.name, "bbox": r.bbox, "center": r.center, "counts": {k: 0 for k in c.tables} | {x.kind: x.n for x in aggregates.counts(docs).collect()},
        "freshness": {x.kind: x.updated_at for x in aggregates.freshness(docs).collect()},
        "categories": [(x.value, x.n) for x in aggregates.top(docs.select(F.explode("categories").alias("value")).groupBy("value").agg(F.count("*").alias("n")), 40).collect()],
        "counties": [x.county for x in gaz.counties(c.gazetteer).collect()], "locales": [x.name for x in gaz.locales(c.gazetteer).collect()],
    }


def overview(c: Catalog) -> dict:
    """What an operator sees first: counts, freshness, the queue, categories and source health."""
    d = describe_region(c)
    health = aggregates.rejected(aggregates.source_metrics(c.metrics)).orderBy("source").collect() if c.metrics is not None else []
    queue = aggregates.histogram(c.submissions, "status", subs.STATUSES).collect() if c.submissions is not None else []
    return {"counts": d["counts"], "freshness": d["freshness"], "categories": d["categories"][:20], "queue": {x.value: x.n for x in queue}, "sources": [x.asDict() for x in health]}


def browse(c: Catalog, query=None, kinds=None) -> DataFrame:
    """Up to a few rows of each kind, kinds in order."""
    out = None
    for i, k in enumerate(args.kinds(kinds, ("place", "event", "article"))):
        part = c.page([k], c.best([k], query, F.lit(True), BROWSE_ROWS), search.rank_order(), BROWSE_ROWS)
        part = part.select(F.lit(i).alias("part"), "id", "kind", "title", "city", "source", "url", "updated_at")
        out = part if out is None else out.union(part)
    return out


def total(c: Catalog, kinds=None, query=None) -> int:
    return c.found(args.kinds(kinds, ("place", "event", "article")), query, F.lit(True)).count()


def submission_status(c: Catalog, reference: str) -> DataFrame:
    """Without the contact, which is never shown."""
    return c.submissions.where(F.col("id") == reference).select("id", "status", "request", "title", text.fmt_ts("submitted_at").alias("submitted"), "review_note", "apply_note")
