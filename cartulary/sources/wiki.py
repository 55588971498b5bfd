"""Geotagged encyclopedia pages: always an article, and a place too if its type is a destination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, ids, text
from ..region import Region
from ..schema import DOCUMENT, conform
from . import landing
from .base import Batch, advance, cursor_int_of, grid_points

HITS = "pageid BIGINT, lat DOUBLE, lon DOUBLE"
PAGES = "pageid BIGINT, title STRING, extract STRING, fullurl STRING, wikibase_item STRING"
TYPES = "entity_id STRING, pos INT, type_id STRING"
LABELS = "type_id STRING, label STRING"
GRID_KM, POINTS_A_RUN, RADIUS_M = 14.0, 25, 10_000.0

# fixed values: type labels of destinations
PLACE_LABELS = [
    "museum", "art museum", "history museum", "national park", "state park", "park", "national monument", "national forest",
    "wilderness area", "protected area", "mountain", "mountain pass", "mountain range", "hill", "summit", "canyon", "valley",
    "lake", "reservoir", "river", "waterfall", "hot spring", "spring", "cave", "glacier", "ski resort", "ski area", "winery",
    "vineyard", "brewery", "distillery", "restaurant", "hotel", "resort", "campground", "golf course", "botanical garden", "zoo",
    "amusement park", "water park", "historic district", "historic house", "monument", "memorial", "bridge", "tunnel", "dam",
    "lighthouse", "observatory", "mine", "ghost town", "city", "town", "village", "unincorporated community",
    "census-designated place", "neighborhood", "theater", "concert hall", "opera house", "stadium", "arena", "library",
    "university", "college", "airport", "railway station", "church building", "cathedral", "trail", "hiking trail", "beach",
    "island",
]


def claims(entities: DataFrame, prop: str = "P31") -> DataFrame:
    """(entity_id, pos, type_id) from entities (entity_id, claims as JSON text); claims without a value are skipped."""
    parsed = entities.withColumn("_v", F.try_variant_get(F.try_parse_json("claims"), f"$.{prop}", "array<variant>"))
    each = parsed.select("entity_id", F.posexplode("_v").alias("pos", "_c"))
    return each.select("entity_id", "pos", F.try_variant_get("_c", "$.mainsnak.datavalue.value.id", "string").alias("type_id")).where("type_id is not null")


def first_hits(hits: DataFrame, seq: str = "_seq") -> DataFrame:
    """Of a page's hits the first to arrive."""
    w = Window.partitionBy("pageid").orderBy(seq)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def hits_near(coordinates: DataFrame, points: list[tuple[float, float]], metres: float = RADIUS_M) -> DataFrame:
    """Landed coordinates within reach of any of these grid points, each page once, in point order."""
    spark = coordinates.sparkSession
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "_seq int, p_lat double, p_lng double")
    top = max((abs(a) for a, _ in points), default=0.0) + 1.0
    near = geo.radius_join(coordinates, p, metres, top, ("lat", "lon"), ("p_lat", "p_lng"))
    return first_hits(near).select("pageid", "lat", "lon")


def labelled(pages: DataFrame, types: DataFrame, labels: DataFrame) -> DataFrame:
    """pages with categories: the labels of their item's types, in claim order, unknown types skipped."""
    named = types.join(labels.select("type_id", F.lower("label").alias("label")), "type_id")
    listed = named.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]).alias("categories"))
    out = pages.join(listed, pages["wikibase_item"] == listed["entity_id"], "left").drop("entity_id")
    return out.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def to_docs(hits: DataFrame, pages: DataFrame, types: DataFrame, labels: DataFrame, now: int) -> DataFrame:
    """Documents of hits whose page landed; pages without coordinates are no documents."""
    p = labelled(pages.join(hits.select("pageid", "lat", F.col("lon").alias("lng")), "pageid"), types, labels)
    p = p.where(geo.is_valid("lat", "lng"))
    body = F.coalesce("extract", F.lit(""))
    key = F.col("pageid").cast("string")
    base = p.withColumns(
        {
            "summary": text.first_paragraph(body), "body": body, "url": F.coalesce("fullurl", text.wiki_page_url("fullurl", "pageid")), "source": F.lit("wikipedia"), "tags": F.array().cast("array<string>"),
            "geo_precision": F.lit("exact"), "updated_at": F.lit(now).cast("long"),
        }
    )
    article = base.withColumns({"kind": F.lit("article"), "source_id": key, "site_name": F.lit("Wikipedia"), "lang": F.lit("en"), "word_count": text.word_count("body")})
    is_place = F.arrays_overlap("categories", F.array(*map(F.lit, PLACE_LABELS)))
    place = base.where(is_place).withColumns({"kind": F.lit("place"), "source_id": F.concat(F.lit("place:"), key), "website": F.col("url"), "wikidata_id": F.col("wikibase_item")})
    both = article.unionByName(place, allowMissingColumns=True)
    return conform(both.withColumn("id", ids.stable_id("wikipedia", "source_id")), DOCUMENT)


class Wikipedia:
    """A slice of grid points a run over landed tables: coordinates, pages, types and labels.

    tiled: coordinates lie in folders by tile (``land``), of which a run reads those that its points reach.
    """

    name, interval_s = "wikipedia", 15 * 60

    def __init__(self, root: str, points: int = POINTS_A_RUN, grid_km: float = GRID_KM, tiled: bool = False):
        self.root, self.points, self.grid_km, self.tiled = root.rstrip("/"), points, grid_km, tiled

    def land(self, coordinates: DataFrame, region: Region) -> None:
        """Put fetched coordinates into the folders of their tiles."""
        tile = geo.tile_of("lat", "lon", region.bbox, *region.grid(self.grid_km))
        landing.land(coordinates, f"{self.root}/coordinates", tile)

    def fetch(self, context, cursor) -> Batch:
        region: Region = context.region
        every = grid_points(region.bbox, self.grid_km)
        start, after, swept = advance(cursor_int_of(cursor, "point"), self.points, len(every))
        mine = [every[(start + k) % len(every)] for k in range(min(self.points, len(every)))]
        load = lambda name, ddl: context.spark.read.schema(ddl).json(f"{self.root}/{name}")
        if self.tiled:
            reach = [b for p in mine for b in geo.circle_boxes(p, RADIUS_M)]
            tiles = landing.tiles_meeting(reach, region.bbox, *region.grid(self.grid_km))
            known = landing.landed(context.spark, f"{self.root}/coordinates", HITS, tiles).drop("tile")
        else:
            known = load("coordinates", HITS)
        hits = hits_near(known, mine)
        return Batch(to_docs(hits, load("pages", PAGES), load("types", TYPES), load("labels", LABELS), context.now), {"point": after}, swept)
