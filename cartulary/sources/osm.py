"""Map elements to places, as one native select over the tag map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, ids, text
from ..region import Region
from ..schema import DOCUMENT, conform
from . import landing
from .base import Batch, advance, cursor_int_of

SCHEMA = "type STRING, id BIGINT, lat DOUBLE, lon DOUBLE, center STRUCT<lat: DOUBLE, lon: DOUBLE>, tags MAP<STRING, STRING>"
TILE_KM, TILE_MOST = 75.0, 3000

# fixed values: tag keys and the values of them that are worth indexing
WANTED = {
    "amenity": "restaurant cafe bar pub fast_food biergarten ice_cream food_court marketplace theatre cinema arts_centre library museum community_centre casino nightclub public_bath spa",
    "craft": "winery brewery distillery caterer",
    "shop": "wine alcohol bakery butcher cheese chocolate coffee deli farm greengrocer pastry seafood books outdoor sports bicycle art antiques gift",
    "tourism": "attraction museum gallery artwork viewpoint zoo theme_park aquarium hotel motel guest_house hostel chalet camp_site caravan_site picnic_site wine_cellar information",
    "leisure": "park nature_reserve garden water_park golf_course sports_centre swimming_pool ice_rink stadium marina fishing dog_park",
    "natural": "peak hot_spring spring waterfall cave_entrance glacier arch",
    "historic": "monument memorial ruins archaeological_site castle fort mine ghost_town",
    "man_made": "lighthouse observatory mineshaft",
}
# fixed values: tag keys that give categories, in order
CATEGORY_KEYS = "amenity craft shop tourism leisure natural historic man_made sport".split()
# fixed values: yes-or-no tags that become facets
FLAG_KEYS = "outdoor_seating takeaway delivery wheelchair dog internet_access drive_through reservation".split()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def wanted() -> Column:
    """Named elements of a wanted kind."""
    kinds = [F.coalesce(tag(k).isin(v.split()), F.lit(False)) for k, v in WANTED.items()]
    return tag("name").isNotNull() & reduce(lambda a, b: a | b, kinds)


def tile_query(box: tuple[float, float, float, float]) -> str:
    """The request that a fetcher would send for a tile: south, west, north, east."""
    area = ",".join(f"{x:.6f}" for x in box)
    parts = [f'{e}["{k}"~"^({v.replace(" ", "|")})$"]["name"]({area});' for k, v in WANTED.items() for e in ("node", "way")]
    return f"[out:json][timeout:120];({''.join(parts)});out center tags {TILE_MOST};"


def categories() -> Column:
    lists = [text.split_semis(tag(k)) for k in [*CATEGORY_KEYS, "cuisine"]]
    brewery = F.when(tag("microbrewery") == "yes", F.array(F.lit("brewery"))).otherwise(F.array().cast("array<string>"))
    return F.concat(*lists, brewery)


def flags() -> Column:
    each = F.array(*(F.when(tag(k).isin("yes", "designated"), F.lit(k.replace("_", " "))) for k in FLAG_KEYS))
    return F.array_compact(each)


def street_address() -> Column:
    return F.when(tag("addr:street").isNotNull(), F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street")))


def to_places(elements: DataFrame, now: int) -> DataFrame:
    """Documents of elements with a name and a valid point; a way is at its centre."""
    e = elements.withColumns({"_lat": F.coalesce("lat", "center.lat"), "_lng": F.coalesce("lon", "center.lon"), "_name": text.collapse_ws(tag("name"))})
    e = e.where((F.col("_name") != "") & geo.is_valid("_lat", "_lng"))
    city = F.nullif(F.trim(F.coalesce(tag("addr:city"), tag("addr:town"))), F.lit(""))
    source_id = F.concat_ws("/", "type", F.col("id").cast("string"))
    told = text.blank_to_null(F.coalesce(tag("description"), F.lit("")))
    either = lambda k: F.coalesce(tag(k), tag(f"contact:{k}"))
    cats = categories()
    site = either("website")
    out = e.select(
        ids.stable_id("osm", source_id).alias("id"), F.lit("place").alias("kind"), F.col("_name").alias("title"), F.coalesce(told, text.describe(F.col("_name"), cats, city)).alias("summary"), F.lit("").alias("body"),
        F.coalesce(site, F.concat(F.lit("https://www.openstreetmap.org/"), source_id)).alias("url"), F.lit("osm").alias("source"), source_id.alias("source_id"), cats.alias("categories"), flags().alias("tags"), F.col("_lat").alias("lat"), F.col("_lng").alias("lng"),
        city.alias("city"), street_address().alias("address"), F.lit("exact").alias("geo_precision"), F.lit(now).cast("long").alias("updated_at"), either("phone").alias("phone"), site.alias("website"), tag("opening_hours").alias("opening_hours"),
        text.split_semis(tag("cuisine")).alias("cuisine"), tag("price_level").alias("price_level"), F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), tag("wikidata").alias("wikidata_id"),
    )
    return conform(out, DOCUMENT)


class Overpass:
    """One tile a run over landed elements; a sweep ends when the last tile is read.

    tiled: path holds folders by tile (``land``), of which a run reads one; else files of JSON lines, all of which it reads.
    """

    name, interval_s = "overpass", 20 * 60

    def __init__(self, path: str, tile_km: float = TILE_KM, tiled: bool = False):
        self.path, self.tile_km, self.tiled = path, tile_km, tiled

    def _tile(self, region: Region) -> Column:
        return geo.tile_of(F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon"), region.bbox, *region.grid(self.tile_km))

    def land(self, elements: DataFrame, region: Region) -> None:
        """Put fetched elements into the folders of their tiles."""
        landing.land(elements, self.path, self._tile(region))

    def fetch(self, context, cursor) -> Batch:
        region: Region = context.region
        cols, rows = region.grid(self.tile_km)
        start, after, swept = advance(cursor_int_of(cursor, "tile"), 1, cols * rows)
        if self.tiled:
            found = landing.landed(context.spark, self.path, SCHEMA, [start]).drop("tile")
        else:
            found = read(context.spark, self.path).where(self._tile(region) == start)
        mine = found.where(wanted()).orderBy("type", "id").limit(TILE_MOST)
        return Batch(to_places(mine, context.now), {"tile": after}, swept)
