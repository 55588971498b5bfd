"""The configured region: bounds, gazetteer and vocabulary, from one TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .schema import struct

# fixed values: words and phrases that a region's vocabulary replaces as a whole
STOP_WORDS = ["a", "an", "and", "at", "for", "in", "is", "it", "near", "of", "on", "or", "the", "to", "with", "where"]
SYNONYMS = [
    ["vineyard", "winery", "wine tasting", "tasting room"],
    ["restaurant", "eatery", "dining", "diner"],
    ["bar", "pub", "tavern"],
    ["brewery", "taproom", "brewpub", "beer garden"],
    ["cafe", "coffee shop", "coffeehouse", "espresso"],
    ["trail", "trailhead", "hiking"],
    ["hotel", "lodging", "motel", "inn"],
    ["museum", "gallery"],
    ["campground", "camping", "campsite"],
    ["hot springs", "hot spring", "thermal springs"],
    ["ski area", "ski resort", "ski hill"],
]


class RegionError(ValueError):
    """A region file that cannot be used."""


@dataclass(frozen=True)
class City:
    name: str
    lat: float
    lng: float
    aliases: tuple[str, ...] = ()
    county: str | None = None
    default_radius_m: int = 12_000


@dataclass(frozen=True)
class Region:
    name: str
    slug: str
    bbox: tuple[float, float, float, float]  # min_lat, min_lng, max_lat, max_lng
    cities: tuple[City, ...] = ()
    polygon: tuple[tuple[float, float], ...] | None = None
    centroid: tuple[float, float] | None = None
    admin_level: str | None = None
    timezone: str | None = None
    stop_words: tuple[str, ...] = tuple(STOP_WORDS)
    synonyms: tuple[tuple[str, ...], ...] = field(default_factory=lambda: tuple(map(tuple, SYNONYMS)))

    @staticmethod
    def parse(text: str) -> Region:
        try:
            raw = tomllib.loads(text)
            box = raw["bbox"]
            words = raw.get("vocabulary") or {}
            region = Region(
                name=raw["name"],
                slug=raw["slug"],
                bbox=tuple(float(box[k]) for k in ("min_lat", "min_lng", "max_lat", "max_lng")),
                cities=tuple(City(c["name"], float(c["lat"]), float(c["lng"]), tuple(c.get("aliases", ())), c.get("county"), int(c.get("default_radius_m", 12_000))) for c in raw.get("cities", ())),
                polygon=tuple((float(a), float(b)) for a, b in raw["polygon"]) if raw.get("polygon") else None,
                centroid=(float(raw["centroid"]["lat"]), float(raw["centroid"]["lng"])) if raw.get("centroid") else None,
                admin_level=raw.get("admin_level"),
                timezone=raw.get("timezone"),
                stop_words=tuple(words.get("stop_words", STOP_WORDS)),
                synonyms=tuple(map(tuple, words.get("synonyms", SYNONYMS))),
            )
        except (KeyError, TypeError, ValueError, tomllib.TOMLDecodeError) as e:
            raise RegionError(f"not a region file: {e!r}") from e
        region.check()
        return region

    @staticmethod
    def load(path: str | Path) -> Region:
        return Region.parse(Path(path).read_text(encoding="utf-8"))

    def check(self) -> None:
        if not (self.bbox[0] < self.bbox[2] and self.bbox[1] < self.bbox[3]):
            raise RegionError("bbox is inverted or empty")
        if self.polygon is not None and len(self.polygon) < 3:
            raise RegionError("a polygon needs three vertices")
        for c in self.cities:  # against the box, not the polygon
            if not self.in_box(c.lat, c.lng):
                raise RegionError(f"{c.name} lies outside the bbox")

    def in_box(self, lat: float, lng: float) -> bool:
        return self.bbox[0] <= lat <= self.bbox[2] and self.bbox[1] <= lng <= self.bbox[3]

    def contains(self, lat: float, lng: float) -> bool:
        return self.in_box(lat, lng) and (self.polygon is None or geo.point_in_polygon(lat, lng, self.polygon))

    def inside(self, lat="lat", lng="lng") -> Column:
        """The same as a column; null coordinates are outside."""
        ok = geo.in_bbox(lat, lng, self.bbox)
        if self.polygon is not None:
            ok = ok & geo.in_polygon(lat, lng, self.polygon)
        return F.coalesce(ok, F.lit(False))

    @property
    def center(self) -> tuple[float, float]:
        return self.centroid or ((self.bbox[0] + self.bbox[2]) / 2, (self.bbox[1] + self.bbox[3]) / 2)

    def grid(self, km: float = 75.0) -> tuple[int, int]:
        return geo.grid_for(self.bbox, km)

    def tiles(self, km: float = 75.0):
        return geo.tiles(self.bbox, *self.grid(km))

    def gazetteer(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c.name, list(c.aliases), c.lat, c.lng, c.county, c.default_radius_m) for i, c in enumerate(self.cities)]
        return spark.createDataFrame(rows, struct("gazetteer"))

    def synonym_map(self) -> dict[str, list[str]]:
        """Each entry's other names: lower-cased, sorted, without repeats."""
        out: dict[str, set[str]] = {}
        for group in self.synonyms:
            names = {s.strip().lower() for s in group if s.strip()}
            for name in names:
                out.setdefault(name, set()).update(names - {name})
        return {k: sorted(v) for k, v in sorted(out.items()) if v}


def synonym_pairs(groups: DataFrame) -> DataFrame:
    """(term, synonyms) of groups (names: array): each entry's other names over all its groups, lower-cased, sorted, without repeats; blanks are no names."""
    names = F.array_distinct(F.filter(F.transform("names", lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    each = groups.select(names.alias("names")).select(F.explode("names").alias("term"), "names")
    other = each.select("term", F.explode("names").alias("other")).where("term <> other")
    return other.groupBy("term").agg(F.array_sort(F.collect_set("other")).alias("synonyms"))
