"""Geometry as native column expressions: degrees in, metres out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
KM_PER_DEGREE = 111.0
JOIN_TASKS = 64  # of a join by distance


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lng1, lat2, lng2) -> Column:
    a1, g1, a2, g2 = (F.radians(_c(x)) for x in (lat1, lng1, lat2, lng2))
    s, t = F.sin((a2 - a1) / 2), F.sin((g2 - g1) / 2)
    a = s * s + F.cos(a1) * F.cos(a2) * t * t
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def haversine_m(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """The same on the driver."""
    a1, g1, a2, g2 = map(math.radians, (lat1, lng1, lat2, lng2))
    a = math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin((g2 - g1) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(a))


def is_valid(lat, lng) -> Column:
    """Finite and in range; null coordinates are not valid."""
    lat, lng = _c(lat), _c(lng)
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def in_bbox(lat, lng, box: Sequence[float]) -> Column:
    """Edges count; box: min_lat, min_lng, max_lat, max_lng."""
    return _c(lat).between(float(box[0]), float(box[2])) & _c(lng).between(float(box[1]), float(box[3]))


def in_polygon(lat, lng, ring: Sequence[Sequence[float]]) -> Column:
    """Ray casting over (lat, lng) vertices; the ring closes itself."""
    lat, lng = _c(lat), _c(lng)
    crossings = F.lit(0)
    for (ya, xa), (yb, xb) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if ya != yb:  # a level edge is never crossed
            edge = F.lit((xb - xa)) * (lat - ya) / (yb - ya) + xa
            crossings = crossings + F.when(((F.lit(ya) > lat) != (F.lit(yb) > lat)) & (lng < edge), 1).otherwise(0)
    return crossings % 2 == 1


def point_in_polygon(lat: float, lng: float, ring: Sequence[Sequence[float]]) -> bool:
    inside, (yb, xb) = False, ring[-1]
    for ya, xa in ring:
        if (ya > lat) != (yb > lat) and lng < (xb - xa) * (lat - ya) / (yb - ya) + xa:
            inside = not inside
        yb, xb = ya, xa
    return inside


def tile_of(lat, lng, box: Sequence[float], cols: int, rows: int) -> Column:
    """The one tile a point is dealt to, row by row: half-open tiles, outer edges clamped."""
    r = F.floor((_c(lat) - box[0]) / ((box[2] - box[0]) / rows))
    c = F.floor((_c(lng) - box[1]) / ((box[3] - box[1]) / cols))
    clamp = lambda x, n: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), x))
    return clamp(r, rows) * cols + clamp(c, cols)


def tiles(box: Sequence[float], cols: int, rows: int) -> list[tuple[float, float, float, float]]:
    """All tiles, row by row; at least one by one."""
    cols, rows = max(1, cols), max(1, rows)
    dy, dx = (box[2] - box[0]) / rows, (box[3] - box[1]) / cols
    return [(box[0] + r * dy, box[1] + c * dx, box[0] + (r + 1) * dy, box[1] + (c + 1) * dx) for r in range(rows) for c in range(cols)]


def span_km(box: Sequence[float]) -> tuple[float, float]:
    """(width, height) in km, width at the middle latitude."""
    mid = math.radians((box[0] + box[2]) / 2)
    return (box[3] - box[1]) * KM_PER_DEGREE * math.cos(mid), (box[2] - box[0]) * KM_PER_DEGREE


def grid_for(box: Sequence[float], km: float, fallback: float = 75.0) -> tuple[int, int]:
    """(columns, rows) of tiles of about this size."""
    if not (math.isfinite(km) and km > 0):
        km = fallback
    width, height = span_km(box)
    return max(1, math.ceil(width / km)), max(1, math.ceil(height / km))


def radius_box(lat: float, lng: float, metres: float) -> tuple[float, float, float, float]:
    """A box that holds the circle, for pruning before the exact distance."""
    dlat = math.degrees(metres / EARTH_M) * 1.001
    edge = min(89.9, abs(lat) + dlat)
    dlng = min(360.0, dlat / max(1e-9, math.cos(math.radians(edge))))
    return lat - dlat, lng - dlng, lat + dlat, lng + dlng


def circle_boxes(at: tuple[float, float], metres: float) -> list[tuple[float, float, float, float]]:
    """One or two boxes that hold a circle; one that crosses the 180th meridian has a box on either side of it."""
    south, west, north, east = radius_box(*at, metres)
    if east - west >= 360:
        return [(south, -180.0, north, 180.0)]
    if west < -180:
        return [(south, -180.0, north, east), (south, west + 360, north, 180.0)]
    if east > 180:
        return [(south, west, north, 180.0), (south, -180.0, north, east - 360)]
    return [(south, west, north, east)]


def within_radius(lat, lng, at: tuple[float, float], metres: float) -> Column:
    """In the circle: plain ranges on the stored columns first, which reach the Parquet scan, then the distance."""
    first, *more = circle_boxes(at, metres)
    inside = in_bbox(lat, lng, first)
    for box in more:
        inside = inside | in_bbox(lat, lng, box)
    return inside & (haversine(lat, lng, *at) <= float(metres))


def curve(lat, lng, bits: int = 20) -> Column:
    """Place on a Z-order curve: the bits of latitude and longitude in turn, so that neighbours on it are neighbours on the map. Null where a coordinate is not valid."""
    top = (1 << bits) - 1

    def spread(x, low: float, width: float) -> Column:
        n = F.least(F.lit(top).cast("long"), F.floor((_c(x) - low) / width * (top + 1)))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
        return n

    return F.when(is_valid(lat, lng), F.shiftleft(spread(lat, -90.0, 180.0), 1).bitwiseOR(spread(lng, -180.0, 360.0)))


def radius_join(left, right, metres: float, max_lat: float, left_at=("lat", "lng"), right_at=("r_lat", "r_lng")):
    """Pairs within metres of each other: equal grid cells (right side dealt to its 3 x 3 neighbours), then the distance.

    No theta-only join: a cell is at least as wide as the radius at max_lat, the largest absolute latitude. Columns of cells
    divide the circle evenly and wrap, so pairs across the 180th meridian meet too. Cells are dealt to ``JOIN_TASKS`` tasks at
    least, whatever the bytes: the pairs are many times the rows, and Spark sizes tasks by the rows' bytes. The chord between two
    points decides all pairs but those so near the radius that rounding counts, which the distance decides.
    """
    dlat = math.degrees(metres / EARTH_M) * 1.001
    columns = max(1, math.floor(360.0 * math.cos(math.radians(min(89.99, max_lat + dlat))) / dlat))
    cell = lambda at: (F.floor(F.col(at[0]) / dlat), F.pmod(F.floor((F.col(at[1]) + 180.0) / (360.0 / columns)), F.lit(columns)))
    ly, lx = cell(left_at)
    ry, rx = cell(right_at)
    beside = F.array_distinct(F.transform(F.sequence(rx - 1, rx + 1), lambda x: F.pmod(x, F.lit(columns))))
    flat = lambda at: F.cos(F.radians(F.col(at[0])))
    turn = lambda at: F.radians(F.col(at[1]))
    unit = lambda at, side: {f"_{side}x": flat(at) * F.cos(turn(at)), f"_{side}y": flat(at) * F.sin(turn(at)), f"_{side}z": F.sin(F.radians(F.col(at[0])))}
    left = left.withColumns({"_cy": ly, "_cx": lx} | unit(left_at, "l"))
    right = right.withColumns(unit(right_at, "r")).withColumn("_cy", F.explode(F.sequence(ry - 1, ry + 1))).withColumn("_cx", F.explode(beside))
    tasks = max(JOIN_TASKS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = left.repartition(tasks, "_cy", "_cx").join(right.repartition(tasks, "_cy", "_cx"), ["_cy", "_cx"])
    # most pairs of neighbouring cells are apart in one direction alone, which is cheaper to see than the distance
    aside = F.abs(F.pmod(F.col(left_at[1]) - F.col(right_at[1]) + 180.0, F.lit(360.0)) - 180.0)
    out = out.where((F.abs(F.col(left_at[0]) - F.col(right_at[0])) <= dlat) & (aside <= 360.0 / columns))
    apart = [F.col(f"_l{k}") - F.col(f"_r{k}") for k in "xyz"]
    chord = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]
    most = (2 * math.sin(min(metres / EARTH_M, math.pi) / 2)) ** 2
    distance = haversine(*left_at, *right_at)
    slack = most * 1e-9 + math.sqrt(most) * 1e-14 + 1e-28  # far more than what rounding does to either
    out = out.where((chord < most - slack) | ((chord <= most + slack) & (distance <= float(metres))))
    return out.drop("_cy", "_cx", *(f"_{side}{k}" for side in "lr" for k in "xyz")).withColumn("distance", distance)
