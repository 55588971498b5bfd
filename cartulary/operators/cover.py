"""Membership in a polygon of any number of vertices, as a join.

The polygon's height is cut into strips. Within a strip the spans of its edges, merged where they overlap,
are border; between them every point is inside or every point is outside. A point meets its strip by
equality. Outside the border that decides; within it the point is tested against the edges of its own
stretch of border only. Results equal ray casting over all edges: an edge that is left out crosses the
ray of all points of the stretch or of none, and that parity is kept with it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..region import Region

MOST_TERMS = 64  # edges that a plan spells out
ENTRIES = 400_000  # edges over all strips, at most twice the ring's: what is broadcast
COVER = "strip int, stretches array<struct<x1:double,x2:double,base:int,edges:array<struct<ya:double,xa:double,yb:double,xb:double>>>>"


def _strip(y: float, low: float, height: float, strips: int) -> int:
    return max(0, min(strips - 1, math.floor((y - low) / height)))


def strips_of(ring: Sequence[Sequence[float]]) -> tuple[float, float, int, list[tuple]]:
    """(lowest latitude, height of a strip, number of strips, rows of COVER)."""
    edges = [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(ring, [ring[-1], *ring[:-1]], strict=True)]
    low, high = min(e[0] for e in edges), max(e[0] for e in edges)
    strips = max(16, min(8192, len(edges) // 8))
    while True:
        height = (high - low) / strips or 1.0
        spans = [(_strip(min(e[0], e[2]), low, height, strips), _strip(max(e[0], e[2]), low, height, strips)) for e in edges]
        if strips == 1 or sum(b - a + 1 for a, b in spans) <= max(ENTRIES, 2 * len(edges)):
            break
        strips //= 2
    held: list[list[tuple[float, float, tuple]]] = [[] for _ in range(strips)]
    for e, (a, b) in zip(edges, spans, strict=True):
        ya, xa, yb, xb = e
        for s in range(a, b + 1):
            x1, x2 = min(xa, xb), max(xa, xb)
            if a < b:  # the part within the strip and a little more
                y1, y2 = low + (s - 0.01) * height, low + (s + 1.01) * height
                at = [xa + (xb - xa) * (min(max(y, min(ya, yb)), max(ya, yb)) - ya) / (yb - ya) for y in (y1, y2)]
                x1, x2 = max(x1, min(at)), min(x2, max(at))
            held[s].append((x1 - 1e-9, x2 + 1e-9, e))
    rows = []
    for s, mine in enumerate(held):
        mine.sort(key=lambda t: t[0])
        merged: list[list] = []  # first and last longitude, edges
        for x1, x2, e in mine:
            if merged and x1 <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], x2)
                merged[-1][2].append(e)
            else:
                merged.append([x1, x2, [e]])
        middle, base, stretches = low + (s + 0.5) * height, 0, []
        for x1, x2, crossed in reversed(merged):  # from the east, where everything is outside
            crossed = [e for e in crossed if e[0] != e[2]]  # a level edge is border, but never crossed
            stretches.append((x1, x2, base, crossed))
            base = (base + sum((e[0] > middle) != (e[2] > middle) for e in crossed)) % 2
        if stretches:
            rows.append((s, stretches[::-1]))
    return low, height, strips, rows


def _crosses(e: Column, lat: Column, lng: Column) -> Column:
    x = (e["xb"] - e["xa"]) * (lat - e["ya"]) / (e["yb"] - e["ya"]) + e["xa"]
    return ((e["ya"] > lat) != (e["yb"] > lat)) & (lng < x)


def in_ring(df: DataFrame, ring: Sequence[Sequence[float]], name: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """df with a boolean column: whether a point lies in the polygon; false for null coordinates. The ring closes itself."""
    spark: SparkSession = df.sparkSession
    low, height, strips, rows = strips_of(ring)
    cover = spark.createDataFrame(rows, COVER)
    y, x = F.col(lat), F.col(lng)
    strip = F.greatest(F.lit(0), F.least(F.lit(strips - 1), F.floor((y - low) / height).cast("int")))
    top = low + strips * height
    met = df.withColumn("_strip", F.when(y.between(low, max(top, max(p[0] for p in ring))), strip))
    met = met.join(F.broadcast(cover.withColumnRenamed("strip", "_s")), F.col("_strip") == F.col("_s"), "left")
    border = F.get(F.filter("stretches", lambda s: (s["x1"] <= x) & (x <= s["x2"])), F.lit(0))
    west = F.filter("stretches", lambda s: s["x2"] < x)
    met = met.withColumns({"_border": border, "_base": F.get(west, F.size(west) - 1)["base"]})
    crossed = F.size(F.filter("_border.edges", lambda e: _crosses(e, y, x)))
    inside = F.when(F.col("_border").isNotNull(), (F.col("_border.base") + crossed) % 2 == 1).otherwise(F.col("_base") == 1)
    return met.withColumn(name, F.coalesce(inside, F.lit(False))).drop("_strip", "_s", "stretches", "_border", "_base")


def inside(df: DataFrame, region: Region, name: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """df with a boolean column: whether a point lies in the region. A small polygon is spelt out in the plan, a large one joined."""
    if region.polygon is None or len(region.polygon) <= MOST_TERMS:
        return df.withColumn(name, region.inside(lat, lng))
    box = F.coalesce(geo.in_bbox(lat, lng, region.bbox), F.lit(False))
    return in_ring(df, region.polygon, name, lat, lng).withColumn(name, F.col(name) & box)
