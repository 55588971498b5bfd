"""Landed rows in folders by map tile: a run that reads one slice of a sweep opens that slice's files.

The tile is a Parquet partition column, so a filter on it prunes folders before anything is read. New files can land at
any time; a reader's cursor is the next tile, and it moves on only after what was read is stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def land(rows: DataFrame, path: str, tile: Column) -> None:
    """Add rows to their tiles. A tile with many rows is written by several tasks; rows without a tile are left out."""
    names = [f"`{c}`" for c in rows.columns if not rows.schema[c].dataType.typeName() == "map"]
    dealt = rows.withColumn("tile", tile.cast("int")).where("tile is not null").repartitionByRange(F.col("tile"), F.xxhash64(*map(F.col, names)))
    dealt.write.mode("append").partitionBy("tile").parquet(path)


def landed(spark: SparkSession, path: str, ddl: str, tiles: Sequence[int]) -> DataFrame:
    """Rows of some tiles, with their tile."""
    return spark.read.schema(f"{ddl}, tile INT").parquet(path).where(F.col("tile").isin(list(tiles)))


def tiles_meeting(boxes: Sequence[Sequence[float]], area: Sequence[float], cols: int, rows: int) -> list[int]:
    """Tiles of an area that a box (south, west, north, east) meets; points beyond the area's edge are dealt to its outer tiles, and so are boxes."""
    dy, dx = (area[2] - area[0]) / rows, (area[3] - area[1]) / cols
    at = lambda x, low, step, n: max(0, min(n - 1, int((x - low) // step)))
    found = set()
    for south, west, north, east in boxes:
        for r in range(at(south, area[0], dy, rows), at(north, area[0], dy, rows) + 1):
            found |= {r * cols + c for c in range(at(west, area[1], dx, cols), at(east, area[1], dx, cols) + 1)}
    return sorted(found)
