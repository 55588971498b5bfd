"""Typed predicates that query builders combine; values are literals, so none can be injected."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..region import Region
from . import cover


def all_of(parts: Iterable[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def equals(name: str, value: str) -> Column:
    """Equality without regard to case."""
    return F.lower(F.col(name)) == value.lower()


def any_of(df: DataFrame, name: str, values: Iterable[str] | None) -> Column | None:
    """One of the values; on an array column, a common entry. Blank values are ignored, an empty list asks for nothing."""
    want = [v.strip().lower() for v in values or () if v and v.strip()]
    if not want:
        return None
    if dict(df.dtypes)[name].startswith("array"):
        return F.arrays_overlap(F.transform(F.col(name), F.lower), F.array(*map(F.lit, want)))
    return F.lower(F.col(name)).isin(want)


def between(name: str, low: int | None = None, high: int | None = None) -> Column | None:
    if low is None and high is None:
        return None
    return all_of([F.col(name) >= low if low is not None else None, F.col(name) <= high if high is not None else None])


def near(at: tuple[float, float], metres: float) -> Column:
    return geo.within_radius("lat", "lng", at, metres)


def base(df: DataFrame, region: Region) -> DataFrame:
    """What every query starts from: documents inside the region."""
    if region.polygon is None or len(region.polygon) <= cover.MOST_TERMS:
        return df.where(region.inside())
    return cover.inside(df.where(geo.in_bbox("lat", "lng", region.bbox)), region, "_inside").where("_inside").drop("_inside")
