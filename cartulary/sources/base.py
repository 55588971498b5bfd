"""What a source is, which exist, and how they keep their place."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Batch:
    """Documents of one run, where the next one starts, and whether a sweep is complete."""

    docs: DataFrame
    cursor: dict[str, Any] | None
    swept: bool = False


class Source(Protocol):
    name: str
    interval_s: int

    def fetch(self, context: Any, cursor: dict[str, Any] | None) -> Batch: ...


#: Seconds between runs, in the order sources run.
INTERVALS = {"submissions": 120, "overpass": 20 * 60, "wikipedia": 15 * 60, "crawl": 10 * 60}


def cursor_int(cursor: Column | str, key: str) -> Column:
    """A whole number of a JSON cursor; 0 if the cursor is malformed."""
    v = F.try_parse_json(F.col(cursor) if isinstance(cursor, str) else cursor)
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "long"), F.lit(0).cast("long"))


def cursor_int_of(cursor: Any, key: str) -> int:
    v = cursor.get(key) if isinstance(cursor, dict) else None
    return v if isinstance(v, int) and not isinstance(v, bool) and v >= 0 else 0


def advance(at: int, step: int, n: int) -> tuple[int, int, bool]:
    """(start, next, swept) of a cyclic slice of n tiles or points; a slice of all of them is a sweep."""
    n = max(1, n)
    start = at % n
    after = start + max(1, min(step, n))
    return start, after % n, after >= n


def backoff(interval_s: float, errors: int, jitter: float = 0.0) -> float:
    """Seconds to the next run: doubled for each of up to three errors in a row, a tenth of jitter, six hours at most."""
    return min(interval_s * 2 ** min(errors, 3) * (1 + 0.1 * min(max(jitter, 0.0), 1.0)), 6 * 3600.0)


def slice_of(df: DataFrame, column: str, start: int, step: int, n: int) -> DataFrame:
    """Rows of the tiles start .. start + step - 1, wrapping at n: a filter that prunes partitions by tile."""
    want = sorted({(start + k) % n for k in range(min(step, n))})
    return df.where(F.col(column).isin(want))


def grid_points(box, km: float) -> list[tuple[float, float]]:
    from ..functions import geo

    return [((a + c) / 2, (b + d) / 2) for a, b, c, d in geo.tiles(box, *geo.grid_for(box, km))]


def finite(x: float | None) -> float | None:
    return x if x is not None and math.isfinite(x) else None
