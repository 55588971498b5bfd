"""Every catalog query against its DuckDB equivalent on the smallest test tables, where those are present."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from cartulary.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def rows(frame, cols):
    return sorted(tuple("" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLE:
        assert len(got)
        return
    want = duck.execute(catalog.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and rows(got, cols) == rows(want, cols)


def test_rate_limit_against_a_loop(spark):
    from cartulary.streaming.ratelimit import accept

    got = catalog.rate_limit(spark, DATA).toPandas().sort_values(["at", "id"], kind="stable")
    kept: dict[str, list[float]] = {}
    for r in got.itertuples():
        kept[r.key], ok = accept(kept.get(r.key, []), r.at, 2, 6 * 3600)
        assert ok == r.accepted
