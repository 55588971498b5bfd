"""Scalar functions against literal cases and small Python models."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.functions import geo, ids, text


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(column).first()[0]


def test_collapse_ws_knows_unicode_space(spark):
    assert one(spark, text.collapse_ws(F.lit("  Carlson  Vineyards \n"))) == "Carlson Vineyards"


def model_truncate(s: str, most: int) -> str:
    if len(s) <= most:
        return s
    head = s[: most - 1]
    if " " in head and len(head.rsplit(" ", 1)[0].encode()) > (most - 1) * 4 // 5:
        head = head.rsplit(" ", 1)[0]
    return head + "…"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é\n", max_size=60), min_size=1, max_size=50))
def test_truncate_matches_model(spark, said):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = {r.i: r.t for r in rows.select("i", text.truncate_chars("s", 20).alias("t")).collect()}
    assert got == {i: model_truncate(s, 20) for i, s in enumerate(said)}


def test_truncate_cuts_at_a_space(spark):
    out = one(spark, text.truncate_chars(F.lit("alpha beta gamma delta epsilon zeta"), 20))
    assert len(out) <= 20 and out.endswith("…") and out.startswith("alpha beta")


def test_dedupe_lower_keeps_order(spark):
    assert one(spark, text.dedupe_lower(F.array(*map(F.lit, ["Winery", "winery", " Vineyard ", " "])))) == ["winery", "vineyard"]


def test_normalize(spark):
    assert one(spark, text.normalize(F.lit("  Cañon--City!  5 "))) == "canon city 5"
    assert len(text.FOLD_FROM) == len(text.FOLD_TO) == 50
    assert one(spark, text.normalize_county(F.lit("Mesa County"))) == "mesa"


def test_geocode_key_and_form_encode(spark):
    assert one(spark, text.geocode_key(F.lit(" ,461  35 Rd, Palisade ,"))) == "461 35 rd, palisade"
    for said, want in (("461 35 Rd, Palisade", "461+35+Rd%2C+Palisade"), ("café", "caf%C3%A9"), ("a&b=c", "a%26b%3Dc"), ("~*", "~%2A")):
        assert one(spark, text.form_encode(F.lit(said))) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [("1970-01-02T00:00:00Z", 86400), ("1970-01-02T00:00:00", 86400), ("1970-01-02", 86400), ("1970-01-02T01:00:00+01:00", 86400), ("1970-01-02T00:00:00.25Z", 86400), ("next week", None), ("1970-01", None), ("1970-13-45", None)],
)
def test_schema_date(spark, said, want):
    assert one(spark, text.schema_date(F.lit(said))) == want


@pytest.mark.parametrize(("m", "want"), [(29, "29 m"), (999, "999 m"), (1000, "1.0 km"), (12_400, "12.4 km")])
def test_distance_label(spark, m, want):
    assert one(spark, text.distance_label(F.lit(m))) == want


@pytest.mark.parametrize(("age", "want"), [(-5, "just now"), (59, "just now"), (60, "1 minute ago"), (7200, "2 hours ago"), (86_400, "1 day ago"), (5_184_000, "2 months ago")])
def test_ago(spark, age, want):
    assert one(spark, text.ago(F.lit(1_000_000_000 - age).cast("long"), 1_000_000_000)) == want


def test_null_inputs_do_not_fail(spark):
    null = F.lit(None).cast("string")
    assert one(spark, text.split_semis(null)) == []
    assert one(spark, text.fmt_ts(F.lit(None).cast("long"))) == "—"
    for f in (text.collapse_ws, text.normalize, text.schema_date, text.host_of, text.kind_of, text.geocode_key):
        assert one(spark, f(null)) is None


def test_snippet_highlight_crop(spark):
    assert one(spark, text.highlight(F.lit("Wine, wines and WINE"), ["wine"])) == "**Wine**, wines and **WINE**"
    long = " ".join(f"w{i}" for i in range(100))
    got = one(spark, text.crop(F.lit(long), ["w60"], 10))
    assert "w60" in got and got.startswith("…") and got.endswith("…") and len(got.strip("…").split()) == 10
    assert one(spark, text.snippet(F.lit(" "), F.lit("body"), F.lit("sum"))) == "body"


def test_ids(spark):
    a = one(spark, ids.stable_id("a", F.lit("bc")))
    assert len(a) == 16 and a == ids.stable_id_of("a", "bc") and a != one(spark, ids.stable_id("ab", F.lit("c")))


def test_content_hash_ignores_times_and_keeps_nulls(spark):
    df = spark.createDataFrame([("t", None, 1, 2), ("t", None, 9, 9), ("t", "", 1, 2), ("u", None, 1, 2)], "title string, body string, updated_at long, indexed_at long")
    h = [r[0] for r in df.select(ids.content_hash(df.columns)).collect()]
    assert h[0] == h[1] and len({h[0], h[2], h[3]}) == 3 and len(h[0]) == 32


def test_haversine(spark):
    want = geo.haversine_m(39.7392, -104.9903, 39.0639, -108.5506)
    assert 300_000 < want < 380_000
    assert one(spark, geo.haversine(39.7392, -104.9903, 39.0639, -108.5506)) == pytest.approx(want)


def test_validity(spark):
    rows = [(39.0, -108.0, True), (91.0, 0.0, False), (0.0, 180.0, True), (math.nan, 0.0, False), (None, 0.0, False), (math.inf, 0.0, False)]
    df = spark.createDataFrame([r[:2] for r in rows], "lat double, lng double")
    assert [r[0] for r in df.select(geo.is_valid("lat", "lng")).collect()] == [r[2] for r in rows]


def test_tiles_and_grids():
    box = (36.992426, -109.060253, 41.003444, -102.041524)
    assert [geo.grid_for(box, km) for km in (75, 14)] == [(9, 6), (44, 32)]
    assert geo.grid_for(box, math.nan) == geo.grid_for(box, 75.0)
    t = geo.tiles(box, 4, 3)
    assert len(t) == 12 and t[0][:2] == box[:2] and t[-1][2:] == pytest.approx(box[2:])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(36, 42), st.floats(-110, -101)), min_size=1, max_size=80))
def test_polygon_and_radius_match_models(spark, points):
    ring = ((37.2, -108.9), (40.8, -107.5), (39.9, -102.4), (38.1, -103.3))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "i int, lat double, lng double")
    got = df.select("i", geo.in_polygon("lat", "lng", ring).alias("p"), geo.within_radius("lat", "lng", (39.0, -105.0), 80_000).alias("r")).collect()
    for r in got:
        lat, lng = points[r.i]
        assert r.p == geo.point_in_polygon(lat, lng, ring)
        assert r.r == (geo.haversine_m(lat, lng, 39.0, -105.0) <= 80_000)


def test_radius_join_is_complete(spark):
    left = spark.range(300).select("id", (38 + F.rand(1) * 2).alias("lat"), (-106 + F.rand(2) * 2).alias("lng")).cache()
    right = spark.range(300).select(F.col("id").alias("r_id"), (38 + F.rand(3) * 2).alias("r_lat"), (-106 + F.rand(4) * 2).alias("r_lng")).cache()
    want = {(a.id, b.r_id) for a in left.collect() for b in right.collect() if geo.haversine_m(a.lat, a.lng, b.r_lat, b.r_lng) <= 25_000}
    rows = geo.radius_join(left, right, 25_000, 40.1).select("id", "r_id").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_radius_join_is_dealt_to_many_tasks_and_exact_at_the_radius(spark):
    left = spark.range(120).select("id", (38 + F.rand(100) * 2).alias("lat"), (-106 + F.rand(200) * 2).alias("lng")).cache()
    right = spark.range(120).select(F.col("id").alias("r_id"), (38 + F.rand(300) * 2).alias("r_lat"), (-106 + F.rand(400) * 2).alias("r_lng")).cache()
    pairs = left.crossJoin(right).select("id", "r_id", geo.haversine("lat", "lng", "r_lat", "r_lng").alias("d")).collect()
    for most in sorted(p.d for p in pairs)[5:1500:700]:  # of these, one pair lies at the radius
        rows = geo.radius_join(left, right, most, 40.1).select("id", "r_id").collect()
        assert Counter(map(tuple, rows)) == Counter((p.id, p.r_id) for p in pairs if p.d <= most)
    # tables of few bytes have many pairs: Spark alone would make it one task
    assert geo.radius_join(left, right, 25_000, 40.1).rdd.getNumPartitions() >= 64
