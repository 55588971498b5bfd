"""What is built for size: large polygons, row numbers of hot keys, writers side by side, sources side by side, entry without the subpackage."""

from __future__ import annotations

import json
import math
import random
import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartulary.functions import geo
from cartulary.operators import aggregates, cover, predicates, ranking
from cartulary.operators.store import Conflict, Store
from cartulary.region import Region, synonym_pairs
from cartulary.sources.base import Batch
from cartulary.sources.web import Crawl
from cartulary.streaming import runner

ROOT = Path(__file__).resolve().parent.parent
BOX = Region("Box", "b", (-60.0, -60.0, 60.0, 60.0))


def rings():
    rng = random.Random(2)
    star = [(10 + (3 + 2 * (i % 2)) * math.sin(2 * math.pi * i / 400), 20 + (3 + 2 * (i % 2)) * math.cos(2 * math.pi * i / 400)) for i in range(400)]
    steps = [(y / 4, x / 4) for k in range(40) for y, x in ((k, k), (k, k + 1))] + [(10, 0), (0, 0)]
    comb = [(0, 0)] + [(5 * (i % 2) + 0.01 * (i % 3), i / 10) for i in range(300)] + [(-1, 30), (-1, 0)]
    tangle = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(90)]
    return {"star": star, "steps": steps, "comb": comb, "tangle": tangle, "square": [(0, 0), (0, 4), (4, 4), (4, 0)], "flat": [(1, 0), (1, 5), (1, 3)]}


@pytest.mark.parametrize("name", list(rings()))
def test_cover_equals_ray_casting(spark, name):
    ring = rings()[name]
    rng = random.Random(4)
    ys, xs = [p[0] for p in ring], [p[1] for p in ring]
    ring = [(float(y), float(x)) for y, x in ring]
    points = [(rng.uniform(min(ys) - 1, max(ys) + 1), rng.uniform(min(xs) - 1, max(xs) + 1)) for _ in range(3000)]
    points += [(y, x + d) for y, x in ring for d in (-0.001, 0.0, 0.001)] + [(y, x) for (y, _), (_, x) in zip(ring, reversed(ring), strict=True)] + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lng double")
    got = {r.i: r.inside for r in cover.in_ring(df, ring, "inside").collect()}
    assert got == {i: y is not None and x is not None and geo.point_in_polygon(y, x, ring) for i, (y, x) in enumerate(points)}


def test_a_ring_of_fifty_thousand_vertices(spark):
    n = 50_000
    ring = [((40 + i % 7) * math.sin(2 * math.pi * i / n), (40 + i % 7) * math.cos(2 * math.pi * i / n)) for i in range(n)]
    low, height, strips, rows = cover.strips_of(ring)
    assert sum(len(s[3]) for _, stretches in rows for s in stretches) <= 2 * max(cover.ENTRIES, n)
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(400)], "i int, lat double, lng double")
    region = Region("Round", "r", (-60.0, -60.0, 60.0, 60.0), polygon=tuple(ring))
    got = {r.i for r in predicates.base(df, region).collect()}
    assert got == {r.i for r in df.collect() if geo.point_in_polygon(r.lat, r.lng, ring)}


def test_numbers_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{rng.randrange(40)}", rng.randrange(500), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, a int, i int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranking.numbered(df, "key", [F.asc("a"), F.desc("i")], "n")
        got = {r.i: r.n for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want: dict = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], -r[2]))
        want |= {r[2]: n for n, r in enumerate(mine)}
    assert got == want
    assert ranking.numbered(df.limit(0), "key", [F.asc("a")], "n").count() == 0


def test_errors_since_the_last_success(spark):
    runs = [("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("a", 3, "same time"), ("a", 4, "y"), ("a", 5, "z"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, None)]
    df = spark.createDataFrame([(*r, False, 1) for r in runs], "source string, run_at long, error string, swept boolean, received long")
    got = {r.source: (r.runs, r.last_run_at, r.last_error, r.consecutive_errors) for r in aggregates.source_metrics(df).collect()}
    assert got == {"a": (6, 5, "z", 2), "b": (2, 2, "y", 2), "c": (1, 1, None, 0)}


def test_synonym_pairs_equal_the_map(spark):
    groups = [["Bar", "pub", " "], ["pub", "TAVERN ", "pub"], ["one"], [], ["a", None, "b"]]
    df = spark.createDataFrame([(g,) for g in groups], "names array<string>")
    want = Region("x", "x", (0, 0, 1, 1), synonyms=tuple(tuple(x for x in g if x) for g in groups)).synonym_map()
    assert {r.term: r.synonyms for r in synonym_pairs(df).collect()} == want
    default = BOX.synonym_map()
    assert default["wine tasting"] == ["tasting room", "vineyard", "winery"] and default["hot springs"] == ["hot spring", "thermal springs"]
    assert "beer garden" in default["brewery"] and "espresso" in default["cafe"]


def test_writers_at_once_line_up(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", fan=3)
    failed = []

    def write(i):
        try:
            Store(spark, store.root, fan=3).upsert("suppressions", spark.createDataFrame([(f"{i}", "x"), ("both", f"{i}")], "id string, doc_id string"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = {r.id: r.doc_id for r in store.read("suppressions").collect()}
    assert set(got) == {"both", *map(str, range(6))} and got["both"] in set(map(str, range(6)))
    with pytest.raises(Conflict):
        store._commit("suppressions", store.manifest("suppressions")["next"] - 1, [])


class Slow:
    """A source that waits for another to have run."""

    interval_s = 0.2

    def __init__(self, name, event, wait):
        self.name, self.event, self.wait, self.runs = name, event, wait, 0

    def fetch(self, context, cursor):
        self.runs += 1
        if self.wait:
            assert self.event.wait(60)
        else:
            self.event.set()
        if self.name == "broken":
            raise OSError("no")
        return Batch(context.spark.createDataFrame([], "id string, source string, source_id string, kind string, title string, lat double, lng double"), {"n": self.runs})


def test_sources_run_side_by_side(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    event = threading.Event()
    out = runner.run_all(store, BOX, [Slow("waits", event, True), Slow("broken", event, False)], 5)
    assert out["waits"]["received"] == 0 and "no" in out["broken"] and runner.cursor_of(store, "waits") == {"n": 1}
    got = {r.source: r.consecutive_errors for r in aggregates.source_metrics(store.read("metrics")).collect()}
    assert got == {"waits": 0, "broken": 1}


def test_a_schedule_takes_stale_claims_back(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("frontier", spark.createDataFrame([("1", "https://a.example/", "in_progress", 1), ("2", "https://b.example/", "done", 1)], "id string, url string, status string, updated_at long"))
    source = Slow("often", threading.Event(), False)
    end = time.time() + 60
    runner.schedule(store, BOX, [source], lambda: source.runs > 1 or time.time() > end, jitter=lambda: 0.5)
    assert source.runs > 1
    assert {r.id: r.status for r in store.read("frontier").collect()} == {"1": "pending", "2": "done"}


def test_a_crawl_obeys_robots_rules(spark, tmp_path):
    for name, rows in (("web", [{"url": f"https://s.example/{p}", "html": f"<title>{p}</title><meta name='geo.position' content='1;1'><p>words</p>"} for p in ("open", "shut", "shut/but")]), ("rules", [{"host": "s.example", "prefix": "/shut", "allow": False}, {"host": "s.example", "prefix": "/shut/but", "allow": True}])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(map(json.dumps, rows)))
    store = Store(spark, f"file://{tmp_path}/s")
    crawl = Crawl(f"file://{tmp_path}/web", [(f"https://s.example/{p}", None) for p in ("open", "shut", "shut/but")], rules=f"file://{tmp_path}/rules")
    batch = crawl.fetch(runner.context(store, BOX, 9), None)
    assert sorted(r.title for r in batch.docs.collect()) == ["open", "shut/but"]
    assert {r.url.rsplit("/", 1)[1]: r.status for r in store.read("frontier").collect()} == {"open": "done", "shut": "error", "but": "done"}


@pytest.mark.parametrize("missing", ["cartulary.llm", "corpus_pipeline", "zstandard"])
def test_entry_without_the_subpackage(missing):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), 'op3_fixed_block_anchors' in e.queries())
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(said[0]) > 90 and said[2:] == {"cartulary.llm": ["False", "False"], "corpus_pipeline": ["False", "True"], "zstandard": ["False", "False"]}[missing]


def test_a_run_reads_the_folders_of_its_slice(spark, tmp_path):
    from cartulary.sources import landing
    from cartulary.sources.base import grid_points
    from cartulary.sources.osm import SCHEMA, Overpass
    from cartulary.sources.wiki import HITS, Wikipedia

    rng = random.Random(9)
    rows = [{"type": "node", "id": i, "lat": rng.uniform(-60, 60), "lon": rng.uniform(-60, 60), "tags": {"name": f"N{i}", "amenity": "cafe"}} for i in range(300)]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    plain, tiled = Overpass(f"file://{tmp_path}/raw", 6000), Overpass(f"file://{tmp_path}/tiles", 6000, tiled=True)
    tiled.land(spark.read.schema(SCHEMA).json(f"{tmp_path}/raw"), BOX)
    ctx = runner.Context(spark, None, BOX, None, 7)
    files, cursor = set(), None
    for _ in range(math.prod(BOX.grid(6000))):
        a, b = plain.fetch(ctx, cursor), tiled.fetch(ctx, cursor)
        assert (a.cursor, a.swept) == (b.cursor, b.swept) and sorted(r.id for r in a.docs.collect()) == sorted(r.id for r in b.docs.collect())
        tile = (cursor or {"tile": 0})["tile"]
        read = {r[0] for r in landing.landed(spark, tiled.path, SCHEMA, [tile]).select(F.input_file_name()).distinct().collect()}
        assert "PartitionFilters: [tile" in b.docs._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [isnotnull(tile" in b.docs._jdf.queryExecution().executedPlan().toString()
        assert not read & files  # no file is read by two slices
        files |= read
        cursor = a.cursor
    assert a.swept and cursor == {"tile": 0} and len(files) == len(list((tmp_path / "tiles").rglob("*.parquet")))
    wiki = Wikipedia(f"file://{tmp_path}/wiki", points=3, grid_km=2000, tiled=True)
    where = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(200)] + [(1000 + k, *p) for k, p in enumerate(grid_points(BOX.bbox, 2000))]
    wiki.land(spark.createDataFrame([(i, a, b) for i, a, b in where], "pageid long, lat double, lon double").select(*(F.col(f.name) if f.name in ("pageid", "lat", "lon") else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], HITS).schema)), BOX)
    for name, row in (("pages", {"pageid": 1000, "title": "T", "extract": "words"}), ("types", {}), ("labels", {})):
        (tmp_path / "wiki" / name).mkdir()
        (tmp_path / "wiki" / name / "a.json").write_text(json.dumps(row))
    batch = wiki.fetch(ctx, None)
    assert [r.title for r in batch.docs.collect()] == ["T"] and batch.cursor == {"point": 3}


def test_a_search_broadcasts_neither_postings_nor_documents(spark):
    """Files of few bytes can hold many rows: what is broadcast are the expansions of the query's terms."""
    from cartulary.operators import search

    path = f"{spark.conf.get('spark.checkpoint.dir')}/few_bytes"
    spark.range(3000).selectExpr("'place' AS kind", "cast(id as string) AS id", "if(id % 3 = 0, 'small ring', 'bolt') AS title").write.parquet(path)
    hits = search.search(spark.read.parquet(path), "ring zzzz", (), {"ring": ["bolt"]})
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "SortMergeJoin" in plan and hits.count() == 3000
