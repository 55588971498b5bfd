"""Gazetteer, ingest, store, search, moderation, crawl and streams."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cartulary.functions import geo
from cartulary.operators import aggregates, frontier, geocache, ingest, predicates, search
from cartulary.operators import gazetteer as gaz
from cartulary.operators import submissions as subs
from cartulary.operators.store import Store
from cartulary.plans import api, render
from cartulary.plans import arguments as args
from cartulary.region import City, Region, RegionError
from cartulary.schema import DOCUMENT, TABLES, conform, empty
from cartulary.sources import base, osm, web, wiki
from cartulary.sources.registry import SOURCES, Submissions
from cartulary.streaming import ratelimit, runner

TOML = """
name = "Colorado"
slug = "co"
[bbox]
min_lat = 36.992426
min_lng = -109.060253
max_lat = 41.003444
max_lng = -102.041524
[[cities]]
name = "Denver"
aliases = ["Mile High City"]
lat = 39.7392
lng = -104.9903
county = "Denver"
[[cities]]
name = "Grand Junction"
lat = 39.0639
lng = -108.5506
county = "Mesa"
[[cities]]
name = "Palisade"
lat = 39.1103
lng = -108.3509
county = "Mesa"
"""
REGION = Region.parse(TOML)
NOW = 1_800_000_000


@pytest.fixture(scope="module")
def gazetteer(spark):
    return REGION.gazetteer(spark).cache()


def docs(spark, rows):
    out = spark.createDataFrame([(json.dumps(r | {"_seq": i}),) for i, r in enumerate(rows)], "j string").select(F.from_json("j", f"{DOCUMENT}, _seq BIGINT").alias("d")).select("d.*")
    return conform(out, f"{DOCUMENT}, _seq BIGINT")


def place(id="p1", title="Carlson Vineyards", lat=39.11, lng=-108.35, **more):
    return {"id": id, "kind": "place", "title": title, "lat": lat, "lng": lng, "source": "osm", "source_id": id, "geo_precision": "exact", "categories": ["Winery"], "summary": "Wine and cider.", "updated_at": 5} | more


# ---------------------------------------------------------------- region and gazetteer


def test_region_checks():
    assert REGION.contains(39.7392, -104.9903) and REGION.contains(*REGION.bbox[:2]) and not REGION.contains(41.5, -104.9)
    assert len(REGION.tiles()) == 54
    with pytest.raises(RegionError):
        Region.parse("name = 'x'")
    with pytest.raises(RegionError):
        Region("x", "x", (1, 1, 0, 0)).check()
    with pytest.raises(RegionError):
        Region("x", "x", (0, 0, 1, 1), polygon=((0, 0), (1, 1))).check()
    with pytest.raises(RegionError):
        Region("x", "x", (0, 0, 1, 1), (City("Far", 5, 5),)).check()


def test_synonyms_go_both_ways():
    m = Region("x", "x", (0, 0, 1, 1), synonyms=(("Bar", "pub"), ("pub", "tavern"))).synonym_map()
    assert m == {"bar": ["pub"], "pub": ["bar", "tavern"], "tavern": ["pub"]}


@pytest.mark.parametrize(("said", "want"), [("denver", "Denver"), ("Mile-High  City", "Denver"), ("Grand Junctoin", "Grand Junction"), ("palisad", "Palisade"), ("Palisade, CO", "Palisade"), ("Chicago", None), ("", None)])
def test_resolve(spark, gazetteer, said, want):
    hit = gaz.resolve(spark.createDataFrame([("a", said)], "id string, name string"), gazetteer).first()
    assert (hit.city if hit else None) == want


def test_nearest_suggest_counties(spark, gazetteer):
    near = gaz.nearest(spark.createDataFrame([("x", 39.108, -108.35)], "id string, lat double, lng double"), gazetteer).first().near
    assert (near.name, near.county) == ("Palisade", "Mesa")
    assert gaz.suggest(gazetteer, "Pallisade", 1).first().name == "Palisade"
    assert [r.name for r in gaz.in_county(gazetteer, "mesa county").collect()] == ["Grand Junction", "Palisade"]
    assert gaz.in_county(gazetteer, "County").isEmpty() and gaz.in_county(gazetteer, "").isEmpty()


# ---------------------------------------------------------------- ingest and store


def test_ingest_counts_and_idempotence(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.ensure()
    ctx = runner.context(store, REGION, NOW)
    runner.suppress(ctx, ["gone"], "asked")
    rows = [place(), place(title="Second"), place("far", lat=45.0), place("blank", title="  "), place("nowhere", lat=None), place("gone"), place("e1", kind="event", start_time=7), place("centre", lat=39.7392, lng=-104.9903)]
    first = runner.ingest_batch(ctx, docs(spark, rows))
    assert first == {"received": 8, "invalid": 2, "out_of_region": 1, "duplicates": 1, "suppressed": 1, "unchanged": 0, "written": 3}
    got = {r.id: r for r in store.read("places").collect()}
    assert set(got) == {"p1", "centre"} and got["p1"].title == "Second" and got["p1"].city == "Palisade" and got["p1"].county == "Mesa" and got["p1"].categories == ["winery"]
    assert got["centre"].geo_precision == "city" and store.read("events").count() == 1
    again = runner.ingest_batch(runner.context(store, REGION, NOW + 9), docs(spark, rows))
    assert again["written"] == 0 and again["unchanged"] == 3 and sum(again.values()) == 2 * again["received"]


def test_backfill_rules(spark, gazetteer):
    rows = [place("a", city=" ", county=""), place("b", city="Fruita"), place("c", geo_precision="address", lat=39.7392, lng=-104.9903)]
    got = {r.id: r for r in ingest.backfill(docs(spark, rows), gazetteer).collect()}
    assert (got["a"].city, got["a"].county) == ("Palisade", "") and (got["b"].city, got["b"].county) == ("Fruita", "Mesa") and got["c"].geo_precision == "address"


def test_empty_batches(spark, gazetteer):
    none = empty(spark, "suppressions")
    planned = ingest.plan(docs(spark, []), REGION, gazetteer, none, empty(spark, "places"), NOW)
    assert ingest.stats(planned).first().asDict() == dict.fromkeys(ingest.COUNTERS, 0)


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", fan=2, keep_s=0)
    assert store.read("places").count() == 0
    store.upsert("places", docs(spark, [place(), place("b")]))
    store.upsert("places", docs(spark, [place(title="New")]))
    assert {r.id: r.title for r in store.read("places").collect()} == {"p1": "New", "b": "Carlson Vineyards"}
    store.delete("places", spark.createDataFrame([("b",)], "id string"))
    assert [r.id for r in store.read("places").collect()] == ["p1"]
    assert len(list((tmp_path / "s" / "places").glob("v-*"))) == len(store.manifest("places")["runs"])  # nothing that does not count stays


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("suppressions", spark.createDataFrame([("a", "x")], "id string, doc_id string"))

    def dies(*_):
        raise OSError("gone")

    for name in ("_commit", "_write"):
        with monkeypatch.context() as m:
            m.setattr(Store, name, dies)
            with pytest.raises(OSError, match="gone"):
                store.upsert("suppressions", spark.createDataFrame([("b", "y")], "id string, doc_id string"))
        assert [r.id for r in store.read("suppressions").collect()] == ["a"]
    folder = tmp_path / "s" / "suppressions" / "_manifests"
    (folder / f"{99:012d}").write_text('{"runs": [{"folder"')  # half a manifest
    assert [r.id for r in store.read("suppressions").collect()] == ["a"]
    store.upsert("suppressions", spark.createDataFrame([("b", "y")], "id string, doc_id string"))
    assert sorted(r.id for r in store.read("suppressions").collect()) == ["a", "b"]
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit("suppressions", 100, [])
    for f in folder.iterdir():
        f.unlink()
    with pytest.raises(RuntimeError, match="no manifest"):
        store.read("suppressions")


def test_a_write_costs_what_its_batch_costs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", fan=100)
    files = lambda: {f: f.stat().st_size for f in (tmp_path / "s").rglob("*.parquet")}
    many = docs(spark, [place(str(i), title=f"Title {i}", body="a long body " * 20, lat=37.5 + i % 30 / 10, lng=-108.5 + i % 50 / 10) for i in range(4000)])
    store.upsert("places", many)
    before = files()
    store.upsert("places", docs(spark, [place("7", title="New")]))
    added = {f: n for f, n in files().items() if f not in before}
    assert set(before) <= set(files()) and len(added) < 30 and sum(added.values()) < sum(before.values()) / 4
    assert store.read("places").where("id = '7'").first().title == "New" and store.read("places").count() == 4000
    store.delete("places", spark.createDataFrame([("7",), ("none",)], "id string"))
    assert store.read("places").count() == 3999 and set(before) <= set(files())
    store.update("places", spark.createDataFrame([("8", "Changed", None), ("new", "Added", "x")], "id string, title string, city string"))
    got = {r.id: r for r in store.read("places").where("id in ('8', '9', 'new')").collect()}
    assert (got["8"].title, got["8"].city, got["8"].summary) == ("Changed", None, got["9"].summary) and got["new"].kind is None and store.read("places").count() == 4000
    assert {r.id: r.title for r in store.lookup("places", spark.createDataFrame([("8",), ("7",), ("10",)], "id string")).collect()} == {"8": "Changed", "10": "Title 10"}


def test_compaction_changes_no_result(spark, tmp_path):
    """Random upserts and deletes against a dictionary, with compactions between them."""
    rng, want = random.Random(3), {}
    store = Store(spark, f"file://{tmp_path}/s", fan=3)
    for step in range(9):
        batch = {str(rng.randrange(30)): f"t{step}" for _ in range(rng.choice([1, 2, 9]))}
        if step % 3 == 2:
            store.delete("places", spark.createDataFrame([(i,) for i in batch], "id string"))
            want = {i: t for i, t in want.items() if i not in batch}
        else:
            store.upsert("places", docs(spark, [place(i, title=t) for i, t in batch.items()]))
            want |= batch
    assert {r.id: r.title for r in store.read("places").collect()} == want
    assert {r.id for r in store.keys("places").collect()} == set(want)
    assert len(store.manifest("places")["runs"]) < 9
    assert sorted(map(tuple, store.postings("place").collect())) == sorted(map(tuple, search.postings(store.read("places")).collect()))
    runs = store.manifest("places")
    while store.compact("places"):
        pass
    assert {r.id: r.title for r in store.read("places").collect()} == want and runs["next"] <= store.manifest("places")["next"]


def test_a_compaction_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", fan=2)

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Store, "compact", lambda *_: False)
        for i in range(4):
            store.upsert("suppressions", spark.createDataFrame([(str(i % 3), f"x{i}")], "id string, doc_id string"))
    for name in ("_commit", "_write"):
        with monkeypatch.context() as m:
            m.setattr(Store, name, dies)
            with pytest.raises(OSError, match="gone"):
                store.compact("suppressions")
        assert {r.id: r.doc_id for r in store.read("suppressions").collect()} == {"0": "x3", "1": "x1", "2": "x2"}
    assert store.compact("suppressions") and len(store.manifest("suppressions")["runs"]) == 1
    assert {r.id: r.doc_id for r in store.read("suppressions").collect()} == {"0": "x3", "1": "x1", "2": "x2"}


def test_circles_read_the_parts_that_they_meet(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rng = random.Random(1)
    rows = [place(str(i), lat=rng.uniform(-80, 80), lng=rng.uniform(-180, 180)) for i in range(3000)]
    with_conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in with_conf}
    for k, v in with_conf.items():
        spark.conf.set(k, v)
    try:
        store.upsert("places", docs(spark, rows))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    store.upsert("places", docs(spark, [place("0", lat=10.0, lng=179.99), place("1", lat=10.0, lng=-179.99)]))
    every = sum(map(len, store.parts("places").values()))
    for at, metres in (((40.0, -105.0), 300_000), ((10.0, 179.999), 5_000), ((-30.0, 20.0), 900_000)):
        boxes = geo.circle_boxes(at, metres)
        near = store.read("places", boxes).where(geo.within_radius("lat", "lng", at, metres))
        whole = store.read("places").where(geo.within_radius("lat", "lng", at, metres))
        assert sorted(r.id for r in near.collect()) == sorted(r.id for r in whole.collect())
        assert sum(map(len, store.parts("places", boxes).values())) < every / 2
    assert {"0", "1"} == {r.id for r in store.read("places", geo.circle_boxes((10.0, 179.999), 5_000)).where(geo.within_radius("lat", "lng", (10.0, 179.999), 5_000)).collect()}


def test_keys_are_read_from_their_buckets(spark, tmp_path, monkeypatch):
    from cartulary.operators import store as module

    monkeypatch.setattr(module, "KEYS", 16)
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("places", docs(spark, [place(str(i)) for i in range(400)]))
    run = store.manifest("places")["runs"][0]
    ids = spark.createDataFrame([("7",), ("none",)], "id string")
    read = store._keys_of("places", run, ids)
    assert run["bits"] == 5 and len(read.inputFiles()) <= 2 and [r.id for r in store.keys("places", ids).collect()] == ["7"]
    assert {r.id for r in store.lookup("places", ids).collect()} == {"7"}


WORDS = "barn bern born band brand grand granite granites mountain mountains fountain mount vineyard vineyards winery beer garden springs spring trail trails".split()


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('indexed')}/s")
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    long = "x" * 34
    rows = [place(str(i), title=text(2), body=text(6) if i % 3 else "", summary=text(rng.randint(0, 3)), lat=39 + i % 9 / 10, lng=-107.0, kind=("place", "article")[i % 2], url=f"u{i % 300}", updated_at=i % 7) for i in range(1200)]
    rows += [place("rare", title="Zanzibar mountain"), place("lone", title="Zanzibar"), place("long", title=f"{long}abc barn"), place("long2", title=f"{long}acb")]
    for name, kind in (("places", "place"), ("articles", "article")):
        mine = [r for r in rows if r["kind"] == kind]
        store.upsert(name, docs(spark, mine[:400]))
        store.upsert(name, docs(spark, mine[400:] + mine[:5]))
    return store, long


def test_stored_dictionary_finds_what_a_scan_finds(spark, indexed):
    store, long = indexed
    index = store.index(["place", "article"])
    words = search.dictionary(search.union_kinds({k: store.postings(k) for k in ("place", "article")}, ["place", "article"]))
    known = {r.term for r in words.collect()}
    for terms in (["mountian"], ["granit"], ["barn", "mou"], ["born"], ["vinyards", "winery"], [f"{long}abc"], [f"{long}ab"], ["zanzibra", "x"], ["no"], ["fountains", "gran"]):
        want = {tuple(r) for r in search.expansions(words, terms, {"winery": ["beer garden"]}).collect()}
        got = {tuple(r) for r in search.stored_expansions(index, terms, {"winery": ["beer garden"]}).collect()}
        assert {g for g in got if g[1] in known} == {w for w in want if w[1] in known}, terms
    plan = search.stored_expansions(index, ["mountian"])._jdf.queryExecution().executedPlan().toString()
    assert "/rows" not in plan


def test_blocks_give_the_page_of_the_full_ranking(spark, indexed, monkeypatch):
    store, _ = indexed
    monkeypatch.setattr(search, "WAVE", 2)
    kinds = ["place", "article"]
    everything = search.union_kinds({k: store.read(f"{k}s") for k in kinds}, kinds)
    fewer = 0
    for query, k, where in (("zanzibar mountain", 1, "true"), ("granit mountian", 10, "true"), ("beer trail", 7, "lat < 39.35"), ("barn", 3, "true"), ("absent", 5, "true"), ("zanzibar", 50, "true")):
        cut = search.narrow(everything.where(where))
        index = store.index(kinds)
        hits, counts = search.top(cut, index, query, k, distinct=True)
        got = [tuple(r) for r in hits.orderBy(*search.rank_order()).limit(k).select("id", "kind", "words", "typos", "proximity", "attribute", "exact").collect()]
        full = search.distinct_articles(search.search(cut, query, index=search.postings(everything)))
        want = [tuple(r) for r in full.orderBy(*search.rank_order()).limit(k).select("id", "kind", "words", "typos", "proximity", "attribute", "exact").collect()]
        assert got == want, query
        assert counts["read"] <= counts["blocks"]
        fewer += counts["read"] < counts["blocks"]
    assert fewer >= 3


def test_postings_follow_the_documents(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("places", docs(spark, [place("a", title="Red barn"), place("b", title="Blue barn")]))
    store.upsert("events", docs(spark, [place("a", title="Barn dance", kind="event")]))
    store.upsert("places", docs(spark, [place("a", title="Green mill")]))
    terms = lambda kind: {(r.id, r.term) for r in store.postings(kind).where("attr = 0").collect()}
    assert terms("place") == {("a", "green"), ("a", "mill"), ("b", "blue"), ("b", "barn")} and terms("event") == {("a", "barn"), ("a", "dance")}
    store.delete("places", spark.createDataFrame([("b",)], "id string"))
    assert {i for i, _ in terms("place")} == {"a"}
    want = {k: search.postings(store.read(f"{k}s")) for k in ("place", "event")}
    for k, w in want.items():
        assert sorted(map(tuple, store.postings(k).collect())) == sorted(map(tuple, w.collect()))


def test_pages_read_texts_last(spark, catalog):
    """Nothing but ranks and ids is sorted and shuffled; bodies come with the page's rows."""
    hits = catalog.found(["place", "article"], "museum", F.lit(True))
    assert "body" not in hits.columns and "title" not in hits.columns


def test_large_gazetteers(spark, monkeypatch):
    """The cell plan and the equality joins give what every pair gives."""
    import random

    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))), [rng.choice(["alias", "abcd", ""])] if i % 5 == 0 else None, rng.uniform(-80, 80), rng.choice([-179.9, 179.9, rng.uniform(-180, 180)]), None, 1) for i in range(300)]
    table = spark.createDataFrame(rows, "ord int, name string, aliases array<string>, lat double, lng double, county string, default_radius_m int").cache()
    points = spark.createDataFrame([(i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(100)] + [(100, None, 1.0), (101, 5.0, 180.0)], "id int, lat double, lng double")
    want = {r.id: r.near for r in gaz.nearest(points, table).collect()}
    monkeypatch.setattr(gaz, "MOST_ROWS", 280)
    got = {r.id: r.near for r in gaz.nearest(points, table).collect()}
    assert len(want) == 102 and {k: v and (v.ord, v.distance) for k, v in got.items()} == {k: v and v.distance is not None and (v.ord, v.distance) or None for k, v in want.items()}
    names = [(str(i), "".join(rng.choice("abcde") for _ in range(rng.randint(1, 10)))) for i in range(150)] + [("x", rows[3][1] + "zz"), ("y", ""), ("z", None)]
    found = {(r.id, r.ord): tuple(r.rank) for r in gaz.candidates(spark.createDataFrame(names, "id string, name string"), table).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    plain = {}
    for i, q in names:
        for o, n, alias, *_ in rows:
            forms = [n, *(alias or [])]
            d, most = min(edits(q or "", f) for f in forms), 2 if len(q or "") >= 8 else 1 if len(q or "") >= 5 else -1
            if not q:
                continue
            if q in forms:
                plain[i, o] = (0, 0, o)
            elif len(n) >= 4 and (n.startswith(q) or q.startswith(n)):
                plain[i, o] = (1, -len(n), -o)
            elif d <= most:
                plain[i, o] = (2, d, o)
    assert found == plain


def test_circles_across_the_antimeridian(spark):
    rows = [(1, 10.0, 179.95), (2, 10.0, -179.95), (3, 10.0, 178.0), (4, 88.0, 0.0), (5, 88.0, 179.0), (6, 10.2, -180.0)]
    df = spark.createDataFrame(rows, "id int, lat double, lng double")
    near = lambda at, m: {r.id for r in df.where(geo.within_radius("lat", "lng", at, m)).collect()}
    assert near((10.0, 180.0), 30_000) == {1, 2, 6} and near((10.0, -179.99), 8_000) == {1, 2} and near((89.0, 90.0), 400_000) == {4, 5}
    other = df.withColumnsRenamed({"id": "r_id", "lat": "r_lat", "lng": "r_lng"})
    got = {(r.id, r.r_id) for r in geo.radius_join(df, other, 30_000, 60.0).where("id < r_id and id not in (4, 5)").collect()}
    assert got == {(1, 2), (1, 6), (2, 6)}


# ---------------------------------------------------------------- search


def test_search_contract(spark):
    rows = [
        place("t", "Wine cellar"), place("s", "Barn", summary="a cellar of wine"), place("x", "Wines of the valley"), place("n", "Swimming pool", summary="water", categories=[]),
        place("y", "Taproom", summary="beer", categories=[]), place("h", "Glenwood", summary="hot springs pool", categories=[]), place("w", "Hot rocks and springs", summary="", categories=[]),
    ]
    d = docs(spark, rows)
    ids_of = lambda q, **k: [r.id for r in search.page(search.search(d, q, REGION.stop_words, **k), search.rank_order(), 50).collect()]
    assert ids_of("the wine cellar")[:2] == ["t", "s"]  # both words; the title beats the summary
    assert set(ids_of("vallley")) == {"x"}  # one edit in a word of seven
    assert set(ids_of("swim")) == {"n"}  # prefix of the last term
    assert ids_of("swim zzz") == []  # but only of the last
    assert "y" in ids_of("brewery", synonyms=REGION.synonym_map())
    phrase = ids_of("spa", synonyms={"spa": ["hot springs"]})
    assert phrase == ["h"]  # a phrase is consecutive
    assert len(ids_of("")) == len(rows) and set(ids_of("the")) == {"x"}  # a query of stop words only keeps them


def test_distinct_articles(spark):
    rows = [place("a", kind="article", url="u", updated_at=1), place("b", kind="article", url="u", updated_at=2), place("c", kind="article"), place("d", kind="article"), place("e", url="u")]
    assert {r.id for r in search.distinct_articles(search.search(docs(spark, rows), None)).collect()} == {"b", "c", "d", "e"}


def test_predicates_hold_literals(spark):
    d = docs(spark, [place(city='Denver" OR city = "Boulder'), place("b", city="Boulder")])
    assert d.where(predicates.equals("city", 'Denver" OR city = "Boulder')).count() == 1
    assert predicates.any_of(d, "city", [" ", ""]) is None and predicates.between("updated_at") is None


@pytest.fixture(scope="module")
def catalog(spark, gazetteer):
    rows = [place(), place("d1", "Denver Museum", 39.74, -104.99, categories=["museum"]), place("out", "Wine far away", 45.0, -100.0), place("d2", "Art Museum", 39.7392, -104.9903, categories=["museum", "art"], county="Denver")]
    all_docs = docs(spark, rows).drop("_seq")
    ev = docs(spark, [place("e1", "Peach Festival", kind="event", start_time=100), place("e2", "Wine Tasting", kind="event", start_time=50), place("e3", "Past", kind="event", start_time=1)]).drop("_seq")
    tables = {"place": conform(all_docs, TABLES["places"]).cache(), "event": conform(ev, TABLES["events"]).cache(), "article": empty(spark, "articles")}
    return api.Catalog(spark, REGION, tables, gazetteer, empty(spark, "submissions"), empty(spark, "metrics"))


def test_queries(catalog):
    assert {r.id for r in api.search_region(catalog, "museum", kinds=["places"]).collect()} == {"d1", "d2"}
    ids_ = lambda df: [r.id for r in df.collect()]
    assert set(ids_(api.search_region(catalog, "museum"))) == {"d1", "d2"} and "out" not in ids_(api.search_region(catalog, "wine"))
    assert ids_(api.search_region(catalog, "museum", categories=["Art"])) == ["d2"]
    near = api.find_nearby(catalog, near="denver", radius_m=5000).collect()
    assert [r.id for r in near] == ["d2", "d1"] and near[0].distance_m == 0 and near[0].city == "Denver"
    assert ids_(api.search_events(catalog, 10)) == ["e2", "e1"] and ids_(api.search_events(catalog, 10, starts_before=60)) == ["e2"]
    assert ids_(api.search_region(catalog, city="Palisade", kinds=["place"])) == ["p1"]
    assert ids_(api.get_document(catalog, "d1", "places")) == ["d1"] and ids_(api.get_document(catalog, "out", "place")) == []
    assert api.resolve(catalog, "Carlson Vineyards").via == "place"
    with pytest.raises(args.ArgumentError, match="Denver"):
        api.resolve(catalog, "Dxnvrr City Of Nothing")
    with pytest.raises(args.ArgumentError):
        api.find_nearby(catalog, lat=39.0)
    with pytest.raises(args.ArgumentError):
        api.search_events(catalog, 10, starts_after=9, starts_before=3)
    with pytest.raises(args.ArgumentError, match="Mesa"):
        api.list_locales(catalog, "Nowhere")
    d = api.describe_region(catalog)
    assert d["counts"] == {"place": 3, "event": 3, "article": 0} and dict(d["categories"])["museum"] == 2
    assert api.overview(catalog)["queue"] == dict.fromkeys(subs.STATUSES, 0)
    assert [r.kind for r in api.browse(catalog).collect()] == ["place"] * 3 + ["event"] * 3
    said = render.page(render.header(2, "Colorado", "denver", 9), near)
    assert "d2" in said and "0 m" in said and "offset 2" in said
    assert "No match" in render.page("x", []) and "Mesa" in render.locales(api.list_locales(catalog).collect()) and "Colorado" in render.region(d)


def test_stored_postings_give_the_same_answer(catalog, tmp_path):
    store = Store(catalog.spark, f"file://{tmp_path}/s")
    for k, v in catalog.tables.items():
        store.upsert(f"{k}s", v)
    stored = api.Catalog.of(store, REGION)
    assert api.search_region(stored, "museum").collect() == api.search_region(catalog, "museum").collect()


def test_radius_reaches_the_scan(spark, tmp_path):
    conform(docs(spark, [place()]), TABLES["places"]).write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p").where(predicates.near((39.1, -108.3), 5000)).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lat" in plan and "ReadSchema: struct<id:string,lat:double,lng:double>" in plan


# ---------------------------------------------------------------- arguments


def test_arguments():
    assert args.kinds(["Places", "event", "place"], ()) == ["place", "event"] and args.kinds([], ("place",)) == ["place"]
    assert [args.limit(n) for n in (None, 0, 51)] == [10, 1, 50]
    assert [args.duration(x) for x in ("45", "30m", "6h", "2d")] == [45, 1800, 21600, 172800]
    for bad in ("0m", "6 weeks", "", "m"):
        with pytest.raises(args.ArgumentError):
            args.duration(bad)
    assert [args.time(x) for x in (None, " ", "0", "1970-01-02", "1970-01-02T00:00:00Z")] == [None, None, 0, 86400, 86400]
    with pytest.raises(args.ArgumentError):
        args.time("soon")
    assert args.intervals("crawl=5m, osm = 1h") == {"crawl": 300, "osm": 3600}
    assert args.seeds("https://a.example/x|Palisade,http://b.example") == [("https://a.example/x", "Palisade"), ("http://b.example", None)]
    with pytest.raises(args.ArgumentError):
        args.seeds("ftp://a.example")
    assert args.client_key("1.1.1.1, 2.2.2.2", None, "p") == "1.1.1.1" and args.client_key(None, " ", None) == "unknown"


# ---------------------------------------------------------------- sources


def elements(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", osm.SCHEMA).alias("e")).select("e.*")


def test_osm(spark):
    rows = [
        {"type": "node", "id": 42, "lat": 39.11, "lon": -108.35, "tags": {"name": "Carlson Vineyards", "craft": "winery", "addr:city": "Palisade", "addr:street": "35 Rd", "addr:housenumber": "461", "website": "https://c.example", "contact:phone": "1"}},
        {"type": "node", "id": 1, "lat": 39.1, "lon": -108.3, "tags": {"name": "Slice", "amenity": "restaurant", "cuisine": "pizza;italian", "outdoor_seating": "yes", "takeaway": "no", "microbrewery": "yes"}},
        {"type": "node", "id": 2, "lat": 39.1, "lon": -108.3, "tags": {"amenity": "restaurant"}},
        {"type": "node", "id": 3, "tags": {"name": "No place"}},
        {"type": "way", "id": 42, "center": {"lat": 39.75, "lon": -104.95}, "tags": {"name": "Park", "leisure": "park"}},
        {"type": "node", "id": 5, "lat": 39.5, "lon": -107.3, "tags": {"name": "Hot Springs Pool", "leisure": "swimming_pool", "addr:city": "Glenwood Springs"}},
        {"type": "node", "id": 6, "lat": 39.5, "lon": -107.3, "tags": {"name": "Bench", "amenity": "bench", "addr:city": " ", "addr:town": "X"}},
    ]
    got = {r.source_id: r for r in osm.to_places(elements(spark, rows), NOW).collect()}
    assert set(got) == {"node/42", "node/1", "way/42", "node/5", "node/6"}
    a = got["node/42"]
    assert (a.title, a.categories, a.address, a.city, a.phone, a.url, a.geo_precision) == ("Carlson Vineyards", ["winery"], "461 35 Rd", "Palisade", "1", "https://c.example", "exact")
    assert got["node/1"].categories == ["restaurant", "pizza", "italian", "brewery"] and got["node/1"].tags == ["outdoor seating"]
    assert got["way/42"].lat == 39.75 and got["node/5"].summary == "Hot Springs Pool — swimming pool in Glenwood Springs." and got["node/6"].city is None
    assert {r.id for r in elements(spark, rows).where(osm.wanted()).select("id").collect()} == {42, 1, 5}
    assert '["amenity"~"^(restaurant|' in osm.tile_query((1, 2, 3, 4)) and "(1.000000,2.000000,3.000000,4.000000)" in osm.tile_query((1, 2, 3, 4))


def test_wiki(spark):
    hits = spark.createDataFrame([(1, 39.1, -108.3), (2, 39.2, -108.3), (9, 39.2, -108.3)], wiki.HITS)
    pages = spark.createDataFrame([(1, "W", "Palisade is a town.\n\nMore.", None, "Q1"), (2, "S", "A song", "https://x.example/S", "Q2"), (3, "No point", "x", None, None)], wiki.PAGES)
    entities = spark.createDataFrame([("Q1", json.dumps({"P31": [{"mainsnak": {}}, {"mainsnak": {"datavalue": {"value": {"id": "T2"}}}}, {"mainsnak": {"datavalue": {"value": {"id": "T1"}}}}]})), ("Q2", "not json")], "entity_id string, claims string")
    types = wiki.claims(entities)
    labels = spark.createDataFrame([("T1", "Winery"), ("T2", "human")], wiki.LABELS)
    got = {(r.kind, r.title): r for r in wiki.to_docs(hits, pages, types, labels, NOW).collect()}
    assert set(got) == {("article", "W"), ("place", "W"), ("article", "S")}
    assert got["article", "W"].categories == ["human", "winery"] and got["article", "W"].summary == "Palisade is a town." and got["article", "W"].url == "https://en.wikipedia.org/?curid=1"
    arrived = spark.createDataFrame([(1, 1.0, 1.0, 1), (1, 2.0, 2.0, 0)], "pageid long, lat double, lon double, _seq int")
    assert wiki.first_hits(arrived).first().lat == 2.0


EVENT = """<html><head><title>Peach Festival</title><meta property="og:title" content="  Best   Tacos "><script type="application/ld+json">
{"@type":"Event","name":"Palisade Peach Festival","startDate":"1970-01-02","location":{"name":"Riverbend","geo":{"latitude":"39.1103","longitude":-108.3509},
"address":{"streetAddress":"451 Pendleton St","addressLocality":"Palisade","addressRegion":"CO"}},"offers":{"price":12.5},"organizer":{"name":"Chamber"}}</script>
<script type="application/ld+json">{not json</script></head><body><nav>Menu</nav><main>The actual <b>content.</b></main>
<a href="/a#top">a</a><a href="/a">a</a><a href="b.html">b</a><a href="https://other.example/">o</a><a href="/x.PDF">p</a><a href="mailto:x@y">m</a><a href="https://s.example/c?q=1">c</a></body></html>"""
GRAPH = '<script type="application/ld+json">{"@graph":[{"@type":["NewsArticle","X"],"headline":"News"},{"@type":"Winery","name":"Cellar","geo":{"latitude":39.1},"location":{"geo":{"latitude":39.1,"longitude":-108.3}}}]}</script><p>hi</p>'


def test_references_of_a_title_count_with_their_semicolon():
    title = lambda t: web.read_page("https://s.example/", f"<html><head><title>{t}</title></head><body><p>a &amp b</p></body></html>")["title"]
    assert title("cut &amp;&amp;&amp") == "cut &&&amp" and title("a &ampb &lt; &#38; &copy &#38") == "a &ampb < & &copy &#38"
    assert title("&amp;quot; &quot;x&quot; &nosuch; &") == '&quot; "x" &nosuch; &'
    assert web.read_page("https://s.example/", "<body>a &amp b</body>")["text"] == "a & b"


def test_web_facts():
    f = web.read_page("https://s.example/dir/page", EVENT)
    n = f["nodes"][0]
    assert len(f["nodes"]) == 1 and n["types"] == ["event"] and n["lat"] == 39.1103 and n["locality"] == "Palisade" and n["address"] == "451 Pendleton St, Palisade, CO" and n["price"] == "12.5" and n["organizer"] == "Chamber"
    assert f["title"] == "Best Tacos" and f["text"] == "The actual content."
    assert f["links"] == ["https://s.example/a", "https://s.example/dir/b.html", "https://s.example/c?q=1"]
    g = web.read_page("https://s.example/", GRAPH)["nodes"]
    assert [x["title"] for x in g] == ["News", "Cellar", None] and g[1]["lat"] is None  # a geo without both numbers hides the other


def test_web_documents(spark, gazetteer):
    rows = [("https://s.example/e", EVENT, 0, None), ("https://s.example/g", GRAPH, 3, "palisade"), ("https://s.example/p", "<title>Plain</title><body>some words here</body>", 0, "Denver"), ("https://s.example/n", "<title>Lost</title>", 0, None), ("https://s.example/x", None, 0, None)]
    facts = web.facts(spark.createDataFrame(rows, web.PAGE)).cache()
    got = {(r.kind, r.title): r for r in web.to_docs(facts, REGION, gazetteer, empty(spark, "geocache"), NOW).collect()}
    assert set(got) == {("event", "Palisade Peach Festival"), ("article", "News"), ("place", "Cellar"), ("article", "Plain")}
    e = got["event", "Palisade Peach Festival"]
    assert e.start_time == 86400 and e.venue_name == "Riverbend" and e.city == "Palisade" and e.geo_precision == "exact" and e.categories == ["event"]
    assert got["place", "Cellar"].geo_precision == "city" and got["article", "Plain"].city == "Denver" and got["article", "Plain"].word_count == 3
    assert {r.url for r in web.next_links(facts).collect()} == {"https://s.example/a", "https://s.example/b.html", "https://s.example/c?q=1"}


def test_cursors_and_backoff(spark):
    assert base.advance(53, 1, 54) == (53, 0, True) and base.advance(60, 25, 54) == (6, 31, False) and base.cursor_int_of({"tile": "x"}, "tile") == 0
    assert [base.backoff(100, n) for n in (0, 1, 9)] == [100, 200, 800] and base.backoff(1e6, 3) == 21600
    df = spark.createDataFrame([('{"tile": 7}',), ("nope",), (None,)], "v string")
    assert [r[0] for r in df.select(base.cursor_int("v", "tile")).collect()] == [7, 0, 0]
    assert list(SOURCES) == list(base.INTERVALS)


# ---------------------------------------------------------------- crawl, moderation, limits


def test_frontier(spark):
    urls = lambda *u: spark.createDataFrame([(x, i, None) for i, x in enumerate(u)], "url string, depth int, default_city string")
    t = frontier.rows(urls("http://a/1", "http://a/2", "http://b/1"), 1)
    t = frontier.add(t, urls("http://a/1", "http://c/1"), 2)
    got, t = frontier.claim(t, 2, 3)
    assert sorted(r.url for r in got.collect()) == ["http://a/1", "http://a/2"] and frontier.pending(t).first().n == 2
    t = frontier.finish(t, spark.createDataFrame([("http://a/1", "done"), ("http://zzz", "done")], "url string, new_status string"), 4)
    status = lambda t: {r.url: r.status for r in t.collect()}
    assert status(t)["http://a/1"] == "done" and "http://zzz" not in status(t)
    t = frontier.requeue_stale(t, 5)
    assert status(t)["http://a/2"] == "pending"
    t = frontier.reseed(t, urls("http://a/1", "http://new"), 6)
    assert status(t)["http://a/1"] == "pending" and status(t)["http://new"] == "pending"


def test_geocache(spark):
    cache = geocache.put(spark.createDataFrame([("1 main st", 39.1, -108.3), ("far", 50.0, 0.0), ("none", None, None)], "key string, lat double, lng double"), REGION, NOW)
    got = {r.address: (r.geo_lat, r.geo_known) for r in geocache.lookup(spark.createDataFrame([("1 Main  St",), ("Far,",), ("new",), (None,)], "address string"), cache, REGION).collect()}
    assert got == {"1 Main  St": (39.1, True), "Far,": (None, True), "new": (None, False), None: (None, False)}
    assert [r.key for r in geocache.missing(spark.createDataFrame([("NEW ",), ("far",), (None,)], "address string"), cache).collect()] == ["new"]


def test_validate(spark):
    good = {"title": "Place", "description": "A nice one", "url": "", "lat": "", "lng": "", "target_kind": "", "categories": " A, b,,", "request": "Add", "address": "", "city": " x ", "existing_id": "", "contact": "me@x"}
    cases = [({}, None), ({"title": "x"}, "title_short"), ({"title": "x" * 201}, "title_long"), ({"description": "hey"}, "description_short"), ({"description": "x" * 4001}, "description_long"), ({"url": "nope"}, "url_invalid"), ({"url": "ftp://x.example/"}, "url_scheme"), ({"lat": "39"}, "coordinates_half"), ({"lat": "a", "lng": "-108"}, "latitude_invalid"), ({"lat": "50", "lng": "0"}, "outside_region"), ({"lat": "39.1", "lng": "-108.3"}, None), ({"target_kind": "song"}, "kind_unknown"), ({"request": "x"}, "request_unknown"), ({"title": None}, "title_short")]
    df = spark.createDataFrame([(i, *((good | c)[k] for k in good)) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} string" for k in good))
    got = subs.validate(df, REGION, NOW).orderBy("i").collect()
    assert [r.error for r in got] == [w for _, w in cases]
    assert got[0].categories == ["a", "b"] and got[0].target_kind == "place" and got[0].city == "x" and got[0].url is None and got[0].request == "add"
    assert len(subs.reference()) == 24 and subs.reference() != subs.reference() and len(set(subs.ALPHABET)) == 32


def test_submissions_end_to_end(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.ensure()
    rows = [
        {"id": "a", "request": "add", "target_kind": "place", "title": "New Cellar", "description": "wine here", "lat": 39.11, "lng": -108.35, "url": "https://n.example/", "contact": "secret@x"},
        {"id": "b", "request": "add", "target_kind": "event", "title": "Fair", "description": "a fair", "city": "palisade"},
        {"id": "c", "request": "add", "target_kind": "place", "title": "Nowhere", "description": "no place"},
        {"id": "d", "request": "remove", "target_kind": "place", "existing_id": "p1", "title": "x", "description": "x"},
        {"id": "e", "request": "update", "target_kind": "place", "title": "x", "description": "x"},
        {"id": "f", "request": "add", "target_kind": "place", "title": "Waiting", "description": "pending", "status": "pending"},
    ]
    df = spark.createDataFrame([(json.dumps({"status": "approved", "submitted_at": i} | r),) for i, r in enumerate(rows)], "j string").select(F.from_json("j", TABLES["submissions"]).alias("s")).select("s.*")
    store.replace("submissions", df)
    store.upsert("places", docs(spark, [place(), place("keep")]))
    out = runner.run_all(store, REGION, [Submissions()], NOW)
    assert out["submissions"]["written"] == 2, out
    titles = {r.title: r for r in store.read("places").collect()}
    assert {r.id for r in store.read("places").collect()} >= {"keep"} and "p1" not in {r.id for r in store.read("places").collect()} and titles["New Cellar"].tags == ["submitted"]
    assert "secret" not in json.dumps([r.asDict() for r in store.read("places").collect()])
    s = {r.id: r for r in store.read("submissions").collect()}
    assert [s[k].status for k in "abcdef"] == ["applied", "applied", "approved", "applied", "approved", "pending"] and s["c"].apply_note and s["f"].apply_note is None
    assert [r.doc_id for r in store.read("suppressions").collect()] == ["p1"] and [r.url for r in store.read("frontier").collect()] == ["https://n.example/"]
    assert store.read("events").first().start_time == NOW
    assert runner.run_all(store, REGION, [Submissions()], NOW)["submissions"]["received"] == 0
    m = aggregates.source_metrics(store.read("metrics")).first()
    assert (m.runs, m.consecutive_errors, m.written) == (2, 0, 2)
    reviewed = subs.review(store.read("submissions"), spark.createDataFrame([("c", "reject", " no "), ("f", "what", "")], "id string, decision string, note string"), NOW)
    s = {r.id: r for r in reviewed.collect()}
    assert s["c"].status == "rejected" and s["c"].review_note == "no" and s["c"].apply_note is None and s["f"].status == "pending"


def test_overpass_cycle_and_errors(spark, tmp_path):
    (tmp_path / "osm").mkdir()
    (tmp_path / "osm" / "a.json").write_text(json.dumps({"type": "node", "id": 1, "lat": 36.99243, "lon": -109.06, "tags": {"name": "Corner", "amenity": "cafe"}}))
    store = Store(spark, f"file://{tmp_path}/s")
    store.ensure()
    source = SOURCES["overpass"](f"file://{tmp_path}/osm", 2000)
    assert runner.run_all(store, REGION, [source], NOW)["overpass"]["written"] == 1 and runner.cursor_of(store, "overpass") == {"tile": 0}
    broken = SOURCES["overpass"](f"file://{tmp_path}/missing")
    assert isinstance(runner.run_all(store, REGION, [broken], NOW + 1)["overpass"], str)
    m = aggregates.source_metrics(store.read("metrics")).first()
    assert m.consecutive_errors == 1 and m.last_error and m.sweeps == 1 and runner.cursor_of(store, "overpass") == {"tile": 0}


def test_crawl_cycle(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "a.json").write_text(json.dumps({"url": "https://s.example/e", "html": EVENT}))
    store = Store(spark, f"file://{tmp_path}/s")
    store.ensure()
    crawl = SOURCES["crawl"](f"file://{tmp_path}/web", [("https://s.example/e", None), ("https://s.example/missing", None)])
    assert runner.run_all(store, REGION, [crawl], NOW)["crawl"]["written"] == 1
    assert {r.url: r.status for r in store.read("frontier").collect()} == {"https://s.example/e": "done", "https://s.example/missing": "error", "https://s.example/a": "pending", "https://s.example/b.html": "pending", "https://s.example/c?q=1": "pending"}


def test_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"type": "node", "id": 1, "lat": 39.1, "lon": -108.3, "tags": {"name": "Cafe", "amenity": "cafe"}}))
    store = Store(spark, f"file://{tmp_path}/s")
    store.ensure()
    go = lambda: runner.ingest_stream(store, REGION, f"file://{tmp_path}/in", osm.SCHEMA, osm.to_places, f"file://{tmp_path}/cp").awaitTermination()
    go()
    version = store.manifest("places")
    assert store.read("places").count() == 1
    go()
    assert store.manifest("places") == version


def test_rate_limit(spark):
    rows = [("a", "1", 0.0), ("a", "2", 1.0), ("a", "3", 2.0), ("b", "4", 2.0), ("a", "5", 3600.5), ("a", "6", 3600.6)]
    df = spark.createDataFrame(rows, "key string, id string, at double")
    got = {r.id: r.accepted for r in ratelimit.limit(df, 2).collect()}
    assert got == {"1": True, "2": True, "3": False, "4": True, "5": True, "6": False}
    assert {r.id: r.accepted for r in ratelimit.limit(df, 0).collect()}["1"]


def test_rate_limit_stream_keeps_state(spark, tmp_path):
    rows = [("a", "1", 0.0), ("a", "2", 1.0), ("a", "3", 2.0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "key string, id string, at double").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, id string, at double").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = ratelimit.limit_stream(stream, 2, expire=False).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.accepted for r in spark.table("limited").collect()) == 2


def test_metrics_streak(spark):
    runs = spark.createDataFrame([("s", 1, "e1", False), ("s", 2, None, True), ("s", 3, "e2", False), ("s", 4, "x" * 600, False), ("t", 1, None, False)], "source string, run_at long, error string, swept boolean")
    got = {r.source: r for r in aggregates.source_metrics(runs).collect()}
    assert got["s"].consecutive_errors == 2 and len(got["s"].last_error) == 500 and got["s"].runs == 4 and got["t"].consecutive_errors == 0


def test_near_keys_are_few_and_meet_every_typo(spark):
    """Terms of any length lie under a bounded number of keys, and a query within its edits of a term has one of them."""
    rng = random.Random(27)
    pairs = []
    for _ in range(1500):
        term = "".join(rng.choice("abc") for _ in range(rng.randint(4, 40)))
        query = list(term)
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(query))
            query[at : at + 1] = rng.choice(([], [rng.choice("abc")], [query[at], rng.choice("abc")]))
        pairs.append(("".join(query), term))
    rows = spark.createDataFrame(pairs, "query string, term string").select("query", "term", F.levenshtein("query", "term").alias("d"), search.near_keys().alias("keys")).collect()
    met = [bool(search.probes(r.query) & set(r["keys"])) for r in rows if 1 <= r.d <= search.edits_allowed(r.query)]
    assert all(met) and len(met) > 1000
    assert max(len(r["keys"]) for r in rows) <= 1 + search.PREFIX + search.PREFIX * (search.PREFIX - 1) // 2
