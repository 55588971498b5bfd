"""Keyed Parquet tables that are merged on reading.

A table is a sequence of runs. A write adds one run: its rows, and the keys that it speaks for; of two
runs that speak for a key the later counts, so a delete is a key without a row, and a write costs what
the batch costs. Reading drops the rows of a run whose keys a later run holds: one join with the keys of
all runs but the oldest. When runs of like size have gathered, they are rewritten as one (size-tiered
compaction), in a commit of its own.

    <table>/_manifests/<number>      JSON: the runs that count, oldest first
    <table>/v-<uuid>/rows/part=<k>   rows; parts are ranges of the table's order
    <table>/v-<uuid>/keys/bucket=<b> id, part, content_hash; buckets by hash of id, as many as the run's keys need
    <table>/v-<uuid>/parts           number of rows and bounds of each part

Documents lie along a space-filling curve, so a part covers a small area and a circle reads the parts
that it meets. The inverted index of documents (``postings``) is kept by the same writes; its runs hold
their terms, the deletions of those terms (for typos) and the blocks of documents (for ranked pages).

A manifest is written last and never replaced: the newest complete one counts. So readers never see half
a write, a writer that dies leaves the table as it was, and of two writers at once the second puts its run
behind the first's.
"""

from __future__ import annotations

import json
import math
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import KINDS, TABLES, conform, empty, struct
from . import search

FAN, TRIES, KEEP_S, SWEEP = 4, 20, 6 * 3600, 16
KEYS, BROADCAST = 1_000_000, 500_000  # keys of a bucket; most keys that are broadcast
CONTENT = {f"{k}s": k for k in KINDS}
KEY = "id STRING, part INT, content_hash STRING"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TURN, _tidied = threading.Lock(), []


class Conflict(RuntimeError):
    """Another writer was first."""


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files go with the write that made them; the setting stays while any of several writers is at it."""
    with _TURN:
        _tidied.append(spark.conf.get(CLEANUP, "false") if not _tidied else _tidied[0])
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _TURN:
            before = _tidied.pop()
            if not _tidied:
                spark.conf.set(CLEANUP, before)


class Store:
    """Tables below one folder of any file system that Spark reads.

    fan: runs of like size that are rewritten as one. keep_s: how long files stay after they stopped counting, or after a writer
    that died left them; longer than any read or write takes.
    """

    def __init__(self, spark: SparkSession, root: str, fan: int = FAN, keep_s: float = KEEP_S):
        self.spark, self.root, self.fan, self.keep_s = spark, root.rstrip("/"), fan, keep_s
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifests

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _manifest(self, name: str, number: str) -> dict | None:
        stream = self._fs.open(self._path(f"{self.root}/{name}/_manifests/{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:  # its writer died
            return None
        finally:
            stream.close()

    def manifest(self, name: str) -> dict:
        """The newest complete manifest: the number of the next one and the runs, oldest first."""
        numbers = [n for n in self._names(f"{self.root}/{name}/_manifests") if n.isdigit()]
        for number in reversed(numbers):
            if found := self._manifest(name, number):
                return found | {"next": int(numbers[-1]) + 1}
        if any(n.startswith("v-") for n in self._names(f"{self.root}/{name}")):  # an empty manifest comes before any data
            raise RuntimeError(f"{self.root}/{name} has data but no manifest")
        return {"next": 0, "runs": []}

    def _begin(self, name: str) -> dict:
        """The manifest to write after."""
        now = self.manifest(name)
        if not now["next"]:
            try:
                self._commit(name, 0, [])
            except Conflict:
                return self.manifest(name)
            now = now | {"next": 1}
        return now

    def _commit(self, name: str, number: int, runs: list[dict]) -> None:
        """Make a manifest count: written aside, then renamed, which fails where another writer has that number.

        On HDFS that is one step; writers of one driver take turns besides. Drivers that write to one table at once need a file
        system whose rename does not overwrite.
        """
        folder = f"{self.root}/{name}/_manifests"
        aside, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{number:012d}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps({"runs": runs}).encode()))
        stream.close()
        with _TURN:
            if self._fs.exists(final) or not self._fs.rename(aside, final):
                self._fs.delete(aside, False)
                raise Conflict(f"another writer changed {name}")

    def _sweep(self, name: str) -> None:
        """Delete manifests that are no longer the newest and old enough, and the runs that no other names. Every SWEEP commits."""
        folder = f"{self.root}/{name}/_manifests"
        old = lambda status: status.getModificationTime() / 1000 <= time.time() - self.keep_s
        numbers = sorted((s.getPath().getName(), old(s)) for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().isdigit())
        if self.keep_s and len(numbers) % SWEEP:
            return
        runs = lambda n: {r["folder"] for r in (self._manifest(name, n) or {"runs": []})["runs"]}
        gone = [n for n, aged in numbers[:-1] if aged]
        used = set().union(*(runs(n) for n, _ in numbers if n not in gone))
        named = set().union(*map(runs, gone))
        for status in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            run = status.getPath().getName()
            if run.startswith("v-") and run not in used and (run in named or self.keep_s and old(status)):
                self._fs.delete(status.getPath(), True)
        for n in gone:
            self._fs.delete(self._path(f"{folder}/{n}"), False)

    # ------------------------------------------------------------ runs

    def _at(self, name: str, run: dict, part: str = "") -> str:
        return f"{self.root}/{name}/{run['folder']}/{part}".rstrip("/")

    def _numbers(self, folder: str) -> list[int]:
        return [int(n.split("=")[1]) for n in self._names(folder) if "=" in n]

    def _rows(self, name: str, run: dict, parts: list[int] | None = None) -> DataFrame:
        """(columns, _seq) of a run, or of some of its parts."""
        root = self._at(name, run, "rows")
        paths = [root] if parts is None else [f"{root}/part={k}" for k in parts]
        rows = self.spark.read.schema(struct(name)).parquet(*paths) if run["rows"] and paths else empty(self.spark, name)
        return rows.select(*struct(name).names, F.lit(run["seq"]).cast("long").alias("_seq"))

    def _side(self, name: str, run: dict, what: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(self._at(name, run, what))

    def _keys_of(self, name: str, run: dict, ids: DataFrame | None = None) -> DataFrame | None:
        """(id, part, content_hash, _seq) that a run speaks for; ids: reads only the buckets that these fall into."""
        root = self._at(name, run, "keys")
        paths = [root]
        if ids is not None and run["bits"]:
            there = set(self._numbers(root))
            paths = [f"{root}/bucket={b}" for b, in ids.select(_bucket(run["bits"])).distinct().collect() if b in there]
        if not run["keys"] or not paths:
            return None
        return self.spark.read.schema(KEY).parquet(*paths).select("id", "part", "content_hash", F.lit(run["seq"]).cast("long").alias("_seq"))

    def keys(self, name: str, ids: DataFrame | None = None) -> DataFrame:
        """(id, content_hash, part, seq) of every stored row, without reading rows; ids: of these only, from their buckets."""
        found = [k for r in self.manifest(name)["runs"] if (k := self._keys_of(name, r, ids)) is not None]
        if not found:
            return self.spark.createDataFrame([], "id string, content_hash string, part int, seq long")
        every = reduce(DataFrame.union, found)
        if ids is not None:
            every = every.join(ids.select("id").distinct(), "id", "left_semi")
        last = every.groupBy("id").agg(F.max_by(F.struct("content_hash", "part", "_seq"), "_seq").alias("k"))
        return last.where("k.part is not null").select("id", "k.content_hash", "k.part", F.col("k._seq").alias("seq"))

    def _masked(self, name: str, rows: DataFrame, runs: list[dict]) -> DataFrame:
        """rows of some runs without those that a later run speaks for."""
        newer = [k.select("id", "_seq") for r in runs[1:] if (k := self._keys_of(name, r)) is not None]
        if not newer:
            return rows
        top = reduce(DataFrame.union, newer).groupBy("id").agg(F.max("_seq").alias("_top"))
        if sum(r["keys"] for r in runs[1:]) <= BROADCAST:
            top = F.broadcast(top)
        return rows.join(top, "id", "left").where("_top is null or _seq >= _top").drop("_top")

    def _live(self, name: str, runs: list[dict], parts: dict[int, list[int]] | None = None) -> DataFrame:
        """The rows that count, with _seq. parts: by run number, else all."""
        each = [self._rows(name, r, parts.get(r["seq"], []) if parts is not None else None) for r in runs if parts is None or r["seq"] in parts]
        every = reduce(DataFrame.unionByName, each) if each else empty(self.spark, name).withColumn("_seq", F.lit(0).cast("long"))
        return self._masked(name, every, runs)

    def _write(self, *args) -> dict | None:
        with _tidy(self.spark):
            return self._written(*args)

    def _written(self, name: str, rows: DataFrame | None, touched: DataFrame | None, seq: int, base: bool) -> dict | None:
        """Write one run. touched: ids that it speaks for besides those of its rows. base: nothing lies below it. None: nothing to write."""
        run = {"folder": f"v-{uuid.uuid4().hex}", "seq": seq, "rows": 0, "keys": 0, "bits": 0, "bytes": 0}
        keyed = "id" in struct(name).names
        if rows is not None:
            rows = conform(rows, TABLES[name])
            order = _order(name)
            laid = rows.repartitionByRange(*order) if order else rows.coalesce(1)
            laid = laid.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order)
            counted = Observation()
            laid.observe(counted, F.count("*").alias("n")).write.option("compression", "zstd").partitionBy("part").parquet(self._at(name, run, "rows"))
            run["rows"] = counted.get["n"]
        if run["rows"]:
            made = self.spark.read.schema(f"{TABLES[name]}, part INT").parquet(self._at(name, run, "rows"))
            bounds = _bounds(name)
            made.groupBy("part").agg(F.count("*").alias("n"), *bounds).coalesce(1).write.parquet(self._at(name, run, "parts"))
            if name == "postings":
                search.write_terms(made, self._at(name, run))
        else:
            made = None
        if keyed and not (base and name == "postings"):
            hashed = F.col("content_hash") if "content_hash" in struct(name).names else F.lit(None).cast("string")
            own = made.select("id", "part", hashed.alias("content_hash")) if made is not None and name != "postings" else None
            keys = own
            if touched is not None:
                gone = touched.select(F.col("id").cast("string").alias("id")).distinct()
                if own is not None:
                    gone = gone.join(own, "id", "left_anti")
                gone = gone.select("id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("string").alias("content_hash"))
                keys = gone if own is None else own.unionByName(gone)
            if keys is not None:
                run["bits"] = max(0, math.ceil(math.log2(max(1, run["rows"]) / KEYS)))
                dealt = keys.withColumn("bucket", _bucket(run["bits"])).repartition("bucket").sortWithinPartitions("bucket", "id")
                counted = Observation()
                dealt.observe(counted, F.count("*").alias("n")).write.partitionBy("bucket").parquet(self._at(name, run, "keys"))
                run["keys"] = counted.get["n"]
        if not run["rows"] and not run["keys"]:
            self._fs.delete(self._path(self._at(name, run)), True)
            return None
        run["bytes"] = self._fs.getContentSummary(self._path(self._at(name, run))).getLength()
        return run

    def _add(self, name: str, rows: DataFrame | None, touched: DataFrame | None) -> None:
        """Write a run and put it behind those there are, however many other writers come first meanwhile."""
        base = not self._begin(name)["runs"]
        run = self._write(name, rows, touched, 0, base)
        for _ in range(TRIES if run else 0):
            now = self.manifest(name)
            if base and now["runs"] and name == "postings":  # written as the first run, without keys
                base, run = False, self._write(name, rows, touched, now["next"], False)
            try:
                self._commit(name, now["next"], [*now["runs"], run | {"seq": now["next"]}])
                break
            except Conflict:
                continue
        else:
            if run:
                raise Conflict(f"{TRIES} other writers changed {name} meanwhile")
            return
        self._sweep(name)
        self.compact(name)

    def _tail(self, runs: list[dict]) -> int:
        """Where the newest runs of like size begin: no run in the tail is larger than fan times all after it."""
        at, size = len(runs) - 1, runs[-1]["bytes"] if runs else 0
        while at > 0 and runs[at - 1]["bytes"] <= self.fan * size:
            at -= 1
            size += runs[at]["bytes"]
        return at

    def compact(self, name: str) -> bool:
        """Rewrite the newest runs of like size as one, where they are ``fan`` or more. Who reads the runs that were can go on: they stay for ``keep_s``."""
        now = self.manifest(name)
        runs = now["runs"]
        at = self._tail(runs)
        if len(runs) - at < self.fan:
            return False
        tail, base = runs[at:], at == 0
        touched = None
        if not base:  # deletes and replacements must go on hiding what lies below
            keys = [k.select("id") for r in tail if (k := self._keys_of(name, r)) is not None]
            touched = reduce(DataFrame.union, keys) if keys else None
        rows = self._live(name, tail).drop("_seq")
        rows = search.blocked(rows) if name == "postings" else rows
        run = self._write(name, rows, touched, tail[-1]["seq"], base)
        try:
            self._commit(name, now["next"], [*runs[:at], *([run] if run else [])])
        except Conflict:  # the next write tries again
            if run:
                self._fs.delete(self._path(self._at(name, run)), True)
            return False
        self._sweep(name)
        return True

    def drop(self, path: str) -> None:
        """Delete a folder of intermediate rows."""
        self._fs.delete(self._path(path), True)

    # ------------------------------------------------------------ tables

    def ensure(self) -> None:
        """Create what is missing; safe to repeat."""
        for name in TABLES:
            if not self._names(f"{self.root}/{name}/_manifests"):
                self._commit(name, 0, [])

    def read(self, name: str, boxes: list[tuple[float, float, float, float]] | None = None) -> DataFrame:
        """All rows; boxes (south, west, north, east): only parts that meet one, so all rows within the boxes and some others."""
        runs = self.manifest(name)["runs"]
        return self._live(name, runs, self.parts(name, boxes) if boxes else None).drop("_seq")

    def parts(self, name: str, boxes: list[tuple[float, float, float, float]] | None = None) -> dict[int, list[int]]:
        """Parts by run number, those that meet a box: what a read with boxes opens."""
        meet = F.lit(True)
        if boxes:
            one = lambda b: (F.col("south") <= b[2]) & (F.col("north") >= b[0]) & (F.col("west") <= b[3]) & (F.col("east") >= b[1])
            meet = reduce(Column.__or__, map(one, boxes))
        found = {}
        for r in self.manifest(name)["runs"]:
            if r["rows"]:
                found[r["seq"]] = sorted(k for k, in self.spark.read.parquet(self._at(name, r, "parts")).where(meet).select("part").collect())
        return {seq: parts for seq, parts in found.items() if parts}

    def lookup(self, name: str, ids: DataFrame) -> DataFrame:
        """The rows of some ids, from the parts that hold them."""
        keys = self.keys(name, ids).select("id", F.col("seq").alias("_seq"), "part")
        parts: dict[int, list[int]] = {}
        for seq, part in keys.select("_seq", "part").distinct().collect():
            parts.setdefault(seq, []).append(part)
        runs = self.manifest(name)["runs"]
        each = [self._rows(name, r, parts[r["seq"]]) for r in runs if r["seq"] in parts]
        return reduce(DataFrame.unionByName, each).join(keys.drop("part"), ["id", "_seq"], "left_semi").drop("_seq") if each else empty(self.spark, name)

    def replace(self, name: str, df: DataFrame) -> None:
        """All rows anew."""
        now, df = self._begin(name), conform(df, TABLES[name])
        if name in CONTENT:
            kind, posts = CONTENT[name], self._begin("postings")
            rest = self.read("postings").where(F.col("kind") != kind).unionByName(conform(_postings(kind, df), TABLES["postings"]))
            run = self._write("postings", search.blocked(rest), None, posts["next"], True)
            self._commit("postings", posts["next"], [run] if run else [])
            self._sweep("postings")
        run = self._write(name, df, None, now["next"], True)
        self._commit(name, now["next"], [run] if run else [])
        self._sweep(name)

    def append(self, name: str, rows: DataFrame) -> None:
        """More rows of a table without keys."""
        self._add(name, rows, None)

    def upsert(self, name: str, updates: DataFrame) -> None:
        """Rows with a new id are added, others replaced as a whole."""
        updates = conform(updates, TABLES[name])
        self._index(name, updates, updates)
        self._add(name, updates, None)

    def update(self, name: str, changes: DataFrame) -> None:
        """Only the columns that changes has are set, null where it has null; rows with a new id are added."""
        self.upsert(name, patched(self.lookup(name, changes), changes))

    def delete(self, name: str, keys: DataFrame) -> None:
        known = self.keys(name, keys).select("id")
        self._index(name, known, None)
        self._add(name, None, known)

    def _index(self, name: str, ids: DataFrame, rows: DataFrame | None) -> None:
        """Keep the postings of a table of documents: those of ids go, those of rows come.

        Written before the documents: if the writer dies between, its rerun still finds the documents changed.
        """
        if name in CONTENT:
            kind = CONTENT[name]
            keys = ids.select(F.concat(F.lit(f"{kind}:"), "id").alias("id")).distinct()
            self._add("postings", _postings(kind, rows) if rows is not None else None, keys)

    # ------------------------------------------------------------ search

    def postings(self, kind: str) -> DataFrame:
        """(term, kind, id, attr, pos) of the stored documents of a kind."""
        return self.read("postings").where(F.col("kind") == kind).select("term", "kind", F.col("doc").alias("id"), "attr", "pos")

    def index(self, kinds: list[str]) -> search.Index:
        """What a search reads of these kinds: terms, their deletions, blocks and postings."""
        every = self.manifest("postings")["runs"]
        runs = [r for r in every if r["rows"]]

        def side(what: str, ddl: str, paths=None) -> DataFrame:
            each = []
            for r in runs:
                at = [self._at("postings", r, what)] if paths is None else paths(self._at("postings", r, what))
                if at:
                    each.append(self.spark.read.schema(ddl).parquet(*at).select(*struct(ddl).names, F.lit(r["seq"]).cast("long").alias("_seq")))
            return reduce(DataFrame.union, each) if each else self.spark.createDataFrame([], f"{ddl}, _seq long")

        def near(probes: DataFrame) -> DataFrame:
            buckets: dict[int, list[int]] = {}

            def paths(root: str) -> list[str]:
                there = self._numbers(root)
                n = 1 + max(there, default=0)
                bits = max(0, math.ceil(math.log2(n)))
                if bits not in buckets:
                    buckets[bits] = [b for b, in probes.select(search.near_bucket(bits)).distinct().collect()]
                return [f"{root}/bucket={b}" for b in buckets[bits] if b in there]

            return side("near", search.NEAR, paths).drop("_seq")

        def posts(terms: list[str] | None) -> DataFrame:
            parts = None
            if terms is not None:
                meet = F.exists(F.array(*map(F.lit, terms)), lambda t: (F.col("low") <= t) & (F.col("high") >= t))
                parts = {r["seq"]: sorted(k for k, in self.spark.read.parquet(self._at("postings", r, "parts")).where(meet).select("part").collect()) for r in runs}
            rows = self._live("postings", every, parts).where(F.col("kind").isin(kinds))
            rows = rows.where(F.col("term").isin(terms)) if terms is not None else rows
            return rows.select("term", "kind", F.col("doc").alias("id"), "attr", "pos", "_seq", "block")

        return search.Index(side("terms", search.TERMS).drop("_seq"), near, side("blocks", search.BLOCKS).where(F.col("kind").isin(kinds)), posts)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or local where all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="store-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def _bucket(bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << bits)).cast("int").alias("bucket")


def _order(name: str) -> list[Column | str]:
    """How a table's rows lie: documents along the curve, postings by term, others by id."""
    if name in CONTENT:
        return [geo.curve("lat", "lng"), F.col("id")]
    if name == "postings":
        return [F.col(c) for c in ("term", "block", "id", "attr", "pos")]
    return [F.col("id")] if "id" in struct(name).names else []


def _bounds(name: str) -> list[Column]:
    if name in CONTENT:
        return [f(c).alias(a) for f, c, a in ((F.min, "lat", "south"), (F.min, "lng", "west"), (F.max, "lat", "north"), (F.max, "lng", "east"))]
    return [F.min("term").alias("low"), F.max("term").alias("high")] if name == "postings" else []


def _postings(kind: str, docs: DataFrame) -> DataFrame:
    """Postings of documents, in blocks of those that rank alike by date and id."""
    made = search.in_blocks(docs.withColumn("stamp", search.stamp()), F.desc("stamp"), "id")
    return search.postings(made, "stamp", "block").select(F.concat(F.lit(f"{kind}:"), "id").alias("id"), "kind", F.col("id").alias("doc"), "term", "attr", "pos", "stamp", "block")


def patched(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows with the columns that changes has set for its ids."""
    names = [c for c in changes.columns if c != "id" and c in rows.columns]
    new = changes.select("id", F.struct(*names).alias("_new"))
    both = rows.join(new, "id", "full_outer")
    return both.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else c for c in rows.columns))


def merge(rows: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(updates.select(key), key, "left_anti").unionByName(updates)


def without(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def exists(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The keys that the table has; reads the key column only."""
    return keys.join(rows.select(key), key, "left_semi").select(key)
