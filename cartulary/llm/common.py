"""What the operators of this package share: work tables, chunk stores, hash exchanges, components.

Work tables go to the folder named in ``spark.checkpoint.dir``, which driver and executors share.
They are plain Parquet, so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = (1 << 63) - 1  # stands for a null document id; sorts after every real id
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
GROUP, GROUP_ROWS = 16 << 20, 4  # bytes of a row group, and rows of megabytes: Spark holds one whole where it writes, and where it reads up to 4096 rows of one
BUCKETS, PARTS = 8, 4  # of 8 MB and of 12 MB, the most that a task goes through: what it sorts stays well below an executor's heap
THIN = 500_000  # edges of a part whose stars one task makes
_own_dir: list[str] = []


# ---------------------------------------------------------------- work tables


class Work:
    """Intermediate tables of one operator call, below the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:  # only on one machine, as in tests
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            if not _own_dir:
                _own_dir.append("file://" + tempfile.mkdtemp(prefix="cartulary-"))
            base = _own_dir[0]
        self.spark, self.root = spark, f"{base.rstrip('/')}/cartulary-{uuid.uuid4().hex}"
        spark.conf.set(BATCH_BYTES, str(4 << 20))

    def put(self, name: str, df: DataFrame, wide: bool = False) -> DataFrame:
        """Write df and read it back: cuts the lineage and frees the shuffle files behind it.

        Row groups are small, and looked at from the first row on (else from the hundredth). wide: rows have megabytes, which
        compress; then a group has a few rows only.
        """
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            small = {"parquet.block.size": GROUP, "parquet.page.size.row.check.min": 1} | ({"parquet.block.row.count.limit": GROUP_ROWS} if wide else {})
            df.write.option("compression", "zstd").options(**small).parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no pending result needs."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as bytes): a null id becomes NO_ID, a null text stays null."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.col(text_col).cast("binary").alias("text"),
    )


def boxed(docs: DataFrame) -> DataFrame:
    """docs as one column ``row``, so that no name of theirs can clash with a helper column."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unboxed(rows: DataFrame, **changed) -> DataFrame:
    """The columns of row, some of them replaced."""
    names = rows.schema["row"].dataType.names
    return rows.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names))


def keys_of() -> dict:
    """id and text hash of a boxed document: what decisions about it are joined by."""
    return {"m_id": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)), "m_hash": F.xxhash64(F.col("row.text").cast("string"))}


def key_columns(found: DataFrame) -> DataFrame:
    """The same for decisions that have doc_id and text_hash."""
    return found.withColumns({"m_id": F.coalesce("doc_id", F.lit(NO_ID)), "m_hash": F.col("text_hash")})


def real_id(name: str = "doc_id"):
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(name).to_pylist()]


# ---------------------------------------------------------------- chunk store

CHUNK_SCHEMA = "chunk long, ids array<long>, ends array<long>, blob binary"


def pack_chunks(work: Work, docs: DataFrame, target: int = 4 << 20, max_docs: int = 20_000) -> DataFrame:
    """Pack whole texts into rows of about ``target`` bytes and store them.

    The stored table fixes which documents a chunk holds, so that later passes can answer a chunk as
    a whole. A longer text makes a chunk of its own. No shuffle.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId() << 24, 0
        ids: list[int] = []
        held: list[bytes] = []
        size = 0

        def row():
            ends = np.cumsum([len(x) for x in held], dtype=np.int64)
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([part + seq], pa.int64()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "ends": pa.array([ends.tolist()], pa.list_(pa.int64())),
                    "blob": pa.array([b"".join(held)], pa.binary()),
                }
            )

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                if held and (size + len(text) > target or len(held) >= max_docs):
                    yield row()
                    seq += 1
                    ids, held, size = [], [], 0
                ids.append(doc)
                held.append(text)
                size += len(text)
        if held:
            yield row()

    return work.put("chunks", doc_rows(docs).mapInArrow(pack, CHUNK_SCHEMA), wide=True)


def total_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0


class Chunk:
    """One row of the chunk store."""

    def __init__(self, chunk: int, ids: np.ndarray, ends: np.ndarray, blob: bytes):
        self.chunk, self.ids, self.ends, self.blob = chunk, ids, ends, blob
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    @staticmethod
    def of(row: dict) -> Chunk:
        return Chunk(row["chunk"], np.array(row["ids"], np.int64), np.array(row["ends"], np.int64), row["blob"])

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            yield self.blob[a:b]


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Polynomial hashes (mod 2^64) of any ranges of a sequence of uint64 codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _power_tables(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Of every window of this width, without regard to documents."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width)) if n else np.zeros(0, np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_code(word: bytes) -> np.uint64:
    """The code that ChunkWords gives to this word."""
    b = np.frombuffer(word, np.uint8)
    return Rolling(BYTE_CODES[b]).of(np.array([0]), np.array([len(b)]))[0]


class ChunkWords:
    """Every word of a chunk: byte range, 64-bit code, and where each document's words begin and end."""

    def __init__(self, chunk: Chunk, lower: bool = False, step: int = 1 << 20):
        starts, ends, codes = [], [], []
        b = np.frombuffer(chunk.blob, np.uint8)
        at, n = 0, len(b)
        while at < n:  # a few documents at a time, to keep the tables small
            stop = int(chunk.ends[min(len(chunk.ends) - 1, np.searchsorted(chunk.ends, at + step))])
            part = b[at:stop]
            ink = ~_SPACE[part]
            edge = np.zeros(len(part) + 1, bool)  # a document begins or ends here
            cuts = chunk.starts[np.searchsorted(chunk.starts, at) : np.searchsorted(chunk.starts, stop)] - at
            edge[cuts] = edge[0] = edge[-1] = True
            before = np.append(False, ink[:-1]) & ~edge[:-1]
            after = np.append(ink[1:], False) & ~edge[1:]
            a, z = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
            codes.append(Rolling(BYTE_CODES[_LOWER[part] if lower else part]).of(a, z))
            starts.append(a + at)
            ends.append(z + at)
            at = stop
        none = np.zeros(0, np.int64)
        self.start, self.end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.code = np.concatenate([np.zeros(0, np.uint64), *codes])
        self.doc_end = np.searchsorted(self.start, chunk.ends)
        self.doc_start = np.concatenate([[0], self.doc_end[:-1]]).astype(np.int64)


# ---------------------------------------------------------------- columns of numbers as bytes


def enc(values: np.ndarray) -> bytes:
    """Fixed-width numbers as compressed byte planes."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def dec(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not data:
        return np.zeros(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def enc_keys(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as gaps."""
    return enc(np.diff(keys, prepend=np.uint64(0)))


def dec_keys(data: bytes) -> np.ndarray:
    return np.cumsum(dec(data, np.uint64), dtype=np.uint64)


# ---------------------------------------------------------------- hash exchange

ASK_SCHEMA = "bucket int, chunk long, part int, keys binary, vals binary"
REPLY_SCHEMA = "chunk long, part int, bucket int, reply binary"
JOINED_SCHEMA = "chunk long, part int, bucket int, ids array<long>, ends array<long>, blob binary"


def bucket_count(size: int, each: int = 8 << 20) -> int:
    """A power of two that grows with the input, so that a bucket keeps its size."""
    return 1 << max(3, (max(1, size // each) - 1).bit_length())


def task_count(units: int, each: int) -> int:
    """Tasks for so many buckets or megabytes of chunks, which a task goes through one by one: as many as there are up to 64, beyond that each takes several."""
    return max(8, min(units, max(64, units // each)))


def split_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets within ascending keys; a bucket is a range of the key space."""
    first = np.arange(buckets, dtype=np.uint64) << np.uint64(64 - buckets.bit_length() + 1)
    return np.append(np.searchsorted(keys, first), len(keys))


def table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.values(), strict=True)], names=list(schema))


_ASK = {"bucket": pa.int32(), "chunk": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "vals": pa.binary()}
_REPLY = {"chunk": pa.int64(), "part": pa.int32(), "bucket": pa.int32(), "reply": pa.binary()}


def asked(chunk: int, part: int, keys: np.ndarray, vals: np.ndarray | None, buckets: int) -> Iterator[pa.RecordBatch]:
    """Requests for ascending, distinct keys, cut by bucket."""
    cuts = split_keys(keys, buckets).tolist()
    rows = [
        (b, chunk, part, enc_keys(keys[i:j]), enc(vals[i:j]) if vals is not None else b"")
        for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))
        if j > i
    ]
    if rows:
        yield table(_ASK, rows)


Bucket = list[tuple[int, int, np.ndarray, np.ndarray]]  # chunk, part, keys, vals


def answered(asks: DataFrame, buckets: int, vals: dict[int, np.dtype | None], answer: Callable[[Bucket], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
    """Meet all requests of a bucket in one task, a bucket at a time, and return its replies.

    answer: gets the bucket's requests and gives (chunk, part, reply) rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            return table(_REPLY, [(chunk, part, now, reply) for chunk, part, reply in answer(held)])

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    if held:
                        yield out()
                    now, held = row["bucket"], []
                kind = vals[row["part"]]
                held.append((row["chunk"], row["part"], dec_keys(row["keys"]), dec(row["vals"], kind) if kind is not None else None))
        if held:
            yield out()

    return asks.repartition(task_count(buckets, BUCKETS), "bucket").sortWithinPartitions("bucket", "part", "chunk").mapInArrow(work, REPLY_SCHEMA)


def with_replies(chunks: DataFrame, replies: DataFrame, size: int, work: Callable[[Chunk, dict[int, list[tuple[int, bytes]]]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring each chunk together with its replies, (bucket, reply) by part, and hand both to work."""
    left = chunks.select("chunk", F.lit(-1).alias("part"), F.lit(-1).alias("bucket"), "ids", "ends", "blob")
    right = replies.where("chunk >= 0").select("chunk", "part", "bucket", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("ends"), F.col("reply").alias("blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, got = None, {}
        for batch in batches:
            part, blob, ids = batch.column("part").to_pylist(), batch.column("blob"), batch.column("ids")
            for i, p in enumerate(part):
                if p < 0:
                    if chunk is not None:
                        yield from work(chunk, got)
                    chunk = Chunk(batch.column("chunk")[i].as_py(), np.array(ids[i].as_py(), np.int64), np.array(batch.column("ends")[i].as_py(), np.int64), blob[i].as_py())
                    got = {}
                else:
                    got.setdefault(p, []).append((batch.column("bucket")[i].as_py(), blob[i].as_py()))
        if chunk is not None:
            yield from work(chunk, got)

    tasks = task_count(size // (12 << 20), PARTS)
    return left.unionByName(right).repartition(tasks, "chunk").sortWithinPartitions("chunk", "part", "bucket").mapInArrow(run, schema)


def reply_array(keys: np.ndarray, replies: list[tuple[int, bytes]], buckets: int, none, dtype) -> np.ndarray:
    """The replies to ascending keys in their order; none where a bucket sent no reply."""
    out, cuts = np.full(len(keys), none, dtype), split_keys(keys, buckets)
    for bucket, data in replies:
        out[cuts[bucket] : cuts[bucket + 1]] = dec(data, dtype)
    return out


def uniques(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys, and for each key its place among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


# ---------------------------------------------------------------- connected components


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node that it reaches) that connect what the edges (a[i], b[i]) connect, without loops."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(names))
    while len(x):
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))  # roots hook onto smaller roots
        while (low[low] != low).any():
            low = low[low]
        x, y = low[x], low[y]
        x, y = x[x != y], y[x != y]
    out = np.flatnonzero(low != np.arange(len(low)))
    return names[out], names[low[out]]


def thinned(work: Work, edges: DataFrame, name: str) -> DataFrame:
    """Edges (a, b), b < a, that connect the same nodes: each part of about ``THIN`` edges sends its stars only.

    Parts are dealt by a hash of the edge, so none is larger for a hot node; passes go on while they halve the edges.
    """

    def run(batches):
        table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        a, b = stars(*(table.column(c).to_numpy() for c in "ab"))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    now = work.put(f"{name}_thin", edges.select("a", "b").where("a <> b"))
    last, rows = f"{name}_thin", now.count()
    for turn in range(60):
        before = rows
        now = work.put(f"{name}_thin{turn}", now.repartition(1 + before // THIN, "a", "b").mapInArrow(run, "a long, b long"))
        rows = now.count()
        work.drop(last)
        last = f"{name}_thin{turn}"
        if 2 * rows > before or before <= THIN:
            break
    return now


def components(work: Work, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of every node of edges (a, b); component: its smallest node.

    Edges are thinned first, so that rounds go over little more than a row a node where a group has many edges.
    Large-star and small-star rounds: each keeps the components, never makes more edges than there
    are, and ends with a star around each smallest node. Hubs cost partial aggregates, not joins of
    their neighbours with each other.
    """
    spark = work.spark
    now = work.put(f"{name}0", thinned(work, edges, name).distinct())
    for turn in range(1, 60):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = work.put(f"{name}{turn}", after)
        same = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        old, new = now.agg(*same).first(), after.agg(*same).first()
        work.drop(f"{name}{turn - 1}")
        now = after
        if tuple(old) == tuple(new):
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
