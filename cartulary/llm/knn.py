"""Operator 5: exact top-k by inner product, as a Voronoi kNN join.

Vectors fall to the nearest of a bounded set of pivots (fitted on a bounded sample). A group keeps a
summary: its pivot, radius and count. Each query is solved in its own group first, which gives it a
k-th best score; the bound q.p + |q|*radius then tells which other groups can still hold a better
or equal one, and only those get a copy of the query. Groups are dealt into blocks of about
``BLOCK`` vectors, and queries meet blocks on (group, block), so a hot group is many tasks.

Vectors that are null, hold null or non-finite components, or have a null id take no part; nor do those with a
component whose 256-fold is beyond a double (2^1016). Scores are exact; one beyond a long is given as the largest or
smallest long, and ties there. Vectors of another length than the query's are no candidates for it. Ties go to the smaller id. A repeated id
counts as one query; repeated candidate rows count one by one. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, PIVOTS, BLOCK, QUERIES, ASKS = 8192, 1024, 4096, 512, 8 << 20
_EXACT, _LONG = float(1 << 53), (1 << 63) - 1


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole doubles: through doubles where those are exact, else in Python's integers."""
    high, other = np.abs(a).max(initial=0), np.abs(b).max(initial=0)
    if high <= _EXACT and other <= _EXACT and high * other * max(1, a.shape[1]) < _EXACT:
        return (a @ b.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    whole = [[int(c) for c in row] for row in b.tolist()]
    for i, row in enumerate(a.tolist()):
        q = [int(c) for c in row]
        out[i] = [max(-_LONG - 1, min(_LONG, sum(map(int.__mul__, q, x)))) for x in whole]
    return out


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, v): v holds floor(256 * x) as bytes of doubles, which are exact for it at any size."""

    def run(batches):
        for batch in batches:
            ids, vecs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i, x in zip(ids, vecs, strict=True):
                if i is None or x is None or any(c is None for c in x):
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    q = np.floor(np.array(x, np.float64) * 256) + 0.0  # no negative zeros
                if np.isfinite(q).all():
                    rows.append((i, len(q), q.tobytes()))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["vec_id", "dim", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "vec_id long, dim int, v binary")


def _pivots(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """A few rounds of k-means over a bounded sample, for each vector length in it."""
    got: dict[int, list[bytes]] = {}
    for dim, v in rows.orderBy(F.xxhash64("vec_id"), "v").limit(SAMPLE).select("dim", "v").collect():
        got.setdefault(dim, []).append(bytes(v))
    want = min(PIVOTS, max(8, int(n**0.5)))
    out = {}
    for dim, vs in got.items():
        x = np.unique(np.frombuffer(b"".join(vs)).reshape(len(vs), dim), axis=0) if dim else np.zeros((1, 0))
        p = x[np.linspace(0, len(x) - 1, min(len(x), want)).astype(int)]
        for _ in range(5):
            near = ((p**2).sum(1) - 2 * x @ p.T).argmin(1)
            p = np.array([x[near == k].mean(0) if (near == k).any() else p[k] for k in range(len(p))]).reshape(len(p), dim)
        out[dim] = p
    return out


def ask_batches(asks):
    """Rows (qid, dim, v, g) in batches of about ``ASKS`` bytes: a query has a copy of its vector for each group, and Arrow holds 2 GB in a column at most."""

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)], names=["qid", "dim", "v", "g"])

    held, size = [], 0
    for row in asks:
        held.append(row)
        size += len(row[2]) + 64
        if size >= ASKS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def knn_join(vectors: DataFrame, work, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row whose id is divisible by every."""
    rows = work.put("vectors", quantized(vectors, id_col, vec_col))
    pivots = _pivots(rows, rows.count())
    for dim, in rows.select("dim").distinct().collect():  # lengths that the sample missed
        pivots.setdefault(dim, np.zeros((1, dim)))
    first, at = {}, 0
    for dim in sorted(pivots):
        first[dim], at = at, at + len(pivots[dim])

    def assign(batches):
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), np.int64)
            group, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            v = batch.column("v").to_pylist()
            for dim in np.unique(dims).tolist():
                on = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(v[i] for i in on)).reshape(len(on), dim)
                p = pivots[dim]
                with np.errstate(over="ignore", invalid="ignore"):  # past a double: any group will do, without a bound
                    near = np.nan_to_num((p**2).sum(1) - 2 * x @ p.T, nan=np.inf).argmin(1)
                    dist[on] = np.nan_to_num(np.sqrt(((x - p[near]) ** 2).sum(1)), nan=np.inf, posinf=np.inf)
                group[on] = first[dim] + near
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), batch.column("v"), pa.array(group), pa.array(dist)], names=["vec_id", "dim", "v", "g", "dist"])

    rows = rows.mapInArrow(assign, "vec_id long, dim int, v binary, g int, dist double")
    # where a row goes within its group; by place, since ids and vectors may repeat
    rows = work.put("grouped", rows.withColumn("spot", F.xxhash64(F.monotonically_increasing_id())))
    summary = {g: (n, r) for g, n, r in rows.groupBy("g").agg(F.count("*"), F.max("dist")).collect()}
    parts = F.element_at(F.array(*[F.lit(-(-summary.get(g, (0, 0))[0] // BLOCK) or 1) for g in range(max(1, at))]), F.col("g") + 1)
    blocks = rows.withColumn("salt", F.pmod("spot", parts).cast("int")).groupBy("g", "salt").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))
    blocks = work.put("blocks", blocks)

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "g")).alias("q")).select(F.col("vec_id").alias("qid"), "q.*")
    queries = work.put("queries", queries)
    deal = max(1, -(-queries.count() // QUERIES))

    def solve(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids = np.array([r["vec_id"] for r in row["rows"]], np.int64)
                x = np.frombuffer(b"".join(r["v"] for r in row["rows"])).reshape(len(ids), dim)
                qids = np.array([q["qid"] for q in row["qs"]], np.int64)
                q = np.frombuffer(b"".join(q["v"] for q in row["qs"])).reshape(len(qids), dim)
                score = _scores(q, x)
                out = []
                for i, qid in enumerate(qids.tolist()):
                    ok = np.flatnonzero(ids != qid)
                    if len(ok) > k:
                        s = score[i, ok]
                        ok = ok[s >= np.partition(s, -k)[-k]]
                    best = ok[np.lexsort((ids[ok], -score[i, ok]))][:k]
                    out += [(qid, a, s) for a, s in zip(ids[best].tolist(), score[i, best].tolist(), strict=True)]
                cols = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    def met(asks: DataFrame) -> DataFrame:
        packs = asks.groupBy("g", "dim", F.pmod(F.xxhash64("qid"), F.lit(deal)).alias("deal")).agg(F.sort_array(F.collect_list(F.struct("qid", "v"))).alias("qs"))
        packs = packs.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        return packs.join(blocks, ["g", "salt"]).select("dim", "rows", "qs").mapInArrow(solve, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    home = work.put("home", top(met(queries.select("qid", "dim", "v", "g"))))
    floor = home.where(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.col("score").alias("floor"))

    def elsewhere(batches):
        """The other groups whose bound reaches a query's k-th best score so far."""
        radius = {d: np.array([summary.get(first[d] + i, (0, 0))[1] for i in range(len(p))]) for d, p in pivots.items()}
        used = {d: np.array([first[d] + i in summary for i in range(len(p))]) for d, p in pivots.items()}

        def reached(row):
            d = row["dim"]
            q = np.frombuffer(row["v"])
            with np.errstate(over="ignore", invalid="ignore"):
                size = np.sqrt((q**2).sum())
                bound = pivots[d] @ q + size * radius[d]
                bound += 1e-9 * (np.abs(pivots[d]) @ np.abs(q) + size * radius[d]) + 1e-3
            bound = np.nan_to_num(bound, nan=np.inf, posinf=np.inf)
            go = used[d] if row["floor"] is None else used[d] & (bound >= row["floor"])
            return ((row["qid"], d, row["v"], first[d] + g) for g in np.flatnonzero(go).tolist() if first[d] + g != row["g"])

        yield from ask_batches(ask for batch in batches for row in batch.to_pylist() for ask in reached(row))

    asks = queries.join(floor, "qid", "left").select("qid", "dim", "v", "g", "floor").mapInArrow(elsewhere, "qid long, dim int, v binary, g int")
    return top(home.drop("rank").union(met(asks))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
