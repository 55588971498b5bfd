"""Operator 10: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash of their id. A source has a block for each ``total / (shards * DRAWS)``
words that it holds, so blocks grow in number with the shards, not in size; the block table stays a
DataFrame. A source's blocks are permuted by hash; its target draws all of them as often as it holds the
source, and once more the blocks before the place where the words reach what is left. Around that place
single documents are drawn: of up to 2 * ``NEAR`` the subset whose words come nearest (subset sums,
exactly). So a source misses its target by little more than the closest that those documents allow.

Draws are numbered within their source, and the numbers are split down a binary tree of output shards: each
node deals each source's quota to its halves by a multivariate-hypergeometric draw, so quotas stay exact.
A task walks only the nodes on the way to its own draws; the driver knows a row of totals a source.
Documents meet their block's draws in a join on (source, block) and are shuffled within their shard.

Nulls: a null source is a source of its own (last); a null text has size 0 and is never taken; a null
id is blocked by its text. Rows with one id in one source are drawn together. Equally near subsets: the one
that leaves out the later documents in the permuted order. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, boxed, unboxed

SHARD, LEAST = 64_000_000, 8  # words of an output shard, shards at least
DRAWS = 64  # blocks of a shard
BITS = 24  # of an exact subset sum
NEAR = 12  # blocks, and documents, on either side of a source's cut that are looked at singly
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), ratio: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source: ratio x all words by weight, none above most x its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = dict.fromkeys(names, 0.0)
    left, open_ = ratio * sum(sizes.values()), [s for s in names if sizes[s] > 0]
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not full:
            out.update({s: share * weight[s] for s in open_})
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def _rng(seed: int, *names) -> np.random.Generator:
    return np.random.default_rng(xxhash.xxh64_intdigest(repr((seed, *names)).encode()))


def split_tree(quota: np.ndarray, shards: int, seed: int, at: int = 0) -> np.ndarray:
    """Quotas (shard x source) that add up to quota: each node deals its blocks to its two halves."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    take = int(round(int(quota.sum()) * left / shards))
    part = _rng(seed, "tree", at, shards).multivariate_hypergeometric(quota, take, method="marginals") if quota.sum() else quota * 0
    return np.vstack([split_tree(part, left, seed, 2 * at + 1), split_tree(quota - part, shards - left, seed, 2 * at + 2)])


def shards_of(quota: np.ndarray, source: np.ndarray, place: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """The shard of each draw (source, place among the source's draws): leaves as in ``split_tree``, of which only those on the way are visited."""
    out = np.zeros(len(place), np.int32)
    todo = [(0, shards, 0, quota, np.zeros_like(quota), np.arange(len(place)))]
    while todo:
        first, n, at, part, low, mine = todo.pop()
        if n == 1 or not len(mine):
            out[mine] = first
            continue
        left = n // 2
        take = int(round(int(part.sum()) * left / n))
        own = _rng(seed, "tree", at, n).multivariate_hypergeometric(part, take, method="marginals") if part.sum() else part * 0
        goes = place[mine] < (low + own)[source[mine]]
        todo.append((first, left, 2 * at + 1, own, low, mine[goes]))
        todo.append((first + left, n - left, 2 * at + 2, part - own, low + own, mine[~goes]))
    return out


def nearest_subset(sizes: list[int], goal: float) -> list[int]:
    """Places of a subset whose sum is nearest to the goal; of equally near sums the smaller, and of its subsets the one that leaves out later places."""
    unit = 1 + (sum(sizes) >> BITS)  # of very long documents the sums are rounded
    sizes, goal = [n // unit for n in sizes], goal / unit
    reach = [1]  # bit k: some of the first items sum to k
    for n in sizes:
        reach.append(reach[-1] | reach[-1] << n)
    below = reach[-1] & (1 << max(0, int(goal)) + 1) - 1
    low = below.bit_length() - 1
    above = reach[-1] >> low + 1
    best = low
    if above:
        high = low + 1 + (above & -above).bit_length() - 1
        best = high if abs(high - goal) < abs(low - goal) else low
    chosen = []
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> best & 1:
            chosen.append(i)
            best -= sizes[i]
    return chosen[::-1]


def sized(docs: DataFrame) -> DataFrame:
    """Boxed documents with their size, source and key."""
    key = F.coalesce(F.col("row.doc_id").cast("long"), F.xxhash64(F.col("row.text")))
    return boxed(docs).withColumns({"m_size": n_words("row.text"), "m_src": F.col("row.source").cast("string"), "m_key": key})


def planned(rows: DataFrame, work: Work, narrow: DataFrame | None = None, weights=(5, 2, 1), ratio: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = 17) -> DataFrame:
    """rows (with m_size, m_src, m_key) with source_size, target and shards, one entry for each time that they are drawn. narrow: these three columns alone, stored."""
    spark, narrow = rows.sparkSession, rows if narrow is None else narrow
    sizes = {r.m_src: r.n or 0 for r in narrow.groupBy("m_src").agg(F.sum("m_size").alias("n")).collect()}
    goal, total = targets(sizes, weights, ratio, most), sum(sizes.values())
    names = list(goal)
    shards = shards or max(LEAST, total // SHARD)
    words = max(1, total // (shards * DRAWS))
    copies = [int(goal[s] // sizes[s]) if sizes[s] else 0 for s in names]
    known = [(k, s, sizes[s], float(goal[s]), max(1, sizes[s] // words), copies[k], goal[s] - copies[k] * sizes[s]) for k, s in enumerate(names)]
    sources = spark.createDataFrame(known, "k int, m_source string, source_size long, target double, blocks long, copies int, rest double")

    def in_blocks(these: DataFrame) -> DataFrame:
        these = these.join(sources, these["m_src"].eqNullSafe(sources["m_source"])).drop("m_source")
        return these.withColumn("m_blk", F.pmod(F.xxhash64("m_key", F.lit(seed)), F.col("blocks")))

    narrow = in_blocks(narrow)

    # blocks in permuted order, and where each source's words reach what is left of its target
    table = work.put("blocks", narrow.where("m_size > 0").groupBy("k", "m_blk", "copies", "rest").agg(F.sum("m_size").alias("words")))
    order = Window.partitionBy("k").orderBy(F.xxhash64("k", "m_blk", F.lit(seed + 1)), "m_blk")
    ranked = table.withColumns({"rank": F.row_number().over(order) - 1, "upto": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    ranked = work.put("ranked", ranked)
    cut = ranked.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("upto") <= F.col("rest")).alias("cut"))
    ranked = ranked.join(cut, "k").withColumns({"full": F.col("rank") < F.col("cut") - NEAR, "near": F.col("rank").between(F.col("cut") - NEAR, F.col("cut") + NEAR - 1)})

    # documents of the blocks around that place: up to the last NEAR before it all are drawn, the nearest subset of the others
    start = ranked.where("near").groupBy("k").agg(F.min(F.struct("rank", F.col("upto") - F.col("words"))).alias("s")).select("k", F.col("s.col2").alias("before"))
    near = narrow.select("k", "m_blk", "m_key", "m_size").where("m_size > 0").join(ranked.where("near").select("k", "m_blk", "rank", "rest"), ["k", "m_blk"])
    near = near.groupBy("k", "m_blk", "m_key", "rank", "rest").agg(F.sum("m_size").alias("size")).join(start, "k")
    walk = Window.partitionBy("k").orderBy("rank", F.xxhash64("m_key", F.lit(seed + 2)), "m_key")
    near = near.withColumns({"i": F.row_number().over(walk), "upto": F.col("before") + F.sum("size").over(walk.rowsBetween(Window.unboundedPreceding, 0))})
    near = work.put("near", near.withColumn("c", F.count_if(F.col("upto") <= F.col("rest")).over(Window.partitionBy("k"))))
    few = near.where(F.col("i").between(F.col("c") - NEAR + 1, F.col("c") + NEAR))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        first = frame.iloc[0]
        return frame.iloc[nearest_subset([int(x) for x in frame["size"]], first["rest"] - (first["upto"] - first["size"]))][["k", "m_blk", "m_key", "rank"]]

    drawn = "k int, m_blk long, m_key long, rank int"
    picks = near.where(F.col("i") <= F.col("c") - NEAR).select("k", "m_blk", "m_key", "rank")
    picks = work.put("picks", picks.unionByName(few.groupBy("k").applyInPandas(choose, drawn)))

    # draws, numbered within their source: whole copies, then the blocks before the cut, then those that are drawn in part
    part = picks.select("k", "m_blk", "rank").distinct().withColumn("e", F.row_number().over(Window.partitionBy("k").orderBy("rank")) - 1)
    whole = ranked.select("k", "m_blk", F.explode(F.expr("sequence(0, copies)")).alias("copy"), "copies", "n", "rank", "full").where("copy < copies or full")
    draws = whole.select("k", "m_blk", (F.col("copy") * F.col("n") + F.col("rank")).alias("place"), (F.col("copy") == F.col("copies")).alias("extra"))
    later = part.join(ranked.select("k", "m_blk", "copies", "n", "cut"), ["k", "m_blk"])
    later = later.select("k", "m_blk", (F.col("copies") * F.col("n") + F.greatest(F.col("cut") - NEAR, F.lit(0)) + F.col("e")).alias("place"), F.lit(True).alias("extra"))
    draws = work.put("draws", draws.unionByName(later))
    quota = np.zeros(len(names), np.int64)
    for k, n in draws.groupBy("k").count().collect():
        quota[k] = n

    def dealt(batches):
        for batch in batches:
            k, place = batch.column("k").to_numpy(), batch.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "m_blk", "extra")), pa.array(shards_of(quota, k, place, shards, seed))], names=["k", "m_blk", "extra", "shard"])

    deal = draws.repartition("k", "place").mapInArrow(dealt, "k int, m_blk long, extra boolean, shard int")
    plan = deal.groupBy("k", "m_blk").agg(F.array_sort(F.collect_list(F.when(~F.col("extra"), F.col("shard")))).alias("always"), F.max(F.when(F.col("extra"), F.col("shard"))).alias("once"))
    plan = work.put("plan", plan.join(ranked.select("k", "m_blk", "full"), ["k", "m_blk"]))
    out = in_blocks(rows).join(plan, ["k", "m_blk"], "left").join(picks.select("k", "m_key", F.lit(True).alias("picked")), ["k", "m_key"], "left")
    once = F.when(F.col("once").isNotNull() & (F.col("full") | F.col("picked")), F.array("once")).otherwise(F.array().cast("array<int>"))
    dealt_to = F.when(F.col("m_size") > 0, F.concat(F.coalesce("always", F.array().cast("array<int>")), once)).otherwise(F.array().cast("array<int>"))
    return out.withColumn("shards", dealt_to)


def mix_sources(docs: DataFrame, seed: int = 17, work: Work | None = None, **how) -> DataFrame:
    """The mix itself: every drawn document, as often as drawn, shard by shard in shuffled order."""
    work = work or Work(docs.sparkSession)
    narrow = work.put("sized", sized(docs).select("m_size", "m_src", "m_key"))
    out = planned(sized(docs), work, narrow, seed=seed, **how).select("row", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64("row.doc_id", "copy", F.lit(seed))
    return unboxed(out.repartition("shard", F.pmod(order, F.lit(16))).sortWithinPartitions("shard", order))


def mix_report(docs: DataFrame, work: Work, seed: int = 17, **how) -> DataFrame:
    """What the mix takes of each document: the shards that the tree deals it to, and the words they take."""
    rows = work.put("sized", sized(docs.select("doc_id", "text", "source")).select("row.doc_id", "m_size", "m_src", "m_key"))
    out = planned(rows, work, seed=seed, **how)
    out = out.select("doc_id", F.col("m_size").alias("size"), "source_size", "target", "shards")
    return out.select("*", (F.col("size") * F.size("shards")).alias("taken"))
