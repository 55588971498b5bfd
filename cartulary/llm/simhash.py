"""Operator 1: SimHash near-dedup with pivot distance tables.

A fingerprint's row in the pivot table holds its Hamming distances to ``REFS`` reference fingerprints
within each of ``blocks`` disjoint bit blocks. The difference of two rows in a block is at most the
number of bits that differ there, so two fingerprints at distance <= bits have equal coordinates in at
least blocks - bits blocks: rows meet by the coordinates of each ``equal`` blocks. Within such a cell,
pairs whose largest coordinate differences sum to more than bits are discarded and the survivors are
verified bit by bit. With bits <= blocks - equal (by default 4 <= 7 - 3) no link is lost; beyond that,
links are found if their differing bits leave ``equal`` blocks untouched.

Equal fingerprints count once. A cell of more than ``CELL`` rows is dealt into parts, and each pair of
parts is a task of its own; a task sends on a spanning forest of its links, never all pairs.

Where texts are compared too, a text has ``PRINTS`` words: independent fingerprints, or with bits = 0 hashes
of its least shingles under ``ORDERS`` orders, which are equal in texts that are alike. Cells of more than
``FEW`` rows are solved over rows that also hold marks of the shingle set: they rule out most pairs of unlike
texts within the cell, and never a pair of like ones. A large cell's rows go to one part each, its smallest
node to all. What a failed comparison or the parts leave apart is searched a second time, where only rows
outside a cell's largest component meet several parts.

Nulls: a null text has no words and fingerprint zero; a null id can link others and gets the
component of its fingerprint (null if only null ids are in it). Repeated rows keep one row each.
"""

from __future__ import annotations

from collections import deque
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, components, doc_rows, key_columns, keys_of, mix, real_id, texts, unboxed

BLOCKS, EQUAL, REFS, CELL, SMALL = 7, 3, 8, 2048, 16
PRINTS, ROUNDS, ORDERS = 24, 4, 5  # words of a text where texts are compared, turns that fingerprints are searched in, least shingles in a word
FEW, MARKS, VOTERS = 3, 256, 256  # rows of a cell that is solved without marks, bytes of marks, rows that place a centre
_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_LANE = (np.arange(8) * 256).astype(np.int64)
_LANES = (np.arange(8 * PRINTS) * 256).astype(np.int64)
_SALT = np.arange(PRINTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ORDER = mix(np.arange(1, PRINTS * ORDERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)  # odd factors: a new order of all hashes each


def shingle_hashes(text: bytes, width: int = 4) -> list[int]:
    """XXH64 (seed 42) of every shingle of lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[: -width] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(start.tolist(), end[width - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, width: int = 4) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; no words: 0."""
    h = np.array(shingle_hashes(text, width), np.uint64)
    if not len(h):
        return 0
    lanes = (h.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANE).ravel()
    bits = np.bincount(lanes, minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(2 * bits.ravel() > len(h), bitorder="little").tobytes(), "little")


def sketch(h: np.ndarray) -> np.ndarray:
    """``PRINTS`` independent fingerprints of the same shingle hashes."""
    if not len(h):
        return np.zeros(PRINTS, np.uint64)
    count = np.zeros(2048 * PRINTS, np.int64)
    for i in range(0, len(h), 4096):
        part = mix(h[i : i + 4096, None] + _SALT[None, :])
        count += np.bincount((part.astype("<u8").view(np.uint8) + _LANES).ravel(), minlength=len(count))
    bits = count.reshape(-1, 256).astype(np.float64) @ _BYTE_BITS.astype(np.float64)
    return np.packbits(2 * bits.ravel() > len(h), bitorder="little").view("<u8")


def least_words(h: np.ndarray) -> np.ndarray:
    """``PRINTS`` hashes of the least shingles under ``ORDERS`` orders each: sets of similarity s share one with 1 - (1 - s ** ORDERS) ** PRINTS."""
    if not len(h):
        return _SALT.copy()
    least = np.full(len(_ORDER), 2**64 - 1, np.uint64)
    for i in range(0, len(h), 1024):
        np.minimum(least, (h[i : i + 1024, None] * _ORDER[None, :]).min(0), out=least)
    word = _SALT.copy()
    for one in least.reshape(ORDERS, PRINTS):
        word = mix(word ^ mix(one))
    return word


def marks_of(h: np.ndarray) -> bytes:
    """The size of a shingle set and a bit for each of its hashes, folded to ``MARKS`` bytes."""
    bit = np.zeros(8 * MARKS, np.uint8)
    bit[(mix(h) % np.uint64(8 * MARKS)).astype(np.int64)] = 1
    return len(h).to_bytes(8, "little") + np.packbits(bit).tobytes()


def may_be_alike(marks: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """False only where sets a[i], b[i] surely have a similarity under ``least``; marks: rows of 64-bit words.

    Each bit that one set has alone is at least one shingle that it has alone.
    """
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 65536):
        x, y = marks[a[at : at + 65536]], marks[b[at : at + 65536]]
        n, m = x[:, 0].astype(np.int64), y[:, 0].astype(np.int64)
        both = np.minimum(n - np.bitwise_count(x[:, 1:] & ~y[:, 1:]).sum(1, dtype=np.int64), m - np.bitwise_count(y[:, 1:] & ~x[:, 1:]).sum(1, dtype=np.int64))
        out[at : at + 65536] = both >= least * (n + m - both)
    return out


def sketches(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """(doc_id, text_hash, node, prints, marks) of every row of doc_rows; node: a hash of the shingle set; prints: fingerprints, or with bits = 0 least_words.

    Repeats do not count, neither here nor in the similarity.
    """

    def run(batches):
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t, width), np.uint64)) for t in texts(batch)]
            prints = [(sketch if bits else least_words)(h).tobytes() for h in sets]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets], np.uint64).view(np.int64)
            made = [pa.array(node), pa.array(prints, pa.binary()), pa.array([marks_of(h) for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], names=["doc_id", "text_hash", "node", "prints", "marks"])

    rows = docs.withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, prints binary, marks binary")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp: the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    rows = doc_rows(docs, id_col, text_col).withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


# ---------------------------------------------------------------- pivot table

REFERENCES = mix(np.arange(1, REFS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def block_masks(blocks: int) -> np.ndarray:
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    return np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)], np.uint64)


def pivot_table(fp: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """Distances (row x block x reference) to the references within each block."""
    return np.bitwise_count((fp[:, None, None] ^ REFERENCES[None, None, :]) & block_masks(blocks)[None, :, None]).astype(np.int8)


def cell_keys(table: np.ndarray, equal: int = EQUAL) -> np.ndarray:
    """A key (row x choice of blocks) for the coordinates of each choice of equal blocks."""
    blocks = table.shape[1]
    code = (table.astype(np.uint64) << (np.arange(REFS, dtype=np.uint64) * np.uint64(8))[None, None, :]).sum(2, dtype=np.uint64)
    code = mix(code + np.arange(blocks, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93))
    out = []
    for combo in combinations(range(blocks), equal):
        key = np.full(len(table), sum(1 << c for c in combo), np.uint64)
        for c in combo:
            key = mix(key ^ code[:, c])
        out.append(key)
    return np.stack(out, 1)


def near(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs (a[i], b[i]) link: pivot bound first, then the bits of the survivors."""
    bound = np.abs(table[a] - table[b]).max(2).sum(1)
    ok = bound <= bits
    left = np.flatnonzero(ok)
    ok[left] = np.bitwise_count(fp[a[left]] ^ fp[b[left]]) <= bits
    return ok


def outwards(rows: np.ndarray) -> np.ndarray:
    """Row numbers by distance from the majority of each bit, as some rows see it; rows: 64-bit words."""
    some = rows[:: max(1, len(rows) // VOTERS)]
    votes = np.unpackbits(some.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    middle = np.packbits(2 * votes > len(some)).view(np.uint64)
    return np.bitwise_count(rows ^ middle[None, :]).sum(1, dtype=np.int64).argsort(kind="stable")


def forest(linked, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one cell, as index pairs.

    Trees grow breadth first from the centre of what is left, so that the many cells that hold one
    group of near copies mostly send the same edges.
    """
    left, a, b = order, [], []
    while len(left):
        todo, left = deque([int(left[0])]), left[1:]
        while todo and len(left):
            at = todo.popleft()
            hit = linked(np.full(len(left), at), left)
            new = left[hit]
            if len(new):
                a.append(np.full(len(new), at))
                b.append(new)
                todo.extend(new.tolist())
                left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def crossing(comp: np.ndarray, linked) -> tuple[np.ndarray, np.ndarray]:
    """All links of one cell between different components, as index pairs."""
    names, at, size = np.unique(comp, return_inverse=True, return_counts=True)
    most, a, b = size.argmax(), [], []
    for i in np.flatnonzero(at != most):  # each pair once: with the largest component, and with later rows of others
        j = np.flatnonzero((at != at[i]) & ((at == most) | (np.arange(len(comp)) > i)))
        j = j[linked(np.full(len(j), i), j)]
        a.append(np.full(len(j), i))
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _edges(fp: np.ndarray, cell: np.ndarray, bits: int, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Links within cells of sorted rows."""
    cuts = np.append(np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(1))), len(fp))
    size = np.diff(cuts)
    table = pivot_table(fp, blocks)
    group = np.repeat(np.arange(len(size)), size)
    small = size[group] <= SMALL
    a, b = [], []
    for lag in range(1, SMALL):
        i = np.flatnonzero(small[:-lag] & (group[:-lag] == group[lag:])) if len(fp) > lag else np.zeros(0, int)
        if not len(i):
            break
        i = i[near(fp, table, i, i + lag, bits)]
        a.append(i)
        b.append(i + lag)
    for g in np.flatnonzero(size > SMALL):
        own, pivots = fp[cuts[g] : cuts[g + 1]], table[cuts[g] : cuts[g + 1]]
        x, y = forest(lambda i, j, own=own, pivots=pivots: near(own, pivots, i, j, bits), outwards(own[:, None]))
        a.append(x + cuts[g])
        b.append(y + cuts[g])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _crowd_edges(fp: np.ndarray, cell: np.ndarray, marks: np.ndarray, comp: np.ndarray | None, bits: int, blocks: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within large cells of sorted rows whose marks allow the similarity; with comp, all those between different components."""
    cuts = np.append(np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(1))), len(fp))
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, seen = fp[lo:hi], marks[lo:hi]
        pivots = pivot_table(own, blocks)

        def ok(i, j, own=own, pivots=pivots, seen=seen):
            hit = near(own, pivots, i, j, bits)
            hit[hit] = may_be_alike(seen, i[hit], j[hit], least)
            return hit

        x, y = forest(ok, outwards(np.concatenate([seen, own[:, None]], 1))) if comp is None else crossing(comp[lo:hi], ok)
        a.append(x + lo)
        b.append(y + lo)
    return np.concatenate(a), np.concatenate(b)


def links(work, fps: DataFrame, bits: int = 4, blocks: int = BLOCKS, equal: int = EQUAL) -> DataFrame:
    """Edges (a, b) that connect the fingerprints at distance <= bits; fps: distinct fp."""

    def keyed(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                keys = cell_keys(pivot_table(part.view(np.uint64), blocks), equal)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(part, keys.shape[1]))], names=["key", "fp"])

    return cell_links(work, work.put("cells", fps.select("fp").mapInArrow(keyed, "key long, fp long")), bits, blocks)


def print_rows(batch, mine, blocks: int, equal: int):
    """(fp, keys) of each of the words ``mine``, for up to 4 096 nodes at a time, and where those start; a word of which all is equal is its own key."""
    prints = np.frombuffer(b"".join(batch.column("prints").to_pylist()), np.uint64).reshape(-1, PRINTS)
    for i in range(0, len(prints), 4096):
        for k in mine:
            fp = np.ascontiguousarray(prints[i : i + 4096, k])
            yield i, fp.view(np.int64), mix(cell_keys(pivot_table(fp, blocks), equal) ^ _SALT[k]) if equal < blocks else fp[:, None]


def sketch_links(work, nodes: DataFrame, bits: int, blocks: int, equal: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between nodes that meet in a cell of up to ``FEW`` rows at distance <= bits, and the rows (key, fp, node, n) of larger cells of n rows."""
    out = wide = None
    turns = ROUNDS if bits else 1
    for turn in range(turns):

        def keyed(batches, mine=range(turn, PRINTS, turns)):
            for batch in batches:
                node = batch.column("node").to_numpy()
                for i, fp, keys in print_rows(batch, mine, blocks, equal):
                    cols = keys.view(np.int64).ravel(), np.repeat(fp, keys.shape[1]), np.repeat(node[i : i + 4096], keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "fp", "node"])

        cells = work.put(f"cells{turn}", nodes.select("node", "prints").mapInArrow(keyed, "key long, fp long, node long"))
        shared = cell_counts(cells).where("count > 1").withColumnRenamed("count", "n")
        met = work.put(f"met{turn}", cells.join(shared, "key"))
        work.drop(f"cells{turn}")
        small = met.where(F.col("n") <= FEW).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "node")
        part = work.put(f"links{turn}", solved(small, ["fp", "node"], lambda cell, cols: _edges(cols[0].view(np.uint64), cell, bits, blocks)).distinct())
        large = met.where(F.col("n") > FEW)
        out, wide = (part, large) if out is None else (out.union(part), wide.union(large))
    return out, wide


def around(wide: DataFrame) -> DataFrame:
    """wide with i, j: each row of a cell of more than ``CELL`` rows goes to one part, the smallest node to all."""
    n = F.ceil(F.col("n") / CELL).cast("int")
    one = F.lit(0).alias("i"), F.lit(0).alias("j")
    big = wide.where(F.col("n") > CELL)
    centre = big.groupBy("key").agg(F.min("node").alias("centre"))
    part = F.when(F.col("node") == F.col("centre"), F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), n).cast("int")))
    big = big.join(centre, "key").select("key", "fp", "node", F.explode(part).alias("i"), F.lit(1).alias("j"))
    return wide.where(F.col("n") <= CELL).select("key", "fp", "node", *one).union(big)


def across(work, wide: DataFrame, group: DataFrame) -> DataFrame:
    """The rows of cells of several components, with comp and i, j: two parts whose rows meet. group: (node, comp) of linked nodes.

    In a cell of more than ``CELL`` rows those of the largest component meet only the parts of the others.
    """
    rows = wide.select("key", "fp", "node").join(group, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = work.put("grouped", rows)
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    cell = each.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
    parts = lambda n: F.ceil(n / CELL).cast("int")
    cell = cell.where("comps > 1").select("key", "n", F.col("top.comp").alias("top"), parts(F.col("top.n")).alias("p"), parts(F.col("n") - F.col("top.n")).alias("q"))
    rows = work.put("several", rows.join(cell, "key"))
    first = F.col("comp") == F.col("top")
    at = F.when(first, F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), F.col("q"))).cast("int")
    big = rows.where(F.col("n") > CELL).withColumn("c", at)
    big = big.select("key", "fp", "node", "comp", "c", F.explode(F.sequence(F.when(first, F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)).alias("d"))
    big = big.select("key", "fp", "node", "comp", (F.least("c", "d") + 1).alias("i"), (F.greatest("c", "d") + 1).alias("j"))
    return rows.where(F.col("n") <= CELL).select("key", "fp", "node", "comp", F.lit(0).alias("i"), F.lit(0).alias("j")).union(big)


def crowd_links(nodes: DataFrame, rows: DataFrame, bits: int, blocks: int, least: float) -> DataFrame:
    """Edges (a, b) between nodes that meet in the cells of rows: a spanning forest of the links that the marks allow, or with a column comp all those between different components."""
    comp = "comp" in rows.columns
    names = ["node", "marks", *(["comp"] if comp else [])]

    def found(cell, cols):
        marks = np.frombuffer(b"".join(x or bytes(8 + MARKS) for x in cols[2]), np.uint64).reshape(len(cell), -1)
        return _crowd_edges(cols[0].view(np.uint64), cell, marks, cols[3] if comp else None, bits, blocks, least)

    return solved(rows.join(nodes.select("node", "marks"), "node"), ["fp", *names], found)


def verified_links(work, docs: DataFrame, nodes: DataFrame, bits: int, blocks: int, equal: int, least: float, width: int) -> DataFrame:
    """Edges (a, b) that connect the nodes whose texts have a similarity of at least ``least``, of those that cells bring together.

    A tree edge that fails the comparison takes its nodes' other links along, and the parts of a cell meet in one
    node only. So if there is either, the large cells are searched again for every link between what the verified
    edges leave apart. Nodes may lack marks; then only bits decide what is compared.
    """
    if "marks" not in nodes.columns:
        nodes = nodes.withColumn("marks", F.lit(None).cast("binary"))
    edges, wide = sketch_links(work, nodes, bits, blocks, equal)
    trees = work.put("trees", crowd_links(nodes, around(wide), bits, blocks, least).distinct())
    edges = work.put("edges", edges.union(trees).distinct())
    good = work.put("good", similar(work, docs, edges, nodes, least, width))
    if trees.join(good, ["a", "b"], "left_anti").isEmpty() and wide.where(F.col("n") > CELL).isEmpty():
        return good
    group = components(work, good, "first").select("node", F.col("component").alias("comp"))
    again = crowd_links(nodes, across(work, wide, group), bits, blocks, least).distinct()
    again = work.put("retried", again.join(edges, ["a", "b"], "left_anti"))
    work.drop("grouped", "several", *(f"met{turn}" for turn in range(ROUNDS)))
    stars = group.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))  # what the good edges connect, in a row a node
    return stars.union(work.put("better", similar(work, docs, again, nodes, least, width, "more_sets")))


def cell_counts(rows: DataFrame) -> DataFrame:
    parts = max(8, rows.count() // 250_000)  # nearly all keys are distinct: small hash tables, no partial sums
    return rows.repartition(parts, "key").groupBy("key").count()


def dealt(work, rows: DataFrame, name: str) -> DataFrame:
    """rows with i, j: the parts of its cell that a row meets in; 0, 0 in cells of up to ``CELL`` rows."""
    heavy = work.put("heavy", cell_counts(rows).where(F.col("count") > CELL).select("key", F.ceil(F.col("count") / CELL).cast("int").alias("n")))
    part = F.pmod(F.xxhash64(name), F.col("n")).cast("int")
    cols = [c for c in rows.columns if c != "key"]
    big = rows.join(heavy, "key").withColumn("c", part).select("key", *cols, "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("d"))
    big = big.select("key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), *cols)
    small = rows.join(heavy, "key", "left_anti").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), *cols)
    return small.union(big)


def cell_links(work, rows: DataFrame, bits: int, blocks: int) -> DataFrame:
    """Edges (a, b) between linked fingerprints; rows: key, fp. Cells of more than ``SMALL`` rows send a spanning forest."""
    return solved(dealt(work, rows, "fp"), ["fp"], lambda cell, cols: _edges(cols[0].view(np.uint64), cell, bits, blocks))


def solved(rows: DataFrame, cols: list[str], find) -> DataFrame:
    """Edges (a, b) by the second of cols (or the only one): find gives index pairs for whole cells of sorted rows."""

    def solve(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            cell = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], 1)
            last = np.flatnonzero((cell != cell[-1]).any(1)) if len(cell) else cell
            cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
            if cut:
                yield found(cell[:cut], table.slice(0, cut))
            rest = table.slice(cut).combine_chunks().to_batches()
            held = rest[0] if rest else None
        if held is not None:
            table = pa.Table.from_batches([held])
            yield found(np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], 1), table)

    def found(cell, table):
        have = [table.column(c).to_pylist() if c == "marks" else np.array(table.column(c).to_numpy()) for c in cols]
        a, b = find(cell, have)
        name = have[min(1, len(cols) - 1)]
        a, b = name[a], name[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt_rows = rows.select("key", "i", "j", *cols).repartition("key", "i", "j")
    return dealt_rows.sortWithinPartitions("key", "i", "j", *(c for c in cols if c != "marks")).mapInArrow(solve, "a long, b long")


def similar(work, docs: DataFrame, edges: DataFrame, nodes: DataFrame, least: float, width: int, name: str = "sets") -> DataFrame:
    """The edges whose texts (one for each node) have shingle sets with a Jaccard similarity of at least ``least``.

    Shingle sets are made only of texts that an edge names; nodes: a row (node, w) for each, w its first document.
    """
    named = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    one = nodes.join(named, "node", "left_semi").select("node", F.col("w.doc_id").alias("doc_id"), F.col("w.text_hash").alias("text_hash"))

    def sets(batches):
        for batch in batches:
            packed = [np.unique(np.array(shingle_hashes(t, width), np.uint64)).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "set"])

    text = docs.withColumn("text_hash", F.xxhash64(F.col("text").cast("string"))).join(one, ["doc_id", "text_hash"]).dropDuplicates(["node"])
    have = work.put(name, text.select("node", "text").mapInArrow(sets, "node long, set binary"))

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = edges.join(have.withColumnsRenamed({"node": "a", "set": "x"}), "a").join(have.withColumnsRenamed({"node": "b", "set": "y"}), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def labelled(docs: DataFrame, work, bits: int, width: int, blocks: int, equal: int, least: float | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp), and for each distinct fp its group, its first row w, and the component_id of the group."""
    if least is None:
        rows = work.put("prints", fingerprints(docs, id_col, text_col, width)).withColumn("node", F.col("fp"))
    else:
        rows = work.put("prints", sketches(doc_rows(docs, id_col, text_col), width, bits))
    first = F.min(F.struct("doc_id", "text_hash")).alias("w")
    nodes = work.put("fps", rows.groupBy("node").agg(first, *(F.first(c).alias(c) for c in ("prints", "marks") if least is not None)))
    if least is None:
        edges = links(work, nodes.select(F.col("node").alias("fp")), bits, blocks, equal)
    else:
        edges = verified_links(work, doc_rows(docs, id_col, text_col), nodes, bits, blocks, equal, least, width)
    group = components(work, edges)
    work.drop("cells")
    linked = group.join(nodes.select("node", "w"), "node")
    lows = linked.groupBy("component").agg(F.min("w.doc_id").alias("least"))
    linked = linked.join(lows, "component").select("node", "component", "least")
    label = nodes.select("node", "w").join(linked, "node", "left")
    label = label.select(F.col("node").alias("fp"), F.coalesce("component", "node").alias("group"), "w", F.coalesce("least", "w.doc_id").alias("component_id"))
    return rows.select("doc_id", "text_hash", F.col("node").alias("fp")), work.put("labels", label)


def near_groups(
    docs: DataFrame, work, bits: int = 4, width: int = 4, blocks: int = BLOCKS, equal: int = EQUAL, least: float | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, fp, group, component_id) of every row.

    group: the smallest fingerprint that links reach; component_id: the smallest doc_id there. least: the
    shingle similarity that the texts of linked, unequal fingerprints must have, if any.
    """
    rows, label = labelled(docs, work, bits, width, blocks, equal, least, id_col, text_col)
    return rows.join(label.drop("w"), "fp").select(real_id(), "text_hash", "fp", "group", real_id("component_id"))


def fp_text(name: str = "fp"):
    return F.lpad(F.lower(F.hex(name)), 16, "0")


def keep_one(docs: DataFrame, work, bits: int = 0, width: int = 5, blocks: int = 1, equal: int = 1, least: float = 0.8) -> DataFrame:
    """docs with one document of each group: the one with the smallest id (null ids last), then text.

    By default over five-word shingles. Two texts are compared if any of their ``PRINTS`` words, hashes of
    the least shingles under ``ORDERS`` orders, are equal: at a similarity of 0.8 all but 0.007 % of pairs.
    Nothing but a similarity of 0.8 or more links two texts. All columns stay. Of rows that repeat both id
    and text, one stays.
    """
    rows, label = labelled(docs, work, bits, width, blocks, equal, least, "doc_id", "text")
    # one row for each distinct text decides, so that a large group is no large task
    won = label.groupBy("group").agg(F.min("w").alias("w")).select(F.col("w.doc_id").alias("m_id"), F.col("w.text_hash").alias("m_hash"))
    again = rows.groupBy(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(F.count("*").alias("n"))
    won = work.put("won", won.join(again, ["m_id", "m_hash"]))
    kept = boxed(docs).withColumns(keys_of()).join(won, ["m_id", "m_hash"])
    return unboxed(kept.where("n = 1").union(kept.where("n > 1").dropDuplicates(["m_id", "m_hash"])))
