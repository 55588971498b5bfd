"""Operator 8: benchmark decontamination by template canonicalisation.

Words lose case and outer punctuation; numbers, units after numbers, and names (capitalised words, not in
capitals throughout, that open no sentence) become typed placeholders. Every window of ``WIDTH`` canonical words of the
benchmark is a row of a table of templates, and every window of every document is looked up in it by a hash join. Of a
document's hits on an item those stay whose slots agree: one value of the item always maps to one value of the
document, alignments with more hits first. An item leaks if the windows that stay cover at least ``COVER`` of its words.

Windows with more placeholders than literal words would match by chance; they are compared by their words as they are.
The documents are scanned once: a bitmap of the templates' hashes (at most 2^``BITS`` bits, whatever the benchmark holds) lets
only windows through that may have a partner, and those are shuffled. Template rows are repeated over ``SALTS`` salts, so a
window that a third of all documents hold is many tasks; a small table is broadcast instead, behind a check of its rows. A
window that more than ``COMMON`` items hold makes pairs only with items that such windows alone can cover, and for pairs
that rarer windows bring together: no pair is lost, and common phrases do not multiply documents by items.

Items of 4 to WIDTH - 1 words are one window; shorter ones say too little to be a leak and match nothing. Null or empty texts
match nothing; repeated documents give a row each, repeated items (also under one id) are items of their own. Rows with a null
doc_id keep it; null item ids are kept too. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Work, boxed, key_columns, keys_of, mix, table, texts, unboxed

WIDTH, COVER, SHORTEST, PIECE = 8, 0.5, 4, 2 << 20
BITS, PAGE, SALTS, COMMON, BROADCAST = 29, 18, 16, 64, 100_000
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
# fixed values: unit names, after a number
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent degree degrees mph kph w kw v a hz khz mhz ghz kb mb gb tb j kj cal kcal".split()
)
_NUMBER = re.compile(r"[-+±]?[$€£¥]?[-+]?\d[\d.,:/]*(?:e[-+]?\d+)?(?:%|°|st|nd|rd|th)?$|^[$€£¥]?\d[\d.,]*[a-z%°]{1,4}$", re.I)
_OUTER = "\"'“”‘’«»„()[]{}<>.,;:!?¡¿…*_`~|-–—"
_PLACE = {k: np.uint64(xxhash.xxh64_intdigest(bytes([0, k]), 11)) for k in (NUMBER, UNIT, NAME)}


def _kind(word: bytes) -> tuple[int, int, bool, bool]:
    """(literal code, kind by itself, may be a unit, ends a sentence)."""
    w = word.decode("utf-8", "replace")
    core = w.strip(_OUTER)
    low = core.casefold()
    kind = NUMBER if _NUMBER.match(core) else NAME if core[:1].isupper() and not core.isupper() else LITERAL
    return xxhash.xxh64_intdigest(low.encode(), 11), kind, low in UNITS, w.rstrip("\"'”’»)]")[-1:] in (".", "!", "?", ":") or not core


class Canonical:
    """Canonical codes and kinds of the words of some texts."""

    def __init__(self, some: list[bytes]):
        self.words: list[bytes] = []
        ends = []
        for t in some:
            self.words += t.split()
            ends.append(len(self.words))
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if ends else self.ends
        place = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        each = [_kind(w) for w in place]
        at = np.fromiter(map(place.__getitem__, self.words), np.int64, len(self.words))
        code, kind, unit, stop = (np.array([e[i] for e in each], t) for i, t in enumerate((np.uint64, np.int8, bool, bool)))
        self.literal, kind = code[at], kind[at]
        opens = np.ones(len(at), bool)
        opens[1:] = stop[at][:-1]
        opens[self.starts[self.starts < len(at)]] = True
        after = np.zeros(len(at), bool)
        after[1:] = kind[:-1] == NUMBER
        after[self.starts[self.starts < len(at)]] = False
        kind = np.where((kind == NAME) & opens, LITERAL, kind)
        self.kind = np.where(unit[at] & after, UNIT, kind).astype(np.int8)
        self.code = self.literal.copy()
        for k, v in _PLACE.items():
            self.code[self.kind == k] = v

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, key, text) of every window within a text; the key of a window of mostly placeholders has its words."""
        n = max(0, len(self.code) - width + 1)
        doc = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)[:n]
        at = np.flatnonzero(np.arange(n) + width <= self.ends[doc])
        slots = np.append(0, np.cumsum(self.kind != LITERAL))
        key = Rolling(self.code).windows(width)[at]
        bare = 2 * (slots[at + width] - slots[at]) > width
        if bare.any():
            key[bare] = mix(Rolling(self.literal).of(at[bare], at[bare] + width) ^ _BARE)
        return at, mix(key + np.uint64(width)), doc[at]

    def slices(self, at: np.ndarray, width: int) -> list[bytes]:
        """The literal codes of some windows."""
        rows = self.literal[at[:, None] + np.arange(width)] if len(at) else np.zeros((0, width), np.uint64)
        return [r.tobytes() for r in rows]


_BARE = np.uint64(0xD1B54A32D192ED03)
_TEMPLATE = {"key": pa.int64(), "width": pa.int32(), "item": pa.int64(), "item_id": pa.int64(), "size": pa.int64(), "a": pa.int64(), "kinds": pa.binary(), "said": pa.binary()}
_WINDOW = {"key": pa.int64(), "doc": pa.int64(), "doc_id": pa.int64(), "text_hash": pa.int64(), "d": pa.int64(), "words": pa.binary()}
_LEAK = {"doc_id": pa.int64(), "text_hash": pa.int64(), "item_id": pa.int64(), "item_words": pa.int64(), "matched_words": pa.int64(), "changed_slots": pa.int64()}
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def _ddl(schema: dict) -> str:
    return ", ".join(f"{k} {_DDL[t]}" for k, t in schema.items())


def _pieces(batches):
    """Some texts at a time, with the row numbers that this task gives them."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        some, lo, size = texts(batch), 0, 0
        for i, t in enumerate(some):
            size += len(t)
            if size >= PIECE or i == len(some) - 1:
                yield batch.slice(lo, i + 1 - lo), some[lo : i + 1], row + lo
                lo, size = i + 1, 0
        row += len(some)


def template_rows(items: DataFrame) -> DataFrame:
    """The windows of all items: key, width, item (a row's own number), item_id, size, place, kinds and words."""

    def run(batches):
        for batch, some, row in _pieces(batches):
            c, ids = Canonical(some), batch.column("item_id").to_pylist()
            size = c.ends - c.starts
            for width in range(SHORTEST, WIDTH + 1):
                at, key, item = c.windows(width)
                keep = size[item] >= width if width == WIDTH else size[item] == width
                at, key, item = at[keep], key[keep], item[keep]
                kinds = [c.kind[i : i + width].tobytes() for i in at.tolist()]
                cols = key.view(np.int64), np.full(len(at), width, np.int32), row + item, [ids[i] for i in item.tolist()], size[item], at - c.starts[item], kinds, c.slices(at, width)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, _TEMPLATE.values(), strict=True)], names=list(_TEMPLATE))

    return items.mapInArrow(run, _ddl(_TEMPLATE))


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Two bits a key in 2^bits, built page by page on the executors; its size is the bound."""
    page = min(bits, PAGE)
    low = F.lit((1 << bits) - 1)
    spots = keys.select(F.explode(F.array(F.col("key").bitwiseAND(low), F.shiftright("key", 32).bitwiseAND(low))).alias("at")).distinct()
    spots = spots.select(F.shiftright("at", page).alias("page"), "at")

    def fill(batches):
        now, bit = None, None
        for batch in batches:
            pages, at = batch.column("page").to_numpy(), batch.column("at").to_numpy() & ((1 << page) - 1)
            for p in np.unique(pages).tolist():
                if p != now:
                    if bit is not None:
                        yield table({"page": pa.int64(), "bit": pa.binary()}, [(now, np.packbits(bit).tobytes())])
                    now, bit = p, np.zeros(1 << page, np.uint8)
                bit[at[pages == p]] = 1
        if bit is not None:
            yield table({"page": pa.int64(), "bit": pa.binary()}, [(now, np.packbits(bit).tobytes())])

    out = np.zeros((1 << bits - page, (1 << page) // 8), np.uint8)
    for p, bit in spots.repartition("page").sortWithinPartitions("page").mapInArrow(fill, "page long, bit binary").collect():
        out[p] = np.frombuffer(bit, np.uint8)
    return out.ravel()


def agreeing(hits, size: int, cover: float) -> tuple[int, int] | None:
    """(matched words, changed slots) of one document and one item, or None where too little agrees.

    hits: (place in the document, place in the item, kinds, the item's words, the document's words).
    """
    if WIDTH * len({a for _, a, *_ in hits}) < cover * size:  # no window covers more
        return None
    support = Counter(d - a for d, a, *_ in hits)
    slot: dict[tuple[int, int], int] = {}
    covered: set[int] = set()
    changed: set[int] = set()
    for _, a, kinds, said, words in sorted(hits, key=lambda x: (-support[x[0] - x[1]], x[0] - x[1], x[0])):
        said, words = np.frombuffer(said, np.uint64).tolist(), np.frombuffer(words, np.uint64).tolist()
        new = {}
        for kind, x, y in zip(kinds, said, words, strict=True):
            if kind and slot.get((kind, x), new.setdefault((kind, x), y)) != y or kind and new[kind, x] != y:
                break
        else:
            slot |= new
            covered.update(range(a, a + len(said)))
            changed.update(a + o for o, (x, y) in enumerate(zip(said, words, strict=True)) if x != y)
    return (len(covered), len(changed)) if len(covered) >= cover * size else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, work: Work | None = None, cover: float = COVER) -> DataFrame:
    """(doc_id, text_hash, item_id, item_words, matched_words, changed_slots) of each document that holds an item."""
    spark = docs.sparkSession
    work = work or Work(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    found = work.put("templates", template_rows(items))
    n = found.count()
    bits = min(BITS, max(16, (64 * n).bit_length()))
    filter_ = spark.sparkContext.broadcast((bits, bitmap(found.select("key"), bits), [w for w, in found.select("width").distinct().collect()]))

    def run(batches):
        bits, seen, widths = filter_.value
        low = np.uint64((1 << bits) - 1)

        def has(spot):
            spot = (spot & low).astype(np.int64)
            return seen[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1 > 0

        for batch, some, row in _pieces(batches) if widths else ():
            c, ids, hashes = Canonical(some), batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            for width in widths:
                at, key, doc = c.windows(width)
                may = has(key)
                at, key, doc = at[may], key[may], doc[may]
                may = has(key >> np.uint64(32))
                at, key, doc = at[may], key[may], doc[may]
                cols = key.view(np.int64), row + doc, [ids[i] for i in doc.tolist()], [hashes[i] for i in doc.tolist()], at - c.starts[doc], c.slices(at, width)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, _WINDOW.values(), strict=True)], names=list(_WINDOW))

    windows = work.put("windows", rows.mapInArrow(run, _ddl(_WINDOW)))
    names = work.put("common", found.groupBy("key").agg(F.count_distinct("item").alias("items")).where(F.col("items") > COMMON).select("key"))

    def met(some: DataFrame) -> DataFrame:
        if n <= BROADCAST:
            return windows.join(F.broadcast(some), "key")
        salted = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return windows.withColumn("salt", F.pmod(F.xxhash64("doc", "d"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")

    if names.isEmpty():
        hits = met(found)
    else:
        common, rare = found.join(names, "key", "left_semi"), met(found.join(names, "key", "left_anti"))
        reach = F.least(F.col("size"), F.lit(WIDTH) * F.count_distinct("a"))  # no more words can be covered
        alone = common.groupBy("item", "size").agg(reach.alias("reach")).where(F.col("reach") >= cover * F.col("size")).select("item")
        by_common = met(common.join(alone, "item", "left_semi"))
        pairs = rare.select("doc", "item").distinct().join(alone, "item", "left_anti")
        others = pairs.join(common, "item").join(windows, ["doc", "key"])
        cols = [*_WINDOW, *(c for c in _TEMPLATE if c != "key")]
        hits = rare.select(cols).union(by_common.select(cols)).union(others.select(cols))

    def judge(batches):
        each = (r for batch in batches for r in batch.to_pylist())
        for _, group in itertools.groupby(each, lambda r: (r["doc"], r["item"])):
            group = list(group)
            r = group[0]
            if got := agreeing([(x["d"], x["a"], x["kinds"], x["said"], x["words"]) for x in group], r["size"], cover):
                yield table(_LEAK, [(r["doc_id"], r["text_hash"], r["item_id"], r["size"], *got)])

    hits = hits.repartition("doc", "item").sortWithinPartitions("doc", "item", "d", "a")
    return hits.mapInArrow(judge, _ddl(_LEAK))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, work) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay."""
    bad = work.put("leaks", key_columns(find_leaks(docs, benchmark, work)).select("m_id", "m_hash").distinct())
    return unboxed(boxed(docs).withColumns(keys_of()).join(bad, ["m_id", "m_hash"], "left_anti"))
