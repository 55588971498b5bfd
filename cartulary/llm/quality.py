"""Operator 4: quality classifier by an interpolated modified Kneser-Ney character n-gram model.

The model (order ``ORDER``) learns from trusted text: labelled quality 1 and not toxic. Counts, the
continuation counts of lower orders, context totals and discounts are Spark aggregates, and the
probabilities of each order are joins of count tables that are sharded by n-gram; a text then gets its
perplexity per character and a peak, the perplexity of its ``PEAK`` most surprising characters (of as many
in each ``SPAN`` of a longer text, so that the peak does not grow with length), where a few foreign words in
sound prose (insults, markup, keys) show that the whole text's mean hides. A
document goes if either lies outside its language's and length class's quantiles of trusted text,
widened by a margin.

All trusted text is learned from. A hash of the id deals documents into ``FOLDS`` halves with a model each,
and a document is scored by the model of the other half, so that every trusted document counts both in a
model and in the quantiles, and none is judged by itself. All texts are scored whole. The models are sent to
the scoring tasks: their n-grams of ``ORDER`` characters grow by about a fifth when the text doubles.
Words of one symbol repeated are no n-gram surprise, so the lower quantile catches them.

Nulls: a null or blank text has no perplexity and goes. A null language is a class of its own; classes
of fewer than 30 trusted documents use their length's quantiles over all languages, or else those of
all trusted text; with no trusted text at all, nothing else goes. Repeated labels of one document count as the least of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, key_columns, keys_of, texts, unboxed

ORDER, FOLDS, SYMBOLS, PIECE = 5, 2, 254, 1 << 20
LOW_Q, HIGH_Q, MARGIN, PEAK, SPAN, BROADCAST_ROWS = 0.001, 0.999, 0.02, 5, 4096, 10_000
_MASK = [np.uint64((1 << (8 * k)) - 1) for k in range(ORDER + 1)]


class Alphabet:
    """One-byte codes for the most frequent characters; 255 for the others, 0 before a text."""

    def __init__(self, points: list[int]):
        self.points = np.sort(np.array(points[:SYMBOLS], np.uint32))

    def codes(self, text: bytes) -> np.ndarray:
        c = np.frombuffer(b" ".join(text.split()).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if not len(self.points):
            return np.full(len(c), 255, np.uint8)
        at = np.minimum(np.searchsorted(self.points, c), len(self.points) - 1)
        return np.where(self.points[at] == c, at + 1, 255).astype(np.uint8)


def ngrams(alphabet: Alphabet, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of these texts, and each text's length."""
    parts, size = [], []
    pad = np.zeros(ORDER - 1, np.uint8)
    for t in some:
        c = alphabet.codes(t)
        size.append(len(c))
        parts += [pad, c]
    c = np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64)
    size = np.array(size, np.int64)
    code = c.copy()
    for k in range(1, ORDER):
        code[k:] |= c[:-k] << np.uint64(8 * k)
    real = np.ones(len(c), bool)
    head = np.cumsum(size + ORDER - 1) - size - (ORDER - 1)
    for k in range(ORDER - 1):
        real[head + k] = False
    return code[real], size


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of documents whose labels all say quality 1 and not toxic."""
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(good.alias("good")).where("good = 1").select(F.col("doc_id").cast("long").alias("t_id"))


def _discounted(table: DataFrame) -> DataFrame:
    """table (code, c) with the share of its own mass and its context's left-over mass."""
    n = table.agg(*(F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [max(0.05, min(k + 0.95, k + 1 - (k + 2) * y * n[k + 1] / n[k])) if n[k] else 0.5 * (k + 1) for k in range(3)]
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    ctx = F.shiftright("code", 8)
    sums = table.groupBy(ctx.alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("left"))
    return table.join(sums, ctx == F.col("h")).select("code", "h", ((F.col("c") - cut) / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("gamma"))


def _fold(name: str = "doc_id"):
    return F.pmod(F.xxhash64(name, F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")


def _trusted_text(docs: DataFrame, good: DataFrame, work) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(good, F.col("doc_id") == F.col("t_id"), "left_semi")
    return work.put("trusted", text.select(_fold(), "text"))


def alphabet_of(text: DataFrame) -> Alphabet:
    def points(batches):
        for batch in batches:
            c = np.frombuffer(b" ".join(texts(batch)).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            u, n = np.unique(c, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n)], names=["p", "n"])

    chars = text.select("text").mapInArrow(points, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    return Alphabet([p for p, _ in chars.orderBy(F.desc("n"), "p").limit(SYMBOLS).collect()])


def train(docs: DataFrame, good: DataFrame, work):
    """(alphabet, model) of all trusted text. The model has, per order: codes, probabilities, contexts, their left-over mass."""
    text = _trusted_text(docs, good, work)
    alphabet = alphabet_of(text)
    return alphabet, _model(text.select("text"), alphabet, work)


def train_folds(docs: DataFrame, good: DataFrame, work):
    """(alphabet, a model for each fold, learned from the trusted text of the others)."""
    text = _trusted_text(docs, good, work)
    alphabet = alphabet_of(text)
    return alphabet, [_model(text.where(F.col("fold") != k).select("text"), alphabet, work, f"_{k}") for k in range(FOLDS)]


def _model(text: DataFrame, alphabet: Alphabet, work, name: str = ""):
    def count(batches):
        for some in pieces(t for batch in batches for t in texts(batch)):
            u, n = np.unique(ngrams(alphabet, some)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n)], names=["code", "c"])

    tables = {ORDER: work.put(f"c{ORDER}{name}", text.mapInArrow(count, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")))}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer n-grams it ends one
        short = F.col("code").bitwiseAND(F.lit(int(_MASK[k])))
        tables[k] = work.put(f"c{k}{name}", tables[k + 1].groupBy(short.alias("code")).agg(F.count("*").alias("c")))
    model, lower = [], None
    for k in range(1, ORDER + 1):
        part = _discounted(tables[k])
        if lower is None:
            part = part.withColumn("p", F.col("own") + F.col("gamma") / 256)
        else:
            suffix = F.col("code").bitwiseAND(F.lit(int(_MASK[k - 1])))
            part = part.join(lower.select(F.col("code").alias("s"), F.col("p").alias("q")), suffix == F.col("s")).withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        lower = work.put(f"p{k}{name}", part.select("code", "h", "gamma", "p"))
        rows = lower.orderBy("code").toArrow()
        code, h, gamma, p = (rows.column(c).to_numpy() for c in ("code", "h", "gamma", "p"))
        ctx, first = np.unique(h, return_index=True)
        model.append((code.astype(np.uint64), p.astype(np.float32), ctx.astype(np.uint64), gamma[first].astype(np.float32)))
    return model


def pieces(some: list[bytes]):
    """Texts in lists of about PIECE bytes."""
    held, size = [], 0
    for t in some:
        held.append(t)
        size += len(t)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


def surprise(model, code: np.ndarray) -> np.ndarray:
    """-log2 of each n-gram's probability."""
    every, place = np.unique(code, return_inverse=True)
    p = np.full(len(every), 1 / 256)
    for k, (codes, probs, ctx, gamma) in enumerate(model, 1):
        gram = every & _MASK[k]
        at, seen = _find(codes, gram)
        c_at, c_seen = _find(ctx, gram >> np.uint64(8))
        if len(codes):
            p = np.where(seen, probs[at], np.where(c_seen, gamma[c_at] * p, p))
    return -np.log2(np.maximum(p, 1e-30))[place]


def perplexities(docs: DataFrame, alphabet: Alphabet, models) -> DataFrame:
    """docs (doc_id, text, fold, ...) with bits per character and at the peak, null for blank texts, in place of the text."""
    handle = docs.sparkSession.sparkContext.broadcast((alphabet, models))
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        alphabet, models = handle.value
        for batch in batches:
            bits: list[float | None] = []
            peak: list[float | None] = []
            fold = batch.column("fold").to_numpy()
            for some in pieces(texts(batch)):
                code, size = ngrams(alphabet, some)
                whose, at = np.repeat(fold[len(bits) : len(bits) + len(some)], size), 0
                each = np.zeros(len(code))
                for k, model in enumerate(models):
                    each[whose == k] = surprise(model, code[whose == k])
                for n in size.tolist():
                    mine = each[at : at + n]
                    at += n
                    bits.append(float(mine.mean()) if n else None)
                    top = min(n, max(PEAK, PEAK * n // SPAN))
                    peak.append(float(np.partition(mine, n - top)[-top:].mean()) if n else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(bits, pa.float64()), pa.array(peak, pa.float64())], names=[*rest, "bits", "peak"])

    fields = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text")
    return docs.select(*rest, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{fields}, bits double, peak double")


def judge(docs: DataFrame, labels: DataFrame, work) -> DataFrame:
    """(doc_id, text_hash, perplexity, peak, low, high, high_peak, keep) of every document."""
    good = work.put("good", trusted(docs, labels))
    alphabet, models = train_folds(docs, good, work)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    size = F.least(F.lit(12), F.floor(F.log2(F.greatest(F.length("text"), F.lit(1))))).cast("int")
    scored = work.put("scored", perplexities(rows.withColumns({"size": F.coalesce(size, F.lit(0)), "fold": _fold()}), alphabet, models))
    sure = scored.where("bits is not null").join(good, F.col("doc_id") == F.col("t_id"), "left_semi")
    names = {"low": ("bits", LOW_Q), "high": ("bits", HIGH_Q), "high_peak": ("peak", HIGH_Q)}
    edge = {n: F.percentile_approx(c, F.lit(q), F.lit(10_000)) for n, (c, q) in names.items()}
    bounds = sure.groupBy(F.coalesce("lang", F.lit("")).alias("b_lang"), F.col("lang").isNull().alias("b_null"), F.col("size").alias("b_size")).agg(*(e.alias(n) for n, e in edge.items()), F.count("*").alias("n")).where("n >= 30").drop("n")
    bounds = work.put("bounds", bounds)
    if bounds.count() <= BROADCAST_ROWS:  # else an ordinary join, whose large side Spark can split
        bounds = F.broadcast(bounds)
    every = sure.groupBy(F.col("size").alias("a_size")).agg(*(e.alias(f"a_{n}") for n, e in edge.items()), F.count("*").alias("n")).where("n >= 30").drop("n")
    overall = sure.agg(*(e.alias(n) for n, e in edge.items())).first()
    key = (F.coalesce("lang", F.lit("")) == F.col("b_lang")) & (F.col("lang").isNull() == F.col("b_null")) & (F.col("size") == F.col("b_size"))
    out = scored.join(bounds, key, "left").join(F.broadcast(every), F.col("size") == F.col("a_size"), "left")
    low, high, top = (F.coalesce(n, f"a_{n}", F.lit(overall[n]).cast("double")) * (1 + m) for n, m in (("low", -MARGIN), ("high", MARGIN), ("high_peak", MARGIN)))
    keep = F.col("bits").isNotNull() & F.coalesce(F.col("bits").between(low, high) & (F.col("peak") <= top), F.lit(True))
    two = {"perplexity": F.col("bits"), "peak": F.col("peak"), "low": low, "high": high, "high_peak": top}
    return out.select("doc_id", "text_hash", *(F.pow(F.lit(2.0), c).alias(n) for n, c in two.items()), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, work) -> DataFrame:
    """docs that the classifier keeps; all columns stay."""
    bad = key_columns(judge(docs, labels, work).where("not keep")).select("m_id", "m_hash").distinct()
    return unboxed(boxed(docs).withColumns(keys_of()).join(bad, ["m_id", "m_hash"], "left_anti"))
