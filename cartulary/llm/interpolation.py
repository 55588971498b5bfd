"""Operator 7: language-model scoring by deleted interpolation.

P(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1), with weights per bucket of context
frequency (the bit length of c(h)). Counts cover every word and word pair of all training documents:
chunks of documents send their distinct words and pairs with counts to buckets of the hash space, and
get back the corpus counts. Weights are learned by expectation-maximisation on held-out counts: a
tenth of the training documents is deleted from the counts that its own tokens are judged by; what
reaches the driver is a histogram with a fixed number of cells.

Nulls: a null text is the empty text (one token, the end). Documents with a null id are scored, never
learned from. With nothing to learn from, every token has probability 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    ASK_SCHEMA, NO_ID, Chunk, ChunkWords, answered, asked, bucket_count, enc, mix, pack_chunks, real_id, reply_array,
    total_bytes, uniques, with_replies, word_code,
)

END, BEGIN = word_code(b" "), word_code(b"\n")  # no word holds white space
ONE, PAIR, TOTALS = 0, 1, 9
FREQS, LEVELS = 25, 128  # buckets of context frequency; steps of a quarter bit per probability
_COUNT = np.dtype([("all", "<i8"), ("held", "<i8")])


class Tokens:
    """Lower-cased words of a chunk, each document closed by an end token."""

    def __init__(self, chunk: Chunk, parts: int, tune: int):
        words = ChunkWords(chunk, lower=True)
        code = np.insert(words.code, words.doc_end, END)
        self.ends = words.doc_end + np.arange(1, len(words.doc_end) + 1)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        crc = np.array([zlib.crc32(str(i).encode()) if i != NO_ID else 0 for i in chunk.ids.tolist()], np.int64)
        size = self.ends - self.starts
        self.learn = np.repeat(crc % parts != 0, size)
        self.tune = self.learn & np.repeat(crc // parts % tune == 0, size)
        before = np.empty_like(code)
        before[1:] = code[:-1]
        before[self.starts] = BEGIN
        self.opening = np.zeros(len(code), bool)
        self.opening[self.starts] = True
        self.ones, self.at = uniques(code)
        self.pairs, self.pair_at = uniques(mix(before * np.uint64(0xD1342543DE82EF95) + code))

    def asks(self, number: int, buckets: int):
        for part, keys, at in ((ONE, self.ones, self.at), (PAIR, self.pairs, self.pair_at)):
            vals = np.zeros(len(keys), _COUNT)
            vals["all"] = np.bincount(at[self.learn], minlength=len(keys))
            vals["held"] = np.bincount(at[self.tune], minlength=len(keys))
            yield from asked(number, part, keys, vals, buckets)

    def counts(self, got, buckets: int, rest: bool):
        """(c(h, w), c(h), c(w)) of every token; rest: without the held-out documents."""
        none = np.zeros((), _COUNT)
        value = lambda c: c["all"] - c["held"] if rest else c["all"]
        one = value(reply_array(self.ones, got.get(ONE, []), buckets, none, _COUNT))
        pair = value(reply_array(self.pairs, got.get(PAIR, []), buckets, none, _COUNT))
        w = one[self.at]
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[self.opening] = one[np.searchsorted(self.ones, END)]  # each document begins and ends once
        return pair[self.pair_at], h, w


def _sum_counts(bucket):
    """Corpus counts for every request, and the bucket's totals."""
    for part in (ONE, PAIR):
        mine = [x for x in bucket if x[1] == part]
        if not mine:
            continue
        keys, at = uniques(np.concatenate([k for _, _, k, _ in mine]))
        vals = np.concatenate([v for _, _, _, v in mine])
        total = np.zeros(len(keys), _COUNT)
        for name in _COUNT.names:
            np.add.at(total[name], at, vals[name])
        if part == ONE:
            yield -1, TOTALS, b"%d %d %d" % (total["all"].sum(dtype=np.int64), total["held"].sum(dtype=np.int64), (total["all"] > 0).sum())
        i = 0
        for chunk, _, k, _ in mine:
            yield chunk, part, enc(total[at[i : i + len(k)]])
            i += len(k)


def freq(c: np.ndarray) -> np.ndarray:
    """The bucket of a context count: 0 for none, else its bit length."""
    return np.minimum(np.frexp(c.astype(np.float64))[1] * (c > 0), FREQS - 1).astype(np.int64)


def _level(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-4 * np.log2(p)), 0, LEVELS - 2), LEVELS - 1).astype(np.int64)


def learn_weights(cells: dict[int, int], v: int, rounds: int = 200) -> np.ndarray:
    """Weights (bucket x [pair, word, uniform]) by EM on a histogram of held-out tokens."""
    cell = np.array(list(cells), np.int64)
    n = np.array(list(cells.values()), np.float64)
    prob = np.append(2.0 ** (-np.arange(LEVELS - 1) / 4), 0.0)
    b = cell // (LEVELS * LEVELS)
    p = np.stack([prob[cell // LEVELS % LEVELS], prob[cell % LEVELS], np.full(len(cell), 1 / (v + 1))], 1)

    def em(some: np.ndarray, w: np.ndarray) -> np.ndarray:
        prior = w.copy()
        for _ in range(rounds):
            share = w * p[some]
            share /= share.sum(1, keepdims=True)
            new = n[some] @ share + prior  # a single token's worth of prior keeps every weight above zero
            new /= new.sum()
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        return new

    flat = em(np.arange(len(cell)), np.array([0.3, 0.4, 0.3])) if len(cell) else np.array([0.3, 0.5, 0.2])
    return np.array([em(np.flatnonzero(b == k), flat) if (b == k).any() else flat for k in range(FREQS)])


def score(docs: DataFrame, work, parts: int = 10, tune: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns from documents whose crc32(id as text) mod parts is not 0.
    """
    chunks = pack_chunks(work, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    size = total_bytes(chunks)
    buckets = bucket_count(size)

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from Tokens(Chunk.of(row), parts, tune).asks(row["chunk"], buckets)

    counts = work.put("counts", answered(chunks.mapInArrow(ask, ASK_SCHEMA), buckets, {ONE: _COUNT, PAIR: _COUNT}, _sum_counts))
    field = F.split(F.col("reply").cast("string"), " ")
    total = counts.where("chunk = -1").agg(*(F.sum(field[i].cast("long")) for i in range(3))).first()
    n, held, v = (x or 0 for x in total)

    def histogram(chunk: Chunk, got):
        t = Tokens(chunk, parts, tune)
        if not t.tune.any():
            return
        hw, h, w = (c[t.tune] for c in t.counts(got, buckets, rest=True))
        cell = (freq(h) * LEVELS + _level(hw / np.maximum(h, 1))) * LEVELS + _level(w / max(1, n - held))
        keys, count = np.unique(cell, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count)], names=["cell", "n"])

    cells = with_replies(chunks, counts, size, histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    weights = learn_weights({c: k for c, k in work.put("cells", cells).collect()}, v) if n else np.tile([0.0, 0.0, 1.0], (FREQS, 1))

    def scored(chunk: Chunk, got):
        t = Tokens(chunk, parts, tune)
        hw, h, w = t.counts(got, buckets, rest=False)
        l2, l1, l0 = weights[freq(h)].T
        p = l2 * hw / np.maximum(h, 1) + l1 * w / max(1, n) + l0 / (v + 1)
        base = np.log10((w + 0.1) / (n + 0.1 * (v + 1)))
        add = lambda x: np.add.reduceat(x, t.starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.ids), pa.array(t.ends - t.starts), pa.array(add((w > 0).astype(np.int64))), pa.array(np.full(len(t.ends), n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    out = with_replies(chunks, counts, size, scored, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", real_id())
