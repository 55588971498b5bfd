"""Operator 6: language identification by a blended-spectrum string kernel.

A text is the set of its character 1-, 2- and 3-grams (presence, not counts), lower-cased. The kernel
of two texts is the size of their common set over the root of the product of their sizes. Nyström
landmarks (a bounded sample of labelled texts) give explicit features, and one-versus-rest kernel
ridge regression on a bounded labelled sample gives one weight per landmark and language. Because
the kernel is linear in n-gram presence, landmarks and weights fold into one matrix n-gram x
language; scoring is the product of a batch's presence matrix with it.

The fit uses about ``PER_LANG`` texts of each language, fewer where that would be more than ``FIT_ROWS`` in all
(chosen by a hash of the id), of up to ``LONGEST`` characters where a language has such texts. So what reaches the driver is
bounded, and no language is left out. Every text is scored whole. ``und`` with score 0: a null text, one
without a letter, or nothing to learn from. Rows with a null id are scored, never learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_LANG, LANDMARKS, FIT_ROWS, LONGEST, RIDGE = 200, 50, 8000, 20_000, 1e-3
CELLS = 8_000_000  # of the presence matrix of a batch


def grams(text: str) -> np.ndarray:
    """Sorted codes of the distinct 1- to 3-grams."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:] if len(c) > 2 else np.zeros(0, np.uint64)
    return np.unique(np.concatenate([c, two, three]))


def split(id_col: str = "doc_id", parts: int = 3):
    """crc32 of the id as text, mod parts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, n-gram codes, weight of each n-gram for each language)."""
    names = sorted(set(langs))
    sets = [grams(t) for t in texts]
    most = max(1, min(LANDMARKS, FIT_ROWS // 4 // len(names)))
    marks = [i for n in names for i in [j for j, x in enumerate(langs) if x == n][:most]]
    codes = np.unique(np.concatenate([sets[i] for i in marks]))
    have = np.zeros((len(codes), len(marks)), np.float32)
    for k, i in enumerate(marks):
        have[np.searchsorted(codes, sets[i]), k] = 1
    norm = np.sqrt(have.sum(0))

    def kernel(some: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(some), len(marks)))
        for r, s in enumerate(some):
            at = np.minimum(np.searchsorted(codes, s), len(codes) - 1)
            rows[r] = have[at[codes[at] == s]].sum(0) / norm / np.sqrt(max(1, len(s)))
        return rows

    value, vec = np.linalg.eigh(kernel([sets[i] for i in marks]))
    keep = value > 1e-8 * value[-1]
    root = vec[:, keep] / np.sqrt(value[keep])  # Nyström: features = kernel to landmarks @ root
    z = kernel(sets) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = np.array([1 / langs.count(x) for x in langs])[:, None] * len(langs) / len(names)
    w = np.linalg.solve(z.T @ (weight * z) + RIDGE * len(texts) * np.eye(z.shape[1]), z.T @ (weight * y))
    return names, codes, ((have / norm) @ (root @ w)).astype(np.float32)


def training_rows(docs: DataFrame) -> list:
    """A bounded sample of labelled texts, each language at its own rate: texts of up to LONGEST characters, and of a language that has none, pieces of LONGEST characters from anywhere in a text."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    short = F.length("text") <= LONGEST
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("short"), F.count("*").alias("all")).orderBy("lang").collect()
    if not counts:
        return []
    per = max(1, min(PER_LANG, FIT_ROWS // len(counts)))
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, (1.2 * per + 8) / (r.short or r["all"])))])
    begin = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.length("text") - LONGEST) + 1
    piece = F.when(short, F.col("text")).otherwise(F.substring(F.col("text"), begin.cast("int"), LONGEST))
    only_long = F.array(*[F.lit(r.lang) for r in counts if not r.short]).cast("array<string>")
    picked = rows.where((short | F.array_contains(only_long, F.col("lang"))) & (spot < F.element_at(rate, F.col("lang")))).select("lang", piece.alias("text"), spot.alias("spot"))
    # never more than a bounded number of rows to the driver, whatever the hash does
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "text"))
    return picked.withColumn("k", rank).where(F.col("k") <= per).orderBy("lang", "k").collect()


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) of docs, learned from train's text and lang."""
    rows = training_rows(train)
    model = fit([r.text for r in rows], [r.lang for r in rows]) if rows else None
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = handle.value
        for batch in batches:
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            todo, sets = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text and model and any(map(str.isalpha, text)):
                    todo.append(i)
                    sets.append(grams(text))
            if todo:
                names, codes, weight = model
                sizes = np.array([len(s) for s in sets])
                have = np.zeros((len(sets), len(codes)), np.float32)
                for row, s in zip(have, sets, strict=True):
                    at = np.minimum(np.searchsorted(codes, s), len(codes) - 1)
                    row[at[codes[at] == s]] = 1
                f = (have @ weight).astype(np.float64) / np.sqrt(sizes)[:, None]
                e = np.exp(4 * (f - f.max(1, keepdims=True)))
                best = f.argmax(1)
                for i, b, p in zip(todo, best.tolist(), (e.max(1) / e.sum(1)).tolist(), strict=True):
                    pred[i], score[i] = names[b], p
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    def small(batches):  # as many texts at a time as their presence matrix allows
        step = max(1, min(256, CELLS // max(1, len(handle.value[1])))) if handle.value else 256
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                yield from run([batch.slice(i, step)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(small, "doc_id long, lang_pred string, score double")
