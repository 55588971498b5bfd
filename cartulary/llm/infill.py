"""Operator 12: fill-in-middle cuts at unit boundaries, found by rank and select over packed bits.

A batch of texts is one run of bytes with two bitvectors: a one where a unit ends and a one where a code
point begins, packed 64 to a word, with a directory of the ones before each block of 512 bits. The ones
within a document's bytes are its units; a select on two ranks gives the two byte cuts, and ranks on the
other vector give lengths in code points. Documents never meet: one pass, no shuffle, and memory is a
batch of texts or one text.

Nulls: a null text is the empty text (form ``plain``); a null id draws as the empty id. Repeated rows
come back one by one. A text that holds a sentinel stays plain, so that ``restored`` can tell sentinels
from text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 8  # of 64 bits, in a block
SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Bits:
    """A packed bitvector with the number of ones before each block."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(ones, bitorder="little")
        words = np.zeros((len(ones) // 64 // WORDS + 1) * WORDS, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        blocks = np.bitwise_count(words).reshape(-1, WORDS).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(blocks)])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at // 64, (at % 64).astype(np.uint64)
        rows = self.words.reshape(-1, WORDS)[word // WORDS]
        whole = np.where(np.arange(WORDS) < (word % WORDS)[:, None], np.bitwise_count(rows), 0).sum(1, dtype=np.int64)
        part = rows[np.arange(len(at)), word % WORDS] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word // WORDS] + whole + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of each k-th one, counted from 1."""
        block = np.searchsorted(self.before, k, "left") - 1
        rows = self.words.reshape(-1, WORDS)[block]
        ends = np.cumsum(np.bitwise_count(rows), 1, dtype=np.int64)
        left = k - self.before[block]
        word = (ends < left[:, None]).sum(1)
        at = np.arange(len(k))
        left -= np.where(word > 0, ends[at, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(rows[at, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block * WORDS + word) * 64 + (np.cumsum(bits, 1) < left[:, None]).sum(1)


def line_ends(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes that end a line: each line feed, and the last byte of each text."""
    ones = text == 0x0A
    ones[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    return ones


def word_ends(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes that end a word with the white space after it, and the last byte of each text."""
    space = (text == 0x20) | ((text >= 0x09) & (text <= 0x0D))
    ones = space & np.append(~space[1:], True)
    ones[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    return ones


UNITS = {"line": line_ends, "word": word_ends}


def draw(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 for a document."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, sentinels=SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    n: its units. form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); rate: per
    cent that are cut at all; spm: per cent of those in the second order.
    """
    ends_of = UNITS[unit]
    marks = [s.encode() for s in sentinels]
    pre, suf, mid = marks
    fields = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def part(ids: list, held: list[bytes]) -> pa.RecordBatch:
        blob, ends = b"".join(held), np.cumsum([len(t) for t in held], dtype=np.int64)
        text, starts = np.frombuffer(blob, np.uint8), np.append(0, ends[:-1])
        units, points = Bits(ends_of(text, ends)), Bits((text & 0xC0) != 0x80)
        first = units.rank(starts)
        n = units.rank(ends) - first
        drawn = np.array([draw(seed, i) for i in ids], np.int64)
        cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
        to_byte = lambda k: np.where(k > 0, units.select(np.maximum(first + k, 1)) + 1, starts) if units.total else starts
        a, b = to_byte(cuts[:, 0]), to_byte(cuts[:, 1])
        at_a = points.rank(a)
        n_pre, n_mid = at_a - points.rank(starts), points.rank(b) - at_a
        form, out = [], []
        for i, t in enumerate(held):
            if not t or drawn[i, 2] % 100 >= rate or any(m in t for m in marks):
                form.append("plain")
                out.append(t)
                continue
            x, y = a[i] - starts[i], b[i] - starts[i]
            if drawn[i, 3] % 100 < spm:
                form.append("spm")
                out.append(b"".join((suf, t[y:], pre, t[:x], mid, t[x:y])))
            else:
                form.append("psm")
                out.append(b"".join((pre, t[:x], suf, t[y:], mid, t[x:y])))
        plain = np.array([f == "plain" for f in form])
        columns = [ids, n, form, pa.array(n_pre, mask=plain), pa.array(n_mid, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, fields.values(), strict=True)], names=list(fields))

    def run(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                t = texts[i].as_py() or b""
                if held and size + len(t) > most:
                    yield part(ids, held)
                    ids, held, size = [], [], 0
                ids.append(doc)
                held.append(t)
                size += len(t)
            if held:
                yield part(ids, held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def restored(form: str = "form", output: str = "output", sentinels=SENTINELS):
    """The text that an output was made of."""
    parts = F.split(F.col(output), "|".join(r"\Q" + s + r"\E" for s in sentinels))
    p = lambda k: F.get(parts, F.lit(k))
    return F.when(F.col(form) == "psm", F.concat(p(1), p(3), p(2))).when(F.col(form) == "spm", F.concat(p(2), p(3), p(1))).otherwise(F.col(output))
