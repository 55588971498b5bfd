"""Operator 3: substring dedup with fixed-block anchors.

A window of ``window`` words always holds a whole block of b = (window + 1) // 2 words that starts at
a multiple of b in its document. So: (1) index these non-overlapping blocks and probe them with every
rolling b-word window; probes and blocks meet by hash in buckets, each chunk of documents sending a
hash once. (2) Hits are extended: every window around a hit is hashed, the smallest document of each
hash is found the same way, and runs of windows that started in a smaller document are the maximal
repeats that go. Windows that hold no hit cannot repeat and are never sent.

Hashes of windows have 96 bits. Nulls: a null text has no words; a null id sorts after all others.
Repeated rows with one id never remove each other's words. Texts with fewer words than a window, and
empty tables, come back unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    ASK_SCHEMA, NO_ID, Chunk, ChunkWords, Rolling, answered, asked, boxed, bucket_count, enc, key_columns, keys_of, mix,
    pack_chunks, real_id, reply_array, table, total_bytes, unboxed, uniques, with_replies,
)

BLOCK_PART, PROBE_PART, WINDOW_PART = 0, 1, 2
_WINDOW = np.dtype([("check", "<u4"), ("low", "<i8"), ("high", "<i8")])


class _Words:
    """Word hashes of a chunk and where windows may start."""

    def __init__(self, chunk: Chunk, block: int, window: int):
        self.words = ChunkWords(chunk)
        self.codes, self.starts, self.ends = self.words.code, self.words.doc_start, self.words.doc_end
        self.doc = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)
        self.block, self.window = block, window
        self.roll = Rolling(self.codes)

    def fits(self, width: int) -> np.ndarray:
        """Positions whose window of this width ends within the document; documents shorter than a window have none."""
        at = np.arange(max(0, len(self.codes) - width + 1))
        doc = self.doc[: len(at)]
        return at[(at + width <= self.ends[doc]) & (self.ends[doc] - self.starts[doc] >= self.window)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of b-word windows, their 40-bit hashes, and which are index blocks."""
        at = self.fits(self.block)
        h = self.roll.windows(self.block)[at] & ~np.uint64((1 << 24) - 1)
        return at, h, (at - self.starts[self.doc[at]]) % self.block == 0

    def candidates(self, hit_at: np.ndarray) -> np.ndarray:
        """Starts of windows that hold an anchor hit."""
        hits = np.zeros(len(self.codes) + 1, np.int64)
        hits[hit_at + 1] = 1
        np.cumsum(hits, out=hits)
        at = self.fits(self.window)
        return at[hits[at + self.window - self.block + 1] > hits[at]]


def _meet_anchors(bucket):
    """Blocks that a probe or another block equals, and probes that a block equals, as bits."""
    blocks = [(k, v) for _, part, k, v in bucket if part == BLOCK_PART]
    probes = [k for _, part, k, _ in bucket if part == PROBE_PART]
    if not blocks:
        return
    every, place = uniques(np.concatenate([k for k, _ in blocks]))
    count = np.bincount(place, np.concatenate([v for _, v in blocks]).astype(float), len(every))
    probed = np.zeros(len(every), bool)
    for k in probes:
        at = np.minimum(np.searchsorted(every, k), len(every) - 1)
        probed[at[every[at] == k]] = True
    good = probed | (count > 1)
    for chunk, part, k, _ in bucket:
        at = np.minimum(np.searchsorted(every, k), len(every) - 1)
        hit = good[at] if part == BLOCK_PART else every[at] == k
        if hit.any():
            yield chunk, part, enc(hit.astype(np.uint8))


def _meet_windows(bucket):
    """For each window that some document of the chunk has after a smaller document: that smallest document."""
    keys = np.concatenate([k for _, _, k, _ in bucket])
    vals = np.concatenate([v for _, _, _, v in bucket])
    order = np.lexsort((vals["check"], keys))
    new = np.ones(len(keys), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(vals["check"][order].astype(np.int64)) != 0)
    low = np.minimum.reduceat(vals["low"][order], np.flatnonzero(new))
    reply = np.empty(len(keys), np.int64)
    reply[order] = low[np.cumsum(new) - 1]
    reply[reply >= vals["high"]] = NO_ID
    at = 0
    for chunk, part, k, _ in bucket:
        mine = reply[at : at + len(k)]
        at += len(k)
        if (mine != NO_ID).any():
            yield chunk, part, enc(mine)


def find_repeats(docs: DataFrame, work, window: int = 50, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_removed, starts, ends, kept, kept_sha256.

    starts, ends: the removed runs as word positions. kept: the text without them, other white space
    untouched (null unless keep_text). kept_sha256: of the kept words joined by one space.
    """
    block = (window + 1) // 2
    chunks = pack_chunks(work, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    size = total_bytes(chunks)
    buckets = bucket_count(size)

    def ask_anchors(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                _, h, own = _Words(chunk, block, window).anchors()
                keys, place = uniques(h[own])
                count = np.minimum(np.bincount(place, minlength=len(keys)), 2).astype(np.uint8)
                yield from asked(chunk.chunk, BLOCK_PART, keys, count, buckets)
                yield from asked(chunk.chunk, PROBE_PART, uniques(h[~own])[0], None, buckets)

    hits = work.put("hits", answered(chunks.mapInArrow(ask_anchors, ASK_SCHEMA), buckets, {BLOCK_PART: np.uint8, PROBE_PART: None}, _meet_anchors))

    def windows(chunk: Chunk, got):
        """Candidate windows: the words, starts, hashes, and the distinct hashes with each start's place."""
        w = _Words(chunk, block, window)
        at, h, own = w.anchors()
        hit = np.zeros(len(at), bool)
        for part, mask in ((BLOCK_PART, own), (PROBE_PART, ~own)):
            keys, place = uniques(h[mask])
            hit[mask] = reply_array(keys, got.get(part, []), buckets, 0, np.uint8)[place] > 0
        start = w.candidates(at[hit])
        keys, place = uniques(w.roll.of(start, start + window))
        return w, start, keys, place

    def ask_windows(chunk: Chunk, got):
        w, start, keys, place = windows(chunk, got)
        if not len(start):
            return
        vals = np.empty(len(keys), _WINDOW)
        second = Rolling(mix(w.codes ^ np.uint64(0x5851F42D4C957F2D)))
        vals["check"][place] = (second.of(start, start + window) >> np.uint64(32)).astype(np.uint32)
        doc = chunk.ids[w.doc[start]]
        order = np.lexsort((doc, place))
        first = np.searchsorted(place[order], np.arange(len(keys)))
        vals["low"] = doc[order][first]
        vals["high"] = doc[order][np.append(first[1:], len(order)) - 1]
        yield from asked(chunk.chunk, WINDOW_PART, keys, vals, buckets)

    asks = with_replies(chunks, hits, size, ask_windows, ASK_SCHEMA)
    lows = work.put("lows", answered(asks, buckets, {WINDOW_PART: _WINDOW}, _meet_windows))

    schema = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "kept": pa.string(), "kept_sha256": pa.string()}

    def cut(chunk: Chunk, got):
        w, start, keys, place = windows(chunk, got)
        low = reply_array(keys, got.get(WINDOW_PART, []), buckets, NO_ID, np.int64)[place]
        gone = start[low < chunk.ids[w.doc[start]]]
        cover = np.zeros(len(w.codes) + 1, np.int64)
        cover[gone] += 1
        np.subtract.at(cover, gone + window, 1)
        removed = np.cumsum(cover)[:-1] > 0
        first, last = w.words.start.tolist(), w.words.end.tolist()
        rows, n = [], 0
        for i, text in enumerate(chunk.texts()):
            a, b = int(w.starts[i]), int(w.ends[i])
            r = removed[a:b]
            lo = hi = []
            kept, joined = text, b" ".join(text.split())
            if r.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], r.view(np.int8), [0]])))
                lo, hi = edge[::2].tolist(), edge[1::2].tolist()
                joined = b" ".join([chunk.blob[first[k] : last[k]] for k in (np.flatnonzero(~r) + a).tolist()])
                kept = _without(chunk, i, [(first[a + x], first[a + y] if a + y < b else None) for x, y in zip(lo, hi, strict=True)])
            h = xxhash.xxh64_intdigest(text, 42)
            rows.append((int(chunk.ids[i]), h - (1 << 64) if h >> 63 else h, b - a, int(r.sum()), lo, hi, kept.decode("utf-8", "replace") if keep_text else None, hashlib.sha256(joined).hexdigest()))
            n += len(text)
            if n > 1 << 20:
                yield table(schema, rows)
                rows, n = [], 0
        if rows:
            yield table(schema, rows)

    out = with_replies(chunks, hits.union(lows), size, cut, "doc_id long, text_hash long, n_words long, n_removed long, starts array<int>, ends array<int>, kept string, kept_sha256 string")
    return out.withColumn("doc_id", real_id())


def _without(chunk: Chunk, i: int, runs: list[tuple[int, int | None]]) -> bytes:
    """The text of document i without these byte runs; a run ends where the next kept word begins."""
    out, at = [], int(chunk.starts[i])
    for a, b in runs:
        out.append(chunk.blob[at:a])
        at = int(chunk.ends[i]) if b is None else b
    return b"".join([*out, chunk.blob[at : int(chunk.ends[i])]])


def remove_repeats(docs: DataFrame, work, window: int = 50) -> DataFrame:
    """docs with repeated windows cut from the text; rows that lose every word go. All columns stay; n_chars follows the text."""
    found = key_columns(find_repeats(docs, work, window).where("n_removed > 0"))
    found = found.groupBy("m_id", "m_hash").agg(F.first("kept").alias("kept"), F.first(F.col("n_removed") == F.col("n_words")).alias("gone"))
    out = boxed(docs).withColumns(keys_of()).join(found, ["m_id", "m_hash"], "left").where("gone is null or not gone")
    new = {"text": F.coalesce("kept", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return unboxed(out, **new)
