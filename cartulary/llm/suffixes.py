"""Operator 9: suffix-array dedup on bytes by range-partitioned suffixes.

Which suffixes: of each ``width``-byte window, the one at its leading token with the smallest hash
(an 8-byte token among the window's first ``REACH``). Equal windows choose the same one, and at least
``width - REACH`` of its bytes lie in the window; so windows can be equal only if their suffixes share
the 32 leading bytes that are sorted here.

(1) Sampled splitters range-partition these suffixes by leading tokens (and, where a token is hot, by
what follows). Each bucket sorts its suffixes by multikey quicksort over 8-byte characters and finds
runs that share them. (2) A suffix whose whole neighbourhood (all bytes of all windows that chose it)
occurs again is a repeat as it is. In runs that mix different neighbourhoods, and in runs that touch
a bucket's boundary and may go on in the next one, the windows themselves are compared, by hash, in a
second exchange. Each distinct neighbourhood is sent for that once.

Window hashes have 96 bits, neighbourhood hashes 64 besides the 256 sorted. Nulls: a null text is
empty; texts shorter than a window, and empty tables, come back unchanged. Repeated rows are texts
like any other, so all their windows repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    ASK_SCHEMA, BYTE_CODES, Chunk, Rolling, answered, asked, bucket_count, dec, enc, mix, pack_chunks, real_id, reply_array, table,
    total_bytes, uniques, with_replies,
)

REACH, SAMPLES = 192, 256
STEP, MEET = 1 << 18, 1 << 19  # window starts whose tokens, and windows whose hashes, are held at a time
_SECOND = mix(BYTE_CODES ^ np.uint64(0x5851F42D4C957F2D))
SUFFIX_PART, WINDOW_PART = 0, 1
UNIQUE, REPEATED, OPEN, ENVOY = 0, 1, 2, 3  # of a suffix: ENVOY is REPEATED and sends its windows
_SUFFIX = np.dtype([("k0", ">u8"), ("k1", ">u8"), ("k2", ">u8"), ("k3", ">u8"), ("around", ">u8"), ("n", "u1")])
_COLS = ("k0", "k1", "k2", "k3", "around")
_WINDOW = np.dtype([("check", "<u4"), ("n", "u1")])


def multikey_order(cols: list[np.ndarray], leaf: int = 4096) -> np.ndarray:
    """The order of rows by multikey quicksort: cols are a row's characters, first to last."""
    order = np.arange(len(cols[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2 or d == len(cols):
            continue
        part = order[lo:hi]
        if hi - lo <= leaf:
            order[lo:hi] = part[np.lexsort([c[part] for c in reversed(cols[d:])])]
            continue
        key = cols[d][part]
        pivot = np.sort(key[:: max(1, len(key) // 64)])[min(32, len(key) // 2)]
        less, same = key < pivot, key == pivot
        a, b = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([part[less], part[same], part[~less & ~same]])
        todo += [(lo, lo + a, d), (lo + a, lo + a + b, d + 1), (lo + a + b, hi, d)]
    return order


class _Suffixes:
    """The chosen suffixes of a chunk: position, and first and last window that chose it."""

    def __init__(self, chunk: Chunk, width: int):
        self.width = width
        n = len(chunk.blob)
        self.bytes = np.concatenate([np.frombuffer(chunk.blob, np.uint8), np.zeros(8, np.uint8)])
        self.roll = None
        long = chunk.ends - chunk.starts >= width
        self.at = self.first = self.last = np.zeros(0, np.int64)
        if not long.any():
            return
        self.roll = Rolling(BYTE_CODES[self.bytes[:n]])
        edge = np.zeros(n + 1, np.int8)
        edge[chunk.starts[long]] = 1
        np.subtract.at(edge, chunk.ends[long] - width + 1, 1)
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0  # a window starts here
        found = [self._chosen(lo + np.flatnonzero(inside[lo : lo + STEP]), lo, min(n, lo + STEP + REACH)) for lo in range(0, n, STEP)]
        at, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        new = np.append(True, at[1:] != at[:-1])
        self.at, self.first = at[new], first[new]
        self.last = last[np.append(np.flatnonzero(new)[1:], len(at)) - 1]

    def _chosen(self, start: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chosen position, first and last window of each run of these window starts, by the tokens from lo to hi."""
        if not len(start):
            return start, start, start
        x = self.bytes[lo : hi + 7].astype(np.uint64)
        x = (x[:-1] << np.uint64(8)) | x[1:]
        x = (x[:-2] << np.uint64(16)) | x[2:]
        token = (x[:-4] << np.uint64(32)) | x[4:]  # the 8 bytes from each position
        v = (mix(token) >> np.uint64(32) << np.uint64(32)) | np.arange(lo, hi, dtype=np.uint64)
        pad = np.full(-(-len(v) // REACH) * REACH + REACH, ~np.uint64(0))
        pad[: len(v)] = v
        rows = pad.reshape(-1, REACH)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[start - lo], ahead[start - lo + REACH - 1])
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.append(True, at[1:] != at[:-1])
        return at[new], start[new], start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]

    def records(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct suffix records in order, and each suffix's place among them."""
        r = np.zeros(len(self.at), _SUFFIX)
        lead = self.bytes[self.at[:, None] + np.arange(32)].view(">u8")
        for k in range(4):
            r[f"k{k}"] = lead[:, k]
        r["around"] = mix(self.roll.of(self.first, self.last + self.width) + (self.at - self.first).astype(np.uint64))
        order = np.lexsort([r[c] for c in reversed(_COLS)])
        s = r[order]
        new = np.ones(len(s), bool)
        new[1:] = np.any([s[c][1:] != s[c][:-1] for c in _COLS], axis=0)
        rank = np.cumsum(new) - 1
        place = np.empty(len(s), np.int64)
        place[order] = rank
        out = s[new]
        out["n"] = np.minimum(np.bincount(rank, minlength=len(out)), 2)
        return out, place

    def windows(self, some: np.ndarray) -> np.ndarray:
        """All window starts of these suffixes."""
        size = self.last[some] - self.first[some] + 1
        return np.repeat(self.first[some] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


def _bytes_of(records: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.stack([records[c] for c in _COLS], 1).astype(">u8")).view("S40").ravel()


def _sort_bucket(bucket):
    """States of the suffixes of a bucket."""
    recs = np.concatenate([v for _, _, _, v in bucket])
    order = multikey_order([recs[c].astype(np.uint64) for c in _COLS])
    s = recs[order]
    lead = np.ones(len(s), bool)
    lead[1:] = np.any([s[c][1:] != s[c][:-1] for c in _COLS[:4]], axis=0)
    whole = lead.copy()
    whole[1:] |= s["around"][1:] != s["around"][:-1]
    run, hood = np.cumsum(lead) - 1, np.cumsum(whole) - 1
    n_run, n_hood = np.bincount(run, s["n"]), np.bincount(hood, s["n"])
    hoods = np.bincount(run[whole])
    edge = (run == 0) | (run == run[-1])  # may go on in a neighbouring bucket
    mixed = (hoods[run] > 1) | edge
    state = np.where(n_hood[hood] > 1, REPEATED, np.where(mixed, OPEN, UNIQUE)).astype(np.uint8)
    state[whole & mixed & (n_hood[hood] > 1)] = ENVOY
    state[(n_run[run] < 2) & ~edge] = UNIQUE
    reply = np.empty(len(s), np.uint8)
    reply[order] = state
    at = 0
    for chunk, part, _, v in bucket:
        mine = reply[at : at + len(v)]
        at += len(v)
        if mine.any():
            yield chunk, part, enc(mine)


def _meet_windows(bucket):
    """Whether each window occurs again; a range of the keys at a time, so that memory stays even where most windows repeat."""
    n = 1 + sum(len(k) for _, _, k, _ in bucket) // MEET
    low, high = min(k[0] for _, _, k, _ in bucket), max(k[-1] for _, _, k, _ in bucket)
    bounds = low + ((high - low) // np.uint64(n) + np.uint64(1)) * np.arange(1, n, dtype=np.uint64)  # keys are hashes, so they lie evenly
    cuts = [np.concatenate([[0], np.searchsorted(k, bounds), [len(k)]]) for _, _, k, _ in bucket]
    replies = [np.empty(len(k), np.uint8) for _, _, k, _ in bucket]
    for i in range(n):
        parts = [slice(c[i], c[i + 1]) for c in cuts]
        keys = np.concatenate([k[p] for (_, _, k, _), p in zip(bucket, parts, strict=True)])
        vals = np.concatenate([v[p] for (_, _, _, v), p in zip(bucket, parts, strict=True)])
        if not len(keys):
            continue
        order = np.lexsort((vals["check"], keys))
        new = np.ones(len(keys), bool)
        new[1:] = (np.diff(keys[order]) != 0) | (np.diff(vals["check"][order].astype(np.int64)) != 0)
        group = np.cumsum(new) - 1
        again = np.empty(len(keys), np.uint8)
        again[order] = np.bincount(group, vals["n"][order])[group] > 1
        at = 0
        for reply, p in zip(replies, parts, strict=True):
            reply[p] = again[at : at + p.stop - p.start]
            at += p.stop - p.start
    for (chunk, part, _, _), mine in zip(bucket, replies, strict=True):
        if mine.any():
            yield chunk, part, enc(mine)


def find_repeats(docs: DataFrame, work, width: int = 400, keep_bytes: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, starts, ends, kept, kept_sha256.

    starts, ends: the maximal removed byte runs. kept: the remaining bytes (null unless keep_bytes).
    """
    if width < REACH + 32:
        raise ValueError(f"width must be at least {REACH + 32}")
    chunks = pack_chunks(work, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), target=2 << 20)
    size = total_bytes(chunks)
    buckets = bucket_count(size)

    def sample(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = _Suffixes(Chunk.of(row), width)
                if len(s.at):
                    r = _bytes_of(s.records()[0])
                    yield table({"r": pa.binary()}, [(bytes(x).ljust(40, b"\0"),) for x in r[:: max(1, len(r) // SAMPLES)]])

    few = max(1, size // (64 * (2 << 20)))
    some = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(few)) == 0).mapInArrow(sample, "r binary").limit(200_000)
    got = np.sort(np.array([bytes(x[0]) for x in some.collect()], "S40"))
    splitters = got[np.linspace(0, len(got) - 1, buckets + 1).astype(int)[1:-1]] if len(got) else got
    hood = {SUFFIX_PART: _SUFFIX, WINDOW_PART: _WINDOW}

    def cuts_of(records):
        return np.concatenate([[0], np.searchsorted(_bytes_of(records), splitters), [len(records)]]).astype(int)

    def ask_suffixes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = _Suffixes(Chunk.of(row), width)
                if not len(s.at):
                    continue
                r, cut = s.records()[0], None
                cut = cuts_of(r).tolist()
                rows = [(b, row["chunk"], SUFFIX_PART, b"", enc(r[i:j])) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
                yield table({"bucket": pa.int32(), "chunk": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "vals": pa.binary()}, rows)

    states = work.put("states", answered(chunks.mapInArrow(ask_suffixes, ASK_SCHEMA), buckets, hood, _sort_bucket))

    def read_states(s: _Suffixes, got) -> np.ndarray:
        r, place = s.records()
        cut, state = cuts_of(r), np.zeros(len(r), np.uint8)
        for bucket, data in got.get(SUFFIX_PART, []):
            state[cut[bucket] : cut[bucket + 1]] = dec(data, np.uint8)
        state = state[place]
        again = np.ones(len(place), bool)
        again[np.unique(place, return_index=True)[1]] = False
        state[again & (state == ENVOY)] = REPEATED
        return state

    def ask_windows(chunk: Chunk, got):
        if not got:
            return
        s = _Suffixes(chunk, width)
        at = s.windows(np.flatnonzero(read_states(s, got) >= OPEN))
        if not len(at):
            return
        keys, place = uniques(s.roll.of(at, at + width))
        vals = np.empty(len(keys), _WINDOW)
        second = Rolling(_SECOND[s.bytes[:-8]])
        vals["check"][place] = (second.of(at, at + width) >> np.uint64(32)).astype(np.uint32)
        vals["n"] = np.minimum(np.bincount(place, minlength=len(keys)), 2)
        yield from asked(chunk.chunk, WINDOW_PART, keys, vals, buckets)

    asks = with_replies(chunks, states, size, ask_windows, ASK_SCHEMA)
    again = work.put("again", answered(asks, buckets, hood, _meet_windows))

    schema = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "kept": pa.binary(), "kept_sha256": pa.string()}

    def cut(chunk: Chunk, got):
        cover = np.zeros(len(chunk.blob) + 1, np.int32)
        if got:
            s = _Suffixes(chunk, width)
            state = read_states(s, got)
            sure = (state == REPEATED) | (state == ENVOY)
            np.add.at(cover, s.first[sure], 1)
            np.subtract.at(cover, s.last[sure] + width, 1)
            at = s.windows(np.flatnonzero(state >= OPEN))
            if len(at):
                keys, place = uniques(s.roll.of(at, at + width))
                at = at[reply_array(keys, got.get(WINDOW_PART, []), buckets, 0, np.uint8)[place] > 0]
                cover[at] += 1
                cover[at + width] -= 1
        removed = np.cumsum(cover, dtype=np.int32)[:-1] > 0
        rows, n = [], 0
        for i, text in enumerate(chunk.texts()):
            r = removed[chunk.starts[i] : chunk.ends[i]]
            lo = hi = []
            kept = text
            if r.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], r.view(np.int8), [0]])))
                lo, hi = edge[::2].tolist(), edge[1::2].tolist()
                kept = np.frombuffer(text, np.uint8)[~r].tobytes()
            rows.append((int(chunk.ids[i]), len(text), int(r.sum()), len(lo), lo, hi, kept if keep_bytes else None, hashlib.sha256(kept).hexdigest()))
            n += len(text)
            if n > 1 << 20:
                yield table(schema, rows)
                rows, n = [], 0
        if rows:
            yield table(schema, rows)

    out = with_replies(chunks, states.union(again), size, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary, kept_sha256 string")
    return out.withColumn("doc_id", real_id())
