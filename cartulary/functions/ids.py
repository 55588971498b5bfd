"""Stable ids and content hashes. SHA-256 prefixes, the same in Spark and in DuckDB."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that change without the content changing.
VOLATILE = ("content_hash", "indexed_at", "updated_at", "distance_m")


def stable_id(namespace: Column | str, key: Column | str) -> Column:
    """16 hex digits of namespace and key, a zero byte between them. namespace as str: a literal."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    k = F.col(key) if isinstance(key, str) else key
    return F.substring(F.sha2(F.concat(ns, F.lit("\x00"), k.cast("string")), 256), 1, 16)


def stable_id_of(namespace: str, key: str) -> str:
    return hashlib.sha256(f"{namespace}\x00{key}".encode()).hexdigest()[:16]


def frontier_id(url) -> Column:
    return F.concat(F.lit("f"), stable_id("frontier", url))


def suppression_id(doc_id) -> Column:
    return F.concat(F.lit("sup-"), stable_id("suppression", doc_id))


def geocache_id(key) -> Column:
    return F.concat(F.lit("g"), stable_id("geocache", key))


def content_hash(columns: list[str]) -> Column:
    """32 hex digits over all stable columns, by name, nulls included."""
    cols = sorted(c for c in columns if c not in VOLATILE and not c.startswith("_"))
    body = F.to_json(F.struct(*(F.col(c) for c in cols)), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, 32)
