"""Ingest cycles and streams.

A cycle reads a source's cursor, fetches, ingests, and only then stores the cursor and the metrics, so a
failed cycle runs again from where it started. As a stream, landed files arrive as micro-batches: the
checkpoint is the cursor, ``availableNow`` is one pass over what is there.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import ids
from ..operators import frontier, ingest
from ..operators.store import Store
from ..region import Region
from ..schema import KINDS
from ..sources.base import Source, backoff


@dataclass
class Context:
    """What a run knows. now: the clock of the whole run."""

    spark: SparkSession
    store: Store
    region: Region
    gazetteer: DataFrame
    now: int


def context(store: Store, region: Region, now: int | None = None) -> Context:
    return Context(store.spark, store, region, region.gazetteer(store.spark), int(time.time()) if now is None else now)


def ingest_batch(ctx: Context, docs: DataFrame) -> dict[str, int]:
    """Plan, count and write one batch; a second call with the same documents writes nothing.

    The planned batch is written once to the store's folder and read back, so that counters and the
    three tables come from the same rows. An unreadable suppression table fails the batch.
    """
    store = ctx.store
    batch = docs.select(F.coalesce(F.col("id"), ids.stable_id(F.col("source"), "source_id")).alias("id")) if "id" in docs.columns else docs.select(ids.stable_id(F.col("source"), "source_id").alias("id"))
    stored = None
    for k in KINDS:  # keys of the batch's ids only; no stored document is read
        part = store.keys(f"{k}s", batch).select(F.lit(k).alias("kind"), "id", "content_hash")
        stored = part if stored is None else stored.union(part)
    planned = ingest.plan(docs, ctx.region, ctx.gazetteer, store.read("suppressions"), stored, ctx.now)
    path = f"{store.root}/_batches/{uuid.uuid4().hex}"
    planned.write.parquet(path)
    planned = ctx.spark.read.schema(planned.schema).parquet(path)
    stats = ingest.stats(planned).first().asDict()
    counts = {r.kind: r.n for r in planned.where("reason is null").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    for name, rows in ingest.route(planned).items():
        if counts.get(name[:-1]):
            store.upsert(name, rows)
    store.drop(path)
    return stats


def cursor_of(store: Store, source: str):
    row = store.read("cursors").where(F.col("source") == source).first()
    try:
        return json.loads(row.value) if row and row.value else None
    except ValueError:
        return None


def run_once(ctx: Context, source: Source) -> dict[str, int]:
    """One cycle of one source; errors are recorded and raised."""
    store, error, swept, stats = ctx.store, None, False, dict.fromkeys(ingest.COUNTERS, 0)
    try:
        batch = source.fetch(ctx, cursor_of(store, source.name))
        swept = batch.swept
        stats = ingest_batch(ctx, batch.docs)
        if commit := getattr(source, "commit", None):
            commit(ctx)
        if batch.cursor is not None:
            row = ctx.spark.createDataFrame([(source.name, json.dumps(batch.cursor), ctx.now)], "source string, value string, updated_at long")
            store.upsert("cursors", row.withColumn("id", F.concat(F.lit("cursor-"), F.col("source"))))
    except Exception as e:
        error = f"{type(e).__name__}: {e}"[:500]
        raise
    finally:
        run = ctx.spark.createDataFrame([(source.name, ctx.now, error, swept, *(stats[c] for c in ingest.COUNTERS))], "source string, run_at long, error string, swept boolean, " + ", ".join(f"{c} long" for c in ingest.COUNTERS))
        store.append("metrics", run)
    return stats


def run_all(store: Store, region: Region, sources: list[Source], now: int | None = None) -> dict[str, dict[str, int] | str]:
    """Every source once, side by side; one that fails does not stop the others. Spark runs their jobs together, and their writes line up behind each other."""

    def one(s: Source) -> dict[str, int] | str:
        try:
            return run_once(context(store, region, now), s)
        except Exception as e:  # noqa: BLE001  recorded in metrics by run_once
            return f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max(1, len(sources))) as pool:
        return dict(zip([s.name for s in sources], pool.map(one, sources), strict=True))


def requeue(store: Store, now: int) -> None:
    """What a run that died had claimed is pending again; called when a schedule begins."""
    back = frontier.requeue_stale(store.read("frontier"), now)
    store.upsert("frontier", back.where(F.col("updated_at") == now))


def schedule(store: Store, region: Region, sources: list[Source], stop: Callable[[], bool], sleep=time.sleep, clock=time.time, jitter: Callable[[], float] = random.random) -> None:
    """Run each source at its own interval until stop() says so; after errors it waits longer, by a random tenth more. No source waits for another."""
    requeue(store, int(clock()))
    due = {s.name: clock() for s in sources}
    errors = dict.fromkeys(due, 0)
    running: dict[str, Future] = {}
    with ThreadPoolExecutor(max(1, len(sources))) as pool:
        while not stop():
            for s in sources:
                if s.name in running and running[s.name].done():
                    ok = isinstance(running.pop(s.name).result()[s.name], dict)
                    errors[s.name] = 0 if ok else errors[s.name] + 1
                    due[s.name] = clock() + backoff(s.interval_s, errors[s.name], jitter())
                if s.name not in running and clock() >= due[s.name] and not stop():
                    running[s.name] = pool.submit(run_all, store, region, [s])
            sleep(max(0.05, min(1.0, min(due.values()) - clock())))


def ingest_stream(store: Store, region: Region, path: str, schema: str, to_docs: Callable[[DataFrame, int], DataFrame], checkpoint: str, interval: str | None = None, files_a_batch: int = 1000, fmt: str = "json") -> StreamingQuery:
    """Files that land under path, as micro-batches of the ingest plan. interval None: one pass over what is there."""
    raw = store.spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_a_batch).load(path)

    def each(batch: DataFrame, _: int) -> None:
        ctx = context(Store(batch.sparkSession, store.root, store.fan, store.keep_s), region)
        ingest_batch(ctx, to_docs(batch, ctx.now))

    writer = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def suppress(ctx: Context, doc_ids: list[str], reason: str) -> None:
    rows = ctx.spark.createDataFrame([(d, reason[:200], ctx.now) for d in doc_ids], "doc_id string, reason string, updated_at long")
    ctx.store.upsert("suppressions", rows.withColumn("id", ids.suppression_id("doc_id")))
