"""The sources in the order they run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import submissions as subs
from ..schema import DOCUMENT
from .base import Batch
from .osm import Overpass
from .web import Crawl
from .wiki import Wikipedia


class Submissions:
    """Approved submissions. Effects other than documents are stored by ``commit``, after the documents are written."""

    name, interval_s = "submissions", 120

    def fetch(self, context, cursor) -> Batch:
        store = context.store
        batch = subs.waiting(store.read("submissions"))
        if batch.isEmpty():
            return Batch(context.spark.createDataFrame([], DOCUMENT), None)
        self.applied = subs.apply(batch, context.region, context.gazetteer, store.read("geocache"), context.now)
        store.upsert("suppressions", self.applied.suppressions)  # before any delete, so no sweep can bring an entry back
        return Batch(self.applied.docs, None)

    def commit(self, context) -> None:
        from ..operators import frontier

        done, store = getattr(self, "applied", None), context.store
        if done is None:
            return
        for kind in ("place", "event", "article"):
            gone = done.deletes.where(F.col("kind") == kind)
            if not gone.isEmpty():
                store.delete(f"{kind}s", gone)
        store.upsert("frontier", frontier.queue(store.read("frontier"), done.urls, context.now).where(F.col("updated_at") == context.now))
        store.upsert("submissions", done.submissions)
        self.applied = None


SOURCES = {"submissions": Submissions, "overpass": Overpass, "wikipedia": Wikipedia, "crawl": Crawl}
