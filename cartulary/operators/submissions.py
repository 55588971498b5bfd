"""The moderation queue: validation, review, and what an approved submission does."""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..region import Region
from ..schema import DOCUMENT, TABLES, conform
from . import cover, geocache
from . import gazetteer as gaz

REQUESTS = ("add", "update", "remove", "correction")
STATUSES = ("pending", "approved", "applied", "rejected")
REQUEST_LABELS = {"add": "Add an entry", "update": "Update an entry", "remove": "Remove an entry", "correction": "Correct an entry"}
MAX_TITLE, MIN_DESCRIPTION, MAX_DESCRIPTION, MAX_CATEGORIES, BATCH, LIST_PAGE = 200, 5, 4000, 10, 50, 50
ALPHABET = "23456789abcdefghijkmnpqrstuvwxyz"


def reference() -> str:
    """A random name that cannot be guessed: 24 of 32 symbols."""
    return "".join(secrets.choice(ALPHABET) for _ in range(24))


def parse(x: Column | str, values: tuple[str, ...]) -> Column:
    v = F.lower(text.ws_trim(x))
    return F.when(v.isin(*values), v)


def needs_existing(request: Column | str) -> Column:
    return (F.col(request) if isinstance(request, str) else request).isin("update", "remove", "correction")


def validate(drafts: DataFrame, region: Region, now: int) -> DataFrame:
    """drafts (strings as typed) with error: the first rule broken, else null, and the fields as they would be stored."""
    d = {c: text.ws_trim(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "description", "target_kind", "categories")}
    url, lat, lng = text.form_field("url"), text.form_field("lat"), text.form_field("lng")
    y, x = lat.try_cast("double"), lng.try_cast("double")
    kind = F.when(d["target_kind"] == "", "place").otherwise(text.kind_of(d["target_kind"]))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    rules = [
        (F.octet_length(d["title"]) < 2, "title_short"),
        (F.length(d["title"]) > MAX_TITLE, "title_long"),
        (F.length(d["description"]) < MIN_DESCRIPTION, "description_short"),
        (F.length(d["description"]) > MAX_DESCRIPTION, "description_long"),
        (url.isNotNull() & (scheme.isNull() | F.try_parse_url(url, F.lit("HOST")).isNull()), "url_invalid"),
        (url.isNotNull() & ~scheme.isin("http", "https"), "url_scheme"),
        (lat.isNull() != lng.isNull(), "coordinates_half"),
        (lat.isNotNull() & y.isNull(), "latitude_invalid"),
        (lng.isNotNull() & x.isNull(), "longitude_invalid"),
        (y.isNotNull() & ~region.inside(y, x), "outside_region"),
        (kind.isNull(), "kind_unknown"),
        (parse("request", REQUESTS).isNull(), "request_unknown"),
    ]
    error = F.coalesce(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for broken, code in rules))
    cats = F.slice(F.filter(F.transform(F.split(d["categories"], ","), lambda c: F.lower(text.ws_trim(c))), lambda c: c != ""), 1, MAX_CATEGORIES)
    stored = {"title": d["title"], "description": d["description"], "url": url, "lat": y, "lng": x, "target_kind": kind, "categories": cats, "request": parse("request", REQUESTS), "status": F.lit("pending"), "submitted_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long"), **{c: text.form_field(c) for c in ("address", "city", "existing_id", "contact")}}
    return drafts.withColumn("error", error).withColumns(stored)


def waiting(submissions: DataFrame, most: int = BATCH) -> DataFrame:
    """Approved and not yet tried, oldest first."""
    return submissions.where((F.col("status") == "approved") & F.col("apply_note").isNull()).orderBy("submitted_at", "id").limit(most)


def listing(submissions: DataFrame, status: str | None = None, request: str | None = None, offset: int = 0) -> DataFrame:
    out = submissions
    if status:
        out = out.where(F.col("status") == status)
    if request:
        out = out.where(F.col("request") == request)
    return out.orderBy(F.desc("submitted_at"), "id").offset(offset).limit(LIST_PAGE)


def review(submissions: DataFrame, decisions: DataFrame, now: int) -> DataFrame:
    """decisions: (id, decision approve|reject|pending, note). A review clears the apply note; unknown decisions change nothing."""
    to = F.col("decision")
    new = F.when(to == "approve", "approved").when(to == "reject", "rejected").when(to == "pending", "pending")
    d = decisions.select(F.col("id").alias("_id"), new.alias("_new"), text.blank_to_null("note").alias("_note")).where("_new is not null")
    out = submissions.join(d, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    keep = lambda c, v: F.when(hit, v).otherwise(F.col(c))
    out = out.withColumns({"status": keep("status", F.col("_new")), "review_note": keep("review_note", F.col("_note")), "apply_note": keep("apply_note", F.lit(None)), "reviewed_at": keep("reviewed_at", F.lit(now)), "updated_at": keep("updated_at", F.lit(now))})
    return conform(out, TABLES["submissions"])


@dataclass
class Applied:
    """What a batch of approved submissions asks for. Ingest docs first, then store the submissions."""

    docs: DataFrame
    suppressions: DataFrame
    deletes: DataFrame
    urls: DataFrame
    submissions: DataFrame


def apply(batch: DataFrame, region: Region, gazetteer: DataFrame, cache: DataFrame, now: int) -> Applied:
    """One plan for the whole batch: place additions, withdraw removals, queue pages to reread."""
    b = cover.inside(geocache.lookup(batch, cache, region), region, "_in")
    towns = gaz.resolve(batch.select("id", F.col("city").alias("name")).where("name is not null"), gazetteer).select(F.col("id").alias("_t"), F.col("lat").alias("_tlat"), F.col("lng").alias("_tlng"))
    b = b.join(towns, F.col("id") == F.col("_t"), "left")
    at = F.coalesce(
        F.when(F.col("_in"), F.struct(F.col("lat").alias("lat"), F.col("lng").alias("lng"), F.lit("exact").alias("p"))),
        F.when(F.col("geo_lat").isNotNull(), F.struct(F.col("geo_lat").alias("lat"), F.col("geo_lng").alias("lng"), F.lit("address").alias("p"))),
        F.when(F.col("_t").isNotNull(), F.struct(F.col("_tlat").alias("lat"), F.col("_tlng").alias("lng"), F.lit("city").alias("p"))),
    )
    add, remove = F.col("request") == "add", F.col("request") == "remove"
    kind = text.kind_of("target_kind")
    note = (
        F.when(add & F.col("at").isNull(), "no coordinates, known address or known town to place it by")
        .when(remove & kind.isNull(), "unknown kind")
        .when(remove & F.col("existing_id").isNull(), "no id of the entry to remove")
        .when(F.col("request").isin("update", "correction") & F.col("url").isNull(), "no website to read again")
    )
    b = b.withColumn("at", at).withColumn("failed", note).withColumn("_kind", kind)
    done = b.where("failed is null")

    adds = done.where(add)
    k = F.coalesce("_kind", F.lit("place"))
    docs = adds.select(
        F.lit("submission").alias("source"), F.col("id").alias("source_id"), ids.stable_id("submission", "id").alias("id"), k.alias("kind"), "title", F.col("description").alias("summary"), F.col("description").alias("body"), "url",
        "categories", F.array(F.lit("submitted")).alias("tags"), "at.lat", "at.lng", "city", "address", F.col("at.p").alias("geo_precision"), F.lit(now).cast("long").alias("updated_at"),
        F.when(k == "place", F.col("url")).alias("website"), F.when(k == "event", F.lit(now)).alias("start_time"), F.when(k == "article", F.col("submitted_at")).alias("published_at"), F.when(k == "article", text.word_count("description")).alias("word_count"),
    )
    removes = done.where(remove)
    withdrawn = removes.select(ids.suppression_id("existing_id").alias("id"), F.col("existing_id").alias("doc_id"), F.substring(F.concat(F.lit("removal requested: "), F.col("id")), 1, 200).alias("reason"), F.lit(now).alias("updated_at"))
    urls = done.where(~remove & F.col("url").isNotNull()).select("url", F.lit(0).alias("depth"), F.col("city").alias("default_city"))
    said = (
        F.when(F.col("failed").isNotNull(), F.col("failed"))
        .when(remove, "removed and withdrawn")
        .when(~add, "website queued")
        .when((F.col("at.p") == "city") & F.col("url").isNotNull(), "indexed at the town centre; website queued")
        .when(F.col("at.p") == "city", "indexed at the town centre")
        .when(F.col("url").isNotNull(), "indexed; website queued")
    )
    after = b.withColumns({"apply_note": said, "status": F.when(F.col("failed").isNull(), "applied").otherwise(F.col("status")), "updated_at": F.lit(now)})
    return Applied(conform(docs, DOCUMENT), conform(withdrawn, TABLES["suppressions"]), removes.select(F.col("existing_id").alias("id"), F.col("_kind").alias("kind")), urls, conform(after, TABLES["submissions"]))
