"""Full-text search over an inverted index that is an ordinary DataFrame.

Contract. Tokens are folded, lower-cased runs of letters and digits, with positions. Stop words leave a
query unless that empties it. A query term matches a document exactly, by synonym (a phrase matches
consecutive positions), by typo within a budget (0 edits under 5 characters, 1 up to 8, else 2), or, for
the last term, by prefix. A document matches if any term does. Order: terms matched (more first), edits,
proximity, best attribute, the caller's sort, exact terms (more first), newest article, id. An empty
query matches everything.

Typos and prefixes are looked for in the dictionary of distinct terms, never in documents; what they find
is a small table that meets the index in an equi-join on the term.

A stored index (``Index``) has its dictionary written beside the postings: terms in order, for prefixes, and
under each term's deletions, so that a typo is met by equality (two terms within e edits have a common string
that is left after at most e deletions from each). Its postings lie in blocks of documents, and a table of
blocks has what each term can do there at best; a ranked page reads the blocks that can reach it (``top``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import geo, text

#: Searchable fields, most telling first.
ATTRIBUTES = ("title", "summary", "categories", "tags", "city", "address", "body")
FAR = 8  # a gap that counts as no proximity
ATTR = 1 << 40  # a place in a document is one number: field * ATTR + position


def postings(docs: DataFrame, *more: str) -> DataFrame:
    """(term, kind, id, attr, pos) and more of the document's columns, of every token of every searchable field."""
    fields = dict(docs.dtypes)
    parts = []
    for i, name in enumerate(ATTRIBUTES):
        if name in fields:
            joined = F.array_join(F.col(name), " . ") if fields[name].startswith("array") else F.col(name)
            parts.append(F.struct(F.lit(i).alias("attr"), text.tokens(F.coalesce(joined, F.lit(""))).alias("terms")))
    each = docs.select("kind", "id", *more, F.explode(F.array(*parts)).alias("a"))
    return each.select("kind", "id", *more, "a.attr", F.posexplode("a.terms").alias("pos", "term")).select("term", "kind", "id", "attr", "pos", *more)


def dictionary(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("n"))


def query_terms(query: str, stop_words: list[str]) -> list[str]:
    """The query's distinct terms in order, on the driver, by the same rule as tokens."""
    import regex

    table = str.maketrans(text.FOLD_FROM, text.FOLD_TO)
    every = list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", query.translate(table).lower())))
    return [t for t in every if t not in set(stop_words)] or every


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) <= 8 else 2


def _synonym_rows(terms: list[str], synonyms: dict[str, list[str]] | None) -> list[tuple]:
    """A synonym of several words gives one row per word, with its place in the phrase."""
    rows = []
    for q, term in enumerate(terms):
        for other in (synonyms or {}).get(term, []):
            parts = query_terms(other, [])
            rows += [(q, p, 0, 1, " ".join(parts) if len(parts) > 1 else None, k) for k, p in enumerate(parts)]
    return rows


def expansions(words: DataFrame, terms: list[str], synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(q, term, edits, how, phrase): dictionary terms that answer each query term; how: 0 exact, 1 otherwise."""
    spark = words.sparkSession
    found = None
    for q, term in enumerate(terms):
        d = F.levenshtein(F.col("term"), F.lit(term), edits_allowed(term)) if edits_allowed(term) else F.when(F.col("term") == term, 0).otherwise(-1)
        near = (d >= 0) & F.length("term").between(len(term) - edits_allowed(term), len(term) + edits_allowed(term))
        hit = F.when(F.col("term") == term, F.struct(F.lit(0).alias("edits"), F.lit(0).alias("how"))).when(near, F.struct(d.alias("edits"), F.lit(1).alias("how")))
        if q == len(terms) - 1:
            hit = F.coalesce(hit, F.when(F.startswith("term", F.lit(term)), F.struct(F.lit(0).alias("edits"), F.lit(1).alias("how"))))
        part = words.select(F.lit(q).alias("q"), "term", hit.alias("hit")).where("hit is not null").select("q", "term", "hit.edits", "hit.how", F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("step"))
        found = part if found is None else found.union(part)
    rows = _synonym_rows(terms, synonyms)
    if rows:
        found = found.union(spark.createDataFrame(rows, "q int, term string, edits int, how int, phrase string, step int"))
    return found


# ---------------------------------------------------------------- stored dictionary and blocks

TERMS, NEAR, BLOCKS = "term string", "key string, term string", "term string, kind string, block long, attr int, stamp long, first string"
BLOCK_DOCS = 7  # bits: documents of a block
OLDEST = -(1 << 63)
PREFIX = 8  # characters of a term that deletions are made of; at least 6
NEAR_KEYS = 2_000_000  # of a bucket
MANY = 1000  # terms or blocks that a filter names; more are met by a join
WAVE = 16  # blocks that give the first page


@dataclass(frozen=True)
class Index:
    """terms: (term); near: for probes (key), at least the rows (key, term) with such keys; blocks: best attr, newest stamp and first id of each (term, kind, _seq, block); posts: for terms (None: all), postings with _seq and block."""

    terms: DataFrame
    near: Callable[[DataFrame], DataFrame]
    blocks: DataFrame
    posts: Callable[[list[str] | None], DataFrame]


def stamp() -> Column:
    """What ranks articles that are else equal: the newest first; other documents come after them."""
    return F.coalesce(F.when(F.col("kind") == "article", F.col("updated_at")), F.lit(OLDEST))


def in_blocks(docs: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in an order, with the block that each falls into: some neighbours in the order."""
    place = F.monotonically_increasing_id()  # partition and place in it
    block = F.shiftleft(F.shiftright(place, 33), 26).bitwiseOR(F.shiftright(place.bitwiseAND(F.lit((1 << 33) - 1)), BLOCK_DOCS))
    return docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", block)


def blocked(rows: DataFrame) -> DataFrame:
    """Postings of several runs with blocks anew."""
    docs = in_blocks(rows.select("kind", "stamp", "id").distinct(), "kind", F.desc("stamp"), "id")
    return rows.drop("block").join(docs.select("id", "block"), "id")


def near_bucket(bits: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(1 << bits)).cast("int").alias("bucket")


def _one_less(t: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, 1, i - 1), F.substring(t, i + 1, F.length(t))))


def near_keys(term: str = "term") -> Column:
    """What a term is stored under: its beginning, and what up to as many deletions leave of that as a query that can mean it may have.

    If deletions make two terms equal, as many at most do so with their first ``PREFIX`` characters: those of them that fall there,
    and the last ones of the longer rest.
    """
    t, n = F.substring(term, 1, PREFIX), F.length(term)
    two = F.flatten(F.transform(_one_less(t), _one_less))
    keys = F.when(n >= 7, F.concat(F.array(t), _one_less(t), two)).when(n >= 4, F.concat(F.array(t), _one_less(t)))
    return F.array_distinct(F.coalesce(keys, F.array().cast("array<string>")))


def probes(term: str) -> set[str]:
    """Keys under which terms within the query term's edits lie."""
    edits = edits_allowed(term)
    if not edits:
        return set()
    found, last = {term[:PREFIX]}, {term[:PREFIX]}
    for _ in range(edits):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        found |= last
    return found


def write_terms(rows: DataFrame, at: str) -> None:
    """The dictionary and the blocks of a run of postings, below its folder."""
    counted = Observation()
    terms = rows.select("term").distinct().repartitionByRange("term").sortWithinPartitions("term")
    terms.observe(counted, F.sum(F.size(near_keys())).alias("n")).write.parquet(f"{at}/terms")
    terms = rows.sparkSession.read.schema(TERMS).parquet(f"{at}/terms")
    bits = ((counted.get["n"] or 0) // NEAR_KEYS).bit_length()
    near = terms.select(F.explode(near_keys()).alias("key"), "term").withColumn("bucket", near_bucket(bits))
    near.repartition("bucket").sortWithinPartitions("bucket", "key").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/near")
    blocks = rows.groupBy("term", "kind", "block").agg(F.min("attr").alias("attr"), F.max("stamp").alias("stamp"), F.min("doc").alias("first"))
    blocks.repartitionByRange("term", "kind", "block").sortWithinPartitions("term", "kind", "block").write.parquet(f"{at}/blocks")


def stored_expansions(index: Index, terms: list[str], synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """The same as ``expansions`` of the index's terms, by equality on deletions and a range of terms: nothing is compared with the whole dictionary."""
    spark = index.terms.sparkSession
    rows = [(q, key, t, edits_allowed(t)) for q, t in enumerate(terms) for key in sorted(probes(t))]
    asked = spark.createDataFrame(rows, "q int, key string, asked string, most int")
    near = index.near(asked).join(F.broadcast(asked), "key").select("q", "term", "asked", "most").distinct()
    near = near.withColumn("edits", F.levenshtein("term", "asked")).where("edits between 1 and most").select("q", "term", "edits")
    last = index.terms.where(F.startswith("term", F.lit(terms[-1]))).where(F.col("term") != terms[-1]).select(F.lit(len(terms) - 1).alias("q"), "term", F.lit(0).alias("edits"))
    other = near.union(last).groupBy("q", "term").agg(F.max("edits").alias("edits"))
    other = other.select("q", "term", "edits", F.lit(1).alias("how"), F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("step"))
    exact = [(q, t, 0, 0, None, 0) for q, t in enumerate(terms)]
    return other.union(spark.createDataFrame(exact + _synonym_rows(terms, synonyms), "q int, term string, edits int, how int, phrase string, step int"))


def bounded(found: DataFrame) -> DataFrame:
    """Expansions as few rows that are broadcast or, if very many, as a side of an ordinary join; never the postings, whatever files of few bytes make Spark expect."""
    rows = found.limit(MANY + 1).collect()
    return F.broadcast(found.sparkSession.createDataFrame(rows, found.schema)) if len(rows) <= MANY else found.hint("merge")


def _named(found: DataFrame) -> list[str] | None:
    """The terms found, unless they are very many."""
    terms = [t for t, in found.select("term").distinct().limit(MANY + 1).collect()]
    return terms if len(terms) <= MANY else None


def block_bounds(index: Index, found: DataFrame) -> DataFrame:
    """(kind, _seq, block, words, typos, proximity, attribute, exact, stamp, first): of each block, what no document of it can rank better than."""
    at = index.blocks.join(found.select("q", "term", "edits", "how"), "term")
    each = at.groupBy("kind", "_seq", "block", "q").agg(F.min("edits").alias("edits"), F.min("attr").alias("attr"), F.max((F.col("how") == 0).cast("int")).alias("exact"), F.max("stamp").alias("stamp"), F.min("first").alias("first"))
    out = each.groupBy("kind", "_seq", "block").agg(F.count("*").alias("words"), F.sum("edits").alias("typos"), F.min("attr").alias("attribute"), F.sum("exact").alias("exact"), F.max("stamp").alias("stamp"), F.min("first").alias("first"))
    return out.withColumn("proximity", F.col("words") - 1)


_BOUND = (("words", True), ("typos", False), ("proximity", False), ("attribute", False), ("exact", True), ("stamp", True), ("first", False))  # more is better


def _reaches(row) -> Column:
    """Whether a bound is as good as a row or better."""
    out = F.lit(True)
    for name, more in reversed(_BOUND):
        better = F.col(name) > row[name] if more else F.col(name) < row[name]
        out = better | ((F.col(name) == row[name]) & out)
    return out


def top(docs: DataFrame, index: Index, query: str, k: int, stop_words=(), synonyms=None, distinct: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Hits that hold the k best by ``rank_order`` exactly, and how many blocks had a term and were read.

    The blocks with the best bounds give a page; its last row rules out the blocks whose bound it beats.
    """
    terms = query_terms(query, list(stop_words))
    found = bounded(stored_expansions(index, terms, synonyms))
    posts = index.posts(_named(found))
    bounds = block_bounds(index, found)
    block = ["kind", "_seq", "block"]

    def hits(blocks: DataFrame) -> DataFrame:
        few = blocks.select(*block).limit(MANY + 1).collect()
        rows = posts
        if len(few) <= MANY:
            rows = rows.where(F.col("block").isin([b.block for b in few])) if few else rows.limit(0)
        out = matching(docs, match(rows.join(blocks.select(*block), block, "left_semi"), found, len(terms)))
        return distinct_articles(out) if distinct else out

    best = bounds.orderBy(*(F.desc(n) if more else F.asc(n) for n, more in _BOUND), *block).limit(WAVE)
    page_ = hits(best).orderBy(*rank_order()).limit(k).select(*(n for n, _ in _BOUND[:5]), stamp().alias("stamp"), F.col("id").alias("first")).collect()
    reach = _reaches(page_[-1]) if k and len(page_) == k else F.lit(True)
    counts = bounds.agg(F.count("*").alias("blocks"), F.count_if(reach).alias("read")).first().asDict()
    return hits(bounds.where(reach)), counts


def matching(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """docs that match, with their ranks. Either side can be all documents, whatever files of few bytes make Spark expect: never broadcast."""
    return docs.join(matches.hint("merge"), ["kind", "id"])


def match(index: DataFrame, found: DataFrame, n_terms: int) -> DataFrame:
    """(kind, id, words, typos, proximity, attribute, exact) of every document that any term matches."""
    hits = index.join(found, "term")
    single = hits.where("phrase is null").select("kind", "id", "q", "attr", "pos", "edits", "how")
    place = F.col("pos") - F.col("step")
    runs = hits.where("phrase is not null").groupBy("kind", "id", "q", "attr", "phrase", place.alias("pos")).agg(F.countDistinct("step").alias("steps"), F.min("edits").alias("edits"), F.min("how").alias("how"))
    runs = runs.where(F.col("steps") == F.size(F.split("phrase", " "))).select("kind", "id", "q", "attr", "pos", "edits", "how")
    every = single.union(runs)
    best = every.groupBy("kind", "id", "q").agg(
        F.min(F.struct("edits", "how", "attr")).alias("best"),
        F.min("attr").alias("attr"),
        F.collect_set(F.col("attr").cast("long") * ATTR + F.col("pos")).alias("at"),
    )
    docs = best.groupBy("kind", "id").agg(
        F.count("*").alias("words"),
        F.sum("best.edits").alias("typos"),
        F.min("attr").alias("attribute"),
        F.count_if(F.col("best.how") == 0).alias("exact"),
        F.array_sort(F.collect_list(F.struct("q", "at"))).alias("terms"),
    )
    # the gap of consecutive matched terms within one field, at its smallest, at most FAR: sets of places, moved by each gap
    moved = lambda a, k: F.transform(a, lambda x: x + k)
    gap = lambda a, b: F.coalesce(*[F.when(F.arrays_overlap(moved(a, k), b) | F.arrays_overlap(a, moved(b, k)), F.lit(k)) for k in range(1, FAR)], F.lit(FAR))
    pairs = F.transform(F.sequence(F.lit(1), F.size("terms") - 1), lambda i: gap(F.get("terms", i - 1)["at"], F.get("terms", i)["at"]))
    near = F.when(F.size("terms") > 1, F.aggregate(pairs, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0))
    return docs.withColumn("proximity", near).drop("terms")


#: What ranking, paging and choosing among articles need of a document.
NARROW = ("kind", "id", "url", "lat", "lng", "updated_at", "start_time")
RANKS = ("words", "typos", "proximity", "attribute", "exact", "distance_m")


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select([c for c in NARROW if c in docs.columns])


def fill(docs: DataFrame, page: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The whole documents of a page of ranked rows, in its order. The page is what its limit says, so it is broadcast."""
    ranks = [c for c in RANKS if c in page.columns]
    return docs.join(F.broadcast(page.select("kind", "id", *ranks)), ["kind", "id"]).orderBy(*order).limit(limit)


def rank_order(sort: list[Column] | None = None) -> list[Column]:
    return [F.desc("words"), F.asc("typos"), F.asc("proximity"), F.asc("attribute"), *(sort or []), F.desc("exact"), F.desc_nulls_last(F.when(F.col("kind") == "article", F.col("updated_at"))), F.asc("id")]


def search(docs: DataFrame, query: str | None, stop_words=(), synonyms=None, index: DataFrame | Index | None = None) -> DataFrame:
    """docs that match, with the columns that rank_order sorts by. index: a stored one or postings, else made here."""
    terms = query_terms(query or "", list(stop_words))
    if not terms:
        zero = {c: F.lit(0) for c in ("words", "typos", "proximity", "attribute", "exact")}
        return docs.withColumns(zero)
    if isinstance(index, Index):
        found = bounded(stored_expansions(index, terms, synonyms))
        return matching(docs, match(index.posts(_named(found)), found, len(terms)))
    index = postings(docs) if index is None else index
    found = bounded(expansions(dictionary(index), terms, synonyms))
    return matching(docs, match(index, found, len(terms)))


def distinct_articles(docs: DataFrame) -> DataFrame:
    """Of articles with one url, the best by ``rank_order``; rows without a url, and other kinds, all stay. A minimum a url, partly taken before rows meet, so no task gets all rows of a url."""
    key = F.when(F.col("kind") == "article", F.coalesce("url", "id")).otherwise(F.col("id"))
    newest = F.when(F.col("kind") == "article", -F.col("updated_at"))
    rank = F.struct(-F.col("words"), "typos", "proximity", "attribute", -F.col("exact"), F.coalesce(newest, F.lit((1 << 63) - 1)), "id")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    best = docs.select("kind", key.alias("_key"), row.alias("_row"), rank.alias("_rank")).groupBy("kind", "_key").agg(F.min_by("_row", "_rank").alias("_row"))
    return best.select("_row.*")


def page(docs: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One TakeOrderedAndProject: nothing but the page leaves the executors."""
    return docs.orderBy(*order).offset(offset).limit(limit)


def by_distance(docs: DataFrame, at: tuple[float, float], metres: float | None) -> DataFrame:
    """docs with distance_m in whole metres, within the radius if one is given."""
    if metres is not None:
        docs = docs.where(geo.within_radius("lat", "lng", at, metres))
    return docs.withColumn("distance_m", F.round(geo.haversine("lat", "lng", *at)).cast("long"))


def union_kinds(tables: dict[str, DataFrame], kinds: list[str]) -> DataFrame:
    """One bag of all kinds' rows; columns that a kind lacks are null."""
    out = None
    for k in dict.fromkeys(kinds):
        part = tables[k]
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def shape(docs: DataFrame, terms: list[str]) -> DataFrame:
    """What a hit shows: no body, public names, readable times, one snippet."""
    have = set(docs.columns)
    c = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    t = lambda n: F.when(F.col(n).isNotNull(), text.fmt_ts(n)) if n in have else F.lit(None).cast("string")
    summary, body = (text.highlight(text.crop(F.coalesce(c(n), F.lit("")), terms), terms) for n in ("summary", "body"))
    return docs.select(
        "id", "kind", text.highlight("title", terms).alias("title"), text.snippet(summary, body, c("summary")).alias("snippet"), "url", "source", "categories", "tags", "city", "county", "address", "lat", "lng", "geo_precision",
        c("distance_m").alias("distance_m"), t("start_time").alias("starts_at"), t("end_time").alias("ends_at"), t("published_at").alias("published_at"), c("venue_name").alias("venue"), c("phone").alias("phone"), c("website").alias("website"), c("opening_hours").alias("opening_hours"),
    )
