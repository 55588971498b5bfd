"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY_CHARS, BODY_CHARS = 600, 20_000

# fixed values: accented letters and what they fold to, letter by letter
FOLD_FROM = "áàâäãåÁÀÂÄÃÅéèêëÉÈÊËíìîïÍÌÎÏóòôöõÓÒÔÖÕúùûüÚÙÛÜñÑçÇ"
FOLD_TO = "aaaaaaaaaaaaeeeeeeeeiiiiiiiioooooooooouuuuuuuunncc"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(ws_trim(x), F.lit(""))


def ws_trim(x: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def collapse_ws(x: Column | str) -> Column:
    """Each run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def truncate_chars(x: Column | str, most: int) -> Column:
    """At most ``most`` characters; cut texts end in an ellipsis, at a space if one stands in the last fifth (by bytes)."""
    x = col(x)
    head = F.substring(x, 1, most - 1)
    before = F.regexp_extract(head, r"^([\s\S]*) [^ ]*$", 1)
    at_space = F.contains(head, F.lit(" ")) & (F.octet_length(before) > (most - 1) * 4 // 5)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.when(at_space, before).otherwise(head), F.lit("…")))


def dedupe_lower(x: Column | str) -> Column:
    """Array entries collapsed and lower-cased, without blanks and repeats, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(col(x), lambda e: F.lower(collapse_ws(e))), lambda e: e != ""))


def fold(x: Column | str) -> Column:
    return F.translate(col(x), FOLD_FROM, FOLD_TO)


def normalize(x: Column | str) -> Column:
    """Folded, lower-cased letters and digits; everything between them is one space."""
    return F.trim(F.regexp_replace(F.lower(fold(x)), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def normalize_county(x: Column | str) -> Column:
    return F.regexp_replace(normalize(x), " county$", "")


def geocode_key(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(collapse_ws(x), r"^[,\s]+|[,\s]+$", ""))


def form_encode(x: Column | str) -> Column:
    """Percent-encoding that keeps letters, digits and -_.~ and writes a space as +."""
    return F.replace(F.replace(F.url_encode(col(x)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def split_semis(x: Column | str) -> Column:
    """Entries of a semicolon list, underscores as spaces; null gives an empty array."""
    parts = F.transform(F.split(col(x), ";"), lambda e: F.replace(F.trim(e), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.filter(parts, lambda e: e != ""), F.array().cast("array<string>"))


def first_paragraph(x: Column | str, most: int = 500) -> Column:
    parts = F.filter(F.split(col(x), "\n\n"), lambda e: ws_trim(e) != "")
    return truncate_chars(collapse_ws(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))), most)


def describe(name: Column, categories: Column, city: Column) -> Column:
    """One line for a place that has no description."""
    what = F.coalesce(F.get(categories, F.lit(0)), F.lit("place"))
    return F.concat(name, F.lit(" — "), what, F.coalesce(F.concat(F.lit(" in "), city), F.lit("")), F.lit("."))


def schema_date(x: Column | str) -> Column:
    """Epoch seconds of an RFC 3339 time, a local date-time (taken as UTC) or a date; else null."""
    x = F.trim(col(x))
    shape = {
        r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]XXX",
        r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$": "yyyy-MM-dd'T'HH:mm:ss",
        r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd",
    }
    first, *rest = shape.items()
    plain = F.regexp_replace(F.regexp_replace(x, r"\.\d+", ""), "^(.{10}) ", "$1T")
    out = F.when(x.rlike(first[0]), F.unix_timestamp(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))
    for pattern, form in rest:
        out = out.when(x.rlike(pattern), F.unix_timestamp(F.try_to_timestamp(x, F.lit(form))))
    return out


def fmt_ts(x: Column | str) -> Column:
    """Epoch seconds as yyyy-MM-dd HH:mm UTC; a dash for null. The session's time zone must be UTC."""
    return F.coalesce(F.date_format(F.timestamp_seconds(col(x)), "yyyy-MM-dd HH:mm 'UTC'"), F.lit("—"))


def ago(x: Column | str, now: Column | int) -> Column:
    """How long before now, in the largest whole unit; a month has 30 days."""
    now = F.lit(now) if isinstance(now, int) else now
    s = F.greatest(now - col(x), F.lit(0).cast("long"))
    out = F.when(s < 60, F.lit("just now"))
    for limit, unit, name in ((3_600, 60, "minute"), (86_400, 3_600, "hour"), (2_592_000, 86_400, "day"), (None, 2_592_000, "month")):
        n = F.floor(s / unit)
        said = F.concat(plural(n, name), F.lit(" ago"))
        out = out.otherwise(said) if limit is None else out.when(s < limit, said)
    return out


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def distance_label(metres: Column | str) -> Column:
    """Whole metres below a kilometre, then kilometres with one decimal, halves up."""
    m = col(metres)
    tenths = F.floor((F.round(m).cast("long") + 50) / 100).cast("long")
    return F.when(m < 1000, F.concat(m.cast("long").cast("string"), F.lit(" m"))).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" km")))


def short(x: Column | str, most: int) -> Column:
    """Trimmed; if longer than most characters, its first most and an ellipsis."""
    t = ws_trim(x)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit("…")))


def form_field(x: Column | str, most: int = 300) -> Column:
    return F.nullif(F.substring(ws_trim(x), 1, most), F.lit(""))


def host_of(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


def wiki_page_url(url: Column | str, page_id: Column | str, default: str = "https://en.wikipedia.org") -> Column:
    u = col(url)
    scheme = F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit(default.split("://")[0]))
    host = F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(default.split("://")[1]))
    return F.concat(scheme, F.lit("://"), host, F.lit("/?curid="), col(page_id).cast("string"))


def word_count(x: Column | str) -> Column:
    c = collapse_ws(x)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " "))).cast("long")


def kind_of(x: Column | str) -> Column:
    """place, event or article, from its singular or plural; else null."""
    k = F.lower(ws_trim(x))
    out = F.lit(None).cast("string")
    for name in ("place", "event", "article"):
        out = F.when(k.isin(name, name + "s"), F.lit(name)).otherwise(out)
    return out


def number(x: Column | str) -> Column:
    """A JSON number, or a string that holds one, as a double."""
    return F.try_variant_get(col(x), "$", "double") if not isinstance(x, str) else F.try_variant_get(F.col(x), "$", "double")


def tokens(x: Column | str) -> Column:
    """Search tokens in order: runs of letters and digits, folded and lower-cased."""
    return F.regexp_extract_all(F.lower(fold(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def snippet(formatted_summary: Column, formatted_body: Column, summary: Column) -> Column:
    return F.coalesce(blank_to_null(formatted_summary), blank_to_null(formatted_body), blank_to_null(summary))


def highlight(x: Column | str, words: list[str], mark: str = "**") -> Column:
    """Whole words marked, whatever their case."""
    if not words:
        return col(x)
    import re

    pattern = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return F.regexp_replace(col(x), rf"(?iu)(?<![\p{{L}}\p{{N}}])({pattern})(?![\p{{L}}\p{{N}}])", f"{mark}$1{mark}")


def crop(x: Column | str, words: list[str], most: int = 40) -> Column:
    """About ``most`` words around the first of these words; the beginning if none occurs."""
    parts = F.split(collapse_ws(x), " ")
    plain = F.transform(parts, lambda w: F.regexp_replace(F.lower(fold(w)), r"[^\p{L}\p{N}]+", ""))
    hit = F.array_min(F.filter(F.transform(F.array(*[F.lit(w) for w in words or [""]]), lambda w: F.array_position(plain, w)), lambda p: p > 0))
    start = F.greatest(F.lit(1).cast("long"), F.least(F.coalesce(hit, F.lit(1).cast("long")) - most // 2, F.size(parts) - most + 1))
    cut = F.array_join(F.slice(parts, start.cast("int"), F.lit(most)), " ")
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(F.size(parts) >= start + most, "…").otherwise(""))
