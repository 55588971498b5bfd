"""Arguments of queries and settings, checked on the driver."""

from __future__ import annotations

from datetime import UTC, date, datetime
from urllib.parse import urlsplit

KIND_NAMES = {"place": "place", "places": "place", "event": "event", "events": "event", "article": "article", "articles": "article"}
DEFAULT_LIMIT, MAX_LIMIT = 10, 50
_UNITS = {"": 1, "s": 1, "sec": 1, "secs": 1, "m": 60, "min": 60, "mins": 60, "h": 3600, "hr": 3600, "hrs": 3600, "d": 86400, "day": 86400, "days": 86400}


class ArgumentError(ValueError):
    """An argument that a query cannot use."""


def kinds(names: list[str] | None, default: tuple[str, ...]) -> list[str]:
    """Known kinds in order, each once."""
    out: dict[str, None] = {}
    for n in names or ():
        kind = KIND_NAMES.get(n.strip().lower())
        if kind is None:
            raise ArgumentError(f"unknown kind {n!r}; known: place, event, article")
        out[kind] = None
    return list(out) or list(default)


def limit(n: int | None) -> int:
    return max(1, min(MAX_LIMIT, DEFAULT_LIMIT if n is None else n))


def time(value: str | int | None) -> int | None:
    """Epoch seconds of a number, an RFC 3339 time or a date; blank is none."""
    if value is None or isinstance(value, int):
        return value
    s = value.strip()
    if not s:
        return None
    try:
        return int(s)
    except ValueError:
        pass
    try:
        if len(s) == 10:
            d = date.fromisoformat(s)
            return int(datetime(d.year, d.month, d.day, tzinfo=UTC).timestamp())
        at = datetime.fromisoformat(s)
        if at.tzinfo is not None and "T" in s.upper():
            return int(at.timestamp())
    except ValueError:
        pass
    raise ArgumentError(f"not a time: {value!r}; use epoch seconds, RFC 3339 or YYYY-MM-DD")


def csv(raw: str | None) -> list[str]:
    return [x.strip() for x in (raw or "").split(",") if x.strip()]


def duration(raw: str) -> int:
    """Seconds of 45, 45s, 30m, 6h or 2d; zero is an error."""
    s = raw.strip()
    n = len(s) - len(s.lstrip("0123456789"))
    unit = s[n:].strip()
    if not n or unit not in _UNITS:
        raise ArgumentError(f"not a duration: {raw!r}")
    seconds = int(s[:n]) * _UNITS[unit]
    if not seconds:
        raise ArgumentError(f"a duration of zero: {raw!r}")
    return seconds


def intervals(raw: str | None) -> dict[str, int]:
    out = {}
    for entry in csv(raw):
        name, eq, value = entry.partition("=")
        if not eq:
            raise ArgumentError(f"not name=duration: {entry!r}")
        out[name.strip()] = duration(value)
    return out


def seeds(raw: str | None) -> list[tuple[str, str | None]]:
    """(url, town) of url|Town entries."""
    out = []
    for entry in csv(raw):
        url, _, town = (x.strip() for x in entry.partition("|"))
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ArgumentError(f"not an http or https url: {entry!r}")
        out.append((url, town or None))
    return out


def client_key(forwarded: str | None, real_ip: str | None, peer: str | None) -> str:
    """Who a request is counted against."""
    first = (forwarded or "").split(",")[0].strip()
    return first or (real_ip or "").strip() or peer or "unknown"
