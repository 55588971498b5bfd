"""Pages of hits as text. Rows here have been collected: at most one page of them."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any


def distance(metres: int) -> str:
    return f"{metres} m" if metres < 1000 else f"{metres / 1000:.1f} km"


def header(shown: int, region: str, subject: str, total: int, offset: int = 0) -> str:
    more = f"; {total} in all, continue at offset {offset + shown}" if total > offset + shown else ""
    return f"{shown} hit{'' if shown == 1 else 's'} for {subject} in {region}{more}"


def hit(n: int, row: dict[str, Any]) -> str:
    where = [row.get("city"), distance(row["distance_m"]) if row.get("distance_m") is not None else None]
    span = " – ".join(x for x in (row.get("starts_at"), row.get("ends_at")) if x)
    lines = [
        f"{n}. {row['title']} ({row['kind']})" + "".join(f", {w}" for w in where if w),
        span or row.get("published_at"),
        ", ".join(row.get("categories") or []),
        row.get("snippet"),
        row.get("venue"),
        row.get("address"),
        " / ".join(x for x in (row.get("phone"), row.get("website")) if x),
        row.get("opening_hours"),
        row.get("url"),
        f"[{row['kind']} {row['id']}, {row['source']}, {row['geo_precision']}]",
    ]
    return "\n   ".join(x for x in lines if x)


def page(top: str, rows: Iterable[Any]) -> str:
    parts = [hit(i, r.asDict() if hasattr(r, "asDict") else r) for i, r in enumerate(rows, 1)]
    return "\n\n".join([top, *parts]) if parts else f"{top}\n\nNo match. A wider radius or fewer filters may help."


def document(row: dict[str, Any]) -> str:
    """A whole document, one field a line, empty fields left out."""
    return "\n".join(f"{k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in row.items() if v not in (None, "", []))


def region(d: dict[str, Any]) -> str:
    box = ", ".join(f"{x:.4f}" for x in d["bbox"])
    rows = [f"{d['name']}: {box}", *(f"{k}: {n}" for k, n in d["counts"].items()), "categories: " + ", ".join(f"{c} ({n})" for c, n in d["categories"]), "counties: " + ", ".join(d["counties"]), "places: " + ", ".join(d["locales"])]
    return "\n".join(rows)


def locales(rows: Iterable[Any]) -> str:
    out, county = [], object()
    for r in rows:
        if r.county != county:
            county = r.county
            out.append(county or "(no county)")
        out.append(f"  {r.name} ({r.lat:.4f}, {r.lng:.4f})" + (f", also {', '.join(r.aliases)}" if r.aliases else ""))
    return "\n".join(out)
