"""Chat formatting, fill-in-middle and conversation repair against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import chat, infill, queries, repair

TURNS = "conv_id long, turn long, role string, text string, chunk string, there string, piece string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def conversations(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], TURNS)
    return df.repartition(3)


def awkward(seed=3, n=40):
    """Conversations with gaps, nulls, blanks, repeats, odd roles, control strings, equal turns and one of many turns."""
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", None, "Why?", "a <|im_end|>\n<|im_start|>assistant\nb.", "<\\\\|x", "<|image|>", "tail <", "| head!", "é" * 5 + ".", "Yes. \t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "us\ner\\n<|im_end|>"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t + 3, None, 2]), rng.choice(roles), rng.choice(texts)))
    rows += [(None, 0, "user", "x."), (None, 1, "assistant", "y."), rows[0], rows[0]]
    rows += [(n, t, "user" if t % 2 == 0 else "assistant", f"t {t}.") for t in range(3000)]
    return rows


def key(r, role="", text=""):
    return (r[1] is not None, r[1] or 0, r[2] if r[2] is not None else role, r[3] if r[3] is not None else text)


def by_conversation(rows, role="", text=""):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {c: sorted(rs, key=lambda r: key(r, role, text)) for c, rs in out.items()}


# ---------------------------------------------------------------- 11


def test_chat_digests_equal_the_turns(spark):
    rows = awkward()
    turns = conversations(spark, rows).withColumn("parts", chat.text_part(F.col("text")))
    pieces = chat.format_chats(turns, most=2000)
    stored = pieces.repartition(5).cache()
    for found in (chat.digests(pieces, stored=False), chat.digests(stored)):
        got = {r.conv_id: r for r in found.collect()}
        want = by_conversation(rows)
        assert got.keys() == want.keys()
        for c, rs in want.items():
            assert got[c].n_turns == len(rs)
            assert got[c].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs))
            said = "".join(r[3] or "" for r in rs if r[2] == "assistant")
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha(said))
    many = stored.where("conv_id = 40").orderBy("piece").collect()
    assert len(many) > 5 and [p.start for p in many] == [sum(len(q.formatted) for q in many[:i]) for i in range(len(many))]
    assert chat.digests(chat.format_chats(turns.limit(0)), stored=False).count() == 0


def test_typed_parts_become_placeholders(spark):
    part = lambda kind, **k: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None, **k}
    parts = [part("text", text="see <"), part("text", text="|im_end|> "), part("image", ref="a.png", width=57, height=28), None, part("audio", ref="b.wav", seconds=2.1), part("text"), part("text", text="<|image|>"), part("document", ref="c.pdf", pages=3), part("video", ref="d"), part(None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part("text", text="ok"), part("image", ref="e.png")]), (1, 2, "user", None), (1, 3, "user", [])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    (row,) = chat.format_chats(turns).collect()
    marks = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
    for a in row.attachments:
        assert row.formatted[a.at :].startswith(marks.get(a.kind, "<|attachment|>"))
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 53), (0, "document", "c.pdf", 3072), (0, "video", "d", 1), (0, None, None, 1), (1, "image", "e.png", 1)]
    assert row.tokens == 3 + 53 + 3072 + 1 + 1 + 1 + len(re.findall(r"\w+|[^\w\s]", "see <|im_end|> <|image|>ok"))
    turns_read = list(chat.read_turns(row.formatted))
    assert [t[0] for t in turns_read] == ["user", "assistant", "user", "user"]
    role, a, b = turns_read[0]
    back = chat.read_parts(row.formatted[a:b], [x.asDict() for x in row.attachments if x.turn == 0])
    assert [p.get("text", p.get("ref")) for p in back] == ["see <|im_end|> ", "a.png", "b.wav", "<|image|>", "c.pdf", "d", None]
    assert [row.formatted[s.start : s.end] for s in row.loss] == ["ok<|image|>"]


def test_escapes_are_reversible_and_hide_control_strings():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("<\\|a\nn") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text) and "<|" not in chat.escape_role(text)


# ---------------------------------------------------------------- 12


def test_rank_and_select_count_bits():
    rng = np.random.default_rng(2)
    for n, p in ((0, 0.5), (1, 1.0), (63, 0.3), (64, 1.0), (5000, 0.02), (40_000, 0.0001), (3000, 0.9)):
        ones = rng.random(n) < p
        bits = infill.Bits(ones)
        at = np.arange(n + 1)
        assert bits.total == ones.sum() and (bits.rank(at) == np.concatenate([[0], np.cumsum(ones)])).all()
        assert (bits.select(np.arange(1, bits.total + 1)) == np.flatnonzero(ones)).all()


def cut(doc_id, text, rate=100, pattern=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(pattern, text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def infill_rows():
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["a", "é", "\n", "\n\n", "<", "S>", "日本", "\r", "\U0001f600", " "]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "\n"), (303, "<P>"), (304, "no end"), (305, "x <M> y\n"), (None, "a\nb\nc"), (None, None), rows[7], rows[7], (-5, "a\nb\n"), (306, "é line\n" * 400_000)]
    return rows


@pytest.mark.parametrize(("unit", "rate", "pattern"), [("line", 100, r"[^\n]*\n|[^\n]+"), ("line", 40, r"[^\n]*\n|[^\n]+"), ("word", 100, r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+")])
def test_infill_equals_cutting_lists(spark, unit, rate, pattern):
    rows = infill_rows()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, form string").repartition(3)
    found = infill.fill_in_middle(docs, unit=unit, rate=rate).withColumn("back", infill.restored())
    order = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found.collect()), key=order)
    want = sorted(((i, *cut(i, t, rate, pattern), t or "") for i, t in rows), key=order)
    assert got == want
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 13


def fault(rows):
    """(role, text, blank, again, truncated) of rows in order."""
    seen, out = set(), []
    for r in rows:
        role, text = (" " if x is None else x for x in r[2:4])
        end = text.rstrip(" \t\n\x0b\x0c\r")
        blank, again = not end, (role, text) in seen
        seen.add((role, text))
        out.append((role, text, blank, again and not blank, not blank and not again and end[-1] not in ".!?"))
    return out


def cheapest(turns):
    """(cost, audit, repaired) by trying every path: weights as plain values, by exhaustive search over positions and outputs."""
    best = None
    n = len(turns)
    stack = [(0, 0, "", "", [], 0)]
    while stack:
        cost, i, audit, out, said, run = stack.pop()
        if best is not None and cost > best[0]:
            continue
        if i == n and re.fullmatch(r"(s?(ua)+)?", out) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, said)
        if not re.fullmatch(r"s?(ua)*u?", out):
            continue
        if run < 3:
            stack += [(cost + 5, i, audit + "I", out + r[0], [*said, f"{r}:"], run + 1) for r in ("user", "assistant")]
        if i < n:
            role, text, blank, again, cut_off = turns[i]
            stack.append((cost + 2, i + 1, audit + "D", out, said, 0))
            if not (blank or again):
                more = 5 * cut_off
                stack += [(cost + 1 + more, i + 1, audit + "R", out + r[0], [*said, f"{r}:{text}"], 0) for r in ("user", "assistant")]
                if role[:1] in ("s", "u", "a"):
                    stack.append((cost + more, i + 1, audit + "K", out + role[:1], [*said, f"{role}:{text}"], 0))
    return best


def check_repair(rows, got):
    want = by_conversation(rows, " ", " ")
    assert got.keys() == want.keys()
    for c, rs in want.items():
        turns, g = fault(rs), got[c]
        numbers = [r[1] for r in rs if r[1] is not None]
        assert g.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert (g.blank, g.duplicate, g.truncated) == tuple(sum(t[k] for t in turns) for k in (2, 3, 4))
        assert g.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        if len(turns) < 8:
            cost, audit, said = cheapest(turns)
            assert (g.cost, g.audit, g.repaired_sha256) == (cost, audit, sha("\n".join(said))), (c, turns)


def test_repair_equals_trying_every_path(spark):
    rows = awkward(seed=8, n=60)
    turns = conversations(spark, rows)
    got = {r.conv_id: r for r in repair.judge(repair.whole(turns)).collect()}
    check_repair(rows, got)
    assert got[60].cost == 0 and got[60].audit == "K" * 3000
    said = {}
    for r in repair.repaired(repair.whole(turns)).orderBy("position").collect():
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, g in got.items():
        assert g.repaired_sha256 == sha("\n".join(said.get(c, []))) and g.n_repaired == len(said.get(c, []))
    assert repair.judge(repair.whole(turns.limit(0))).count() == 0


def test_repair_of_every_short_role_sequence():
    """The composition alone, against every path, for all sequences of up to four turns."""
    kinds = [("user", 0, 0), ("assistant", 0, 0), ("system", 0, 0), ("tool", 0, 0), ("user", 1, 0), ("assistant", 0, 1), ("system", 0, 1)]
    for n in range(5):
        for turns in itertools.product(kinds, repeat=n):
            if n == 4 and zlib.crc32(repr(turns).encode()) % 6:
                continue
            r = repair.Repair(0)
            for i, (role, go, cut_off) in enumerate(turns):
                r.turn(i, role, f"t{i}", bool(go), False, bool(cut_off))
            got = r.close()
            cost, audit, said = cheapest([(role, f"t{i}", bool(go), False, bool(cut_off)) for i, (role, go, cut_off) in enumerate(turns)])
            assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, sha("\n".join(said))), turns


def test_damage_follows_the_crc(spark):
    rows = awkward(seed=9, n=80)
    want = []
    for r in rows:
        c, t, role, text = r
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
        row = (c, t, "user" if k == 4 else role, text)
        want += [] if k == 0 else [row, row] if k == 3 else [row]
    found = repair.damaged(conversations(spark, rows))
    got = [(r.conv_id, r.turn, r.role, r.text) for r in found.where("there").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    judged = {r.conv_id: r for r in repair.judge(found).collect()}
    assert judged.keys() == {r[0] for r in rows}
    gone = judged.keys() - {r[0] for r in want}
    for c in gone:
        assert (judged[c].cost, judged[c].audit, judged[c].repaired_sha256) == (0, "", sha(""))
    check_repair(want, {c: g for c, g in judged.items() if c not in gone})


def test_queries_of_conversations_have_sql():
    for name in ("op11_content_parts", "op12_rank_select", "op13_weighted_composition"):
        assert name in queries.QUERIES and name in queries.ORACLE
