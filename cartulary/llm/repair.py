"""Operator 13: conversation repair by composing weighted finite-state machines.

The turns of a conversation are the input acceptor, a chain. The edit transducer keeps a turn (cost 0),
gives it the role user or assistant (1), deletes it (2; a blank or repeated turn must go) or inserts an
empty turn anywhere (5); a truncated turn that stays adds 5. The grammar acceptor takes the role initials
``(s?(ua)+)?``. Their composition is expanded lazily, a turn at a time in topological order: no best path
inserts more than two turns in a row (of three, two neighbours can go, which leaves the grammar satisfied
and costs 10 less), so the transducer counts inserts up to two and the machine has no cycle. Weights are
(cost, label string), added by the smaller and multiplied by sum and concatenation. Best strings into
different states that end with a turn's edit are never one the beginning of the other, so their order is
kept as a rank and strings are compared by what a turn appends.

A conversation streams through one task in order, sorted by Spark, which spills. The task holds a digest
of the repaired turns and a weight for each of the grammar's four states, and four bytes a turn to trace
the labels back; texts are not held. A conversation is not cut: its two digests and its audit are each one
value that depends on all its turns in order. What is seen earlier in a conversation is found by a window
over equal turns.

Order: by turn, null turns first; rows of one turn by role and text. Null role or text: one space. A null
conv_id is a conversation of its own. Repeated rows are turns of their own. A conversation without turns
gets zeros, an empty audit and the digest of nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = ("user", "assistant")
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: The grammar: state and role initial to state; it may end where nothing was said yet or the assistant spoke last.
GRAMMAR = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (BEGIN, ASSISTANT)
LABELS = "DIKR"
INSERTED = {BEGIN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the one turn that may follow as an insert
_FOUND = pa.schema([(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())] + [(n, pa.int64()) for n in ("n_turns", "n_repaired")])
FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_turns long, n_repaired long"
_EDIT = pa.schema([("conv_id", pa.int64()), ("number", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("new_role", pa.string())])
EDIT = "conv_id long, number long, position long, edit string, new_role string"


class Path:
    """The best path into a grammar state that ends with a turn's edit."""

    __slots__ = ("cost", "rank", "digest", "said")

    def __init__(self, cost: int, rank: int, digest, said: bool):
        self.cost, self.rank, self.digest, self.said = cost, rank, digest, said

    def then(self, cost: int, inserts: int, first: int, role: str | None, text: str) -> Path:
        """Longer by inserted turns, the first of them of a role, and by a turn (role None: deleted)."""
        turns = [f"{ROLES[(first + k) % 2]}:" for k in range(inserts)]
        if role is not None:
            turns.append(f"{role}:{text}")
        digest = self.digest.copy()
        if turns:
            digest.update(("\n" * self.said + "\n".join(turns)).encode())
        return Path(cost, 0, digest, self.said or bool(turns))


class Composition:
    """Chain, transducer and grammar, composed turn by turn: best paths, and the edits that led to each."""

    def __init__(self):
        self.best = {BEGIN: Path(0, 0, hashlib.sha256(), False)}
        self.back = bytearray()  # of each turn and state: the state before, inserts, label

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        new: dict[int, tuple] = {}
        initial, more = role[:1], TRUNCATED if truncated else 0

        def arc(state: int | None, cost: int, suffix: str, path: Path, before: int, out: str | None) -> None:
            if state is not None and (state not in new or (cost, path.rank, suffix) < new[state][:3]):
                new[state] = (cost, path.rank, suffix, path, before, out)

        for before, path in self.best.items():
            at, cost, inserts = before, path.cost, ""
            for _ in range(3):
                arc(at, cost + DELETE, inserts + "D", path, before, None)
                if not must_go:
                    arc(GRAMMAR.get((at, initial)), cost + KEEP + more, inserts + "K", path, before, role)
                    for r in ROLES:
                        arc(GRAMMAR.get((at, r[0])), cost + REROLE + more, inserts + "R", path, before, r)
                at, cost, inserts = INSERTED[at], cost + INSERT, inserts + "I"
        self.best, trace = {}, bytearray(4)
        for rank, state in enumerate(sorted(new, key=lambda s: new[s][1:3])):
            cost, _, suffix, path, before, out = new[state]
            after = path.then(cost, len(suffix) - 1, INSERTED[before] != USER, out, text)
            after.rank = rank
            self.best[state] = after
            trace[state] = before | (len(suffix) - 1) << 2 | LABELS.index(suffix[-1]) << 4
        self.back += trace

    def end(self) -> tuple[int, str, str]:
        """Cost, labels and digest of the best path of all."""
        found = None
        for before, path in self.best.items():
            at, cost = before, path.cost
            for k in range(3):
                if at in FINAL and (found is None or (cost, path.rank, k) < found[:3]):
                    found = (cost, path.rank, k, before)
                at, cost = INSERTED[at], cost + INSERT
        cost, _, inserts, state = found
        digest = self.best[state].then(cost, inserts, INSERTED[state] != USER, None, "").digest.hexdigest()
        labels = ["I" * inserts]
        for at in range(len(self.back) - 4, -1, -4):
            code = self.back[at + state]
            labels.append("I" * (code >> 2 & 3) + LABELS[code >> 4])
            state = code & 3
        return cost, "".join(reversed(labels)), digest


class Repair:
    """Faults and cheapest edits of one conversation, from its turns in order."""

    def __init__(self, conv: int | None):
        self.conv, self.machine = conv, Composition()
        self.blank = self.duplicate = self.truncated = self.illegal = self.n = self.distinct = 0
        self.low = self.high = self.before = None

    def turn(self, number: int | None, role: str, text: str, blank: bool, again: bool, truncated: bool) -> None:
        if number is not None:
            if number != self.high:
                self.distinct += 1
            self.low = number if self.low is None else self.low
            self.high = number
        self.blank += blank
        self.duplicate += again
        self.truncated += truncated
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.n += 1
        self.machine.turn(role, text, blank or again, truncated)

    def close(self) -> dict:
        cost, audit, digest = self.machine.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv_id": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest, "n_turns": self.n, "n_repaired": len(audit) - audit.count("D")}


def edits(conv: int | None, audit: str) -> Iterator[dict]:
    """The turns that an audit gives: number of the input turn (null: inserted), place, edit, new role (null: its own). The grammar fixes the roles."""
    number = position = 0
    opening = (len(audit) - audit.count("D")) % 2  # an odd number of turns begins with the system
    for label in audit:
        number += label != "I"
        if label != "D":
            yield {"conv_id": conv, "number": None if label == "I" else number, "position": position, "edit": label, "new_role": None if label == "K" else ROLES[(position - opening) % 2]}
            position += 1


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there) after the damage that a row's crc32 names; a dropped row stays as a mark with ``there`` false."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), what.alias("what"), spaced("role").alias("role"), spaced("text").alias("text"))
    role = F.when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("what") <= 1, F.lit("")).when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") != 0).alias("there"), F.explode(times).alias("_copy")).drop("_copy")


def whole(turns: DataFrame) -> DataFrame:
    """Turns as they are, for ``repair``."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"), F.lit(True).alias("there"))


#: Of the rows of a conversation.
ORDER = ("turn", "role", "text")


def flagged(turns: DataFrame) -> DataFrame:
    """Turns in order, with the first fault of each: blank, again (role and text seen earlier) or truncated."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = turns.repartition("conv_id").withColumns({"blank": (end == "") & F.col("there"), "_open": ~F.substring(end, -1, 1).isin(".", "!", "?")})
    seen = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy("turn")) > 1
    rows = rows.withColumn("again", seen & ~F.col("blank") & F.col("there"))
    rows = rows.withColumn("truncated", F.col("_open") & ~F.col("blank") & ~F.col("again") & F.col("there"))
    return rows.select("conv_id", "turn", "role", "text", "there", "blank", "again", "truncated").sortWithinPartitions("conv_id", *ORDER)


def _stream(turns: DataFrame, each, schema: pa.Schema, ddl: str) -> DataFrame:
    """each: rows of a conversation, from its closed Repair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        for batch in batches:
            rows: list[dict] = []
            for conv, number, role, text, there, *faults in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        rows += each(now.close())
                    now = Repair(conv)
                if there:
                    now.turn(number, role, text, *faults)
            yield pa.RecordBatch.from_pylist(rows, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist(list(each(now.close())), schema)

    return flagged(turns).mapInArrow(run, ddl)


def judge(turns: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cost and labels of the cheapest edits (audit) and the digest of the repaired turns. turns: from ``whole`` or ``damaged``."""
    return _stream(turns, lambda found: [found], _FOUND, FOUND)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns themselves: (conv_id, position, edit, role, text)."""
    made = _stream(turns, lambda found: edits(found["conv_id"], found["audit"]), _EDIT, EDIT)
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(*ORDER)).cast("long")
    own = turns.where("there").select(F.col("conv_id").alias("_conv"), number.alias("_number"), F.col("role").alias("_role"), "text")
    both = made.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("number") == F.col("_number")), "left")
    return both.select("conv_id", "position", "edit", F.coalesce("new_role", "_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
