"""Operator 11: chat formatting of turns made of typed content parts.

A visitor flattens a turn's parts: text stays text, an image, audio or document part becomes a placeholder
in its place, with a record of its reference, its place and the tokens that it will expand to. Turns are
written between control strings, with a loss mask over what the assistant says. A control string within a
text gets one more backslash after its ``<`` and loses it when read back, so a text can never open or
close a turn.

Conversations are dealt by id, sorted by turn, and written as a stream of pieces of whole turns, so what a
task holds is one piece (``most`` characters, or one turn) however long the conversation is; only a
conversation beyond that has more than one piece. Places count code points from the conversation's begin.

Order: by turn, null turns first; rows of one turn by role and text. Null role, text, part or list of
parts: empty. Parts of a kind not known become ``<|attachment|>``. A null conv_id is a conversation of its
own. Repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, CLOSE = "<|im_start|>", "<|im_end|>", "<|im_end|>\n"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ATTACHED = pa.struct([("turn", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
_PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("n_turns", pa.int64()), ("start", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN)), ("attachments", pa.list_(_ATTACHED)), ("tokens", pa.int64())])
PIECE = "conv_id long, piece int, n_turns long, start long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<turn:long,kind:string,ref:string,at:long,tokens:long>>, tokens long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("tokens", pa.int64())])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, tokens long"


# ---------------------------------------------------------------- escapes


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    """A role stays on its line."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


# ---------------------------------------------------------------- visitor


@dataclass(frozen=True)
class Rates:
    """Tokens that an attachment expands to: image patches of a side in pixels, audio frames a second, a page's tokens; where a size is null, one patch, second or page."""

    patch: int = 28
    audio: float = 25.0
    page: int = 1024


class Visitor:
    """Flattens parts: ``body`` with placeholders in order, ``found`` (kind, ref, place in body, tokens) and ``tokens``, the text's words and marks plus all expansions."""

    TOKEN = re.compile(r"\w+|[^\w\t\n\f\r ]")

    def __init__(self, rates: Rates):
        self.rates = rates

    def visit(self, parts: list[dict] | None) -> Visitor:
        self.out, self.run, self.found, self.chars, self.tokens = [], [], [], 0, 0
        for part in parts or []:
            if part is not None:
                getattr(self, f"visit_{part['kind']}", self.visit_other)(part)
        self._text()
        self.body = "".join(self.out)
        return self

    def visit_text(self, part: dict) -> None:
        self.run.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        sides = (max(1, math.ceil((part[k] or 0) / self.rates.patch)) for k in ("width", "height"))
        self._attach("image", part, math.prod(sides))

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"]
        self._attach("audio", part, max(1, math.ceil((1.0 if seconds is None or not math.isfinite(seconds) else seconds) * self.rates.audio)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part["pages"] or 1) * self.rates.page)

    def visit_other(self, part: dict) -> None:
        self._attach("attachment", part, 1)

    def _text(self) -> None:
        """Neighbouring texts are escaped as one: a control string can lie across them."""
        text = "".join(self.run)
        self.run = []
        if text:
            self.tokens += sum(1 for _ in self.TOKEN.finditer(text))
            self._put(escape(text))

    def _attach(self, name: str, part: dict, tokens: int) -> None:
        self._text()
        self.found.append({"kind": part["kind"], "ref": part["ref"], "at": self.chars, "tokens": tokens})
        self.tokens += tokens
        self._put(f"<|{name}|>")

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.chars += len(text)


def text_part(text: Column) -> Column:
    """Parts of a turn that is only text."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(null.cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


# ---------------------------------------------------------------- writing


class Writer:
    """Turns of one conversation after another, as pieces."""

    def __init__(self, rates: Rates, most: int):
        self.visitor, self.most, self.open, self.rows = Visitor(rates), most, False, []

    def turn(self, conv: int | None, role: str, parts: list[dict] | None) -> None:
        if not self.open or conv != self.now:
            self.close()
            self.now, self.piece, self.at, self.number, self.open = conv, 0, 0, 0, True
            self._begin()
        elif self.held > self.most:
            self._emit()
            self.piece += 1
            self._begin()
        v = self.visitor.visit(parts)
        head = f"{START}{escape_role(role)}\n"
        body = self.at + len(head)
        if role == "assistant" and v.body:
            self.loss.append({"start": body, "end": body + len(v.body)})
        self.attached += [{**a, "turn": self.number, "at": body + a["at"]} for a in v.found]
        self.out += [head, v.body, CLOSE]
        size = len(head) + len(v.body) + len(CLOSE)
        self.at, self.held, self.number, self.turns, self.tokens = self.at + size, self.held + size, self.number + 1, self.turns + 1, self.tokens + v.tokens

    def _begin(self) -> None:
        self.start, self.held, self.turns, self.tokens, self.out, self.loss, self.attached = self.at, 0, 0, 0, [], [], []

    def _emit(self) -> None:
        self.rows.append({"conv_id": self.now, "piece": self.piece, "n_turns": self.turns, "start": self.start, "formatted": "".join(self.out), "loss": self.loss, "attachments": self.attached, "tokens": self.tokens})

    def close(self) -> None:
        if self.open:
            self._emit()
            self.open = False

    def taken(self) -> list[dict]:
        rows, self.rows = self.rows, []
        return rows


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Each conversation in one task, sorted by Spark (which spills), so that a task streams it."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_chats(turns: DataFrame, rates: Rates = Rates(), most: int = 4_000_000) -> DataFrame:
    """Pieces (conv_id, piece, n_turns, start, formatted, loss, attachments, tokens) of (conv_id, turn, role, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(rates, most)
        for batch in batches:
            for conv, role, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                writer.turn(conv, role or "", parts)
            yield pa.RecordBatch.from_pylist(writer.taken(), _PIECE)
        writer.close()
        yield pa.RecordBatch.from_pylist(writer.taken(), _PIECE)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(PARTS).alias("parts"))
    return in_order(rows, "turn", "role", "parts").select("conv_id", "role", "parts").mapInArrow(run, PIECE)


# ---------------------------------------------------------------- reading back


def read_turns(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, begin of the body, end of the body) of every turn of a piece."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        if not formatted.startswith(START, at):
            raise ValueError("no turn begins here")
        yield unescape_role(formatted[at + len(START) : line]), line + 1, end
        at = end + len(CLOSE)


def read_parts(body: str, attachments: list[dict]) -> list[dict]:
    """The parts of a body, neighbouring texts as one; attachments: those of this turn, in order."""
    parts, left = [], list(attachments)
    for k, piece in enumerate(re.split(r"<\|[a-z]+\|>", body)):
        if k:
            found = left.pop(0)
            parts.append({"kind": found["kind"], "ref": found["ref"]})
        if piece:
            parts.append({"kind": "text", "text": unescape(piece)})
    return parts


class Reader:
    """Digests of conversations, read from their pieces in order."""

    def __init__(self):
        self.open, self.rows = False, []

    def piece(self, row: dict) -> None:
        if row["piece"] == 0:
            self.close()
            self.open, self.conv, self.turns, self.chars, self.loss, self.tokens = True, row["conv_id"], 0, 0, 0, 0
            self.all, self.said = hashlib.sha256(), hashlib.sha256()
        text, start = row["formatted"], row["start"]
        for role, a, b in read_turns(text):
            self.all.update(f"{role}\n{unescape(text[a:b])}\n".encode())
            self.turns += 1
        for span in row["loss"]:
            said = unescape(text[span["start"] - start : span["end"] - start])
            self.said.update(said.encode())
            self.loss += len(said)
        self.chars += len(text)
        self.tokens += row["tokens"]

    def close(self) -> None:
        if self.open:
            self.rows.append({"conv_id": self.conv, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.said.hexdigest(), "formatted_chars": self.chars, "tokens": self.tokens})
            self.open = False


def digests(pieces: DataFrame, stored: bool = True) -> DataFrame:
    """What the pieces of each conversation hold. stored: pieces come from a table, so they are dealt and sorted first; those fresh from ``format_chats`` lie in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for row in batch.to_pylist():
                reader.piece(row)
            rows, reader.rows = reader.rows, []
            yield pa.RecordBatch.from_pylist(rows, _DIGEST)
        reader.close()
        yield pa.RecordBatch.from_pylist(reader.rows, _DIGEST)

    rows = in_order(pieces, "piece") if stored else pieces
    return rows.select("conv_id", "piece", "start", "formatted", "loss", "tokens").mapInArrow(run, DIGEST)
