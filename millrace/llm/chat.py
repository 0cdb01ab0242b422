"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor walks the parts in order
and flattens them into the turn's template: text is escaped, every other part becomes a placeholder, an
attachment reference is recorded with its ordinal, and the tokens that the placeholder will expand to are
counted. The template marks turns with control strings; the same strings inside texts are escaped so that
``parse_turn`` gives back exactly what went in.

One row is made per turn (a segment); the formatted conversation is its segments joined in order. So a
conversation of any length is formatted in parallel, and only readers that need the order sort it.

Defined cases: null roles and texts are empty; a null content list is one empty text; turns are ordered by
turn (nulls first), then role, then text, and equal rows all count; an empty table gives an empty table;
columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
TURN_START, TURN_END, CONTROL = "<|im_start|>", "<|im_end|>", "<|"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

PART_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

_ESCAPED = re.compile(r"\\(.)", re.S)
_UNESCAPED = {"n": "\n"}


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder expands to."""

    patch: int = 14
    audio_per_second: float = 25.0
    document_per_page: int = 256

    def image(self, part: dict) -> int:
        across = -(-(part.get("width") or 0) // self.patch)
        down = -(-(part.get("height") or 0) // self.patch)
        return max(1, across * down)

    def audio(self, part: dict) -> int:
        return max(1, -int(-(part.get("seconds") or 0.0) * self.audio_per_second // 1))

    def document(self, part: dict) -> int:
        return max(1, (part.get("pages") or 0) * self.document_per_page)


def escape(text: str) -> str:
    """Text in which no control string is left."""
    return text.replace("\\", "\\\\").replace(CONTROL, "<\\|")


def escape_role(role: str) -> str:
    """As ``escape``, on one line."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str, names: dict[str, str] | None = None) -> str:
    """The text that ``escape`` (or, with its names, ``escape_role``) was given."""
    return _ESCAPED.sub(lambda m: (names or {}).get(m[1], m[1]), text) if "\\" in text else text


@dataclass
class PartVisitor:
    """Flattens parts in order; ``visit_<kind>`` handles a kind."""

    expansion: Expansion = field(default_factory=Expansion)
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded_tokens: int = 0
    length: int = 0

    def visit(self, part: dict) -> None:
        handler: Callable[[dict], None] | None = getattr(self, f"visit_{part.get('kind')}", None)
        if handler is None:
            raise ValueError(f"unknown kind of content part: {part.get('kind')!r}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach(part, self.expansion.image(part))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, self.expansion.audio(part))

    def visit_document(self, part: dict) -> None:
        self._attach(part, self.expansion.document(part))

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"ordinal": len(self.attachments), "kind": part["kind"], "ref": part.get("ref"), "offset": self.length, "n_tokens": tokens})
        self._add(PLACEHOLDERS[part["kind"]])
        self.expanded_tokens += tokens

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)


def format_turn(role: str | None, parts: list[dict] | None, trained: frozenset[str], expansion: Expansion) -> dict:
    """One turn's segment, the bounds of what is trained on in it, and its attachments."""
    visitor = PartVisitor(expansion)
    for part in parts if parts is not None else [{"kind": "text"}]:
        visitor.visit(part)
    head = f"{TURN_START}{escape_role(role or '')}\n"
    body = "".join(visitor.pieces)
    for a in visitor.attachments:
        a["offset"] += len(head)
    last = len(head) + len(body) if role in trained else len(head)
    return {"segment": head + body + f"{TURN_END}\n", "loss_from": len(head), "loss_to": last, "attachments": visitor.attachments, "expanded_tokens": visitor.expanded_tokens}


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text of a segment of text parts; a turn's marks stand at its ends and nowhere else."""
    if not segment.startswith(TURN_START) or not segment.endswith(f"{TURN_END}\n"):
        raise ValueError("not a turn")
    inner = segment[len(TURN_START) : -len(TURN_END) - 1]
    if TURN_START in inner or TURN_END in inner:
        raise ValueError("a mark inside a turn")
    role, _, body = inner.partition("\n")
    return unescape(role, _UNESCAPED), unescape(body)


class TurnReader:
    """Finds the turns of a formatted conversation that comes in chunks of any size, whatever made them.

    Only the turn that is still open is held.
    """

    def __init__(self):
        self.open, self.at, self.seen = "", 0, 0

    def feed(self, chunk: str) -> Iterator[tuple[int, str]]:
        """Offset and segment of each turn that ends in what has come so far."""
        self.open += chunk
        while (end := self.open.find(TURN_END, self.seen)) >= 0 and end + len(TURN_END) < len(self.open):
            past = end + len(TURN_END) + 1
            turn, first = self.open[:past], self.at
            self.open, self.at, self.seen = self.open[past:], self.at + past, 0
            yield first, turn
        self.seen = max(0, len(self.open) - len(TURN_END))

    def close(self) -> None:
        if self.open:
            raise ValueError("the last turn has no end")


def parse_conversation(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    reader = TurnReader()
    turns = [parse_turn(t) for _, t in reader.feed(formatted)]
    reader.close()
    return turns


def format_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, trained: tuple[str, ...] = ("assistant",), expansion: Expansion | None = None) -> DataFrame:
    """A segment for each row, with ``conv_id, turn, role, text`` kept for the order.

    Give ``parts`` (of ``PART_TYPE``) for typed content; else each text is one text part. Adds ``segment``,
    ``loss_from``, ``loss_to`` (code points in the segment), ``attachments`` and ``expanded_tokens``.
    Narrow: no shuffle.
    """
    kinds, how = frozenset(trained), expansion or Expansion()
    content: Column = F.col(parts).cast(PART_TYPE) if parts else F.lit(None).cast(PART_TYPE)
    chosen = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), content.alias("parts"))
    keys = [chosen.schema[n] for n in ("conv_id", "turn")]
    schema = (
        f"{', '.join(f'{k.name} {k.dataType.simpleString()}' for k in keys)}, role string, text string, segment string, loss_from int, loss_to int, "
        "attachments array<struct<ordinal:int,kind:string,ref:string,offset:int,n_tokens:int>>, expanded_tokens long"
    )
    attachment = pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int32()), ("n_tokens", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts, typed = (batch.column(k).to_pylist() for k in (2, 3, 4))
            made = [format_turn(r, p if p is not None else [{"kind": "text", "text": t}], kinds, how) for r, t, p in zip(roles, texts, typed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array([m["segment"] for m in made], pa.string()),
                    pa.array([m["loss_from"] for m in made], pa.int32()),
                    pa.array([m["loss_to"] for m in made], pa.int32()),
                    pa.array([m["attachments"] for m in made], attachment),
                    pa.array([m["expanded_tokens"] for m in made], pa.int64()),
                ],
                ["conv_id", "turn", "role", "text", "segment", "loss_from", "loss_to", "attachments", "expanded_tokens"],
            )

    return chosen.mapInArrow(run, schema)


def ordered(segments: DataFrame) -> DataFrame:
    """Segments with each conversation together and its turns in order within one partition.

    A conversation's digest and text are sequential, so its segments meet in one task; they stream through
    it sorted (spilling to disk), never as one group in memory.
    """
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def join_segments(segments: DataFrame) -> DataFrame:
    """One row a conversation: ``formatted`` and ``loss_spans`` over it. For conversations of document size."""

    def flush(conv: object, texts: list[str], spans: list[dict]) -> dict:
        return {"conv_id": conv, "formatted": "".join(texts), "loss_spans": spans}

    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, spans, size, begun, done, schema = None, [], [], 0, False, [], None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])))])
            for conv, segment, a, b in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "segment", "loss_from", "loss_to")), strict=True):
                if begun and conv != now:
                    done.append(flush(now, texts, spans))
                    texts, spans, size = [], [], 0
                now, begun = conv, True
                texts.append(segment)
                if b > a:
                    spans.append({"first": size + a, "past": size + b})
                size += len(segment)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if begun:
            yield pa.RecordBatch.from_pylist([flush(now, texts, spans)], schema)

    return ordered(segments).select("conv_id", "segment", "loss_from", "loss_to").mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans array<struct<first:int,past:int>>")


class _Digest:
    """Reads one conversation back from its formatted output and the loss mask over it, keeping digests only."""

    def __init__(self, conv: object):
        self.conv, self.n, self.chars, self.loss = conv, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()
        self.reader, self.spans = TurnReader(), deque()

    def add(self, chunk: str, a: int, b: int) -> None:
        """The next chunk of the output, with the mask's bounds in it."""
        if b > a:
            self.spans.append((self.chars + a, self.chars + b))
        self.chars += len(chunk)
        for first, turn in self.reader.feed(chunk):
            role, text = parse_turn(turn)
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
            while self.spans and self.spans[0][0] < first + len(turn):
                x, y = self.spans.popleft()
                part = unescape(turn[x - first : y - first])
                self.masked.update(part.encode())
                self.loss += len(part)

    def row(self) -> dict:
        self.reader.close()
        return {"conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.masked.hexdigest(), "formatted_chars": self.chars}


def conversation_digest(segments: DataFrame) -> DataFrame:
    """What the formatted conversations hold: counts and digests, read back from each one's whole output.

    The output streams by as its joined segments; turns are found by their marks in it, never by the segments' ends.
    """
    counts = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now = None, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *counts])
            done = []
            for conv, segment, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(segment, a, b)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    in_order = ordered(segments).select("conv_id", "segment", "loss_from", "loss_to")
    kind = segments.schema["conv_id"].dataType.simpleString()
    return in_order.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
