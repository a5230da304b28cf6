"""Chat formatting with typed content parts.

A turn's content is a list of parts (type, text, uri, tokens). A visitor walks over it: text parts are escaped and written,
image, audio and document parts become numbered placeholders in order, with their attachment's reference and expanded token count
recorded beside the conversation. The template is

    <|turn|>ROLE<|content|>TEXT<|end|>   and, for an attachment within TEXT,   <|image:0|>

Inside texts and roles every "<", backslashes (none or more), "|" gets one backslash more, so none of the template's strings can occur in
them, and taking one away from each gives the text back. The loss mask is the spans of assistant texts, as written.

Conversations are brought together by one shuffle and sorted within their tasks; a task holds one conversation at a
time. Turns of equal number are ordered by role, then by text.

Corner cases: a null text or part list is the empty text, a null role the empty role, a null turn goes first; rows without conv_id form a
conversation of their own. Unknown part types are written as placeholders of their own type, with no tokens. Repeated rows are turns
like others; very long texts are written whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import fill_missing

TURN, CONTENT, END = "<|turn|>", "<|content|>", "<|end|>"
ESCAPE, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
MARK = re.compile(r"<\|turn\|>(.*?)<\|content\|>(.*?)<\|end\|>", re.DOTALL)
PLACEHOLDER = re.compile(r"<\|\w+:\d+\|>")
PARTS = "array<struct<type:string,text:string,uri:string,tokens:int>>"
FORMATTED = "conv_id long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<turn:int,type:string,number:int,uri:string,tokens:int>>, n_tokens_expanded long"
#: Tokens of an attachment that does not state them.
TOKENS = {"image": 576, "audio": 750, "document": 1024}


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


@dataclass
class Visitor:
    """Writes the parts of a conversation's turns one after another."""

    written: list[str] = field(default_factory=list)
    size: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    turns: int = 0

    def write(self, text: str) -> None:
        self.written.append(text)
        self.size += len(text)

    def turn(self, role: str | None, parts: list[dict]) -> None:
        self.write(f"{TURN}{escape(role or '')}{CONTENT}")
        for part in parts:
            start = self.size
            visit: Callable[[dict], None] = getattr(self, f"visit_{part['type'] or 'text'}", self.visit_other)
            visit(part)
            if role == "assistant" and (part["type"] or "text") == "text" and self.size > start:
                self.loss.append({"start": start, "end": self.size})
        self.write(END)
        self.turns += 1

    def visit_text(self, part: dict) -> None:
        self.write(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def visit_other(self, part: dict) -> None:
        self._attach(re.sub(r"\W+", "_", part["type"]) or "other", part)

    def _attach(self, kind: str, part: dict) -> None:
        number = len(self.attachments)
        tokens = part.get("tokens")
        self.attachments.append({"turn": self.turns, "type": kind, "number": number, "uri": part.get("uri"), "tokens": TOKENS.get(kind, 0) if tokens is None else tokens})
        self.write(f"<|{kind}:{number}|>")

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, "".join(self.written), self.loss, self.attachments, sum(a["tokens"] for a in self.attachments)


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row a conversation of messages(conv_id, turn, role, text or parts)."""
    rows = fill_missing(messages, conv_id="long", turn="long", role="string", text="string", parts=PARTS)
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("tokens")))
    rows = rows.select("conv_id", "turn", "role", "text", F.coalesce("parts", text).alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "parts")
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("attachments", pa.list_(pa.struct([("turn", pa.int32()), ("type", pa.string()), ("number", pa.int32()), ("uri", pa.string()), ("tokens", pa.int32())]))), ("n_tokens_expanded", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor, conv_id = None, None
        for batch in batches:
            done = []
            for own, role, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if visitor is None or own != conv_id:
                    if visitor is not None:
                        done.append(visitor.row(conv_id))
                    visitor, conv_id = Visitor(), own
                visitor.turn(role, [p for p in parts.as_py() if p is not None])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        if visitor is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(visitor.row(conv_id), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(run, FORMATTED)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read from a formatted conversation; placeholders stay as they are."""
    return [(unescape(m[1]), "".join(p if PLACEHOLDER.fullmatch(p) else unescape(p) for p in re.split(f"({PLACEHOLDER.pattern})", m[2]))) for m in MARK.finditer(formatted)]


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read from formatted conversations: their turns, and the texts under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, whole, loss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                whole = whole.as_py()
                turns = turns_of(whole)
                of_turns = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8", "replace"))
                masked = "".join(unescape(whole[x["start"] : x["end"]]) for x in loss.as_py())
                out.append((conv_id, len(turns), of_turns.hexdigest(), len(masked), hashlib.sha256(masked.encode("utf-8", "replace")).hexdigest(), len(whole)))
            if out:
                kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, READ)
