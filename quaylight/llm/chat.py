"""Chat formatting over typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one text with ordered
placeholders, and notes for each attachment its reference and how many tokens it will expand to. Turns are
then framed by a template. Its control strings all begin with ``<`` or ``#``; those characters and the
backslash are escaped inside texts, so a formatted conversation can be read back without loss.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENTS = "array<struct<turn:int,place:int,kind:string,ref:string,tokens:bigint>>"
FORMATTED = f"conv_id bigint, formatted string, mask array<struct<start:int,length:int>>, attachments {ATTACHMENTS}"

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"


@dataclass(frozen=True)
class Expansion:
    """How many tokens an attachment stands for."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 256

    def tokens(self, part: dict) -> int:
        kind = part["kind"]
        if kind == "image":
            return math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch)
        if kind == "audio":
            return math.ceil((part.get("seconds") or 0) * self.audio_rate)
        return (part.get("pages") or 0) * self.page_tokens


def escape(text: str, also: str = "") -> str:
    for c in "\\<#" + also:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, i = [], 0
    while (k := text.find("\\", i)) >= 0:
        out.append(text[i:k])
        out.append(text[k + 1 : k + 2])
        i = k + 2
    return "".join([*out, text[i:]])


class Visitor:
    """Visits the parts of one conversation in order."""

    def __init__(self, expansion: Expansion):
        self.expansion, self.attachments, self.places = expansion, [], 0

    def turn(self, number: int, parts: list[dict]) -> str:
        return "".join(self.text(p) if p["kind"] == "text" else self.attachment(number, p) for p in parts)

    def text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def attachment(self, number: int, part: dict) -> str:
        self.places += 1
        kind = part["kind"] or "unknown"
        self.attachments.append({"turn": number, "place": self.places, "kind": kind, "ref": part.get("ref"), "tokens": self.expansion.tokens(part | {"kind": kind})})
        return f"<{escape(kind, '>')}:{self.places}>"


def format_turns(turns: list[tuple[str | None, list[dict]]], expansion: Expansion) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """The formatted conversation, the loss mask (assistant texts) and the attachments."""
    visitor, out, mask, at = Visitor(expansion), [], [], 0
    for number, (role, parts) in enumerate(turns):
        head = HEAD + escape(role or "", ":") + COLON
        body = visitor.turn(number, parts)
        if role == "assistant":
            mask.append((at + len(head), len(body)))
        out += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(out), mask, visitor.attachments


def _unescaped(text: str, what: str, at: int) -> int:
    """The first place of ``what`` that no backslash escapes."""
    while (k := text.find(what, at)) >= 0:
        back = k
        while back > at and text[back - 1] == "\\":
            back -= 1
        if (k - back) % 2 == 0:
            return k
        at = k + 1
    raise ValueError(f"no {what!r}")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back; placeholders stay in their escaped form's place."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError("no turn here")
        colon = _unescaped(formatted, COLON, at + len(HEAD))
        tail = _unescaped(formatted, TAIL, colon + len(COLON))
        turns.append((unescape(formatted[at + len(HEAD) : colon]), unescape(formatted[colon + len(COLON) : tail])))
        at = tail + len(TAIL)
    return turns


def text_parts(column: str = "text"):
    """A plain text column as a list of one text part."""
    empty = [F.lit(None).cast(t) for t in ("string", "int", "int", "double", "int")]
    names = ("ref", "width", "height", "seconds", "pages")
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(column, F.lit("")).alias("text"), *(c.alias(n) for c, n in zip(empty, names, strict=True))))


def format_chats(turns: DataFrame, expansion: Expansion | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role and ``parts``, or else ``text``).

    Rows are ordered by turn, then role, then parts; nulls come first, repeated rows stay repeated turns.
    A null role is an empty one, a null text or list of parts empty; an unknown kind of part gets a
    placeholder of its name. Rows without a conv_id form one conversation of null id. A conversation is one
    text, so its own turns (and only they) meet in one task.
    """
    expansion = expansion or Expansion()
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else text_parts()
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", "role", parts.alias("parts")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts, masks, attached = [], [], []
                for rows in part.column("rows"):
                    turns = [(r["role"], [p for p in r["parts"] or () if p]) for r in rows.as_py()]
                    text, mask, attachments = format_turns(turns, expansion)
                    texts.append(text)
                    masks.append([{"start": a, "length": n} for a, n in mask])
                    attached.append(attachments)
                kinds = pa.list_(pa.struct({"start": pa.int32(), "length": pa.int32()}))
                held = pa.list_(pa.struct({"turn": pa.int32(), "place": pa.int32(), "kind": pa.string(), "ref": pa.string(), "tokens": pa.int64()}))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array(texts, pa.string()), pa.array(masks, kinds), pa.array(attached, held)], names=["conv_id", "formatted", "mask", "attachments"])

    return whole.mapInArrow(task, FORMATTED)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, read from the formatted text and the mask."""

    def digest(text: str, mask: list[dict]) -> dict:
        turns = read_turns(text)
        loss = "".join(unescape(text[m["start"] : m["start"] + m["length"]]) for m in mask)
        said = "".join(f"{role}\n{words}\n" for role, words in turns)
        return {
            "n_turns": len(turns),
            "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
            "loss_chars": len(loss),
            "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
            "formatted_chars": len(text),
        }

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"conv_id": c.as_py()} | digest(t.as_py(), m.as_py()) for c, t, m in zip(batch.column("conv_id"), batch.column("formatted"), batch.column("mask"), strict=True)]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(task, DIGEST)
