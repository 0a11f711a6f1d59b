"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A
visitor flattens them in order into one string with placeholders, recording
each attachment's reference, place and expanded token count. Turns are framed
by control strings; the same strings inside a text are escaped, so the
formatted conversation can be read back without loss.

Neighbouring text parts are one text, so a control string can't come together
from two of them.

Defined results: turns are ordered by (turn, role, text, parts), so repeated and
tied rows have one order and each is a turn; null role, text and turn count as
empty, empty and first. A null conv_id is a conversation of its own. A null part,
or one of no known kind, is left out; null numbers of an attachment count as 0,
and it takes one token at least. An empty table gives no rows. Columns other
than conv_id, turn, role, text and parts aren't read. A conversation is one row
of the result, however long it is.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
BEGIN, ROLE, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
IMAGE, AUDIO, DOCUMENT = "<image>", "<audio>", "<document>"
CONTROL = (BEGIN, ROLE, BODY, END, IMAGE, AUDIO, DOCUMENT)

_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_FRAME = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    """No control string is left in the result: a backslash goes after its
    first character, and backslashes are doubled."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Text:
    text: str


@dataclass
class Image:
    ref: str
    width: int
    height: int


@dataclass
class Audio:
    ref: str
    seconds: float


@dataclass
class Document:
    ref: str
    pages: int


@dataclass
class Attachment:
    kind: str
    ref: str
    start: int
    tokens: int


@dataclass
class Flattener:
    """Visits parts in order; ``out`` is the flat text so far."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 512
    out: list[str] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)
    size: int = 0
    waiting: list[str] = field(default_factory=list)  # text parts not yet escaped

    def visit(self, part: object) -> None:
        getattr(self, f"visit_{type(part).__name__.lower()}")(part)

    def _put(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def end_text(self) -> None:
        if self.waiting:
            self._put(escape("".join(self.waiting)))
            self.waiting.clear()

    def _attach(self, kind: str, mark: str, ref: str, tokens: int) -> None:
        self.end_text()
        self.attachments.append(Attachment(kind, ref, self.size, max(tokens, 1)))
        self._put(mark)

    def visit_text(self, part: Text) -> None:
        self.waiting.append(part.text or "")

    def visit_image(self, part: Image) -> None:
        self._attach("image", IMAGE, part.ref, math.ceil(part.width / self.patch) * math.ceil(part.height / self.patch))

    def visit_audio(self, part: Audio) -> None:
        self._attach("audio", AUDIO, part.ref, math.ceil(part.seconds * self.audio_rate))

    def visit_document(self, part: Document) -> None:
        self._attach("document", DOCUMENT, part.ref, part.pages * self.page_tokens)


@dataclass
class Formatted:
    text: str
    loss: list[tuple[int, int]]  # spans of the formatted text that are trained on
    attachments: list[Attachment]


def format_chat(turns: list[tuple[str, list]], train_on: str = "assistant") -> Formatted:
    """Frame each turn: <s>[INST]role[/INST]content</s>."""
    flat, loss = Flattener(), []
    for role, parts in turns:
        flat._put(BEGIN + ROLE)
        flat._put(escape(role))
        flat._put(BODY)
        begin = flat.size
        for part in parts:
            flat.visit(part)
        flat.end_text()
        if role == train_on:
            loss.append((begin, flat.size))
        flat._put(END)
    return Formatted("".join(flat.out), loss, flat.attachments)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, content) of every turn; placeholders stay where they stand."""
    out, pos, role = [], 0, ""
    for m in _FRAME.finditer(text):
        if m[0] == ROLE:
            pos = m.end()
        elif m[0] == BODY:
            role, pos = unescape(text[pos : m.start()]), m.end()
        elif m[0] == END:
            out.append((role, unescape(text[pos : m.start()])))
    return out


#: A column ``parts`` of this type holds typed contents.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<kind:string,ref:string,start:long,tokens:long>>"


def _typed(x: dict | None) -> list:
    """A row of ``parts`` as a part, in a list that is empty if there is none."""
    match x and x["kind"]:
        case "text":
            return [Text(x["text"])]
        case "image":
            return [Image(x["ref"], x["width"] or 0, x["height"] or 0)]
        case "audio":
            return [Audio(x["ref"], x["seconds"] or 0.0)]
        case "document":
            return [Document(x["ref"], x["pages"] or 0)]
    return []


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_starts, loss_ends, attachments per conversation.
    ``rows`` holds turns; a column ``parts`` (see ``PARTS``), where it is there
    and not null, gives a turn's contents, else ``text`` is its only part.
    One conversation is one output text, so its turns meet in one row; they are
    gathered by an aggregate with a map-side part, and no other group forms."""
    text = F.coalesce("text", F.lit("")) if "text" in rows.columns else F.lit("")
    parts = F.col("parts").cast(PARTS) if "parts" in rows.columns else F.lit(None).cast(PARTS)
    # nulls come first in the order of structs, so a null turn stays null
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), parts.alias("parts"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def content(x: dict) -> list:
        return [Text(x["text"])] if x["parts"] is None else [y for part in x["parts"] for y in _typed(part)]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                got = [format_chat([(x["role"], content(x)) for x in turns]) for turns in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([x.text for x in got], pa.string()),
                        pa.array([[s for s, _ in x.loss] for x in got], pa.list_(pa.int64())), pa.array([[e for _, e in x.loss] for x in got], pa.list_(pa.int64())),
                        pa.array([[vars(y) for y in x.attachments] for x in got], kind),
                    ],
                    ["conv_id", "formatted", "loss_starts", "loss_ends", "attachments"],
                )

    return grouped.mapInArrow(work, f"conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>, attachments {ATTACHMENTS}")


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all of them read back from the formatted text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
