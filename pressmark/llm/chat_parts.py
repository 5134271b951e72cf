"""Chat formatting over typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
flattens it into one string in which every attachment is an ordered placeholder, and
records the attachment's reference and the number of tokens that its placeholder
stands for. A turn is written

    <|turn|>role\\ncontent<|end|>\\n

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|`` (a role's
line break becomes ``\\n``), so no control string can come from a text, and reading
back restores every text exactly. The loss mask covers the content of assistant turns.

Turns are formatted where they lie, before the shuffle. Reading back walks each
conversation's turns in order with running digests, so no conversation has to fit in
memory, however many of the rows it has.

Defined cases: a null text or role is empty; rows without a conversation id are one
conversation; turns with the same number (null first) go by role, then text; a part of
an unknown kind is an error; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
LOSS_ROLE = "assistant"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

PATCH = 28  # pixels of an image that make one token, each way
AUDIO_RATE = 25  # tokens a second
PAGE = 256  # tokens for a page of a document

_ESCAPED = re.compile(r"\\(.)", re.S)
_HOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
_ONE_TURN = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


@dataclass(frozen=True)
class TextPart:
    text: str

    def accept(self, visitor: "PartVisitor") -> None:
        visitor.visit_text(self)


@dataclass(frozen=True)
class ImagePart:
    ref: str
    width: int
    height: int

    def accept(self, visitor: "PartVisitor") -> None:
        visitor.visit_image(self)


@dataclass(frozen=True)
class AudioPart:
    ref: str
    seconds: float

    def accept(self, visitor: "PartVisitor") -> None:
        visitor.visit_audio(self)


@dataclass(frozen=True)
class DocumentPart:
    ref: str
    pages: int

    def accept(self, visitor: "PartVisitor") -> None:
        visitor.visit_document(self)


class PartVisitor:
    """What a walk over parts may do with each kind."""

    def visit_text(self, part: TextPart) -> None: ...
    def visit_image(self, part: ImagePart) -> None: ...
    def visit_audio(self, part: AudioPart) -> None: ...
    def visit_document(self, part: DocumentPart) -> None: ...


@dataclass
class Flattener(PartVisitor):
    """Collects escaped text and placeholders in order, with (kind, ref, tokens) of every attachment."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)

    def visit_text(self, part: TextPart) -> None:
        self.pieces.append(escape(part.text))

    def visit_image(self, part: ImagePart) -> None:
        self._attach("image", part.ref, max(1, math.ceil(part.width / PATCH) * math.ceil(part.height / PATCH)))

    def visit_audio(self, part: AudioPart) -> None:
        self._attach("audio", part.ref, max(1, math.ceil(part.seconds * AUDIO_RATE)))

    def visit_document(self, part: DocumentPart) -> None:
        self._attach("document", part.ref, max(1, part.pages) * PAGE)

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        self.pieces.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append((kind, ref, tokens))


def part_of(p: dict) -> TextPart | ImagePart | AudioPart | DocumentPart:
    kind, ref = p.get("kind"), p.get("ref") or ""
    if kind == "text":
        return TextPart(p.get("text") or "")
    if kind == "image":
        return ImagePart(ref, p.get("width") or 0, p.get("height") or 0)
    if kind == "audio":
        return AudioPart(ref, p.get("seconds") or 0.0)
    if kind == "document":
        return DocumentPart(ref, p.get("pages") or 0)
    raise ValueError(f"no such kind of part: {kind}")


def format_turn(role: str | None, parts: list) -> tuple[str, list[tuple[str, str, int]], tuple[int, int]]:
    """The turn as text, its attachments, and the span of its content."""
    f = Flattener()
    for p in parts:
        p.accept(f)
    head = f"{TURN}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n"
    content = "".join(f.pieces)
    return f"{head}{content}{END}\n", f.attachments, (len(head), len(head) + len(content))


def read_turns(formatted: str) -> Iterator[tuple[str, str, list[tuple[str, int]]]]:
    """Role, text and placeholders (kind, number) of every turn of a formatted string."""
    at = 0
    while at < len(formatted):
        m = _ONE_TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        yield unescape(m[1]), unescape(_HOLDER.sub("", m[2])), [(k, int(n)) for k, n in _HOLDER.findall(m[2])]
        at = m.end()


def format_rows(rows: DataFrame, parts: Column | None = None) -> DataFrame:
    """Every row (conv_id, turn, role, text) formatted: with its attachments, their tokens and the span under the loss mask (null: none).

    parts: a column of type PARTS in place of the text.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    chosen = rows.select("conv_id", "turn", "role", "text", (F.to_json(parts) if parts is not None else F.lit(None).cast("string")).alias("_parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, attached, tokens, spans = [], [], [], []
            for role, text, own in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), b.column("_parts").to_pylist()):
                made, found, span = format_turn(role, [TextPart(text or "")] if own is None else [part_of(p) for p in json.loads(own)])
                texts.append(made)
                attached.append([{"kind": k, "ref": r, "tokens": n} for k, r, n in found])
                tokens.append(sum(n for _, _, n in found))
                spans.append({"start": span[0], "end": span[1]} if role == LOSS_ROLE else None)
            yield pa.record_batch(
                [
                    b.column("conv_id"), b.column("turn"), pa.array(texts, pa.string()),
                    pa.array(attached, pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), pa.array(tokens, pa.int64()), pa.array(spans, pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                ],
                ["conv_id", "turn", "formatted", "attachments", "attachment_tokens", "loss"],
            )

    return chosen.mapInArrow(run, f"conv_id {kind}, turn {turn}, formatted string, attachments array<struct<kind:string,ref:string,tokens:bigint>>, attachment_tokens long, loss struct<start:bigint,end:bigint>")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from format_rows(): turns, digests of all turns and of the text under the mask, sizes."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.select("conv_id", "turn", "formatted", "loss").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                n, turns, loss_n, loss, size = state
                done.append((key, n, turns.hexdigest(), loss_n, loss.hexdigest(), size))

        for b in batches:
            for conv, text, span in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content, _ in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                if span is not None:
                    masked = unescape(_HOLDER.sub("", text[span["start"] : span["end"]]))
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if len(done) >= 2000:
                yield batch_of(done, b.schema.field("conv_id").type)
                done = []
        close()
        if done:
            yield batch_of(done, b.schema.field("conv_id").type)

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    hostile = "\\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], rows.schema)
    return digests(format_rows(rows.unionByName(extra)))
