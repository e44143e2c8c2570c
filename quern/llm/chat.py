"""Chat formatting: typed content parts to one training text per conversation.

A visitor flattens the parts of every message (text, image, audio, document) into
text with ordered placeholders, and records what each placeholder stands for and how
many tokens it expands to. The template marks turns with control strings; inside
texts those are escaped reversibly: a backslash is doubled, and a control string gets
one after its first character.

Formatted text is kept as one piece per message, numbered within its conversation, so
messages are formatted wherever they are and a long conversation is dealt out; readers
sort pieces by number and stream them, and never hold a whole conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.rows import Columns, map_rows
from quern.operators.windows import with_ordinal

#: What the template writes itself and therefore escapes inside texts.
CONTROL = ("<|turn|>", "<|end|>", "<|image|>", "<|audio|>", "<|document|>", "<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(.)", re.S)

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<part:int,kind:string,ref:string,tokens:long>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of one message in order."""

    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 256
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, n: int, part: dict) -> None:
        getattr(self, f"visit_{part['type'] or 'text'}", self.visit_unknown)(n, part)

    def visit_text(self, n: int, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def visit_image(self, n: int, part: dict) -> None:
        tokens = math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch)
        self.attach(n, "image", part, tokens)

    def visit_audio(self, n: int, part: dict) -> None:
        self.attach(n, "audio", part, math.ceil((part["seconds"] or 0) * self.audio_rate))

    def visit_document(self, n: int, part: dict) -> None:
        self.attach(n, "document", part, (part["pages"] or 0) * self.page_tokens)

    def visit_unknown(self, n: int, part: dict) -> None:
        raise ValueError(f"content part of unknown type {part['type']!r}")

    def attach(self, n: int, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<|{kind}|>")
        self.attachments.append({"part": n, "kind": kind, "ref": part["ref"], "tokens": max(1, tokens)})


def piece(role: str, body: str) -> str:
    """One turn; line ends inside a role are escaped, so the first bare one ends it."""
    return f"<|turn|>{escape(role).replace(chr(10), chr(92) + chr(10))}\n{body}<|end|>\n"


_PIECE = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*)<\|end\|>\n\Z", re.S)


def parse(text: str) -> tuple[str, str, int, int]:
    """role, body (unescaped), and where the escaped body begins and ends in the piece."""
    m = _PIECE.match(text)
    if not m:
        raise ValueError(f"no formatted turn: {text[:40]!r}")
    return unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)


FORMATTED = f"conv_id long, position long, turn long, piece string, loss_start int, loss_end int, attachments array<{ATTACHMENT}>"


def _pieces(batches: Iterator[Columns], learned: tuple[str, ...]) -> Iterator[list[tuple]]:
    for batch in batches:
        rows = []
        for conv, position, turn, role, parts in zip(*(batch[c] for c in ("conv_id", "position", "turn", "role", "parts")), strict=True):
            seen = Flattener()
            for n, part in enumerate(parts or ()):
                if part is not None:
                    seen.visit(n, part)
            role, body = role or "", "".join(seen.out)
            text = piece(role, body)
            end = len(text) - len("<|end|>\n")
            start = end - len(body) if role in learned else end
            rows.append((conv, position, turn, text, start, end, seen.attachments))
        yield rows


def format_turns(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``FORMATTED``: a piece for each message, its place in the conversation from 0, its loss span, attachments.

    ``messages`` has conv_id, turn, role and either ``parts`` (array of ``PART``) or
    ``text``, one text part. Rows go by turn (null first); equal turns by role, then
    content; repeated rows all count. Null roles, texts and parts are empty. Null
    conv_ids form a conversation. The loss span is the body where the role is learned,
    else empty. Other columns are not used; an empty table gives no piece. Rows come
    in no order: a conversation's pieces, by position, are its text.
    """
    if "parts" in messages.columns:
        parts = F.col("parts").cast(f"array<{PART}>")
    else:
        nothing = F.lit(None)
        parts = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *(nothing.alias(x) for x in ("ref", "width", "height", "seconds", "pages")))).cast(f"array<{PART}>")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", parts.alias("parts"))
    rows = with_ordinal(rows, ["conv_id"], ["turn", "role", "parts"], "position")
    return map_rows(rows, lambda it: _pieces(it, learned), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[Columns]) -> Iterator[list[tuple]]:
    now, state = object(), None

    def row() -> tuple:
        return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        out = []
        for conv, text, start, end in zip(*(batch[c] for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
            if conv != now:
                if state:
                    out.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, body, _, _ = parse(text)
            loss = unescape(text[start:end])
            state[0] += 1
            state[1].update(f"{role}\n{body}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(text)
        yield out
    if state:
        yield [row()]


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, parsed from pieces in any order and of any number of files: see ``DIGEST``.

    Pieces are dealt by conversation and sorted by position here; the state of a
    conversation is two digests, which run over its text one after the other, so a
    conversation is read by one task, as a stream. A null conv_id is a conversation;
    no pieces give no row; a piece that is no formatted turn is an error.
    """
    rows = pieces.select("conv_id", "position", "piece", "loss_start", "loss_end")
    return map_rows(rows.repartition("conv_id").sortWithinPartitions("conv_id", "position"), _read_back, DIGEST)
