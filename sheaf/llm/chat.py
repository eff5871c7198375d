r"""Chat formatting: conversations through a compiled template, with a loss
mask, and back.

Control strings inside a text are escaped by one more backslash after their
first character (``</s>`` becomes ``<\/s>``, ``<\/s>`` becomes ``<\\/s>``), so
no text can close its turn, and dropping one backslash restores it.  Roles are
one line: backslash and newline in them are written ``\\`` and ``\n``.

Rendering and reading back stream: turns arrive sorted, pieces are rendered,
read and digested one turn at a time, so a task holds one turn however long the
conversation is.

Edge cases: null roles and texts are empty; rows that repeat a turn are turns
of their own, in order of role and text; a null turn comes first; rows with a
null conv_id are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.tables import parts
from sheaf.llm.template import Piece, compile_template, text_of

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'assistant' %}<s>{{ m.role | line }}\n{% generation %}{{ m.text | escape }}{% endgeneration %}</s>\n"
    "{% else %}[INST]{{ m.role | line }}\n{{ m.text | escape }}[/INST]\n{% endif %}"
    "{% endfor %}"
)
_CONTROL = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS)
_PLAIN, _ESCAPED = re.compile(_CONTROL), re.compile(_CONTROL.replace(r"\\*", r"\\+"))


def escape(value: object) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text_of(value))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def line(value: object) -> str:
    return escape(text_of(value).replace("\\", "\\\\").replace("\n", "\\n"))


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS = {"escape": escape, "line": line}


def formatter(template: str = TEMPLATE):
    """render(messages) -> (text, generated) pieces of one conversation."""
    run = compile_template(template, ["messages"], FILTERS)
    return lambda messages: run({"messages": messages})


_OPEN = {"<s>": "</s>\n", "[INST]": "[/INST]\n"}


class Reader:
    """Reads (role, text) turns back from formatted text, piece by piece."""

    def __init__(self):
        self.rest, self.seen = "", 0

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        while True:
            start = next((o for o in _OPEN if self.rest.startswith(o)), None)
            if start is None:
                if self.rest and not any(o.startswith(self.rest) for o in _OPEN):
                    raise ValueError(f"not a turn: {self.rest[:20]!r}")
                return
            end = self.rest.find(_OPEN[start], max(len(start), self.seen))
            if end < 0:
                self.seen = max(0, len(self.rest) - len(_OPEN[start]))
                return
            role, _, body = self.rest[len(start):end].partition("\n")
            self.rest, self.seen = self.rest[end + len(_OPEN[start]):], 0
            yield unline(role), unescape(body)


def read(pieces: Iterable[Piece]) -> dict[str, object]:
    """The digests of one formatted conversation, from its text and mask alone."""
    reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
    n = chars = under = 0
    span: list[str] = []
    for text, generated in chain(pieces, [("", False)]):
        chars += len(text)
        if generated:
            span.append(text)
        elif span:
            plain = unescape("".join(span))
            under += len(plain)
            loss.update(plain.encode())
            span = []
        for role, body in reader.feed(text):
            n += 1
            turns.update(f"{role}\n{body}\n".encode())
    if reader.rest:
        raise ValueError("the last turn is not closed")
    return {"n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": under, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}


def _sorted(conversations: DataFrame) -> DataFrame:
    n = parts(conversations.sparkSession)
    return (conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            .repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its messages, to be taken in turn) over sorted batches."""
    rows = (row for batch in batches for row in zip(batch["conv_id"].to_pylist(), (dict(role=r.as_py(), text=t.as_py()) for r, t in zip(batch["role"], batch["text"]))))
    for conv_id, own in groupby(rows, key=lambda r: r[0]):
        yield conv_id, (m for _, m in own)


FORMATTED = "conv_id long, part int, formatted string, mask array<struct<start:long,end:long>>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = 1 << 20) -> DataFrame:
    """The formatted text of each conversation and the spans (code points in
    it) under the loss mask.  A long conversation comes in parts of about
    ``part_chars`` characters, cut between pieces; spans count from the start
    of their part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = formatter(template)
        for conv_id, messages in _conversations(batches):
            part, text, mask, at = 0, [], [], 0
            for piece, generated in chain(render(messages), [(None, False)]):
                if piece is None or at >= part_chars:
                    yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([part], pa.int32()), pa.array(["".join(text)]),
                                                      pa.array([mask], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "part", "formatted", "mask"])
                    part, text, mask, at = part + 1, [], [], 0
                if piece:
                    if generated:
                        mask.append({"start": at, "end": at + len(piece)})
                    text.append(piece)
                    at += len(piece)

    return _sorted(conversations).mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formats each conversation and reads the output back: a row of digests
    for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out = formatter(template), []
        for conv_id, messages in _conversations(batches):
            out.append({"conv_id": conv_id, **read(render(messages))})
            if len(out) == 1000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    return _sorted(conversations).mapInArrow(run, DIGEST)
