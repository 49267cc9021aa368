r"""Chat formatting with a grammar round trip.

Template, turn after turn, nothing between:

    user       [INST] text [/INST]
    assistant  one space, text, </s>
    system     <<SYS>> line break, text, line break <</SYS>>
    any other  <|role as hex of its UTF-8|> text, </s>

A text must not hold a control string. Where it does, a backslash goes behind the string's bracket; a
string that already has backslashes there gets one more, so reading back takes one away and nothing else
changes. Each turn is rendered as it is, read back by the parser, compared with its source, and escaped
until both agree. The loss mask covers the assistants' texts.

Turns stream in order, one at a time, so a conversation of any length needs only one turn's memory: a piece
of output per turn, whose concatenation is the conversation.

Cases: a null text is empty. A null role counts as an empty one. Turns with equal numbers go by role and
text; a null turn number comes first. Null conv_id is a conversation of its own. Repeated rows are turns of
their own. An empty table gives an empty result. Other columns are ignored.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.llm.common import ship

#: Bracket, backslashes, rest: every string the parser could take for a mark, escaped or not.
_CONTROL = re.compile(r"(\[/?|<</?|</?|<\|)(\\*)(INST\]|SYS>>|s>|[0-9a-f]*\|>)")
_MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
_OTHER = re.compile(r"<\|((?:[0-9a-f]{2})*)\|>")


class Unreadable(ValueError):
    """The text is not a sentence of the grammar."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def marks(role: str) -> tuple[str, str]:
    return _MARKS.get(role) or (f"<|{role.encode().hex()}|>", "</s>")


def parse_turn(text: str, at: int = 0) -> tuple[str, int, int, int]:
    """Role, start and end of the raw text, and end of the turn that starts at `at`."""
    for role, (opening, closing) in _MARKS.items():
        if text.startswith(opening, at):
            break
    else:
        m = _OTHER.match(text, at)
        if not m:
            raise Unreadable(text[at : at + 20])
        role, opening, closing = bytes.fromhex(m[1]).decode(), m[0], "</s>"
        if role in _MARKS:
            raise Unreadable(m[0])
    start = at + len(opening)
    end = text.find(closing, start)
    if end < 0 or any(not m[2] for m in _CONTROL.finditer(text, start, end)):
        raise Unreadable(text[at : at + 20])
    return role, start, end, end + len(closing)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The rendered turn, and how often its text had to be escaped for it to read back as given."""
    opening, closing = marks(role)
    body, times = text, 0
    while True:
        rendered = opening + body + closing
        try:
            found, start, end, stop = parse_turn(rendered)
            if (found, unescape(rendered[start:end]), stop) == (role, text, len(rendered)):
                return rendered, times
        except Unreadable:
            pass
        body, times = escape(body), times + 1
        if times > 3:  # the escape is its own proof: one round is enough
            raise Unreadable(text[:80])


PIECES = "conv_id bigint, formatted string, escapes int, loss_start int, loss_length int"


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row per turn in conversation order (see PIECES); the partition holds whole conversations."""
    ship(turns.sparkSession)
    ordered = (
        turns.select(
            F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, escapes, starts, lengths = [], [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                piece, times = format_turn(role, text)
                _, start, end, _ = parse_turn(piece)
                pieces.append(piece)
                escapes.append(times)
                starts.append(start if role == "assistant" else 0)
                lengths.append(end - start if role == "assistant" else 0)
            columns = (pa.array(pieces, pa.string()), *(pa.array(c, pa.int32()) for c in (escapes, starts, lengths)))
            names = ["conv_id", "formatted", "escapes", "loss_start", "loss_length"]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=names)

    return ordered.mapInArrow(run, PIECES)


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_escaped bigint"
)


class Reader:
    """Digests of one conversation, from its formatted pieces only."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.escaped = 0

    def add(self, piece: str, loss_start: int, loss_length: int, escapes: int) -> None:
        at = 0
        while at < len(piece):
            role, start, end, at = parse_turn(piece, at)
            self.turns.update(f"{role}\n{unescape(piece[start:end])}\n".encode())
            self.n_turns += 1
        masked = unescape(piece[loss_start : loss_start + loss_length])
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.chars += len(piece)
        self.escaped += escapes > 0

    def row(self) -> tuple:
        return (
            self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.escaped
        )


def read_back(pieces: DataFrame) -> DataFrame:
    """A row per conversation (see DIGESTS) from format_conversations(), in whose order the pieces must be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        reader = None
        for batch in batches:
            done = []
            wanted = ("conv_id", "formatted", "loss_start", "loss_length", "escapes")
            for conv_id, *piece in zip(*(batch.column(c).to_pylist() for c in wanted)):
                if reader is None or reader.conv_id != conv_id:
                    if reader is not None:
                        done.append(reader.row())
                    reader = Reader(conv_id)
                reader.add(*piece)
            yield batch_of(done)
        yield batch_of([reader.row()] if reader else [])

    return pieces.mapInArrow(run, DIGESTS)
