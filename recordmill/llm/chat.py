"""Chat formatting checked by a grammar round trip.

A turn is rendered as ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line
break.  Every rendered turn is parsed again by the deterministic parser below, whose grammar
has no ``<|`` in a text and neither ``<`` nor a bare per cent sign in a role; where what comes
back is not the source, the content that conflicts with the grammar is escaped and the turn
is rendered anew.  So no control string is left inside a turn.  The formatted conversation is
one row per turn, so no conversation has to fit in memory, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.textarrays import prepare

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"

_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")
_NOT_IN_ROLE = re.compile(r"<|%(?!25|0A|3C)")


def escape(text: str) -> str:
    """One more backslash inside every ``<|``, ``<\\|``, ``<\\\\|`` ...: no control string is left."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Per cent signs, line breaks and ``<`` as per cent codes."""
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unescape_role(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


class Parser:
    """turns := (START role "\\n" body END "\\n")*; text may arrive in pieces of any size."""

    def __init__(self) -> None:
        self.held = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn that ends in what has arrived."""
        self.held += piece
        while self.held:
            head = self.held[: len(START)]
            if head != START[: len(head)]:
                raise ValueError("a turn must begin with its control string")
            end = self.held.find(END)
            if len(self.held) < end + len(END) + 1 or end < 0:
                return
            role, line, body = self.held[len(START) : end].partition("\n")
            if not line or self.held[end + len(END)] != "\n":
                raise ValueError("a turn needs its line breaks")
            if "<|" in body or _NOT_IN_ROLE.search(role):
                raise ValueError("a role or text holds what must be escaped")
            self.held = self.held[end + len(END) + 1 :]
            yield unescape_role(role), unescape(body)

    def close(self) -> None:
        if self.held:
            raise ValueError("a turn does not end")


def parse(text: str) -> list[tuple[str, str]]:
    parser = Parser()
    turns = list(parser.feed(text))
    parser.close()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """(turn, start and end of the body in it), escaped only where the round trip asks for it."""
    for shown_role, body in ((role, text), (escape_role(role), text), (escape_role(role), escape(text))):
        turn = f"{START}{shown_role}\n{body}{END}\n"
        try:
            if parse(turn) == [(role, text)]:
                begin = len(START) + len(shown_role) + 1
                return turn, begin, begin + len(body)
        except ValueError:
            continue
    raise AssertionError("an escaped turn must come back")


def format_turns(
    conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, position, formatted, loss_start, loss_end): one row per turn, in order in its partition.

    The conversation is the concatenation of its rows by position.  loss_start and loss_end
    (code points in ``formatted``) bound what is learned, null for other roles.  Turns are
    ordered by turn, then role and text, nulls first; repeated rows stay; null roles and
    texts are empty; rows without a conv_id are one conversation.  Other columns are not
    read; an empty table gives no rows.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    prepare(rows.sparkSession)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, position = object(), 0
        for batch in batches:
            ids, out = batch.column("conv_id").to_pylist(), []
            for key, who, what in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                position = position + 1 if key == last else 0
                last = key
                formatted, begin, end = render(who, what)
                learned = who == LEARNED
                out.append((position, formatted, begin if learned else None, end if learned else None))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["conv_id", "position", "formatted", "loss_start", "loss_end"],
            )

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"conv_id {kind}, position bigint, formatted string, loss_start bigint, loss_end bigint"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the rows of ``format_turns`` in their order.

    turns_sha256 is over role, line break, text, line break of each parsed turn; loss_sha256
    over the unescaped text under the mask.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Digest | None = None
        id_type = pa.int64()
        for batch in batches:
            id_type, done = batch.schema.field("conv_id").type, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state.conv_id != row[0]:
                    done += [state.row()] if state else []
                    state = _Digest(row[0])
                state.add(*row[2:])
            yield _batch(done, id_type)
        if state is not None:
            yield _batch([state.row()], id_type)

    return formatted.mapInArrow(
        run,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint",
    )


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


class _Digest:
    def __init__(self, conv_id) -> None:
        self.conv_id, self.parser = conv_id, Parser()
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_start: int | None, loss_end: int | None) -> None:
        self.chars += len(formatted)
        for role, text in self.parser.feed(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if loss_start is not None:
            learned = unescape(formatted[loss_start:loss_end])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

    def row(self) -> tuple:
        self.parser.close()
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
