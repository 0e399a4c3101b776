"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "[INST]" text "[/INST]" | "<<SYS>>" text "<</SYS>>" | "<s>" text "</s>"
                  | "<|role|>" text "<|text|>" text "<|end|>"

The first three are user, system and assistant; the last names any other role.  A control string may not stand in a
text, and a backslash there takes the next character as it is.  Every turn is rendered as it is, reparsed by the
deterministic parser and compared with its source; content in conflict is escaped (a backslash goes inside each control
string and before each backslash) and the turn is tried again.

Turns of a conversation are ordered by turn, role and text, and streamed: a conversation of any length is never held as
a whole.  Rows: NULL texts and roles count as empty; a NULL turn comes first; NULL ids form one conversation; repeated
rows are turns of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The template's control strings.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"

CONTROLS = sorted([*(m for pair in MARKS.values() for m in pair), ROLE, TEXT, END], key=len, reverse=True)
_OPENS = {pair[0]: (role, pair[1]) for role, pair in MARKS.items()}
_CONFLICT = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_TOKEN = re.compile("|".join([r"\\(.)", *map(re.escape, CONTROLS)]), re.DOTALL)
_OPEN = re.compile("|".join(map(re.escape, [*_OPENS, ROLE])))


class GrammarError(ValueError):
    """The text is not a conversation of the grammar."""


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: m[0][0] + "\\" + m[0][1:] if len(m[0]) > 1 else "\\\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _field(text: str, at: int, close: str) -> tuple[str, int, int]:
    """(content, its end, position after ``close``) of the field that starts at ``at``."""
    parts, start = [], at
    for token in _TOKEN.finditer(text, at):
        parts.append(text[start: token.start()])
        start = token.end()
        if token[1] is not None:
            parts.append(token[1])
        elif token[0] == close:
            return "".join(parts), token.start(), start
        else:
            raise GrammarError(f"{token[0]!r} where {close!r} is due")
    raise GrammarError(f"{close!r} is missing")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, content, start, end) of every turn; start and end bound the escaped content."""
    turns, at = [], 0
    while at < len(text):
        opened = _OPEN.match(text, at)
        if not opened:
            raise GrammarError(f"no turn starts at {at}")
        if opened[0] == ROLE:
            role, _, start = _field(text, opened.end(), TEXT)
            close = END
        else:
            (role, close), start = _OPENS[opened[0]], opened.end()
        content, end, at = _field(text, start, close)
        turns.append((role, content, start, end))
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """(turn, start, end of its content): rendered, reparsed, and escaped if the parser recovers anything else."""
    for change in (str, escape):
        if role in MARKS:
            opening, closing = MARKS[role]
        else:
            opening, closing = f"{ROLE}{change(role)}{TEXT}", END
        turn = f"{opening}{change(text)}{closing}"
        try:
            found = parse(turn)
        except GrammarError:
            continue
        if [x[:2] for x in found] == [(role, text)]:
            return turn, found[0][2], found[0][3]
    raise GrammarError("a turn cannot be recovered")  # not reached: escaped content holds no control string


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, formatted, start, loss_start, loss_end): a conversation's text is its rows' texts in order.

    Offsets count code points from the conversation's start; the loss mask covers assistant content and is NULL for
    other turns.  Rows of a conversation lie together and in order in one partition.
    """
    id_type = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, at = object(), 0, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if conv != now:
                    now, position, at = conv, 0, 0
                turn, start, end = render(role, text)
                learns = role == "assistant"
                rows.append((position, turn, at, at + start if learns else None, at + end if learns else None))
                position, at = position + 1, at + len(turn)
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), kind) for c, kind in zip(columns, kinds)]],
                                             names=["conv_id", "position", "formatted", "start", "loss_start", "loss_end"])

    ready = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ready = ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ready.mapInArrow(run, f"conv_id {id_type}, position bigint, formatted string, start bigint, loss_start bigint, loss_end bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests recovered from the formatted text alone, one row per conversation; takes what ``format_turns`` returns."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> tuple:
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def rows_of(found: list) -> pa.RecordBatch:
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*found), kinds)],
                                              names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            found = []
            for conv, text, start, first, last in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if state is None or conv != now:
                    if state is not None:
                        found.append(done())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content, _, _ in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                if first is not None:
                    learned = unescape(text[first - start: last - start])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if found:
                yield rows_of(found)
        if state is not None:
            yield rows_of([done()])

    return formatted.mapInArrow(run, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
