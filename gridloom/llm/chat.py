"""Chat formatting by prefix-target expansion (operator 9).

Every assistant turn becomes an example of its own: all turns before it are the
context, and only the characters of that reply are trainable. Turns after the
last reply (or a conversation without one) make an example with an empty mask,
so the output holds every turn.

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside roles and texts ``<``, any number of backslashes and ``|`` get one more
backslash, so no text can hold a control string; taking it off again restores
the text. Backslashes and line ends in roles are escaped as well.

Defined cases: null role or text is empty; rows are ordered by turn, then role
and text, null turns first; repeated rows are turns of their own; null conv_id
is a conversation. An example is made and read one at a time, so memory holds
one conversation's turns and one example, not their product. A text of any length is
formatted whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def examples(turns):
    """(text, start, end) of each example of a list of (role, text); [start, end) is trainable."""
    context, waiting = "", True
    for role, text in turns:
        head = f"{START}{_escape_role(role)}\n"
        body = escape(text)
        start = len(context) + len(head)
        context = f"{context}{head}{body}{END}\n"
        waiting = role != "assistant"
        if not waiting:
            yield context, start, start + len(body)
    if waiting:
        yield context, 0, 0


def read_turns(text: str) -> list[tuple[str, str]]:
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def _conversations(rows: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _pairs(cell) -> list[tuple[str, str]]:
    rows = cell.values
    return list(zip(rows.field("role").to_pylist(), rows.field("text").to_pylist()))


def expand(rows: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) of ``rows(conv_id, turn, role, text)``."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                for n, (text, start, end) in enumerate(examples(_pairs(batch.column(1)[k]))):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([n]), pa.array([text]), pa.array([start]), pa.array([end])], names=["conv_id", "example", "text", "loss_start", "loss_end"])

    return _conversations(rows).mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long")


def read_back(rows: DataFrame) -> DataFrame:
    """What the formatted examples of each conversation say when they are read again."""

    def run(batches):
        for batch in batches:
            out = []
            for k in range(len(batch)):
                last, size, loss, chars = "", 0, hashlib.sha256(), 0
                for text, start, end in examples(_pairs(batch.column(1)[k])):
                    reply = unescape(text[start:end])
                    loss.update(reply.encode("utf-8"))
                    chars += len(reply)
                    size += len(text)
                    last = text
                turns = read_turns(last)
                said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8")).hexdigest()
                out.append((len(turns), said, chars, loss.hexdigest(), size))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return _conversations(rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
