r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, the reply as the only trainable
text. A conversation that does not end with an assistant turn adds one example without a target, so that no turn is lost.

Template: each turn is `### Role: ` + text + ` </turn>\n`. Inside texts a backslash is put before every backslash and
before every `###` and `</turn>`, so no text can be taken for a mark, and `unescaped` restores it exactly.

Turns are sorted inside Spark's partitions and formatted as a stream: memory holds the one prefix that is growing, never
a group's rows. A digest of a conversation is sequential in its turns, so one conversation is one task's stream.

Nulls and odd rows: a null text is empty, a null role is the role `unknown`. Turns are ordered by turn, then role, then
text, null turns first, so repeated rows are repeated turns with a fixed order. A null conv_id is one conversation of
its own. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lictor.llm.tables import map_arrow

OPEN, CLOSE, END = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)

EXAMPLES = "conv_id long, nth int, target boolean, text string, begin int, end int"


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(role: str | None) -> str:
    """A role with its control characters escaped; colons too, as they end it."""
    return re.sub(r"([\\:])", r"\\\1", "unknown" if role is None else role)


def ordered(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv_id, role, text in order, with None between conversations."""
    last, begun = None, False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if begun and conv != last:
                yield None
            last, begun = conv, True
            yield conv, role, text
    if begun:
        yield None


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of EXAMPLES, one by one."""
    prefix, nth, open_end, conv = [], 0, False, None
    for turn in _conversations(batches):
        if turn is None:
            if open_end:
                yield conv, nth, False, "".join(prefix), None, None
            prefix, nth, open_end = [], 0, False
            continue
        conv, role, text = turn
        head = OPEN + _role(role) + CLOSE
        body = escaped(text)
        prefix.append(head + body + END)
        open_end = role != "assistant"
        if not open_end:
            whole = "".join(prefix)
            prefix = [whole]
            end = len(whole) - len(END)
            yield conv, nth, True, whole, end - len(body), end
            nth += 1


def _batched(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=["conv_id", "nth", "target", "text", "begin", "end"])

    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > most or len(held) >= 4096:
            yield batch()
            held, size = [], 0
    yield batch()


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, nth, target (whether it has one), text, and the loss mask's span [begin, end) in code points."""
    return map_arrow(ordered(conversations), lambda batches: _batched(_examples(batches)), EXAMPLES)


def turns_of(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted example, read back."""
    out, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        end = text.find(END, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((re.sub(r"\\([\\:])", r"\1", head[1]), unescaped(text[head.end():end])))
        at = end + len(END)
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turns and their digest, the text under the loss mask, characters.

    A conversation's examples must stand in one partition in the order of nth, as `examples` gives them. The turns of an
    example beyond those of the one before it are new.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        state = None
        for batch in batches:
            done = []
            for conv, text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "begin", "end")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(_finished(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""]
                seen = state[6]
                if not text.startswith(seen):
                    raise ValueError(f"conversation {conv}: an example does not continue the one before it")
                for role, turn in turns_of(text[len(seen):]):
                    state[1] += 1
                    state[2].update(f"{role}\n{turn}\n".encode())
                if begin is not None:
                    loss = unescaped(text[begin:end])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(text)
                state[6] = text
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)
        last = [] if state is None else [_finished(state)]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in last], k) for i, k in enumerate(kinds)], names=names)

    return map_arrow(formatted.select("conv_id", "text", "begin", "end"), work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _finished(state: list) -> tuple:
    return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]
