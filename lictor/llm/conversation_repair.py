r"""Conversation structure repair by iterative-deepening A*.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn: its role
initials read `(s?(ua)+)?`. Edits, in ASCII order of their initials:

* D deletes a row (2). A blank row and a duplicate must be deleted.
* I inserts an empty turn of the role that may stand there (5).
* K keeps a row whose initial may stand there (0, and 5 more if it is truncated).
* R gives a row the role user or assistant, whichever may stand there (1, and 5 more if it is truncated).

The search goes depth first in that order under a cost bound. A place (row, state of the grammar) that failed is kept
with the budget it failed under and is not entered again with as little. If nothing is accepted, the bound rises to the
smallest estimate that exceeded it. The estimate is the cost under a relaxed grammar that may end after any turn, so it
never exceeds the true cost and few bounds are tried. The first accepting path under the first sufficient bound is the
cheapest one, and of several the least in ASCII. As the turns alternate, an audit fixes every role.

Rows are read in the order turn (nulls first), role, text, sorted by Spark and streamed: one conversation is one task's
stream, for an audit is sequential in its turns. The search holds an initial, a fault, a 16-byte digest and some numbers per
row of the conversation at hand, some hundreds of bytes in all, never its texts: they stream by a second time to be
repaired.

Nulls and odd rows: a null role or text is one space, so a null text is blank. A null turn stands first and opens no gap.
A null conv_id is a conversation of its own. Very long texts are only read for their last character and their digest.
Rows with the same turn keep the order of role and text; repeated rows are duplicates. A conversation without rows is not
seen here; `audits` of an empty table is empty. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lictor.llm.tables import map_arrow, stored

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Faults of a row.
CLEAN, CUT, GONE = 0, 1, 2
#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_LAST = re.compile("([^\x20\x09-\x0D])[\x20\x09-\x0D]*\\Z")
_FAR = 1 << 60

AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _kept(state: int, initial: str) -> int | None:
    """The state after a row is kept, or None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def estimates(rows: list[tuple[str, int]]) -> list[list[int]]:
    """Per state and row: the least cost of the rows from there on if a conversation might end after any turn."""
    n = len(rows)
    least = [[0] * (n + 1) for _ in range(4)]
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        more = TRUNCATED if fault == CUT else 0
        row = []
        for state in range(4):
            best = DELETE + least[state][i + 1]
            if fault != GONE:
                best = min(best, REROLE + more + least[_NEXT[state]][i + 1])
                after = _kept(state, initial)
                if after is not None:
                    best = min(best, more + least[after][i + 1])
            row.append(best)
        for state in range(4):
            least[state][i] = min(row[state], INSERT + row[_NEXT[state]])
    return least


def search(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of rows (role initial, fault)."""
    n, least = len(rows), estimates(rows)
    bound, failed = least[START][0], {}
    while True:
        beyond = _FAR
        path, stack = [], [[0, START, 0, 0]]
        while stack:
            frame = stack[-1]
            i, state, cost, move = frame
            if move == 0 and i == n and state in (START, ASSISTANT):
                return cost, "".join(path)
            frame[3] = move + 1
            at, after, price = i + 1, None, 0
            if move == 0:  # D
                if i < n:
                    after, price = state, DELETE
            elif move == 1:  # I
                at, after, price = i, _NEXT[state], INSERT
            elif move < 4:  # K, R
                if i < n and rows[i][1] != GONE:
                    after = _kept(state, rows[i][0]) if move == 2 else _NEXT[state]
                    price = (0 if move == 2 else REROLE) + (TRUNCATED if rows[i][1] == CUT else 0)
            else:
                failed[4 * i + state] = max(failed.get(4 * i + state, -1), bound - cost)
                stack.pop()
                if path:
                    path.pop()
                continue
            if after is None:
                continue
            total = cost + price
            f = total + least[after][at]
            if f > bound:
                beyond = min(beyond, f)
            elif failed.get(4 * at + after, -1) < bound - total:
                path.append("DIKR"[move])
                stack.append([at, after, total, 0])
        bound = beyond


def ordered(rows: DataFrame, *before: str) -> DataFrame:
    keys = ["conv_id", *before, "turn", "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*keys)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of role and text as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


class _Conversation:
    """What is known of the conversation whose rows stream by."""

    def __init__(self, conv: int | None):
        self.conv, self.rows, self.seen = conv, [], set()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.first, self.last, self.distinct = 0, None, None, 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        if self.rows and self.rows[-1][0] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        last, fault = _LAST.search(text[-64:]) or _LAST.search(text), CLEAN
        if last is None:
            fault, name = GONE, "blank"
        elif mark in self.seen:
            fault, name = GONE, "duplicate"
        elif last[1] not in ".!?":
            fault, name = CUT, "truncated"
        if fault:
            self.faults[name] += 1
        self.seen.add(mark)
        self.rows.append((role[:1], fault))

    def done(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return self.conv, gaps, *self.faults.values(), self.illegal, *search(self.rows)


def audits(conversations: DataFrame) -> DataFrame:
    """Per conversation with rows: gaps in its turns, its faults, and the cost and audit of its cheapest repair."""
    kinds = (*[pa.int64()] * 7, pa.string())
    names = [c.split()[0] for c in AUDITS.split(", ")]

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in batches:
            done = []
            for conv, turn, role, text in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        done.append(held.done())
                    held = _Conversation(conv)
                held.add(turn, role, text)
            yield batch(done)
        yield batch([held.done()] if held is not None else [])

    return map_arrow(ordered(turns(conversations)), work, AUDITS)


def repaired_turns(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that the audit makes of the rows."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _kept(state, role[:1])
        else:
            state = _NEXT[state]
            role = "user" if state == USER else "assistant"
        yield role, text


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, Iterator[tuple[str, str]]]]:
    """conv_id, audit and the stream of rows of each conversation. A stream must be read to its end."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        conv, _, audit, _ = ahead

        def own() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while (ahead := next(rows, None)) is not None and ahead[1] == 1:
                yield ahead[2], ahead[3]

        stream = own()
        yield conv, audit, stream
        for _ in stream:
            pass


def _with_audits(conversations: DataFrame, found: DataFrame) -> DataFrame:
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), F.lit("").alias("text"))
    return ordered(heads.unionByName(turns(conversations).withColumn("kind", F.lit(1))), "kind")


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, nth, role, text: the turns of every repaired conversation, by the audits found for it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for conv, audit, rows in _streams(batches):
            for nth, (role, text) in enumerate(repaired_turns(rows, audit)):
                held.append((conv, nth, role, text))
                size += len(text)
                if size > 4 << 20 or len(held) >= 4096:
                    yield batch(held)
                    held, size = [], 0
        yield batch(held)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "nth", "role", "text"])

    return map_arrow(_with_audits(conversations, found), work, "conv_id long, nth long, role string, text string")


def digests(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and the digest of its repaired turns, `role:text` joined by line breaks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv, audit, rows in _streams(batches):
            digest = hashlib.sha256()
            for nth, (role, text) in enumerate(repaired_turns(rows, audit)):
                digest.update(f"{chr(10) if nth else ''}{role}:{text}".encode())
            done.append((conv, digest.hexdigest()))
            if len(done) >= 4096:
                yield batch(done)
                done = []
        yield batch(done)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])

    return map_arrow(_with_audits(conversations, found), work, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its full stops and
    exclamation and question marks, 3 repeats it, 4 makes its role user. Nulls are one space."""
    rows = turns(conversations)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.pmod(F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")), F.lit(20))
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    rows = rows.withColumn("times", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Per conv_id of `conversations`: the audit of its `rows` and the digest of what it repairs them to.

    A conversation without rows has zeros, an empty audit and the digest of the empty string.
    """
    found = stored(audits(rows))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.alias("e").join(found.alias("f"), F.expr("e.conv_id <=> f.conv_id"), "left")
    joined = joined.join(digests(rows, found).alias("d"), F.expr("e.conv_id <=> d.conv_id"), "left")
    number = [F.coalesce(f"f.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("e.conv_id", *number, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", nothing).alias("repaired_sha256"))
