"""Sparse suffix-array deduplication: passages of `LEAST` or more words that occur at several places.

Suffixes are kept only at minimisers: of the seeds (`SEED_WORDS` consecutive words) inside a window of `LEAST` words the
one with the smallest hash is chosen. Equal windows choose equal places, so every repeated passage holds a kept suffix at
the same place of each copy. About one word in 21 starts one.

1. Kept suffixes are brought into the order of their seeds; a seed without an equal neighbour cannot repeat and goes.
2. Equal seeds are ordered by the context over which the suffix was chosen, which reaches left to the first and right to
   the last window that chose it. Suffixes with equal contexts match as a whole, one of them stands for all.
3. Where a seed has several contexts, the match is extended left and right, window by window, between the
   representatives: a window is repeated if another representative has an equal one.
4. The windows' runs, joined over neighbouring suffixes, are the maximal repeated passages.

The order is that of 64-bit hashes of seed, context and window, not of the words themselves: in a lexicographic order the
neighbour shares the longest text to the right, but the partner that also shares the text to the left can lie anywhere
between, and comparing neighbours alone would miss it. With hashed contexts equal means neighbouring, at every step.

The first place of a passage in the order (doc_id, row, word) stays, the others are marked `removed`.

Nulls and odd rows: null, empty and shorter texts have no passage. Null doc_ids sort first. A row repeated with the same
doc_id and text is one document delivered twice: its passages are reported as repeated, but nothing of it is cut, for
both rows are the first place. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lictor.llm import hashing as H
from lictor.llm.tables import Scratch, map_arrow, parted, stored

LEAST, SEED_WORDS = 50, 10


def _minimisers(found: H.Words, least: int, seed_words: int) -> tuple[np.ndarray, ...]:
    """Kept suffixes of a batch: place, first and last window start that chose it (places within the batch), seed hash."""
    empty = np.empty(0, np.int64)
    seeds = H.sequences(found.hashes, seed_words)
    span = least - seed_words + 1
    if len(seeds) < span:
        return empty, empty, empty, np.empty(0, H.U)
    at = np.concatenate([
        begin + np.arange(min(1 << 18, len(seeds) - span + 1 - begin)) +
        np.lib.stride_tricks.sliding_window_view(seeds[begin:begin + (1 << 18) + span - 1], span).argmin(axis=1)
        for begin in range(0, len(seeds) - span + 1, 1 << 18)])
    starts = np.arange(len(at))
    text = np.searchsorted(found.bounds, starts, "right") - 1
    whole = starts + least <= found.bounds[text + 1]
    starts, at, text = starts[whole], at[whole], text[whole]
    if not len(starts):
        return empty, empty, empty, np.empty(0, H.U)
    breaks = np.flatnonzero((np.diff(at) != 0) | (np.diff(text) != 0)) + 1
    first, last = starts[np.r_[0, breaks]], starts[np.r_[breaks, len(starts)] - 1]
    place = at[np.r_[0, breaks]]
    return place, first, last, seeds[place]


def suffixes(docs: DataFrame, least: int = LEAST, seed_words: int = SEED_WORDS) -> DataFrame:
    """Kept suffixes of all texts: doc_id, row_key, seed, context, first (window start in words), windows (how many)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.small(batches, "text"):
            found = H.words(batch.column("text"), lower=False)
            place, first, last, seed = _minimisers(found, least, seed_words)
            context = H.Segments(found.hashes)(first, last + least)
            with np.errstate(over="ignore"):
                context = H.mixed(context + (place - first).astype(H.U))
            text = np.searchsorted(found.bounds, first, "right") - 1
            index = pa.array(text)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(index), batch.column("row_key").take(index), pa.array(H.signed(seed)), pa.array(H.signed(context)),
                pa.array(first - found.bounds[text], pa.int32()), pa.array(last - first + 1, pa.int32()),
            ], names=["doc_id", "row_key", "seed", "context", "first", "windows"])

    return map_arrow(_keyed(docs), work, "doc_id long, row_key long, seed long, context long, first int, windows int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text")


def _windows(docs: DataFrame, chosen: DataFrame, least: int) -> DataFrame:
    """One row per window of the chosen suffixes (seed, context, row_key, first, windows): seed, context, i, window (its hash)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.small(batches, "text"):
            found = H.words(batch.column("text"), lower=False)
            of = H.Segments(found.hashes)
            listed = batch.column("chosen")
            flat, many = listed.flatten(), listed.value_lengths().to_numpy()
            text = np.repeat(np.arange(batch.num_rows), many)
            windows = flat.field("windows").to_numpy()
            which = np.repeat(np.arange(len(windows)), windows)
            i = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
            begin = (found.bounds[text] + flat.field("first").to_numpy())[which] + i
            index = pa.array(which)
            yield pa.RecordBatch.from_arrays([
                flat.field("seed").take(index), flat.field("context").take(index), pa.array(i, pa.int32()), pa.array(H.signed(of(begin, begin + least))),
            ], names=["seed", "context", "i", "window"])

    per_text = chosen.groupBy("row_key").agg(F.collect_list(F.struct("seed", "context", "first", "windows")).alias("chosen"))
    texts = _keyed(docs).select("row_key", "text").join(per_text, "row_key").select("text", "chosen")
    return map_arrow(texts, work, "seed long, context long, i int, window long")


def passages(docs: DataFrame, least: int = LEAST, seed_words: int = SEED_WORDS) -> DataFrame:
    """Repeated passages: doc_id, row_key, begin, end (in words), removed (an earlier place holds the same words), first_doc_ids."""
    scratch = Scratch()
    kept = scratch.stored(suffixes(docs, least, seed_words))
    # Counts are stored before they are joined back: only a join of two plain shuffles is split at a hot key.
    again = scratch.stored(kept.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"))
    kept = scratch.stored(kept.join(again, "seed"))
    place = F.struct("doc_id", "row_key", "first")
    alike = kept.groupBy("seed", "context").agg(F.min(place).alias("own"), F.count("*").alias("n"), F.first("windows").alias("windows"))
    alike = scratch.stored(alike)
    several = alike.groupBy("seed").agg(F.min("context").alias("lo"), F.max("context").alias("hi")).where("lo < hi").select("seed")
    several = scratch.stored(several)
    extended = scratch.stored(alike.join(several, "seed"))

    # Extension: windows of one representative per context, against those of all others of the table.
    chosen = extended.select("seed", "context", "own.row_key", "own.first", "windows")
    windows = _windows(docs, chosen, least).dropDuplicates(["seed", "context", "i"])
    windows = scratch.stored(windows.join(extended.select("seed", "context", "own", "n"), ["seed", "context"]).select(
        "window", "seed", "context", "i", "n", F.struct("own.doc_id", "own.row_key", (F.col("own.first") + F.col("i")).alias("first")).alias("own")))
    repeated = windows.groupBy("window").agg(F.sum("n").alias("total"), F.min("own").alias("origin")).where("total > 1").select("window", "origin")
    repeated = scratch.stored(repeated)
    matched = windows.select("window", "seed", "context", "i").join(repeated, "window")
    matched = matched.select("seed", "context", "i", "origin.doc_id", "origin.row_key", (F.col("origin.first") - F.col("i")).alias("shift"))
    line = Window.partitionBy("seed", "context", "doc_id", "row_key", "shift").orderBy("i")
    runs = matched.withColumn("island", F.col("i") - F.row_number().over(line))
    runs = runs.groupBy("seed", "context", "doc_id", "row_key", "shift", "island").agg(F.min("i").alias("i"), F.max("i").alias("j"))
    runs = runs.select("seed", "context", "i", "j", F.col("doc_id").alias("from_doc"), F.col("row_key").alias("from_row"), (F.col("shift") + F.col("i")).alias("from"))
    single = alike.join(several, "seed", "left_anti").where("n > 1").select(
        "seed", "context", F.lit(0).alias("i"), (F.col("windows") - 1).alias("j"), F.col("own.doc_id").alias("from_doc"), F.col("own.row_key").alias("from_row"), F.col("own.first").alias("from"))

    # Every place of a context takes over its runs; overlapping and touching ones are joined per document.
    spans = kept.select("doc_id", "row_key", "seed", "context", "first").join(runs.unionByName(single), ["seed", "context"])
    begin = F.col("first") + F.col("i")
    own = F.col("from_row").eqNullSafe(F.col("row_key")) & (F.col("from") == begin)
    spans = spans.select("doc_id", "row_key", begin.alias("begin"), (F.col("first") + F.col("j") + least).alias("end"), (~own).alias("removed"), "from_doc")
    before = Window.partitionBy("row_key", "removed").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("row_key", "removed").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("reached", F.max("end").over(before))
    spans = spans.withColumn("island", F.sum(F.when(F.col("begin") <= F.col("reached"), 0).otherwise(1)).over(through))
    out = spans.groupBy("row_key", "removed", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_sort(F.collect_set("from_doc")).alias("first_doc_ids"),
    ).select("doc_id", "row_key", "begin", "end", "removed", "first_doc_ids")
    out = stored(out)
    scratch.drop(docs.sparkSession)
    return out


def _cut(text: str, begins: np.ndarray, ends: np.ndarray) -> str | None:
    """The text without the given word spans; nothing if no word is left."""
    raw = text.encode()
    starts = np.r_[H.words(pa.array([text]), lower=False).starts, len(raw)]
    pieces, at = [], 0
    for begin, end in sorted(zip(starts[begins].tolist(), starts[ends].tolist(), strict=True)):
        pieces.append(raw[at:max(at, begin)])
        at = max(at, end)
    left = b"".join([*pieces, raw[at:]])
    return left.decode() if left.strip(b" \t\n\x0b\x0c\r") else None


@F.arrow_udf(StringType())
def _cut_all(texts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
    """The texts without their spans, as Arrow arrays: a worker needs no pandas and keeps no memory of the batch."""
    numbers = lambda spans: np.array(spans.as_py(), np.int64)
    out = pa.array([t.as_py() if not b.is_valid else _cut(t.as_py(), numbers(b), numbers(e)) for t, b, e in zip(texts, begins, ends, strict=True)], pa.string())
    pa.default_memory_pool().release_unused()
    return out


def cleaned(docs: DataFrame, least: int = LEAST, seed_words: int = SEED_WORDS) -> DataFrame:
    """`docs` without repeated passages, except for their first place; n_chars, if there, counts what is left.

    A text is cut from the passage's first word up to the next word behind it. Rows whose words are all cut go; rows
    without a cut stay as they are.
    """
    cuts = stored(passages(docs, least, seed_words).where("removed").groupBy(F.col("row_key").alias("_row")).agg(
        F.collect_list("begin").alias("_begins"), F.collect_list("end").alias("_ends")))
    # Only rows that may have a cut meet the cuts in a shuffle.
    met, others = parted(docs.withColumn("_row", F.xxhash64("doc_id", "text")), cuts, "_row")
    joined = met.join(cuts, "_row", "left")
    joined = joined.withColumn("text", _cut_all("text", "_begins", "_ends")).where("_begins IS NULL OR text IS NOT NULL")
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("_begins").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return others.select(*docs.columns).unionByName(joined.select(*docs.columns))
