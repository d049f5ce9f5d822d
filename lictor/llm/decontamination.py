"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

Every benchmark item becomes windows of `WINDOW` consecutive words (a shorter item is one window), every window the set
of its word shingles with their places. A document contains a window only if it contains all of its shingles, so for
containment 1 the necessary prefix is one shingle, the window's rarest over the documents.

1. One pass over the whole texts marks the places whose shingle occurs in the benchmark, by a bitmap of a fixed number
   of bits (false marks cost work, never results). Neighbouring marked places form a run; only runs leave the scan, with
   their word hashes. Everything that a window can match lies inside one run.
2. Marked shingles are counted over all documents; every window keeps its rarest one and its place in the window.
3. Runs join the windows on that shingle. The position bound drops windows that would begin before the run, the length
   bound those that would end after it, and the rest is verified word by word (64-bit hashes at every place).

Nulls and odd rows: a null or empty text has no words (n_words 0, not contaminated). Items without words have no
window. An item without item_id marks words but is not counted or named. A null doc_id is a document like any other.
Repeated document rows are judged each by itself; repeated items count once. Empty tables: without documents nothing is
returned, without items nothing is contaminated. Further columns of both tables are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lictor.llm import hashing as H
from lictor.llm.tables import map_arrow, parted, stored

WINDOW = 13
#: Words of a shingle; windows of fewer words are one shingle.
SHINGLE = 5
#: Size of the bitmap that is sent to the executors, whatever the benchmark's size: 2**23 bits, 1 MB.
MAP_BITS = 23


def windows(items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows: win (their key), words (64-bit hashes), k (words of a shingle), shingles; and items (win, item_id)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.small(batches, "text"):
            found = H.words(batch.column("text"), H.ALPHANUMERIC)
            ids, held, parts = [], [], []
            for item, i in zip(batch.column("item_id").to_pylist(), range(batch.num_rows), strict=True):
                of = found.of(i)
                length = min(size, len(of))
                for begin in range(len(of) - length + 1 if length else 0):
                    ids.append(item)
                    held.append(H.signed(of[begin:begin + length]))
                    parts.append(H.signed(H.sequences(of[begin:begin + length], min(shingle, length))))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.string()),
                H.lists(np.concatenate(held) if held else np.empty(0, np.int64), [len(h) for h in held], pa.int64()),
                H.lists(np.concatenate(parts) if parts else np.empty(0, np.int64), [len(p) for p in parts], pa.int64()),
            ], names=["item_id", "words", "shingles"])

    found = map_arrow(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), work, "item_id string, words array<long>, shingles array<long>")
    key = F.concat(F.size("words").cast("string"), F.lit("-"), F.md5(F.to_json(F.struct("words"))))
    return stored(found.withColumn("win", key).withColumn("k", F.least(F.lit(shingle), F.size("words"))).distinct())


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent bit places of a hash in the bitmap."""
    return hashes >> H.U(64 - MAP_BITS), hashes & H.U((1 << MAP_BITS) - 1)


def _bitmap(found: DataFrame) -> dict[int, np.ndarray]:
    """Per shingle length a bitmap of 2**MAP_BITS bits, two per shingle of the benchmark, combined by Spark."""
    shingle = found.select("k", F.explode("shingles").alias("s"))
    probes = F.array(F.shiftrightunsigned("s", 64 - MAP_BITS), F.col("s").bitwiseAND(F.lit((1 << MAP_BITS) - 1)))
    bits = shingle.select("k", F.explode(probes).alias("bit"))
    words = bits.groupBy("k", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    maps: dict[int, np.ndarray] = {}
    for k, word, held in words.collect():  # at most SHINGLE x 2**(MAP_BITS - 6) rows, whatever the input
        maps.setdefault(k, np.zeros(1 << (MAP_BITS - 6), np.int64))[word] = held
    return maps


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _probes(hashes):
        found &= ((bits.view(H.U)[(at >> H.U(6)).astype(np.int64)] >> (at & H.U(63))) & H.U(1)).astype(bool)
    return found


def runs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per document and marked run; a document without any gives one row with a null run.

    Columns: row (a number per document row), doc_id, n_words, k, begin (place of the run's first word), words (hashes of
    its words). Texts are read whole, once.
    """
    maps = docs.sparkSession.sparkContext.broadcast(_bitmap(found))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.small(batches, "text"):
            seen = H.words(batch.column("text"), H.ALPHANUMERIC)
            rows, lengths, begins, held = [], [], [], []
            for k, bits in maps.value.items():
                at = np.flatnonzero(_marked(bits, H.sequences(seen.hashes, k)))
                row = np.searchsorted(seen.bounds, at, "right") - 1
                inside = at + k <= seen.bounds[row + 1]
                at, row = at[inside], row[inside]
                if not len(at):
                    continue
                breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0)) + 1
                for first, last in zip(np.r_[0, breaks], np.r_[breaks, len(at)] - 1, strict=True):
                    rows.append(int(row[first]))
                    lengths.append(k)
                    begins.append(int(at[first] - seen.bounds[row[first]]))
                    held.append(H.signed(seen.hashes[at[first]:at[last] + k]))
            bare = np.setdiff1d(np.arange(batch.num_rows), np.array(rows, np.int64))
            nothing, every = [None] * len(bare), np.r_[np.array(rows, np.int64), bare]
            words = H.lists(np.concatenate(held) if held else np.empty(0, np.int64), [len(h) for h in held], pa.int64())
            index = pa.array(every, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("row").take(index), batch.column("doc_id").take(index), pa.array(np.diff(seen.bounds)[every], pa.int64()),
                pa.array(lengths + nothing, pa.int32()), pa.array(begins + nothing, pa.int32()),
                pa.concat_arrays([words, pa.array(nothing, pa.list_(pa.int64()))]),
            ], names=["row", "doc_id", "n_words", "k", "begin", "words"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(map_arrow(source, work, "row long, doc_id long, n_words long, k int, begin int, words array<long>"))


def _with_places(spans: DataFrame) -> DataFrame:
    """One row per place of a run with its shingle, computed again from the run's words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat = lists.flatten().to_numpy().view(H.U)
            bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            parts = [H.sequences(flat[bounds[i]:bounds[i + 1]], k) for i, k in enumerate(batch.column("k").to_pylist())]
            sizes = np.array([len(p) for p in parts], np.int64)
            index = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).take(index) for c in ("row", "k", "begin")), pa.array(places, pa.int32()),
                pa.array(H.signed(np.concatenate(parts)) if parts else np.empty(0, np.int64)),
            ], names=["row", "k", "begin", "place", "shingle"])

    return map_arrow(spans.select("row", "k", "begin", "words"), work, "row long, k int, begin int, place int, shingle long")


def occurrences(marked: DataFrame, found: DataFrame) -> DataFrame:
    """Verified occurrences: row (a document), win, start (place of the first word) and length in words."""
    spans = marked.where("k IS NOT NULL")
    places = stored(_with_places(spans))
    rarity = places.groupBy("k", "shingle").agg(F.count("*").alias("n"))
    unique = found.select("win", "k", "words", "shingles").dropDuplicates(["win"])
    tokens = unique.select("win", "k", F.posexplode("shingles").alias("offset", "shingle"))
    ranked = tokens.join(rarity, ["k", "shingle"], "left").select("win", "k", "offset", "shingle", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = ranked.groupBy("win", "k").agg(F.min(F.struct("n", "shingle", "offset")).alias("rare")).where("rare.n > 0")
    prefix = prefix.join(unique.select("win", "words"), "win").select("win", "k", F.col("rare.shingle").alias("shingle"), F.col("rare.offset").alias("offset"), F.col("words").alias("want"))
    candidates = places.join(prefix, ["k", "shingle"])
    first = F.col("place") - F.col("offset")
    candidates = candidates.withColumn("first", first).where("first >= 0").select("row", "k", "begin", "win", "want", "first")
    held = spans.select("row", "k", "begin", "words")
    fits = candidates.join(held, ["row", "k", "begin"]).where(F.col("first") + F.size("want") <= F.size("words"))
    exact = fits.where(F.slice("words", F.col("first") + 1, F.size("want")) == F.col("want"))
    return exact.select("row", "win", (F.col("begin") + F.col("first")).alias("start"), F.size("want").alias("length"))


def judged(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, percent: int = 5) -> DataFrame:
    """Per document row: row, doc_id, n_words, n_hit, n_items, item_ids (sorted), contaminated."""
    found = windows(items, size, shingle)
    marked = runs(docs, found)
    hits = stored(occurrences(marked, found))
    within = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = hits.select("row", "start", "length").distinct().withColumn("reached", F.coalesce(F.max(end).over(within), F.lit(0)))
    covered = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reached"))).alias("n_hit"))
    named = hits.select("row", "win").distinct().join(found.select("win", "item_id").where("item_id IS NOT NULL").distinct(), "win")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    every = marked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    out = every.join(covered, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    out = out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), item_ids.alias("item_ids"))
    bad = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return out.select("row", "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", bad.alias("contaminated"))


def cleaned(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, percent: int = 5) -> DataFrame:
    """`docs` without the contaminated rows."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    bad = judged(keyed.select(F.col("_row").alias("doc_id"), "text"), items, size, shingle, percent).where("contaminated")
    bad = stored(bad.select(F.col("doc_id").alias("_row")).distinct())
    # Only rows that may be contaminated meet the list in a shuffle.
    met, others = parted(keyed, bad, "_row")
    return others.unionByName(met.join(bad, "_row", "left_anti")).drop("_row")
