"""MinHash near-duplicates with odd sketches.

Every text becomes its set of distinct word shingles. `BANDS * ROWS` MinHash samples of the set are banded into buckets,
and all samples are folded into one parity bitmap, the odd sketch: the number of ones in the XOR of two sketches
estimates how many samples differ, closely so at high similarity. Candidates are texts that share a bucket; the sketch
estimate drops the hopeless ones, with a slack of several standard deviations, and the full sets decide the rest.

* Texts with equal sets are one class from the start (one row per class is compared, its copies follow it).
* First every class is compared with the bucket centre that it meets most often, and linked groups are built. Only buckets that
  then still hold more than one group are compared in full, in blocks of at most about `BLOCK` x `BLOCK` sketches, and only
  classes outside the bucket's main group ask the others: a bucket of thousands of near copies costs one comparison per copy,
  and no pair is left out. A pair comes from its smallest common bucket only.
* In those blocks a second, finer odd sketch of a hash sample of the shingles (all of them, if they are few) drops most pairs
  between the estimate's slack and the threshold, so that a group just below the threshold does not become all its pairs.
* At the similarity 0.8 a pair misses all 30 buckets with probability 7e-6, at 0.85 with 2e-8. Nothing is capped.

Nulls and odd rows: a null text and a text without words have an empty set and link with nothing; their component is
their own doc_id. A null doc_id takes part in links, is never the name of a component with a named document, and is not
kept. Rows repeated with the same doc_id and text are copies of each other and get the same component and flag; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lictor.llm import hashing as H
from lictor.llm.tables import Scratch, groups, map_arrow, parted, stored

ROWS, BANDS, BITS, BLOCK = 5, 30, 512, 512
#: How far below the threshold an estimate may lie before the pair is dropped; the estimate's deviation is about 0.035.
SLACK = 0.17
#: Finer sketches take all shingles of a small set, of a larger one those in a hash sample that keeps it below FINE_BITS.
#: Their deviation is about 0.009 without sampling, 0.02 with it.
FINE_BITS, FINE_SLACK, SAMPLED_SLACK = 1024, 0.05, 0.1
#: Buckets of more than LARGE classes go through so many rounds of nearest pairs first.
LARGE, NEAREST_ROUNDS = 64, 2
_SAMPLES = ROWS * BANDS
_A = (H.multipliers(_SAMPLES, 21) >> H.U(32)).astype(np.uint32) | np.uint32(1)
_B = (H.multipliers(_SAMPLES, 22) >> H.U(32)).astype(np.uint32)
_BAND = H.multipliers(BANDS, 23)

SIGNATURES = "doc_id long, row_key long, n_shingles long, cls binary, bands array<long>, sketch array<long>, fine array<long>"


def samples(items: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of 64-bit items: the smallest of a * x + b modulo 2**32, per sample."""
    x = (items >> H.U(32)).astype(np.uint32)
    best = np.full(_SAMPLES, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(x), 2048):
        np.minimum(best, (x[begin:begin + 2048, None] * _A + _B).min(axis=0), out=best)
    return best


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, for many sample rows at once."""
    grouped = least.reshape(-1, BANDS, ROWS).astype(H.U)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(_BAND, grouped.shape[:2]).copy()
        for r in range(ROWS):
            key = H.mixed(key * H.U(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples: sample i with value m flips one bit chosen by (i, m)."""
    least = least.reshape(-1, _SAMPLES)
    with np.errstate(over="ignore"):
        bit = (H.mixed(least.astype(H.U) + (np.arange(1, _SAMPLES + 1, dtype=H.U) << H.U(32))) % H.U(BITS)).astype(np.int64)
    ones = np.zeros((len(least), BITS), np.uint8)
    np.add.at(ones, (np.arange(len(least))[:, None], bit), 1)
    return np.packbits(ones & 1, axis=1)


def sample_level(n: np.ndarray) -> np.ndarray:
    """How often a set of n items is halved by hash for its fine sketch."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(np.asarray(n, np.float64), 1) / FINE_BITS))).astype(np.int64)


def fine_sketches(items: np.ndarray) -> np.ndarray:
    """Two parity bitmaps: of the hash sample at the set's own level and of the next smaller one, for a larger partner."""
    level, out = int(sample_level(len(items))), []
    for k in (level, level + 1):
        kept = items[(items & H.U((1 << k) - 1)) == 0]
        bit = (H.mixed(kept ^ H.U(0x2545F4914F6CDD1D)) % H.U(FINE_BITS)).astype(np.int64)
        out.append(np.packbits((np.bincount(bit, minlength=FINE_BITS) & 1).astype(np.uint8)).view(H.U))
    return np.concatenate(out)


def fine_similar(n: int, fine: np.ndarray, others_n: np.ndarray, others: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarities to the other sets (sizes, fine sketches) by the sketches, and which may reach the threshold."""
    level, levels = int(sample_level(n)), sample_level(others_n)
    at = np.maximum(level, levels)
    near = (abs(levels - level) <= 1) & (np.minimum(n, others_n) >= threshold * np.maximum(n, others_n) - 1e-9)
    words = FINE_BITS // 64
    pick = lambda sketch, of: np.where((at - of == 0)[:, None], sketch[:, :words], sketch[:, words:])
    ones = np.bitwise_count(pick(np.broadcast_to(fine, others.shape), level) ^ pick(others, levels)).sum(axis=1)
    apart = -FINE_BITS / 2 * np.log(np.maximum(1 - 2 * ones / FINE_BITS, 1e-9)) * 2.0**at
    similar = (n + others_n - apart) / (n + others_n + apart)
    return similar, near & (similar >= threshold - np.where(at > 0, SAMPLED_SLACK, FINE_SLACK))


def fine_fits(n: int, fine: np.ndarray, others_n: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the other sets (sizes, fine sketches) may be as similar as the threshold."""
    return fine_similar(n, fine, others_n, others, threshold)[1]


def estimates(different: np.ndarray) -> np.ndarray:
    """Similarity from the number of ones in the XOR of two sketches."""
    left = np.maximum(1 - 2 * different / BITS, 1e-9)
    return 1 + BITS * np.log(left) / (4 * _SAMPLES)


def _most_different(threshold: float) -> int:
    """The largest XOR count whose estimate still reaches the threshold minus the slack."""
    fits = estimates(np.arange(BITS // 2 + 1)) >= threshold - SLACK
    return int(np.flatnonzero(fits).max())


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """Per row: set size, class (a 128-bit fingerprint of the set), bucket keys and odd sketch. Reads the texts once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.small(batches, "text"):
            found = H.words(batch.column("text"))
            n, kept, least, sizes, marks, finer = batch.num_rows, [], [], np.zeros(batch.num_rows, np.int64), [], []
            for i in range(n):
                items = H.shingles(found.of(i), size)
                sizes[i] = len(items)
                if len(items):
                    kept.append(i)
                    least.append(samples(items))
                    finer.append(fine_sketches(items))
                    with np.errstate(over="ignore"):
                        marks.append((items.sum() + H.U(len(items)), H.mixed(items ^ H.U(0x5851F42D4C957F2D)).sum()))
            bands = H.signed(band_keys(np.array(least))).reshape(-1) if kept else np.empty(0, np.int64)
            bitmaps = odd_sketches(np.array(least)).view(np.int64).reshape(-1) if kept else np.empty(0, np.int64)
            place = dict(zip(kept, range(len(kept)), strict=True))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()),
                pa.array([np.array(marks[place[i]], ">u8").tobytes() if i in place else None for i in range(n)], pa.binary()),
                H.lists(bands, [BANDS if i in place else 0 for i in range(n)], pa.int64()),
                H.lists(bitmaps, [BITS // 64 if i in place else 0 for i in range(n)], pa.int64()),
                H.lists(H.signed(np.concatenate(finer)) if kept else np.empty(0, np.int64), [FINE_BITS // 32 if i in place else 0 for i in range(n)], pa.int64()),
            ], names=["doc_id", "row_key", "n_shingles", "cls", "bands", "sketch", "fine"])

    return map_arrow(_keyed(docs), work, SIGNATURES)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The full sets of the wanted classes (cls, row_key): cls, items as sorted 64-bit numbers. One row per class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.small(batches, "text"):
            found = H.words(batch.column("text"))
            items = [H.shingles(found.of(i), size).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(items, pa.binary())], names=["cls", "items"])

    # Only texts that may be wanted meet the wanted rows in a shuffle.
    texts = parted(_keyed(docs).select("row_key", "text"), wanted, "row_key")[0].join(wanted, "row_key")
    return map_arrow(texts.select("cls", "text"), work, "cls binary, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least `percent` hundredths of their union in common."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for left, right in zip(batch.column("left_items"), batch.column("right_items"), strict=True):
                x, y = np.frombuffer(left.as_buffer(), H.U), np.frombuffer(right.as_buffer(), H.U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fits.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(fits, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("left_items"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("right_items"))
    return map_arrow(pairs.select("a", "b").join(left, "a").join(right, "b"), work, "a binary, b binary")


def _compare_blocks(threshold: float, nearest: bool = False) -> Callable:
    """Rows of `_ordered_blocks` -> pairs of different groups that may be similar: each class that asks with those that stay.

    A pair comes from its smallest common bucket only. With `nearest` every class that asks gives the most similar one alone.
    """
    most = _most_different(threshold)

    def compare(bucket: int, parts: list[list[np.ndarray]]) -> list[tuple]:
        stays, asks, loose, cls, comp, n, sketch, fine, *bands = (np.concatenate(c) for c in zip(*parts, strict=True))
        there = np.flatnonzero(stays)
        found = []
        for i in np.flatnonzero(asks) if len(there) else ():
            fits = (np.bitwise_count(sketch[i] ^ sketch[there]).sum(axis=1) <= most) & (comp[there] != comp[i])
            if not nearest:
                # Two classes outside the bucket's main group ask each other; their pair counts once.
                fits &= ~loose[there] | (cls[i] < cls[there])
            hits = there[fits]
            if not nearest:
                common = np.where(bands[0][hits] == bands[0][i], bands[0][hits], np.iinfo(np.int64).max)
                hits = hits[common.min(axis=1, initial=np.iinfo(np.int64).max) == bucket]
            if not len(hits):
                continue
            similar, fits = fine_similar(int(n[i]), fine[i], n[hits], fine[hits], threshold)
            apart = np.rint((1 - similar[fits]) * 1e6).astype(np.int64)
            pairs = [(cls[i:i + 1].tobytes(), cls[j:j + 1].tobytes(), int(d)) for j, d in zip(hits[fits], apart, strict=True)]
            found += [min(pairs, key=lambda pair: (pair[2], pair[1]))] if nearest and pairs else [(min(a, b), max(a, b), d) for a, b, d in pairs]
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key: tuple | None = None
        for batch in batches:
            n, found = batch.num_rows, []
            places = np.stack([batch.column(c).to_numpy() for c in ("bucket", "block", "chunk")], axis=1)
            columns = [np.array(batch.column(c).to_pylist(), kind) for c, kind in (("stays", bool), ("asks", bool), ("loose", bool), ("cls", "S16"), ("comp", "S16"), ("n", np.int64))]
            columns += [batch.column(c).flatten().to_numpy().view(np.int64 if c == "bands" else H.U).reshape(n, -1) for c in batch.schema.names[9:]] if n else []
            begins = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(axis=1)]) if n else []
            for begin, end in zip(begins, np.r_[begins[1:], n], strict=True) if n else ():
                at = tuple(places[begin].tolist())
                if held and at != key:
                    found += compare(key[0], held)
                    held = []
                key = at
                held.append([c[begin:end] for c in columns])
            yield _pairs(found)
        yield _pairs(compare(key[0], held) if held else [])

    return work


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    found = sorted(set(found))
    kinds = (pa.binary(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=["a", "b", "d"])


def _ordered_blocks(scratch: Scratch, members: DataFrame, known: DataFrame, finer: DataFrame, least: int, bands: bool) -> tuple[DataFrame, DataFrame]:
    """Buckets of more than `least` classes that still hold several groups, dealt into comparisons; and their sizes.

    Two classes of the bucket's main group are never compared, so only the others, the loose ones, ask. A class stays in its
    own block of the bucket; one that asks goes to all blocks, in its own chunk. A comparison has at most about `BLOCK` of either.
    """
    placed = members.select("bucket", "cls").join(known.select(F.col("node").alias("cls"), "root"), "cls", "left")
    placed = scratch.stored(placed.select("bucket", "cls", F.coalesce("root", "cls").alias("comp")))
    held = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"))
    share = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = scratch.stored(held.where((F.col("comps") > 1) & (F.col("n") > least)).select(
        "bucket", F.col("main.comp").alias("main"), share(F.col("n")).alias("blocks"), share(F.col("n") - F.col("main.n")).alias("chunks")))
    own = lambda parts: F.pmod(F.xxhash64("cls"), F.col(parts)).cast("int")
    at = lambda block, chunk, stays, asks: F.struct(block.alias("block"), chunk.alias("chunk"), stays.alias("stays"), asks.alias("asks"))
    upto = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    stays = F.transform(upto("chunks"), lambda c: at(own("blocks"), c, F.lit(True), F.col("loose") & (c == own("chunks"))))
    asks = F.transform(F.filter(upto("blocks"), lambda b: F.col("loose") & (b != own("blocks"))), lambda b: at(b, own("chunks"), F.lit(False), F.lit(True)))
    rows = placed.join(mixed, "bucket").withColumn("loose", F.col("comp") != F.col("main"))
    rows = rows.select("bucket", "cls", "comp", "loose", F.explode(F.concat(stays, asks)).alias("at")).join(finer, "cls")
    rows = rows.select("bucket", "at.block", "at.chunk", "at.stays", "at.asks", "loose", "cls", "comp", "n", "sketch", "fine", *(["bands"] if bands else []))
    return rows.repartition("bucket", "block", "chunk").sortWithinPartitions("bucket", "block", "chunk", "cls"), mixed


def _differing(x: str, y: str):
    """Ones in the XOR of two sketches, as a native expression over their 64-bit words."""
    total = F.lit(0)
    for k in range(BITS // 64):
        total = total + F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k]))
    return total


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id (smallest doc_id linked by any chain), one row per row of `docs`.

    root tells groups apart whose rows all lack a doc_id; it is null for empty sets.
    """
    most, scratch = _most_different(percent / 100), Scratch()
    full = scratch.stored(signatures(docs, size))
    rows = stored(full.select("doc_id", "row_key", "n_shingles", "cls"))
    classes = scratch.stored(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first"), F.min("row_key").alias("row_key")))
    nodes = full.select("cls", "row_key", "n_shingles", "bands", "sketch", "fine").join(classes.select("cls", "row_key"), ["cls", "row_key"]).dropDuplicates(["cls"])
    nodes = scratch.stored(nodes)
    # Buckets with more than one class, and their members.
    band = nodes.select("cls", F.explode("bands").alias("bucket"))
    crowded = band.groupBy("bucket").agg(F.min("cls").alias("centre"), F.max("cls").alias("other")).where("centre < other")
    # Minima are stored before they are joined back: only a join of two plain shuffles is split at a hot key.
    members = scratch.stored(band.join(scratch.stored(crowded.select("bucket", "centre")), "bucket"))

    # Sketches of the classes in such buckets alone.
    crowd = scratch.stored(members.select(F.xxhash64("cls").alias("key")).distinct())
    finer = nodes.select(F.xxhash64("cls").alias("key"), "cls", F.col("n_shingles").alias("n"), "sketch", "fine", "bands")
    finer = scratch.stored(parted(finer, crowd, "key")[0].drop("key"))
    sketches = finer.select("cls", "sketch")

    # One comparison per class first: with the bucket centre that it meets most often.
    meets = members.where("cls <> centre").groupBy("cls", "centre").agg(F.count("*").alias("n"))
    stars = meets.groupBy("cls").agg(F.max(F.struct("n", "centre")).alias("best")).select(F.col("best.centre").alias("a"), F.col("cls").alias("b"))
    stars = stars.join(sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), "a")
    stars = stars.join(sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("y")), "b")
    stars = scratch.stored(stars.where(_differing("x", "y") <= most).select("a", "b"))
    links = scratch.stored(_confirmed(stars, _wanted_sets(scratch, docs, classes, stars, size), percent))
    known = groups(links)

    # Large buckets: in each round every class outside its bucket's main group is compared with its nearest class of another
    # group, so that a large group of near copies closes before its pairs are looked at. This only orders the work; the last
    # step is complete.
    tested, threshold, schema = stars, percent / 100, "a binary, b binary, d int"
    for _ in range(NEAREST_ROUNDS):
        blocks, large = _ordered_blocks(scratch, members, known, finer.drop("bands"), LARGE, False)
        if large.isEmpty():
            break
        pairs = map_arrow(blocks, _compare_blocks(threshold, nearest=True), schema).groupBy("a").agg(F.min(F.struct("d", "b")).alias("best"))
        pairs = pairs.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()
        pairs = scratch.stored(pairs.join(tested, ["a", "b"], "left_anti"))
        found = scratch.stored(_confirmed(pairs, _wanted_sets(scratch, docs, classes, pairs, size), percent))
        tested, links = tested.union(pairs), links.union(found)
        if found.isEmpty():
            break
        known = groups(links)

    # Then everything that shares a bucket across the groups found so far.
    blocks, _ = _ordered_blocks(scratch, members, known, finer, 1, True)
    more = map_arrow(blocks, _compare_blocks(threshold), schema).select("a", "b").distinct()
    more = scratch.stored(more.join(tested, ["a", "b"], "left_anti"))
    more_links = _confirmed(more, _wanted_sets(scratch, docs, classes, more, size), percent)
    known = groups(links.union(more_links))

    # Names of the groups, and every row with its group's name.
    named = classes.select("cls", "first").join(known.select(F.col("node").alias("cls"), "root"), "cls", "left")
    named = named.select("cls", "first", F.coalesce("root", "cls").alias("root"))
    named = stored(named)
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id")))
    scratch.drop(docs.sparkSession)
    by_class = named.join(least, "root").select("cls", "root", "component_id")
    out = rows.select("doc_id", "row_key", "n_shingles", "cls").join(by_class, "cls", "left")
    name = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_key", "n_shingles", name.alias("component_id"), "root")


def _wanted_sets(scratch: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = _sets(docs, scratch.stored(wanted.join(classes.select("cls", "row_key"), "cls")), size)
    return scratch.stored(sets.dropDuplicates(["cls"]))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group left: the row named by the component. Of repeated rows one stays.

    Rows without doc_id stay only where their group has no named row, one for the group. Texts without words stay
    unless they repeat a whole row's doc_id and text.
    """
    found = components(docs, size, percent)
    row = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    unnamed = found.where("component_id IS NULL AND root IS NOT NULL").groupBy("root").agg(F.min("row_key").alias("row_key"))
    gone = found.where("root IS NOT NULL AND NOT doc_id <=> component_id OR component_id IS NULL AND root IS NOT NULL")
    gone = stored(gone.join(unnamed, "row_key", "left_anti").select(F.col("row_key").alias("_row")).distinct())
    again = stored(found.groupBy("row_key").count().where("count > 1").select(F.col("row_key").alias("_row")))
    # Rows that neither may concern go past the joins.
    met, others = parted(row, gone.union(again), "_row")
    left = met.join(gone, "_row", "left_anti")
    single, repeated = left.join(again, "_row", "left_anti"), left.join(again, "_row", "left_semi")
    return others.unionByName(single).unionByName(repeated.dropDuplicates(["_row"])).drop("_row")
