"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

A source's size is its number of words. All sources together are to give as many words as there are. Targets are
proportional to weights, but no target exceeds `epochs` times its source's size: the excess of capped sources is shared
by weight among the others until none is above. Sorted by cap / weight, the capped sources are a prefix, so one pass
over the (one row per source) table finds the final level.

A source with target t and size s gives every document floor(t / s) times, and a sampled part of one more repetition:
documents in the order of a seeded hash, until the words are used up; the last one gives only its first words. Each
source's words so come within rounding of its target, and the sample is the same in every run. The cut in the hash
order is found in two steps, by 4096 hash ranges and then inside the one range where the words run out, so that no
source is ever sorted as a whole.

Nulls and odd rows: a null text has size 0 and takes nothing, a null source is a source of its own, last in order; a
null doc_id is hashed like any value. Rows repeated with the same doc_id and text have one place in the hash order and
share a cut evenly. An empty table gives an empty result. Clashing columns: none is read but doc_id, text and source;
the added columns replace others of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lictor.llm.tables import WORD, small_side, stored

#: Weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 20
_BITS, _RANGE_BITS = 52, 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: int) -> Column:
    """A document's place in the seeded order: 52 bits of a digest of doc_id and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, _BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> with target. One row per source; windows run over this small table only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    named = sizes.withColumn("nth", F.row_number().over(order)).withColumn("weight", cycle[(F.col("nth") - 1) % len(weights)])
    named = named.withColumn("cap", epochs * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = named.withColumn("all_words", F.sum("source_size").over(everything)).withColumn(
        "level", (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    filled = filled.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    first_open = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("nth"), F.col("level")))).over(everything)
    filled = filled.withColumn("final", first_open["level"])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final"))
    return filled.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Per source: source_size, target, whole repetitions, and the cut (place, words there, rows there) of the partial one."""
    rows = stored(docs.select("source", place(seed).alias("place"), n_words(F.col("text")).alias("size")).where("size > 0"))
    named = docs.select("source").distinct()
    ranges = rows.groupBy("source", F.shiftright("place", _BITS - _RANGE_BITS).alias("range")).agg(F.sum("size").alias("words"))
    ranges = stored(ranges)  # at most 4096 rows per source
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    sizes = named.join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    sizes = sizes.select("source", F.coalesce("source_size", F.lit(0)).alias("source_size"))
    shares = targets(sizes, weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    shares = shares.withColumn("whole", whole.cast("long"))
    shares = stored(shares.withColumn("part", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size"))))

    # The range in which the words of the partial repetition run out, then the place in it.
    wanted = shares.select(F.col("source").alias("s"), "part")
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(by_range), F.lit(0)))
    ranges = ranges.join(wanted, F.col("source").eqNullSafe(F.col("s")))
    cut = ranges.where("before < part AND part <= before + words").select(F.col("source").alias("s"), "range", "before", "part")
    inside = rows.join(small_side(stored(cut.coalesce(1))), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", _BITS - _RANGE_BITS) == F.col("range")))
    inside = inside.groupBy("source", "place", "before", "part").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    by_place = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(by_place), F.lit(0)))
    ends = inside.where("before < part AND part <= before + words").select(
        F.col("source").alias("s"), F.col("place").alias("cut_place"), (F.col("part") - F.col("before")).alias("cut_words"), F.col("rows").alias("cut_rows"))
    return stored(shares.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "part").coalesce(1))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """`docs` with size, source_size, target and taken: the words of the document that the mix takes, repeats counted.

    taken = whole repetitions x size + the sampled part; a training job reads the document `taken / size` times.
    """
    made = plan(docs, weights, epochs, seed)
    made = made.select(F.col("source").alias("_source"), "source_size", "target", "whole", "cut_place", "cut_words", "cut_rows")
    docs = docs.drop("size", "source_size", "target", "taken")
    sized = docs.withColumn("size", n_words(F.col("text"))).withColumn("_place", place(seed))
    joined = sized.join(small_side(made), F.col("source").eqNullSafe(F.col("_source")))
    extra = (
        F.when(F.col("cut_place").isNull() | (F.col("_place") > F.col("cut_place")), 0)
        .when(F.col("_place") < F.col("cut_place"), F.col("size"))
        .otherwise(F.floor(F.col("cut_words") / F.col("cut_rows")))
    )
    taken = (F.col("whole") * F.col("size") + extra).cast("long")
    return joined.withColumn("taken", taken).select(*docs.columns, "size", "source_size", "target", "taken")
