"""Quality rules: base rules on word statistics, then robust multivariate outliers. DataFrame functions only.

Every document gets a vector of transformed statistics (`FEATURES`). Per language and source the centre and covariance
are estimated by the minimum covariance determinant: of all subsets with `SHARE` of the documents the one with the
smallest determinant, approached by concentration steps (estimate, keep the closest share, estimate again) from several
starts at once. Each group and start goes on until its own determinant's logarithm falls by less than `FALL`, and keeps its
best estimate, so that an estimate depends on no other group. A document whose squared Mahalanobis distance exceeds the
chi-square quantile `CUT` is rejected. `FLOORS` squared are added to the variances, after the factor that makes them
consistent, so that a statistic that is the same for most documents (no symbols at all) does not turn every small deviation
into an outlier. They are small against what a statistic can reach: in a group without any, 5.1 symbols or repeated lines
per 100 words, 13.1 % repeated or 5.1 % stuttered words reject alone; one of them in the shortest document (20 words) does not.

* Groups with fewer than `SMALL` documents that pass the base rules are pooled by language, and small pools over all.
* Quantiles of distances come from counts on a fixed logarithmic grid (256 steps per doubling): exact to the grid, the
  same in every run, and aggregated before the shuffle, so that a group with a third of all rows costs no single task
  more. Tables of estimates have one row per group and start.

Nulls and odd rows: a null text has no words and fails the base rules. Null languages and sources are values of their
own. Repeated rows and null doc_ids are documents like any other. An empty table gives an empty result. Only doc_id,
text, lang and source are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lictor.llm.tables import WORD, small_side, stored

SHARE, CUT, SMALL, STARTS, SEED = 0.75, 0.999, 60, 3, 4
#: Statistic -> smallest standard deviation it is trusted to have.
FLOORS = {"length": 0.02, "symbols": 0.4, "lines": 0.4, "repeats": 0.08, "stutter": 0.05}
FEATURES = tuple(FLOORS)
_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
FALL = 1e-3
#: Documents of a random start.
_FIRST = 6 * (_P + 1)


def chi_square(x: float, k: int) -> float:
    """Distribution function, by the recursion over degrees of freedom."""
    total, at = (math.erf(math.sqrt(x / 2)), 1) if k % 2 else (1 - math.exp(-x / 2), 2)
    while at < k:
        total -= (x / 2) ** (at / 2) * math.exp(-x / 2) / math.gamma(at / 2 + 1)
        at += 2
    return total


def chi_square_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < q else (low, middle)
    return high


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutter (words equal to the one before).

    Each step is a projection of its own, so that an array used twice is computed once.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("words"))
    done = ["doc_id", "lang", "source", "word_chars", "n_symbols", "n_dup_lines", "n_words"]
    rows = rows.select(*done[:5], (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("words").cast("long").alias("n_words"), "words")
    windows = F.when(F.size("words") < 8, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("words") - 7), lambda i: F.xxhash64(F.slice("words", i, 8))))
    stutter = F.size(F.filter("words", lambda w, i: (i > 0) & (w == F.get("words", i - 1))))
    done.append("n_stutter")
    rows = rows.select(*done[:7], stutter.cast("long").alias("n_stutter"), windows.alias("windows"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select(*done, ordered.alias("ordered"))
    same = lambda e, i: (e["h"] == F.get("ordered", i - 1)["h"]) | (e["h"] == F.get("ordered", i + 1)["h"])
    places = F.array_sort(F.transform(F.filter("ordered", lambda e, i: F.coalesce(same(e, i), _other(e, i), F.lit(False))), lambda e: e["i"]))
    rows = rows.select(*done, places.alias("places"))
    gaps = F.aggregate(F.transform("places", lambda at, i: F.least(F.lit(8), F.coalesce(F.get("places", i + 1) - at, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    return rows.select(*done, F.coalesce(gaps, F.lit(0)).cast("long").alias("n_repeat_words"))


def _other(e: Column, i: Column) -> Column:
    """At an end of the sorted array one neighbour is missing: only the other counts."""
    return F.coalesce(e["h"] == F.get("ordered", i - 1)["h"], e["h"] == F.get("ordered", i + 1)["h"])


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics of documents that have words."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "length": F.log(F.greatest(per_word("word_chars"), F.lit(1.0))), "symbols": F.log1p(100 * per_word("n_symbols")),
        "lines": F.log1p(100 * per_word("n_dup_lines")), "repeats": F.sqrt(per_word("n_repeat_words")), "stutter": F.sqrt(per_word("n_stutter")),
    })


def _grouped(rows: DataFrame, small: int) -> DataFrame:
    """Adds grp: language and source, or the pool that a small group belongs to."""
    fine = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    fine = fine.withColumn("level", F.when(F.col("n") >= small, 2).otherwise(1))
    pools = fine.where("level = 1").groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("pool"))
    fine = fine.join(pools, F.col("lang").eqNullSafe(F.col("l")), "left")
    level = F.when(F.col("level") == 2, 2).when(F.col("pool") >= small, 1).otherwise(0)
    key = F.when(level == 2, F.to_json(F.struct("lang", "source"))).when(level == 1, F.to_json(F.struct("lang"))).otherwise(F.lit("all"))
    named = fine.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.concat(level.cast("string"), key).alias("grp"))
    return rows.join(small_side(stored(named.coalesce(1))), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_l", "_s")


def _step(value: Column) -> Column:
    """A distance's step on the logarithmic grid."""
    return F.floor(256 * F.log2(F.greatest(value, F.lit(1e-9)))).cast("int")


def _nearest(rows: DataFrame, keys: list[str], share: float, least: int, most: int | None = None) -> DataFrame:
    """keys -> cut: the grid step up to which rows of a group must be kept to have the wanted number of the closest."""
    counts = rows.groupBy(*keys, "step").agg(F.count("*").alias("n"))
    along, whole = Window.partitionBy(*keys).orderBy("step"), Window.partitionBy(*keys)
    counts = counts.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(whole))
    wanted = F.least(F.col("all"), F.greatest(F.ceil(share * F.col("all")), F.lit(least)) if most is None else F.lit(most))
    return counts.where(F.col("upto") >= wanted).groupBy(*keys).agg(F.min("step").alias("cut"))


def _estimate(rows: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """Mean m_i, inverse Cholesky factor w_i_j of the covariance times the factor plus floors, and the logarithm of its determinant."""
    sums = [F.sum(f).alias(f"s_{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q_{i}_{j}") for i, j in _PAIRS]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)
    out = out.select(*keys, *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(_P)], "n", *[f"q_{i}_{j}" for i, j in _PAIRS])
    floor = [x * x for x in FLOORS.values()]
    means = [f"m_{i}" for i in range(_P)]
    cov = [(factor * (F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) + (floor[i] if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS]
    out = out.select(*keys, *means, *cov)
    for i, j in _PAIRS:  # Cholesky factor, row by row
        rest = F.col(f"c_{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(floor[i] * 1e-6))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for j in range(_P):  # its inverse, column by column
        for i in range(j, _P):
            rest = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}")
            out = out.withColumn(f"w_{i}_{j}", rest / F.col(f"l_{i}_{i}"))
    log_det = sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(1, _P)), 2 * F.log(F.col("l_0_0")))
    return out.select(*keys, *means, *[f"w_{i}_{j}" for i, j in _PAIRS], log_det.alias("log_det"))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(_P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w_{i}_{j}") * (F.col(FEATURES[j]) - F.col(f"m_{j}"))
        total = total + y * y
    return total


def _starts(rows: DataFrame, starts: int, seed: int) -> DataFrame:
    """First subsets: the documents nearest to the medians, and small random ones. Columns of rows with start."""
    values = rows.select("grp", F.posexplode(F.array(*FEATURES)).alias("f", "x"))
    middle = _median(values, "x", "median")
    middle = small_side(stored(middle.coalesce(1)), 100_000)
    spread = values.join(middle, ["grp", "f"]).select("grp", "f", F.abs(F.col("x") - F.col("median")).alias("x"))
    scale = _median(spread, "x", "mad").join(middle, ["grp", "f"])
    floors = F.array(*[F.lit(x) for x in FLOORS.values()])
    scale = scale.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("f", "median", (1.4826 * F.col("mad") + floors[F.col("f")]).alias("scale")))).alias("by"))
    far = sum((((F.col(f) - F.col("by")[i]["median"]) / F.col("by")[i]["scale"]) ** 2 for i, f in enumerate(FEATURES)), F.lit(0.0))
    first = rows.join(small_side(stored(scale.coalesce(1))), "grp").withColumn("start", F.lit(0)).withColumn("step", _step(far)).drop("by")
    central = first.join(small_side(stored(_nearest(first, ["grp", "start"], SHARE, _FIRST).coalesce(1))), ["grp", "start"])
    for start in range(1, starts):
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed + start), "doc_id", *FEATURES), 34).cast("int")
        some = rows.withColumn("start", F.lit(start)).withColumn("step", draw)
        bins = some.withColumn("step", F.shiftright("step", 14))
        central = central.unionByName(bins.join(small_side(stored(_nearest(bins, ["grp", "start"], SHARE, _FIRST, _FIRST).coalesce(1))), ["grp", "start"]))
    return central.where("step <= cut")


def _median(values: DataFrame, column: str, name: str) -> DataFrame:
    """Lower median per grp and f, on a grid of 1/1024."""
    counts = values.groupBy("grp", "f", F.floor(F.col(column) * 1024).alias("at")).agg(F.count("*").alias("n"))
    key = ["grp", "f"]
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("at"))).withColumn("all", F.sum("n").over(Window.partitionBy(*key)))
    return counts.where(2 * F.col("upto") >= F.col("all")).groupBy(*key).agg((F.min("at") / 1024).alias(name))


def estimates(rows: DataFrame, share: float = SHARE, starts: int = STARTS, seed: int = SEED) -> DataFrame:
    """grp -> the minimum covariance determinant estimate, scaled to be consistent for normal vectors."""
    keys = ["grp", "start"]
    consistent = share / chi_square(chi_square_quantile(share, _P), _P + 2)

    def concentrated(now: DataFrame) -> DataFrame:
        near = rows.join(small_side(now), "grp").select(*keys, *FEATURES, _step(_distance()).alias("step"))
        cut = stored(_nearest(near, keys, share, _FIRST).coalesce(1))
        return stored(_estimate(near.join(small_side(cut), keys).where("step <= cut"), keys, consistent).coalesce(1))

    best = concentrated(stored(_estimate(_starts(rows, starts, seed), keys).coalesce(1))).withColumn("falls", F.lit(True))
    estimate = [c for c in best.columns if c not in (*keys, "falls")]
    while not (going := best.where("falls")).isEmpty():
        new = concentrated(going.drop("falls")).select(*keys, F.struct(*estimate).alias("new"))
        both = best.join(small_side(new), keys, "left").withColumn("fall", F.coalesce(F.col("log_det") - F.col("new.log_det"), F.lit(0.0)))
        best = stored(both.select(*keys, *[F.when(F.col("fall") > 0, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in estimate], (F.col("fall") >= FALL).alias("falls")).coalesce(1))
    smallest = best.groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("pick")).select("grp", "pick.start")
    return best.join(smallest, keys).drop("start", "log_det", "falls")


def judged(docs: DataFrame, share: float = SHARE, cut: float = CUT, small: int = SMALL) -> DataFrame:
    """Statistics of every document, base_failed, distance (squared, of documents that pass the base rules) and kept."""
    stats = statistics(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stored(vectors(stats).withColumn("base_failed", failed))
    rows = stored(_grouped(stats.where("NOT base_failed"), small))
    found = stored(estimates(rows, share).coalesce(1))
    out = rows.join(small_side(found), "grp").withColumn("distance", _distance()).select(*stats.columns, "distance")
    out = out.unionByName(stats.where("base_failed").withColumn("distance", F.lit(None).cast("double")))
    limit = chi_square_quantile(cut, _P)
    return out.withColumn("kept", F.coalesce(F.col("distance") <= limit, F.lit(False)))
