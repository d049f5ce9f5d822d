"""Entity resolution: entities that declare the same or nearly the same evidence, and their groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lictor.operators.collusion import pairs_in_groups
from lictor.session import Rounds, cut

# The fields that count as evidence.
EVIDENCE = ["domicilio", "email_pliego", "directorio", "representante_tecnico", "balance_hash"]


def sorted_tokens(value: Column) -> Column:
    """Lower-case words in alphabetical order."""
    words = F.split(F.lower(value), r"(?U)[\s\x1c-\x1f]+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def declared_evidence(entities: DataFrame) -> DataFrame:
    """(entidad_id, metodo, clave): one row per entity and evidence field it fills."""
    fields = [c for c in EVIDENCE if c in entities.columns]
    texts = entities.select("entidad_id", *[F.col(c).cast("string").alias(c) for c in fields])
    if not fields:
        return texts.select("entidad_id", F.lit("").alias("metodo"), F.lit("").alias("clave")).filter("false")
    return (
        texts.unpivot("entidad_id", fields, "metodo", "valor")
        .dropna(subset=["entidad_id", "valor"])
        .select("entidad_id", "metodo", sorted_tokens(F.col("valor")).alias("clave"))
        .distinct()
    )


def _numbered(texts: pd.Series) -> tuple[np.ndarray, list[str]]:
    found: dict[str, int] = {}
    return np.array([found.setdefault(t, len(found)) for t in texts], np.int64), list(found)


def subsequence_lengths(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Lengths of the longest common subsequences, all of one text's positions at a time as bits, all pairs at a time.

    Each distinct left text has a row of bit masks, one per letter. Beyond 64 letters the bits are those of a Python integer.
    """
    of_left, lefts = _numbered(left)
    of_right, rights = _numbered(right)
    sizes = lambda texts: np.array([len(t) for t in texts], np.int64)
    letters_of = lambda texts, most: np.array([t[:most] for t in texts], f"U{most}").view(np.uint32).reshape(len(texts), most)
    n, m = sizes(lefts), sizes(rights)
    first, second = letters_of(lefts, 64), letters_of(rights, max(1, int(m.max(initial=1))))
    alphabet = np.unique(first)
    rows = np.arange(len(lefts))
    masks = np.zeros((len(lefts), len(alphabet) + 1), np.uint64)
    for i in range(min(64, int(n.max(initial=0)))):
        held = rows[i < n]
        masks[held, np.searchsorted(alphabet, first[held, i])] |= np.uint64(1 << i)
    code = np.minimum(np.searchsorted(alphabet, second), len(alphabet) - 1) if len(alphabet) else np.zeros(second.shape, np.int64)
    known = (alphabet[code] == second) if len(alphabet) else np.zeros(second.shape, bool)
    code = np.where(known & (np.arange(second.shape[1]) < m[:, None]), code, len(alphabet))
    every = np.array([(1 << min(size, 64)) - 1 for size in n.tolist()], np.uint64)[of_left]
    row = every.copy()
    for j in range(second.shape[1]):
        hit = row & masks[of_left, code[of_right, j]]
        row = (row + hit) | (row - hit)
    found = n[of_left] - np.bitwise_count(row & every)

    def long(a: str, b: str) -> int:
        places: dict[str, int] = {}
        for i, letter in enumerate(a):
            places[letter] = places.get(letter, 0) | 1 << i
        row = every = (1 << len(a)) - 1
        for letter in b:
            hit = row & places.get(letter, 0)
            row = (row + hit) | (row - hit)
        return len(a) - (row & every).bit_count()

    for at in np.flatnonzero(n[of_left] > 64):
        found[at] = long(left.iloc[at], right.iloc[at])
    return found


@F.pandas_udf(T.IntegerType())
def common_subsequence(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(subsequence_lengths(left, right))


def _meeting_values(values: DataFrame, slack: int) -> DataFrame:
    """(metodo, corta, larga, limite): distinct values of a field that may be within limite = slack % of their lengths in edits.

    An edit puts in or takes out one letter. Letters are dealt to g groups by code point, and an edit changes only what its
    own group spells; with d edits and g = d / 2 + 1 groups some group sees at most one. So texts meet where the letters
    of a group spell the same, or one's with a letter left out spell the other's: no position and no shift to try.
    """
    edits = lambda total: F.floor(total * slack / 100).cast("int")
    groups = lambda n, m: F.floor(edits(n + m) / 2).cast("int") + 1
    n, m = F.col("n"), F.col("m")
    nearest, farthest = F.ceil(n * (100 - slack) / (100 + slack)), F.floor(n * (100 + slack) / (100 - slack))
    letter = lambda c: F.pmod(F.ascii(c), F.col("g")) == F.col("i")
    spelled = (
        values.select("metodo", "clave", F.length("clave").alias("n"), F.regexp_extract_all("clave", F.lit("(?s)."), F.lit(0)).alias("letras"))
        .withColumn("g", F.explode(F.sequence(groups(n, nearest), groups(n, farthest))))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("metodo", "clave", "n", "g", "i", F.array_join(F.filter("letras", letter), "").alias("escrito"))
    )
    index = spelled.withColumnsRenamed({"clave": "una", "escrito": "trozo"})
    size = F.length("escrito")
    without = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda p: F.concat(
        F.substring("escrito", F.lit(1), p - 1), F.substring("escrito", p + 1, size)))
    probe = spelled.withColumn("trozo", F.explode(F.array_distinct(F.concat(F.array("escrito"), without)))).select(
        "metodo", F.col("clave").alias("otra"), n.alias("m"), "g", "i", "trozo", (F.length("trozo") == size).alias("entera"))
    # What is spelled is small and meets often: both sides are dealt over a fixed number of tasks, as in `pairs_in_groups`.
    tasks, keys = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["metodo", "g", "i", "trozo"]
    met = index.repartition(tasks, *keys).join(probe.repartition(tasks, *keys), keys).withColumn("limite", edits(n + m)).filter(
        (F.col("g") == groups(n, m)) & (F.abs(n - m) <= F.col("limite"))
        & F.when(F.col("entera"), F.col("una") < F.col("otra")).otherwise(F.col("una") != F.col("otra"))
    )
    return met.select("metodo", F.least("una", "otra").alias("corta"), F.greatest("una", "otra").alias("larga"), "limite")


def similar_values(values: DataFrame, threshold: int = 90) -> DataFrame:
    """(metodo, a, b, score) for distinct values of a field with 100 (1 - indel / total length) >= threshold.

    No candidate is lost, see `_meeting_values`.
    """
    slack = 100 - threshold
    if slack <= 0:  # distinct values are never equal
        return values.select("metodo", F.col("clave").alias("a"), F.col("clave").alias("b"), F.lit(1.0).alias("score")).filter(F.lit(False))
    candidates = _meeting_values(values, slack)
    total = F.length("corta") + F.length("larga")
    # All candidates are measured where they meet: a batch of pairs at a time costs less than an edit distance per pair.
    scored = candidates.select("metodo", "corta", "larga", common_subsequence("corta", "larga").alias("comun"))
    scored = scored.filter((total - 2 * F.col("comun")) * 100 <= slack * total).distinct()
    return scored.select(
        "metodo", F.col("corta").alias("a"), F.col("larga").alias("b"), F.round(2 * F.col("comun") / total, 4).alias("score"),
    )


def similar_entities(entities: DataFrame, threshold: int = 90) -> DataFrame:
    """Pairs of entities whose sorted words in one evidence field score at least `threshold` of 100.

    Texts are compared once per distinct value; entities are paired only at the end, since each pair is a result row.
    """
    declared = declared_evidence(entities)
    same = pairs_in_groups(declared, ["metodo", "clave"], "entidad_id").select("metodo", "a", "b", F.lit(1.0).alias("score"))
    alike = similar_values(declared.select("metodo", "clave").distinct(), threshold).withColumnsRenamed({"a": "_a", "b": "_b"})
    holders = lambda key, name: declared.select("metodo", F.col("clave").alias(key), F.col("entidad_id").alias(name))
    near = alike.join(holders("_a", "x"), ["metodo", "_a"]).join(holders("_b", "y"), ["metodo", "_b"]).filter("x <> y").select(
        "metodo", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score"
    )
    return (
        same.unionByName(near).groupBy("a", "b", "metodo").agg(F.max("score").alias("score_similitud"))
        .select(F.col("a").alias("entidad_id"), F.col("b").alias("entidad_relacionada_id"), "metodo", "score_similitud")
    )


def entity_links(entities: DataFrame, threshold: int = 90) -> DataFrame:
    """Pairs that connect the same groups as `similar_entities`, one per entity and value and one per pair of alike values."""
    declared = declared_evidence(entities)
    heads = declared.groupBy("metodo", "clave").agg(F.min("entidad_id").alias("cabeza"))
    members = declared.join(heads, ["metodo", "clave"]).filter("entidad_id <> cabeza").select(
        "entidad_id", F.col("cabeza").alias("entidad_relacionada_id")
    )
    head = lambda key, name: heads.select("metodo", F.col("clave").alias(key), F.col("cabeza").alias(name))
    across = (
        similar_values(declared.select("metodo", "clave").distinct(), threshold)
        .join(head("a", "entidad_id"), ["metodo", "a"]).join(head("b", "entidad_relacionada_id"), ["metodo", "b"])
        .filter("entidad_id <> entidad_relacionada_id").select("entidad_id", "entidad_relacionada_id")
    )
    return members.unionByName(across).distinct()


def group_entities(pairs: DataFrame) -> DataFrame:
    """(entidad_id, grupo_real): the transitive closure of the pairs, each group named by its smallest entity.

    Alternating large-star and small-star steps: every round links nodes straight to smaller ones, so the number of
    rounds grows with the logarithm of the longest chain.
    """
    # Written once, as both the links and the nodes alone are read from them.
    edges = cut(pairs.dropna(subset=["entidad_id", "entidad_relacionada_id"]).select(
        F.greatest("entidad_id", "entidad_relacionada_id").alias("u"), F.least("entidad_id", "entidad_relacionada_id").alias("v")
    ))
    alone = edges.filter("u = v").select("u", "v")
    rounds = Rounds()
    links, state = rounds.cut(edges.filter("u <> v").distinct()), None
    while True:  # until the links stay the same
        there = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = there.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = there.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        links = rounds.cut(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.withColumnRenamed("m", "v")).distinct()
        )
        before, state = state, links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == state:
            break
    roots = links.select(F.col("v").alias("u")).distinct().withColumn("v", F.col("u"))
    return links.unionByName(roots).unionByName(alone).groupBy(F.col("u").alias("entidad_id")).agg(F.min("v").alias("grupo_real"))
