"""Weighted undirected graphs as edge tables (origen_id, destino_id, peso) and measures of their nodes.

The iterative measures keep their state in a table that is checkpointed once per round; no graph is ever held in one place.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lictor.functions.numeric import exact_medians, rounded, scale_between, statistics
from lictor.operators.blocks import Blocks, components
from lictor.operators.moves import MOST_LINKS, settled
from lictor.operators.paths import MOST_ARCS, MOST_NODES, block_measures
from lictor.session import Rounds, cut


def award_edges(tenders: DataFrame, weight: str = "monto_adjudicado") -> DataFrame:
    """Organism to supplier, weighted by the money awarded."""
    return (
        tenders.dropna(subset=["organismo", "proveedor"])
        .groupBy(F.col("organismo").alias("origen_id"), F.col("proveedor").alias("destino_id"))
        .agg(F.sum(weight).cast("double").alias("peso"))
    )


def undirected(edges: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row per pair of nodes, (a, b, peso) with a <= b; the last weight in `order_col` wins, else the largest."""
    weight = F.coalesce(F.col("peso").cast("double"), F.lit(1.0)) if "peso" in edges.columns else F.lit(1.0)
    order = F.col(order_col) if order_col else F.lit(0)
    return (
        edges.dropna(subset=["origen_id", "destino_id"])
        .groupBy(F.least("origen_id", "destino_id").alias("a"), F.greatest("origen_id", "destino_id").alias("b"))
        .agg(F.max_by(weight, F.struct(order.alias("orden"), weight.alias("peso"))).alias("peso"))
    )


def both_ways(graph: DataFrame, weight: Column | str = "peso") -> DataFrame:
    """(u, v, w) in both directions; a loop stays one row."""
    w = F.col(weight) if isinstance(weight, str) else weight
    there = graph.select(F.col("a").alias("u"), F.col("b").alias("v"), w.alias("w"))
    back = graph.filter("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"), w.alias("w"))
    return there.unionByName(back)


def nodes_of(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode(F.array("a", "b")).alias("nodo_id")).distinct()


def degree(edges: DataFrame, order_col: str | None = None) -> DataFrame:
    """Neighbours of each node; a loop counts twice."""
    ends = undirected(edges, order_col).select(F.explode(F.array("a", "b")).alias("nodo_id"))
    return ends.groupBy("nodo_id").agg(F.count("*").alias("degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 1000) -> DataFrame:
    """(nodo_id, pagerank) by weighted power iteration until the total change is below tolerance x nodes.

    Raises if that takes more than `max_rounds` rounds; an unfinished state is never returned.
    """
    arcs = both_ways(undirected(edges))
    totals = arcs.groupBy("u").agg(F.sum("w").alias("total"))
    arcs = cut(arcs.join(totals, "u").select("u", "v", (F.col("w") / F.nullif(F.col("total"), F.lit(0.0))).alias("parte")))
    sinks = arcs.filter("parte IS NULL").select("u").distinct()
    start = cut(arcs.select(F.col("u").alias("nodo_id")).distinct())
    n = start.count()
    if n == 0:
        return start.withColumn("pagerank", F.lit(None).cast("double"))
    ranks, rounds = start.withColumn("pagerank", F.lit(1.0 / n)), Rounds()
    for _ in range(max_rounds):
        received = (
            arcs.join(ranks, F.col("u") == F.col("nodo_id"))
            .groupBy("v").agg(F.sum(F.col("pagerank") * F.col("parte")).alias("recibido"))
            .withColumnRenamed("v", "nodo_id")
        )
        lost = ranks.join(sinks, F.col("nodo_id") == F.col("u"), "left_semi").agg(
            F.coalesce(F.sum("pagerank"), F.lit(0.0))
        ).scalar()
        following = ranks.withColumnRenamed("pagerank", "antes").join(received, "nodo_id", "left").select(
            "nodo_id", "antes",
            (damping * (F.coalesce("recibido", F.lit(0.0)) + lost / n) + (1 - damping) / n).alias("pagerank"),
        )
        following = rounds.cut(following)
        change = following.agg(F.sum(F.abs(F.col("pagerank") - F.col("antes")))).first()[0]
        ranks = following.select("nodo_id", "pagerank")
        if change < n * tolerance:
            return ranks
    raise RuntimeError(f"PageRank did not settle in {max_rounds} rounds")


def _shortest(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, v, d): distance of every node reached from every source, by relaxing only what improved last round."""
    length, rounds = arcs.schema["w"].dataType, Rounds()
    known = sources.select(F.col("nodo").alias("s"), F.col("nodo").alias("v"), F.lit(0).cast(length).alias("d"))
    known = rounds.cut(known.withColumn("nuevo", F.lit(True)))
    while not known.filter("nuevo").isEmpty():
        reached = (
            known.filter("nuevo").select("s", F.col("v").alias("u"), "d").join(arcs, "u")
            .groupBy("s", "v").agg(F.min((F.col("d") + F.col("w")).cast(length)).alias("candidata"))
        )
        better = F.col("d").isNull() | (F.col("candidata") < F.col("d"))
        known = rounds.cut(known.drop("nuevo").join(reached, ["s", "v"], "full_outer").select(
            "s", "v", F.least("d", "candidata").alias("d"), F.coalesce(better, F.lit(False)).alias("nuevo")
        ))
    return known.select("s", "v", "d")


def _spread(steps: DataFrame, first: DataFrame, source: str, target: str) -> DataFrame:
    """Sum over all lengths of the values carried along `steps` from `source` to `target`, starting with `first`.

    `first` and the result are (s, v, valor); a step's value arrives unchanged and meeting values add up. Steps lead
    strictly away from their source, so the last layer is empty after at most as many rounds as there are nodes.
    """
    layer, layers = first, [first]
    while True:
        layer = cut(
            steps.select("s", F.col(source).alias("v"), F.col(target).alias("_hacia")).join(layer, ["s", "v"])
            .groupBy("s", F.col("_hacia").alias("v")).agg(F.sum("valor").alias("valor"))
        )
        if layer.isEmpty():
            return reduce(DataFrame.unionByName, layers).groupBy("s", "v").agg(F.sum("valor").alias("valor"))
        layers.append(layer)


def _exact_lengths(graph: DataFrame, n: int) -> tuple[DataFrame, int, int]:
    """(a, b, w), with the edges' lengths as whole numbers that add up and compare exactly, their unit and tie factor.

    A weight is taken as the decimal it prints as, with up to 18 places, and scaled by the places that occur. An edge of
    weight 0 has no length, so paths could pass it back and forth: it counts as a tie-breaker below any real length,
    w = weight x factor + 1. Of equally long paths those with the fewest such edges are shortest.
    """
    exact = F.col("peso").cast("decimal(38,18)")
    checked = F.when(exact >= 0, exact).otherwise(F.raise_error(F.lit("edge weights must not be negative")).cast("decimal(38,18)"))
    places = F.length(F.regexp_replace(F.substring_index(exact.cast("string"), ".", -1), "0+$", ""))
    largest, digits, zero = graph.agg(F.max(checked), F.max(places), F.coalesce(F.max(F.when(exact == 0, 1)), F.lit(0))).first()
    digits, factor = digits or 0, max(n, 1) if zero else 1
    unit = 10**digits
    fits = int((largest or 0) * unit + 1) * factor * max(n, 1) < 2**62
    kind = "long" if fits else "decimal(38,0)"
    whole = (exact * F.lit(unit).cast("decimal(19,0)")).cast("decimal(38,0)")
    length = whole.cast(kind) * F.lit(factor).cast("long") + F.when(exact == 0, 1).otherwise(0).cast("long")
    return graph.select("a", "b", length.cast(kind).alias("w")), unit, factor


def path_measures(edges: DataFrame, state_rows: int = 50_000_000, packed_from: int = 64) -> DataFrame:
    """(nodo_id, betweenness, closeness) over all shortest paths, with the weight as the length of an edge.

    Lengths are compared exactly, see `_exact_lengths`; negative weights raise. The graph is split at its articulation
    points (`Blocks`), bridges and trees included, and paths are found inside blocks only, with every node of a block
    standing for the nodes behind it: the state is the sum of the squares of the blocks' sizes, not the square of the graph. Blocks
    of at least `packed_from` nodes that a task can hold are measured by slices of sources (`paths`); in all others, smaller or larger,
    sources are worked off in batches of about `state_rows` (source, node) rows. Betweenness is normalised by 1/((n-1)(n-2));
    closeness is scaled by the share of nodes reached.

    * A pair of nodes behind s and t of one block passes v of that block as often as s and t do; pairs in different blocks
      at v all pass it.
    * With A(v) the sum of distances from v to all of a block's nodes, times the nodes behind them, two nodes of a block
      differ in their sums of all distances by the difference of their A.
    """
    graph = cut(undirected(edges))
    # Nodes get short numbers once; the written table keeps them stable.
    nodes = cut(nodes_of(graph).withColumn("nodo", F.monotonically_increasing_id()))
    n = nodes.count()
    lengths, unit, factor = _exact_lengths(graph, n)
    number = lambda end: nodes.select(F.col("nodo_id").alias(end), F.col("nodo").alias(f"{end}_"))
    lengths = lengths.filter("a <> b").join(number("a"), "a").join(number("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"), "w")
    lengths = cut(lengths)
    parts = Blocks(lengths)
    # A node has a number of its own in each of its blocks, so that the blocks fall apart.
    places = cut(parts.members.withColumn("lugar", F.monotonically_increasing_id()))
    place = lambda end: places.select("bloque", F.col("v").alias(end), F.col("lugar").alias(f"{end}_"))
    inner = lengths.join(parts.arcs_of, ["a", "b"]).join(place("a"), ["bloque", "a"]).join(place("b"), ["bloque", "b"])
    inner = cut(inner.select("bloque", F.col("a_").alias("a"), F.col("b_").alias("b"), "w"))
    counted = places.groupBy("bloque").agg(F.count("*").alias("n")).join(inner.groupBy("bloque").agg((2 * F.count("*")).alias("m")), "bloque")
    fits = (F.col("n") >= packed_from) & (F.col("n") <= MOST_NODES) & (F.col("m") <= MOST_ARCS)
    packed = cut(counted.filter(fits if inner.schema["w"].dataType.typeName() == "long" else F.lit(False)).select("bloque"))
    central, sums, heights = [], [], []
    every = places
    if not packed.isEmpty():
        arcs_in = inner.join(packed, "bloque").select("bloque", F.col("a").alias("u"), F.col("b").alias("v"), "w")
        held = places.join(packed, "bloque").select("bloque", "lugar", "detras", (F.col("v") == F.col("cima")).alias("es_cima"))
        for results, found in zip((central, sums, heights), block_measures(cut(arcs_in), held, factor), strict=True):
            results.append(found)
        places, inner = cut(places.join(packed, "bloque", "left_anti")), inner.join(packed, "bloque", "left_anti")
    arcs = cut(both_ways(inner, "w"))
    squares = places.groupBy("bloque").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    batches = math.ceil(squares / state_rows)
    weight = places.select(F.col("lugar").alias("v"), "detras")
    top = places.filter("v = cima").select("bloque", F.col("lugar").alias("s"))
    for batch in range(batches):
        sources = places.select(F.col("lugar").alias("nodo"))
        sources = sources.filter(F.pmod(F.xxhash64("nodo"), F.lit(batches)) == batch) if batches > 1 else sources
        distance = _shortest(arcs, sources)
        from_u = distance.withColumnsRenamed({"v": "u", "d": "du"})
        # An arc longer than the distance of its ends is on no shortest path from anywhere; a full batch knows all ends.
        useful = arcs if batches > 1 else arcs.join(distance.select(F.col("s").alias("u"), "v", F.col("d").alias("w")), ["u", "v", "w"], "left_semi")
        steps = cut(
            from_u.join(useful, "u").join(distance, ["s", "v"]).filter(F.col("du") + F.col("w") == F.col("d")).select("s", "u", "v")
        )
        origin = sources.select(F.col("nodo").alias("s"), F.col("nodo").alias("v"), F.lit(1.0).alias("valor"))
        paths = cut(_spread(steps, origin, "u", "v"))
        # Carrying weight/paths backwards sums, per node, the share of the paths to everything behind it.
        share = paths.join(weight, "v").select("s", "v", (F.col("detras") / F.col("valor")).alias("valor"))
        beyond = _spread(steps, share, "v", "u")
        passing = paths.withColumnRenamed("valor", "caminos").join(beyond, ["s", "v"]).filter("s <> v").join(weight, "v")
        passing = passing.join(weight.select(F.col("v").alias("s"), F.col("detras").alias("desde")), "s")
        # What is left of a node's own weight by rounding alone does not count as passing.
        more = F.col("caminos") * F.col("valor") - F.col("detras")
        more = F.when(more > 1e-9 * F.col("detras"), more).otherwise(0.0)
        central.append(cut(passing.groupBy(F.col("v").alias("lugar")).agg(F.sum(F.col("desde") * more).alias("pasos"))))
        real = (F.floor(F.col("d") / factor) if factor > 1 else F.col("d")).cast("decimal(38,0)")
        sums.append(cut(distance.join(weight, "v").groupBy(F.col("s").alias("lugar")).agg(
            F.sum((real * F.col("detras")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("suma"))))
        heights.append(cut(distance.join(top, "s").select(F.col("v").alias("lugar"), real.alias("altura"))))
    if not central:
        return nodes.select("nodo_id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("closeness"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    places = every
    inside = reduce(DataFrame.unionByName, central).join(places, "lugar").groupBy("v").agg(F.sum("pasos").alias("dentro"))
    others = F.col("total") - F.col("detras")
    across = places.join(parts.nodes.select("v", "total"), "v").groupBy("v").agg(
        (F.first("total") - 1).alias("otros"), F.sum(others.cast("double") * others).alias("cuadrados"))
    across = across.withColumn("entre", F.col("otros").cast("double") * F.col("otros") - F.col("cuadrados"))
    # Sums of distances: a root's from the heights of all nodes, the others by the differences on the way up.
    measured = places.join(reduce(DataFrame.unionByName, sums), "lugar").join(reduce(DataFrame.unionByName, heights), "lugar")
    tops = measured.filter("v = cima").select("bloque", F.col("suma").alias("suma_cima"))
    steps_up = measured.filter("v <> cima").join(tops, "bloque").select("v", (F.col("suma") - F.col("suma_cima")).cast("decimal(38,0)").alias("mas"), "altura")
    ways = cut(parts.along_up(cut(steps_up), "mas", "altura"))
    ways = ways.join(parts.nodes.select("v", "raiz"), "v")
    root = ways.groupBy("raiz").agg(F.sum("altura").cast("decimal(38,0)").alias("suma_raiz"))
    total = ways.join(root, "raiz").select("v", ((F.col("suma_raiz") + F.col("mas")).cast("double") / unit).alias("total"))
    found = across.select("v", "otros", "entre").join(inside, "v", "left").join(total, "v").withColumnRenamed("v", "nodo")
    return nodes.join(found, "nodo", "left").select(
        "nodo_id",
        (F.greatest(F.coalesce("entre", F.lit(0.0)) + F.coalesce("dentro", F.lit(0.0)), F.lit(0.0)) * scale).alias("betweenness"),
        F.when(F.col("total") > 0, F.col("otros") / F.col("total") * F.col("otros") / max(n - 1, 1)).otherwise(0.0)
        .alias("closeness"),
    )


def betweenness(edges: DataFrame, top_n: int | None = 20, state_rows: int = 50_000_000) -> DataFrame:
    """The nodes most shortest paths pass through; all of them with top_n=None."""
    found = path_measures(edges, state_rows).select("nodo_id", "betweenness")
    return found if top_n is None else found.orderBy(F.desc("betweenness"), "nodo_id").limit(top_n)


def brokers(edges: DataFrame, entities: DataFrame, state_rows: int = 50_000_000) -> DataFrame:
    """Entities of kind BROKER with more than the median betweenness of the whole graph."""
    central = cut(betweenness(edges, None, state_rows)).join(
        entities, F.col("nodo_id") == F.col("entidad_id"), "left"
    )
    middle = exact_medians(central, ["betweenness"]).agg(F.max("mediana")).scalar()
    return central.filter((F.col("tipo") == "BROKER") & (F.col("betweenness") > middle))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (nodo_id, comunidad)."""
    arcs = both_ways(undirected(edges), F.when(F.col("a") == F.col("b"), F.col("peso") * 2).otherwise(F.col("peso")))
    return _modularity(arcs, communities)


def _modularity(arcs: DataFrame, communities: DataFrame) -> DataFrame:
    of = lambda end, name: communities.select(F.col("nodo_id").alias(end), F.col("comunidad").alias(name))
    per = arcs.join(of("u", "cu"), "u").join(of("v", "cv"), "v").groupBy("cu").agg(
        F.sum("w").alias("grado"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("dentro")
    )
    whole = F.sum("grado")
    return per.agg(
        (F.sum("dentro") / whole - F.sum(F.col("grado") * F.col("grado")) / (whole * whole)).alias("modularidad")
    )


def _connected_parts(arcs: DataFrame, level: DataFrame) -> DataFrame:
    """The partition (nodo_id, comunidad) with every community split into its connected pieces, named by a node of each."""
    of = lambda end: level.select(F.col("nodo_id").alias(end), F.col("comunidad").alias(f"c{end}"))
    inside = arcs.filter("u < v").join(of("u"), "u").join(of("v"), "v").filter("cu = cv")
    pieces = components(inside.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("v").alias("nodo_id"), "raiz")
    return level.select("nodo_id").join(pieces, "nodo_id", "left").select("nodo_id", F.coalesce("raiz", "nodo_id").alias("comunidad"))


def connected_communities(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(comunidad, piezas): in how many connected pieces each community of (nodo_id, comunidad) lies."""
    arcs = both_ways(undirected(edges))
    pieces = _connected_parts(arcs, communities).withColumnRenamed("comunidad", "pieza")
    return communities.join(pieces, "nodo_id").groupBy("comunidad").agg(F.countDistinct("pieza").alias("piezas"))


def _turn(arcs: DataFrame, level: DataFrame, whole: float, turn: int, min_gain: float) -> tuple[DataFrame, float, int]:
    """The level after a third of its nodes could move, what its state before adds to the modularity, and how many nodes would gain.

    `arcs` (u, v, w, k) has no loops but one of weight 0 per node, which keeps a node's own community among its options;
    k is the weight at u. The sums over the nodes are observed while the new state is written, so a turn reads the arcs once.
    """
    totals = level.groupBy(F.col("comunidad").alias("destino")).agg(F.sum("k").alias("total"))
    options = (
        arcs.join(level.select(F.col("nodo_id").alias("v"), F.col("comunidad").alias("destino")), "v")
        .groupBy("u", "destino").agg(F.sum("w").alias("enlace"), F.max("k").alias("k"), F.max(F.col("u") == F.col("v")).alias("propia"))
        .join(totals, "destino")
    )
    gain = F.col("enlace") - (F.col("total") - F.when(F.col("propia"), F.col("k")).otherwise(0.0)) * F.col("k") / whole
    chosen = options.withColumn("ganancia", gain).groupBy(F.col("u").alias("nodo_id")).agg(
        F.max("k").alias("k"),
        F.min(F.struct((-F.col("ganancia")).alias("menos"), "destino")).alias("mejor"),
        F.max(F.when(F.col("propia"), F.struct("destino", "ganancia", "enlace", "total"))).alias("actual"),
    )
    gains = -F.col("mejor.menos") > F.col("actual.ganancia") + min_gain
    seen = Observation()
    may_move = F.pmod(F.xxhash64("nodo_id", F.lit(turn)), F.lit(3)) == 0
    following = cut(
        chosen.observe(
            seen, F.sum(F.col("actual.enlace") / whole - F.col("k") * F.col("actual.total") / (whole * whole)).alias("valor"),
            F.count_if(gains).alias("quieren"),
        ).select("nodo_id", "k", F.when(may_move & gains, F.col("mejor.destino")).otherwise(F.col("actual.destino")).alias("comunidad"))
    )
    return following, seen.get["valor"], seen.get["quieren"]


def communities(edges: DataFrame, min_gain: float = 1e-6) -> DataFrame:
    """(nodo_id, comunidad) by repeated local moves and contraction, named by the smallest node of each community.

    In each round another third of the nodes, chosen by hash, may move to the neighbouring community with the best gain in
    modularity (ties to the smallest), judged against the last round's state; the best partition seen is kept. A level
    ends after four rounds without a better partition or when no node would gain, the whole after a level that gains nothing: as
    modularity cannot pass 1, both ends are reached. A level whose links a task can hold is worked off in one (`moves`). Before a level is contracted, a community that its moves have left in
    several pieces is split into them, which never lowers modularity; so every community is connected.
    """
    graph = undirected(edges)
    arcs = cut(both_ways(graph, F.when(F.col("a") == F.col("b"), F.col("peso") * 2).otherwise(F.col("peso"))))
    belongs = cut(nodes_of(graph).withColumn("comunidad", F.col("nodo_id")))
    whole = arcs.agg(F.sum("w")).first()[0]
    if not whole:
        return belongs
    while True:
        weights = cut(arcs.groupBy("u").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("lazo")))
        inside = weights.agg(F.sum("lazo")).first()[0] / whole
        level = weights.select(F.col("u").alias("nodo_id"), "k", F.col("u").alias("comunidad"))
        links = arcs.filter("u <> v").unionByName(weights.select("u", F.col("u").alias("v"), F.lit(0.0).alias("w")))
        # Dealt by u once, so that a round whose state is small enough to be sent around needs no shuffle of the links.
        links = links.join(weights.select("u", "k"), "u").select("u", "v", "w", "k").repartition("u").persist()
        small = links.limit(MOST_LINKS + 1).count() <= MOST_LINKS
        best, best_value, start_value, idle = level, None, None, 0
        for turn in itertools.count():
            following, value, gaining = _turn(links, level, whole, turn, min_gain)
            value += inside
            if best_value is None:
                best_value = start_value = value
            else:
                idle = 0 if value > best_value + min_gain else idle + 1
                if value > best_value:
                    best, best_value = level, value
            if idle == 4 or not gaining:
                break
            level = following
            if small:  # the first round has told where the level starts; a task takes the others
                best, best_value = settled(links, level, best, whole, inside, best_value, turn + 1, min_gain)
                break
        links.unpersist()
        if best_value - start_value < min_gain:
            break
        best = cut(_connected_parts(arcs, best))
        merged = best.select(F.col("nodo_id").alias("comunidad"), F.col("comunidad").alias("mayor"))
        belongs = cut(belongs.join(merged, "comunidad").select("nodo_id", F.col("mayor").alias("comunidad")))
        end = lambda name: best.select(F.col("nodo_id").alias(name), F.col("comunidad").alias(f"c{name}"))
        arcs = cut(arcs.join(end("u"), "u").join(end("v"), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(
            F.sum("w").alias("w")
        ))
    names = belongs.groupBy("comunidad").agg(F.min("nodo_id").alias("nombre"))
    return belongs.join(names, "comunidad").select("nodo_id", F.col("nombre").alias("comunidad"))


def isolation(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Density inside each community against the density of the whole graph."""
    graph = undirected(edges)
    members = communities.groupBy("comunidad").agg(F.count("*").alias("n_nodos"))
    of = lambda end, name: communities.select(F.col("nodo_id").alias(end), F.col("comunidad").alias(name))
    inside = (
        graph.join(of("a", "comunidad"), "a").join(of("b", "otra"), "b").filter(F.col("comunidad") == F.col("otra"))
        .groupBy("comunidad").agg(F.count("*").alias("m"))
    )
    density = lambda m, n: F.when(n > 1, 2 * m / F.nullif(n * (n - 1), F.lit(0).cast("long"))).otherwise(0.0)
    m = graph.agg(F.count("*")).scalar()
    n = nodes_of(graph).agg(F.count("*")).scalar()
    return (
        members.join(inside, "comunidad", "left")
        .withColumn("dentro", density(F.coalesce("m", F.lit(0)).cast("double"), F.col("n_nodos")))
        .withColumn("fuera", density(m.cast("double"), n))
        .select(
            "comunidad",
            "n_nodos",
            rounded(F.col("dentro"), 4).alias("densidad_interna"),
            rounded(F.col("fuera"), 4).alias("densidad_global"),
            rounded(F.when(F.col("fuera") > 0, F.col("dentro") / F.nullif(F.col("fuera"), F.lit(0.0))).otherwise(0.0), 3)
            .alias("indice_aislamiento"),
        )
    )


def network_score(metrics: DataFrame) -> DataFrame:
    """Adds network_score 0..100: the mean of degree, betweenness, closeness and PageRank, each scaled over the graph."""
    measures = ["degree", "betweenness", "closeness", "pagerank"]
    spans = statistics(
        metrics, **{f"min_{c}": F.min(c).cast("double") for c in measures}, **{f"max_{c}": F.max(c).cast("double") for c in measures}
    )
    span = lambda name: F.col("_s").getField(name)
    scaled = [scale_between(F.col(c).cast("double"), span(f"min_{c}"), span(f"max_{c}")) for c in measures]
    score = rounded(sum(scaled, F.lit(0.0)) / len(measures) * 100, 2)
    return metrics.withColumn("_s", spans).withColumn("network_score", score).drop("_s")


def entity_measures(edges: DataFrame, state_rows: int = 50_000_000) -> DataFrame:
    """Degree, betweenness, closeness, PageRank and network_score of every node (nodo_id)."""
    edges = cut(edges)
    metrics = cut(path_measures(edges, state_rows)).join(degree(edges), "nodo_id").join(pagerank(edges), "nodo_id")
    return network_score(metrics)


def entity_metrics(edges: DataFrame, state_rows: int = 50_000_000) -> DataFrame:
    """The measures of every entity, its community and its network_score."""
    edges = cut(edges)
    metrics = cut(entity_measures(edges, state_rows)).join(communities(edges), "nodo_id")
    return metrics.withColumnRenamed("nodo_id", "entity").select(
        "entity", "degree", "betweenness", "closeness", "pagerank", "comunidad", "network_score"
    )
