import itertools
import random
from fractions import Fraction

import pytest

from lictor.operators import blocks, entities, graph, paths

EDGE = "origen_id string, destino_id string, peso double"


def shortest_paths(edges):
    """All shortest paths by trying every simple path: fine for a handful of nodes."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    best = {}

    def go(path, length):
        key = (path[0], path[-1])
        if length < best.get(key, (1e18, None))[0]:
            best[key] = (length, [path])
        elif length == best[key][0] and path not in best[key][1]:
            best[key][1].append(path)
        for v, w in near[path[-1]].items():
            if v not in path:
                go(path + [v], length + w)

    for node in near:
        go([node], 0)
    return near, best


def weights(rng, kind):
    return {
        "ties": lambda: float(rng.randint(1, 3)), "tiny": lambda: rng.choice([1e-5, 2e-5, 3e-9]), "zero": lambda: float(rng.randint(0, 2)),
        "huge": lambda: rng.choice([1e15, 2e15, 0.5]), "cents": lambda: rng.randint(1, 9) / 10,
    }[kind]


@pytest.mark.parametrize("kind", ["ties", "tiny", "zero", "huge", "cents"])
def test_paths_against_brute_force(table, rows, kind):
    rng = random.Random(7)
    draw = weights(rng, kind)
    edges = [(a, b, draw()) for a, b in itertools.combinations("ABCDEF", 2) if rng.random() < 0.6]
    # A free step is longer than nothing, shorter than any priced one.
    exact = [(a, b, Fraction(repr(w)) or Fraction(1, 10**30)) for a, b, w in edges]
    near, best = shortest_paths(exact)
    n = len(near)
    between = dict.fromkeys(near, 0.0)
    for (s, t), (_, paths) in best.items():
        for v in near:
            if v not in (s, t):
                between[v] += sum(v in p for p in paths) / len(paths) / ((n - 1) * (n - 2))
    for r in rows(graph.path_measures(table(EDGE, *edges), state_rows=20 if kind == "ties" else 1000), "nodo_id"):
        total = float(sum(d for (s, _), (d, _) in best.items() if s == r["nodo_id"]))
        others = sum(s == r["nodo_id"] != t for s, t in best)
        assert r["betweenness"] == pytest.approx(between[r["nodo_id"]], abs=1e-12)
        assert r["closeness"] == pytest.approx(others / total * others / (n - 1) if total > 1e-20 else 0.0)


def knotted(rng):
    """Cycles and full graphs hung on each other and on trees, in two components."""
    edges, nodes = set(), ["A"]
    for letters in ("BCD", "EFG", "H", "IJ"):
        ring = [rng.choice(nodes), *letters]
        full = rng.random() < 0.5
        edges |= {(a, b) for i, a in enumerate(ring) for j, b in enumerate(ring) if i < j and (full or j == i + 1 or (i, j) == (0, len(ring) - 1))}
        nodes += letters
    return [(a, b, float(rng.randint(0, 2))) for a, b in sorted(edges | {("X", "Y"), ("Y", "Z")})]


@pytest.mark.parametrize("seed", range(3))
def test_blocks_against_brute_force(table, rows, seed):
    edges = knotted(random.Random(seed))
    near, best = shortest_paths([(a, b, Fraction(w) or Fraction(1, 10**30)) for a, b, w in edges])
    n = len(near)
    between = dict.fromkeys(near, 0.0)
    for (s, t), (_, paths) in best.items():
        for v in near:
            if v not in (s, t):
                between[v] += sum(v in p for p in paths) / len(paths) / ((n - 1) * (n - 2))
    for r in rows(graph.path_measures(table(EDGE, *edges, ("Q", "Q", 1.0))), "nodo_id"):
        if r["nodo_id"] == "Q":
            assert (r["betweenness"], r["closeness"]) == (0.0, 0.0)
            continue
        total = sum(float(d // 1) for (s, _), (d, _) in best.items() if s == r["nodo_id"])
        others = sum(s == r["nodo_id"] != t for s, t in best)
        assert r["betweenness"] * n * (n - 1) == pytest.approx(between[r["nodo_id"]] * (n - 1) * (n - 2), abs=1e-9)
        assert r["closeness"] == pytest.approx(others / total * others / n if total else 0.0)


@pytest.mark.parametrize("kind", ["ties", "zero", "cents"])
def test_packed_blocks_measure_as_the_joins_do(table, rows, monkeypatch, kind):
    rng = random.Random(11)
    draw, odd = weights(rng, kind), knotted(rng)
    edges = [(a, b, draw()) for a, b, _ in odd] + [(f"p{a:02}", f"p{b:02}", draw()) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.4]
    joined = rows(graph.path_measures(table(EDGE, *edges), packed_from=1000), "nodo_id")
    # Several tasks a block, slices of a few sources, steps of a few arcs.
    monkeypatch.setattr(paths, "TASK", 200), monkeypatch.setattr(paths, "SLICE", 100), monkeypatch.setattr(paths, "STEP", 16)
    packed = rows(graph.path_measures(table(EDGE, *edges), packed_from=2), "nodo_id")
    for one, two in zip(joined, packed, strict=True):
        assert one["nodo_id"] == two["nodo_id"]
        assert (two["betweenness"], two["closeness"]) == pytest.approx((one["betweenness"], one["closeness"]), abs=1e-12)


def test_sums_of_long_distances_are_whole(spark):
    ends = [(0, 1, 2**60 - 1), (1, 2, 1), (2, 0, 2**60 - 1)]
    arcs = spark.createDataFrame([(7, a, b, w) for x, y, w in ends for a, b in ((x, y), (y, x))], "bloque long, u long, v long, w long")
    places = spark.createDataFrame([(7, v, 10**9, v == 0) for v in range(3)], "bloque long, lugar long, detras long, es_cima boolean")
    _, sums, heights = paths.block_measures(arcs, places, 1)
    assert {r["lugar"]: int(r["suma"]) for r in sums.collect()} == {0: 2 * (2**60 - 1) * 10**9, 1: 2**60 * 10**9, 2: 2**60 * 10**9}
    assert {r["lugar"]: int(r["altura"]) for r in heights.collect()} == {0: 0, 1: 2**60 - 1, 2: 2**60 - 1}


def reached(near, start, without):
    found, todo = {start}, [start]
    while todo:
        for v in near[todo.pop()]:
            if v not in found and v != without:
                found.add(v)
                todo.append(v)
    return found


def test_blocks_end_at_articulation_points(table, rows):
    edges = [(a, b) for a, b, _ in knotted(random.Random(5))]
    number = {v: i for i, v in enumerate(sorted({v for e in edges for v in e}))}
    near = {}
    for a, b in edges:
        near.setdefault(number[a], set()).add(number[b])
        near.setdefault(number[b], set()).add(number[a])
    found = blocks.Blocks(table("a long, b long", *[tuple(sorted((number[a], number[b]))) for a, b in edges]))
    block_of = {(r["a"], r["b"]): r["bloque"] for r in rows(found.arcs_of, "a", "b")}
    for one, two in itertools.combinations(block_of, 2):
        # Two edges are in one block unless a single node parts an end of the one from an end of the other.
        parted = any(
            b not in reached(near, a, cut) for cut in near for a in one if a != cut for b in two if b != cut)
        assert (block_of[one] == block_of[two]) == (not parted), (one, two)
    for r in rows(found.members, "bloque", "v"):
        inside = {v for e, k in block_of.items() if k == r["bloque"] for v in e} - {r["v"]}
        beyond = set().union(*(reached(near, v, r["v"]) for v in inside))
        assert r["detras"] == len(reached(near, r["v"], None)) - len(beyond)


def test_long_chains_are_finished_and_negative_weights_raise(table, rows):
    chain = table(EDGE, *[(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(11)])
    ends = rows(graph.path_measures(chain), "nodo_id")[0]
    assert ends["closeness"] == pytest.approx(11 / 66)
    with pytest.raises(Exception, match="must not be negative"):
        graph.path_measures(table(EDGE, ("A", "B", -1.0))).collect()


def test_an_unsettled_rank_raises(table):
    with pytest.raises(RuntimeError, match="did not settle"):
        graph.pagerank(table(EDGE, ("A", "B", 1.0), ("A", "C", 1.0)), max_rounds=2)


def test_last_weight_wins_and_loops_count_twice(table, rows):
    edges = table(EDGE + ", orden int", ("A", "B", 1.0, 1), ("B", "A", 5.0, 2), ("A", "A", 1.0, 3))
    assert {(r["a"], r["b"]): r["peso"] for r in rows(graph.undirected(edges, "orden"), "a")} == {("A", "B"): 5.0, ("A", "A"): 1.0}
    assert {r["nodo_id"]: r["degree"] for r in rows(graph.degree(edges), "nodo_id")} == {"A": 3, "B": 1}


def test_pagerank_of_a_star(table, rows):
    star = table(EDGE, *[("A", x, 1.0) for x in "BCD"])
    center, leaf = 0.25, 0.25
    for _ in range(300):
        center, leaf = 0.15 / 4 + 0.85 * 3 * leaf, 0.15 / 4 + 0.85 * center / 3
    found = {r["nodo_id"]: r["pagerank"] for r in rows(graph.pagerank(star, tolerance=1e-4), "nodo_id")}
    assert found == pytest.approx({"A": center, "B": leaf, "C": leaf, "D": leaf}, abs=1e-3)


def test_two_cliques_are_two_communities(table, rows):
    cliques = [(a, b, 1.0) for group in ("ABCD", "EFGH") for a, b in itertools.combinations(group, 2)]
    edges = table(EDGE, *cliques, ("D", "E", 1.0))
    found = graph.communities(edges)
    groups = {}
    for r in rows(found, "nodo_id"):
        groups.setdefault(r["comunidad"], set()).add(r["nodo_id"])
    assert groups == {"A": set("ABCD"), "E": set("EFGH")}
    assert graph.modularity(edges, found).first()[0] == pytest.approx(12 / 13 - 0.5)
    isolated = rows(graph.isolation(edges, found), "comunidad")
    assert [(r["n_nodos"], r["densidad_interna"], r["indice_aislamiento"]) for r in isolated] == [(4, 1.0, 2.154)] * 2


def test_a_bridge_is_a_broker(table, rows):
    edges = table(EDGE, ("A", "B", 1.0), ("B", "C", 1.0))
    people = table("entidad_id string, tipo string", ("B", "BROKER"), ("A", "BROKER"), ("C", "EMPRESA"))
    assert [(r["nodo_id"], r["betweenness"]) for r in rows(graph.brokers(edges, people), "nodo_id")] == [("B", 1.0)]


def test_network_score_is_the_mean_of_scaled_measures(table, rows):
    metrics = table("nodo_id string, degree long, betweenness double, closeness double, pagerank double", ("A", 1, 0.0, 1.0, 0.2), ("B", 2, 1.0, 1.0, 0.4))
    assert [r["network_score"] for r in rows(graph.network_score(metrics), "nodo_id")] == [0.0, 75.0]


def indel_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 1 - (len(a) + len(b) - 2 * row[-1]) / (len(a) + len(b))


@pytest.mark.parametrize("threshold", [80, 90])
def test_similar_values_lose_nothing(table, rows, threshold):
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 30))) for _ in range(12)]
    texts = set()
    for text in base:
        for _ in range(6):
            letters = list(text)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
            texts.add("".join(letters))
    entities_in = table("entidad_id string, domicilio string", *[(f"e{i:03}", t) for i, t in enumerate(sorted(texts))])
    keys = {f"e{i:03}": " ".join(sorted(t.lower().split())) for i, t in enumerate(sorted(texts))}
    same = lambda a, b: 1.0 if a == b else indel_ratio(a, b)
    expected = {(x, y) for x, y in itertools.combinations(sorted(keys), 2) if same(keys[x], keys[y]) * 100 >= threshold - 1e-9}
    found = {(r["entidad_id"], r["entidad_relacionada_id"]) for r in rows(entities.similar_entities(entities_in, threshold), "entidad_id")}
    assert found == expected
    pairs = entities.similar_entities(entities_in, threshold)
    groups = lambda p: {r["entidad_id"]: r["grupo_real"] for r in entities.group_entities(p).collect()}
    assert groups(pairs) == groups(entities.entity_links(entities_in, threshold))


def test_values_of_common_words_meet_seldom(table):
    rng = random.Random(4)
    words = ["hot cold red blue small large old new".split(), "ring bolt gear plate widget gizmo nut cog".split(), "ECONOMY SMALL MEDIUM PROMO LARGE STANDARD".split()]
    draw = lambda: " ".join([rng.choice(words[0]), rng.choice(words[1]), f"brand#{rng.randint(1, 25)}", rng.choice(words[2]).lower(), str(rng.randint(1, 50))])
    texts = sorted({" ".join(sorted(draw().split())) for _ in range(800)})
    met = entities._meeting_values(table("metodo string, clave string", *[("d", t) for t in texts]), 10)
    # Common segments of four letters would make most of the 300,000 pairs meet.
    assert met.count() < 6000


def test_letters_beyond_the_basic_plane_and_short_texts_meet(table, rows):
    texts = ["", "a", "\U0001f600bcdefghijkl", "bcdefghijkl", "\U0001f601bcdefghijkl", "\n0123456789", "0123456789"]
    found = entities.similar_values(table("metodo string, clave string", *[("d", t) for t in texts]), 90)
    pairs = {tuple(sorted((x, y))) for x, y in itertools.combinations(texts, 2) if x + y and indel_ratio(x, y) >= 0.9 - 1e-12}
    assert {tuple(sorted((r["a"], r["b"]))) for r in rows(found, "a", "b")} == pairs and pairs


def test_groups_are_transitive(table, rows):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("z", "y"), ("q", "q")]
    random.Random(1).shuffle(chain)
    found = {r["entidad_id"]: r["grupo_real"] for r in rows(entities.group_entities(table("entidad_id string, entidad_relacionada_id string", *chain)), "entidad_id")}
    assert found == {**{f"n{i:02}": "n00" for i in range(21)}, "y": "y", "z": "y", "q": "q"}


def sequential_louvain(edges):
    """Modularity of the plain method: nodes in order, best neighbouring community, contraction, until nothing gains."""
    whole = 2 * sum(w for _, _, w in edges)
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    loops, members = dict.fromkeys(near, 0.0), {v: [v] for v in near}
    while True:
        degree = {v: sum(near[v].values()) + loops[v] for v in near}
        of, total, moved = {v: v for v in near}, dict(degree), False
        while True:
            again = False
            for v in near:
                links = {of[v]: 0.0}
                for u, w in near[v].items():
                    links[of[u]] = links.get(of[u], 0.0) + w
                total[of[v]] -= degree[v]
                best = max(links, key=lambda c: (links[c] - total[c] * degree[v] / whole, c == of[v]))
                total[best] += degree[v]
                again |= best != of[v]
                of[v] = best
            moved |= again
            if not again:
                break
        if not moved:
            return sum(loops[v] / whole - (degree[v] / whole) ** 2 for v in near)
        parts = {}
        for v, c in of.items():
            parts.setdefault(c, []).append(v)
        inside = {c: sum(loops[v] + sum(w for u, w in near[v].items() if of[u] == c) for v in held) for c, held in parts.items()}
        merged = {c: {} for c in parts}
        for v in near:
            for u, w in near[v].items():
                if of[u] != of[v]:
                    merged[of[v]][of[u]] = merged[of[v]].get(of[u], 0.0) + w
        near, loops = merged, inside


@pytest.mark.parametrize("seed", [0])
def test_communities_are_connected_and_as_good_as_one_by_one(table, rows, seed):
    rng = random.Random(seed)
    edges = [(f"n{a:02}", f"n{b:02}", float(rng.randint(1, 3))) for a, b in itertools.combinations(range(36), 2) if rng.random() < (0.6 if a // 9 == b // 9 else 0.04)]
    given = table(EDGE, *edges)
    found = graph.communities(given).cache()
    assert {r["piezas"] for r in rows(graph.connected_communities(given, found), "comunidad")} == {1}
    assert graph.modularity(given, found).first()[0] >= 0.99 * sequential_louvain(edges)


def test_a_round_of_communities_knows_the_modularity_before_it_and_takes_few_jobs(spark, table, monkeypatch):
    rng = random.Random(3)
    edges = table(EDGE, *[(f"n{a:02}", f"n{b:02}", float(rng.randint(1, 3))) for a, b in itertools.combinations_with_replacement(range(24), 2) if rng.random() < 0.3])
    turns, states = [], []
    once = graph._turn

    def watched(arcs, level, whole, turn, min_gain):
        found = once(arcs, level, whole, turn, min_gain)
        turns.append(turn), states.append((level, found[1]))
        return found

    monkeypatch.setattr(graph, "_turn", watched)
    spark.sparkContext.setJobGroup("communities", "rounds")
    graph.communities(edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("communities"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6 * len(turns) + 50 * turns.count(0)
    loops = edges.filter("origen_id = destino_id").agg({"peso": "sum"}).first()[0] * 2
    whole = edges.agg({"peso": "sum"}).first()[0] * 2
    for level, value in states[: turns.index(0, 1) if 0 in turns[1:] else None]:
        assert value + loops / whole == pytest.approx(graph.modularity(edges, level).first()[0])


def test_a_community_in_pieces_is_split(table, rows):
    edges = table(EDGE, ("A", "B", 1.0), ("C", "D", 1.0), ("B", "X", 1.0), ("C", "X", 1.0))
    parts = table("nodo_id string, comunidad string", *[(v, "A") for v in "ABCD"], ("X", "X"))
    assert {r["comunidad"]: r["piezas"] for r in rows(graph.connected_communities(edges, parts), "comunidad")} == {"A": 2, "X": 1}


def test_meeting_values_are_dealt_over_all_tasks(spark, table):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        met = entities._meeting_values(table("metodo string, clave string", *[("d", f"street number {i}") for i in range(100, 140)]), 10)
        assert met.rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
