"""Networks and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lictor.operators import entities, graph
from lictor.session import cut
from registry.adapters import Tables, sql_round, with_tables
from registry.base import query, round_columns

R = sql_round
EDGES = """SELECT organismo AS a, proveedor AS b, CAST(sum(monto_adjudicado) AS DOUBLE) AS w FROM licitaciones
  WHERE proveedor IS NOT NULL GROUP BY 1, 2"""
ARCS = "SELECT least(a, b) AS u, greatest(a, b) AS v, w FROM g UNION ALL SELECT greatest(a, b), least(a, b), w FROM g"


def awards(t: Tables) -> DataFrame:
    return graph.award_edges(t.licitaciones(dates=False))


@query(with_tables("licitaciones", "SELECT a AS origen_id, b AS destino_id, w AS peso FROM g", g=EDGES))
def award_edges(t: Tables) -> DataFrame:
    return awards(t)


@query(with_tables("licitaciones", """
  SELECT least(organismo, proveedor) AS a, greatest(organismo, proveedor) AS b,
         arg_max(CAST(monto_adjudicado AS DOUBLE), licitacion_id) AS peso
  FROM licitaciones WHERE proveedor IS NOT NULL GROUP BY 1, 2"""))
def graph_last_weight(t: Tables) -> DataFrame:
    turned = F.pmod("licitacion_id", F.lit(2)) == 1
    rows = t.licitaciones().select(
        F.when(turned, F.col("proveedor")).otherwise(F.col("organismo")).alias("origen_id"),
        F.when(turned, F.col("organismo")).otherwise(F.col("proveedor")).alias("destino_id"),
        F.col("monto_adjudicado").alias("peso"), "licitacion_id",
    )
    return graph.undirected(rows, "licitacion_id")


@query(with_tables("licitaciones", "SELECT u AS nodo_id, count(*) AS degree FROM k GROUP BY 1", g=EDGES, k=ARCS))
def degree(t: Tables) -> DataFrame:
    return graph.degree(awards(t))


# All rounds up to 90, then the first whose total change is below 1e-6 per node.
RANKS = dict(
    totals="SELECT u, sum(w) AS total, count(*) OVER () AS n FROM k GROUP BY u",
    rounds="""WITH RECURSIVE r(i, n, x) AS (
        SELECT 0, u, 1.0::DOUBLE / n FROM totals UNION ALL
        SELECT i + 1, k.v, 0.85::DOUBLE * sum(x * w / total) + 0.15::DOUBLE / any_value(t.n)
        FROM r JOIN totals t ON t.u = r.n JOIN k ON k.u = r.n WHERE i < 90 GROUP BY i, k.v)
      SELECT * FROM r""",
    settled="""SELECT min(a.i) AS i FROM (
        SELECT x.i, sum(abs(x.x - y.x)) AS change, count(*) AS n FROM rounds x JOIN rounds y ON y.n = x.n AND y.i = x.i - 1 GROUP BY x.i) a
      WHERE change < n * 1e-6::DOUBLE""",
)


@query(with_tables("licitaciones", f"SELECT n AS nodo_id, {R('x', 9)} AS pagerank FROM rounds JOIN settled USING (i)", g=EDGES, k=ARCS, **RANKS))
def pagerank(t: Tables) -> DataFrame:
    return round_columns(graph.pagerank(awards(t)), 9, "pagerank")


# Amounts are whole cents, so lengths add up exactly. Only what got shorter is carried on.
REACH = dict(
    lengths="SELECT u, v, CAST(round(w * 100) AS BIGINT) AS w FROM k",
    reach="""WITH RECURSIVE r(s, v, d) USING KEY (s, v) AS (
        SELECT DISTINCT u, u, 0::BIGINT FROM lengths UNION
        SELECT c.s, c.v, c.d FROM (SELECT r.s, l.v, min(r.d + l.w) AS d FROM r JOIN lengths l ON l.u = r.v GROUP BY ALL) c
        LEFT JOIN recurring.r o ON o.s = c.s AND o.v = c.v WHERE o.d IS NULL OR c.d < o.d)
      SELECT * FROM r""",
)


# Paths of every source counted layer by layer along the steps of shortest paths, then their shares carried back.
BETWEEN = dict(
    useful="SELECT u, l.v, w FROM lengths l JOIN reach r ON r.s = u AND r.v = l.v AND r.d = w",
    steps="SELECT r.s, r.v AS u, l.v AS v FROM reach r JOIN useful l ON l.u = r.v JOIN reach t ON t.s = r.s AND t.v = l.v AND t.d = r.d + l.w",
    counted="""WITH RECURSIVE r(i, s, v, n) AS (
        SELECT 0, s, v, 1::DOUBLE FROM reach WHERE s = v UNION ALL
        SELECT i + 1, r.s, x.v, sum(n) FROM r JOIN steps x ON x.s = r.s AND x.u = r.v GROUP BY i, r.s, x.v)
      SELECT s, v, sum(n) AS n FROM r GROUP BY s, v""",
    behind="""WITH RECURSIVE r(i, s, v, x) AS (
        SELECT 0, s, v, 1 / n FROM counted UNION ALL
        SELECT i + 1, r.s, t.u, sum(x) FROM r JOIN steps t ON t.s = r.s AND t.v = r.v GROUP BY i, r.s, t.u)
      SELECT s, v, sum(x) AS x FROM r GROUP BY s, v""",
    passed="SELECT v, sum(CASE WHEN s <> v AND n * x - 1 > 1e-9 THEN n * x - 1 ELSE 0 END) AS pasos FROM counted JOIN behind USING (s, v) GROUP BY v",
    between="SELECT v AS nodo_id, pasos / ((n - 1) * (n - 2.0::DOUBLE)) AS betweenness FROM passed, (SELECT count(DISTINCT u) AS n FROM lengths)",
)
KEPT = "reach useful steps counted behind between"


@query(with_tables("licitaciones", f"SELECT nodo_id, {R('betweenness', 9)} AS betweenness FROM between", KEPT, g=EDGES, k=ARCS, **REACH, **BETWEEN))
def betweenness(t: Tables) -> DataFrame:
    return round_columns(graph.betweenness(awards(t), top_n=None), 9, "betweenness")


@query(with_tables("licitaciones", f"""
  SELECT s AS nodo_id, {R("(count(*) - 1) * 1e6 / (sum(d) / 100::DOUBLE) * (count(*) - 1) / (any_value(n) - 1)", 6)} AS closeness_ppm
  FROM reach, (SELECT count(DISTINCT u) AS n FROM lengths) GROUP BY s""", g=EDGES, k=ARCS, **REACH))
def closeness(t: Tables) -> DataFrame:
    """Closeness in millionths, as paths are as long as their awards."""
    found = graph.path_measures(awards(t)).select("nodo_id", (F.col("closeness") * 1e6).alias("closeness_ppm"))
    return round_columns(found, 6, "closeness_ppm")


@query(with_tables("licitaciones", f"""
  SELECT nodo_id, {R('betweenness', 9)} AS betweenness, nodo_id AS entidad_id, 'BROKER' AS tipo FROM between
  WHERE nodo_id LIKE 'EMP-%' AND (nodo_id LIKE '%2' OR nodo_id LIKE '%7') AND betweenness > (SELECT median(betweenness) FROM between)""",
    KEPT, g=EDGES, k=ARCS, **REACH, **BETWEEN))
def brokers(t: Tables) -> DataFrame:
    kinds = t.licitaciones().filter("proveedor IS NOT NULL").select(F.col("proveedor").alias("entidad_id")).distinct()
    kind = F.when(F.col("entidad_id").endswith("7") | F.col("entidad_id").endswith("2"), "BROKER").otherwise("EMPRESA")
    return round_columns(graph.brokers(awards(t), kinds.withColumn("tipo", kind)), 9, "betweenness")


@query()
def communities(t: Tables) -> DataFrame:
    return graph.communities(awards(t))


@query(with_tables("licitaciones", "SELECT count(DISTINCT u) AS nodos, count(DISTINCT u) AS filas, true AS nombrada_por_un_nodo, true AS mejor_que_sola, true AS conexas FROM k", g=EDGES, k=ARCS))
def communities_properties(t: Tables) -> DataFrame:
    """Every node in one connected community, named by its smallest member; modularity above that of single nodes."""
    edges = cut(awards(t))
    found = cut(graph.communities(edges))
    alone = graph.modularity(edges, found.withColumn("comunidad", F.col("nodo_id"))).first()[0]
    named = found.groupBy("comunidad").agg((F.min("nodo_id") == F.col("comunidad")).alias("propia"))
    return found.agg(
        F.countDistinct("nodo_id").alias("nodos"), F.count("*").alias("filas"),
        F.lit(named.filter("NOT propia").isEmpty()).alias("nombrada_por_un_nodo"),
        F.lit(graph.modularity(edges, found).first()[0] > alone).alias("mejor_que_sola"),
        F.lit(graph.connected_communities(edges, found).filter("piezas > 1").isEmpty()).alias("conexas"),
    )


# The four measures scaled over the graph, and their mean.
MEASURES = dict(
    RANKS, **REACH, **BETWEEN,
    measures="""SELECT nodo_id, degree, betweenness, closeness, pagerank FROM between JOIN (SELECT u AS nodo_id, count(*) AS degree FROM k GROUP BY 1) USING (nodo_id)
      JOIN (SELECT s AS nodo_id, (count(*) - 1) / (sum(d) / 100::DOUBLE) * (count(*) - 1) / (any_value(n) - 1) AS closeness
            FROM reach, (SELECT count(DISTINCT u) AS n FROM lengths) GROUP BY s) USING (nodo_id)
      JOIN (SELECT n AS nodo_id, x AS pagerank FROM rounds JOIN settled USING (i)) USING (nodo_id)""",
    scores="SELECT nodo_id, " + R("100 / 4::DOUBLE * (" + " + ".join(
        f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE ELSE 0 END"
        for c in ("degree", "betweenness", "closeness", "pagerank")) + ")", 2) + " AS network_score FROM measures",
)
MEASURES_KEPT = f"{KEPT} rounds measures scores"


@query(with_tables("licitaciones", f"""
  SELECT nodo_id, degree, {R('betweenness', 9)} AS betweenness, {R('closeness * 1e6', 6)} AS closeness_ppm, {R('pagerank', 9)} AS pagerank, network_score
  FROM measures JOIN scores USING (nodo_id)""", MEASURES_KEPT, g=EDGES, k=ARCS, **MEASURES))
def network_scores(t: Tables) -> DataFrame:
    """All measures of the network but the communities, and the score that the risk index takes from them."""
    found = graph.entity_measures(awards(t)).withColumn("closeness_ppm", F.col("closeness") * 1e6).drop("closeness")
    return round_columns(round_columns(found, 9, "betweenness", "pagerank"), 6, "closeness_ppm")


@query()
def network_metrics(t: Tables) -> DataFrame:
    return graph.entity_metrics(awards(t))


MEMBERS = """SELECT 'ORG-' || c_custkey AS n, c_nationkey AS c FROM customer WHERE 'ORG-' || c_custkey IN (SELECT u FROM k)
  UNION ALL SELECT 'EMP-' || s_suppkey, s_nationkey FROM supplier WHERE 'EMP-' || s_suppkey IN (SELECT u FROM k)"""


@query(with_tables("licitaciones", f"""
  SELECT comunidad, n_nodos, {R("dentro", 4)} AS densidad_interna, {R("fuera", 4)} AS densidad_global, {R("dentro / fuera", 3)} AS indice_aislamiento
  FROM (SELECT c AS comunidad, count(*) AS n_nodos, CASE WHEN count(*) > 1
                 THEN 2.0::DOUBLE * coalesce(any_value(m), 0) / (count(*) * (count(*) - 1)) ELSE 0 END AS dentro
        FROM p LEFT JOIN (SELECT x.c, count(*) AS m FROM g JOIN p x ON x.n = a JOIN p y ON y.n = b WHERE x.c = y.c GROUP BY 1) USING (c)
        GROUP BY 1),
       (SELECT 2.0::DOUBLE * (SELECT count(*) FROM g) / ((SELECT count(DISTINCT u) FROM k) * ((SELECT count(DISTINCT u) FROM k) - 1)) AS fuera)""",
    g=EDGES, k=ARCS, p=MEMBERS))
def isolation_index(t: Tables) -> DataFrame:
    edges = awards(t)
    present = graph.nodes_of(graph.undirected(edges))
    members = t.raw("customer").select(F.concat(F.lit("ORG-"), "c_custkey").alias("nodo_id"), F.col("c_nationkey").alias("comunidad"))
    members = members.unionByName(
        t.raw("supplier").select(F.concat(F.lit("EMP-"), "s_suppkey").alias("nodo_id"), F.col("s_nationkey").alias("comunidad"))
    )
    return graph.isolation(edges, members.join(present, "nodo_id", "left_semi"))


KEYS = """SELECT entidad_id, 'domicilio' AS metodo, array_to_string(list_sort(string_split_regex(lower(domicilio), '\\s+')), ' ') AS clave
  FROM entidades WHERE domicilio IS NOT NULL
  UNION ALL SELECT entidad_id, 'representante_tecnico', array_to_string(list_sort(string_split_regex(lower(representante_tecnico), '\\s+')), ' ')
  FROM entidades WHERE representante_tecnico IS NOT NULL"""
SAME = """SELECT x.entidad_id, y.entidad_id AS entidad_relacionada_id, metodo, 1.0::DOUBLE AS score_similitud
  FROM c x JOIN c y USING (metodo, clave) WHERE x.entidad_id < y.entidad_id"""


@query(with_tables("entidades", SAME, c=KEYS))
def entity_exact(t: Tables) -> DataFrame:
    return entities.similar_entities(t.entidades(), threshold=100)


@query(with_tables("entidades", """
  SELECT entidad_id, min(otro) AS grupo_real FROM (SELECT entidad_id, entidad_id AS otro FROM s UNION SELECT entidad_relacionada_id, entidad_relacionada_id FROM s
    UNION SELECT n, l FROM z) GROUP BY 1""", c=KEYS, s=SAME,
    z="""WITH RECURSIVE r(n, l) AS (
           SELECT entidad_id, entidad_relacionada_id FROM s UNION SELECT entidad_relacionada_id, entidad_id FROM s
           UNION SELECT r.n, CASE WHEN e.entidad_id = r.l THEN e.entidad_relacionada_id ELSE e.entidad_id END
           FROM r JOIN s e ON e.entidad_id = r.l OR e.entidad_relacionada_id = r.l) SELECT * FROM r"""))
def components(t: Tables) -> DataFrame:
    return entities.group_entities(entities.entity_links(t.entidades(), threshold=100))


def parts(t: Tables) -> DataFrame:
    """Parts as entities; name, brand, type and size make a text that many share but for a few letters."""
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_size")
    return t.raw("part").select(F.concat(F.lit("PART-"), "p_partkey").alias("entidad_id"), text.alias("domicilio"))


# Candidates by edit distance, then the longest common subsequence, one letter of the second text per round.
ALIKE = dict(
    c="""SELECT 'PART-' || p_partkey AS entidad_id,
           array_to_string(list_sort(string_split_regex(lower(concat_ws(' ', p_name, p_brand, p_type, p_size)), '\\s+')), ' ') AS clave FROM part""",
    near="""SELECT x.clave AS a, y.clave AS b FROM (SELECT DISTINCT clave FROM c) x JOIN (SELECT DISTINCT clave FROM c) y ON x.clave < y.clave
      WHERE levenshtein(x.clave, y.clave) <= floor((length(x.clave) + length(y.clave)) / 10)""",
    lcs="""WITH RECURSIVE r(a, b, i, best) AS (
        SELECT a, b, 0, list_transform(range(0, length(a) + 1), lambda j: 0) FROM near UNION ALL
        SELECT a, b, i + 1, list_concat([0], list_transform(range(1, len(best)), lambda j: list_max(best[1:j]))) FROM (
          SELECT a, b, i, list_concat(list_transform(range(1, length(a) + 1), lambda j: greatest(best[j + 1], best[j] + (a[j] = b[i + 1])::INT)), [0]) AS best
          FROM r WHERE i < length(b)))
      SELECT a, b, best[length(a) + 1] AS n, length(a) + length(b) AS total FROM r WHERE i = length(b)""",
    alike="SELECT a, b, round(2 * n / total::DOUBLE, 4) AS score FROM lcs WHERE (total - 2 * n) * 100 <= 10 * total",
    pairs="""SELECT x.entidad_id AS p, y.entidad_id AS q, 1.0::DOUBLE AS score FROM c x JOIN c y USING (clave) WHERE x.entidad_id < y.entidad_id
      UNION ALL SELECT least(x.entidad_id, y.entidad_id), greatest(x.entidad_id, y.entidad_id), score
      FROM alike JOIN c x ON x.clave = a JOIN c y ON y.clave = b""",
)


@query(with_tables("", "SELECT p AS entidad_id, q AS entidad_relacionada_id, 'domicilio' AS metodo, score AS score_similitud FROM pairs", **ALIKE))
def entity_fuzzy(t: Tables) -> DataFrame:
    return entities.similar_entities(parts(t))


@query(with_tables("", "SELECT n AS entidad_id, l AS grupo_real FROM least_of", **ALIKE,
    ends="SELECT p AS n, q AS m FROM pairs UNION SELECT q, p FROM pairs",
    least_of="""WITH RECURSIVE r(n, l) USING KEY (n) AS (
        SELECT DISTINCT n, n FROM ends UNION
        SELECT e.m, min(r.l) FROM r JOIN ends e ON e.n = r.n JOIN recurring.r o ON o.n = e.m WHERE r.l < o.l GROUP BY e.m)
      SELECT * FROM r"""))
def entity_groups(t: Tables) -> DataFrame:
    return entities.group_entities(entities.entity_links(parts(t)))
