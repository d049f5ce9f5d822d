"""Bids, finance, conduct, courts, rules and risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lictor.functions.numeric import rounded, scale_between, statistics
from lictor.operators import collusion, conduct, finance, graph, judicial, patterns, risk
from lictor.plans.report import Report
from lictor.session import cut
from registry.adapters import Tables, sql_round, with_tables
from registry.base import as_text, query, round_columns
from registry.graphs import ARCS, EDGES, MEASURES, MEASURES_KEPT

R = sql_round

SHARED = """
  SELECT x.empresa_id AS a, y.empresa_id AS b, count(*) AS n, sum(x.w) AS wa, sum(y.w) AS wb
  FROM (SELECT licitacion_id, empresa_id, count(*) FILTER (WHERE resultado = 'GANADORA') AS w FROM ofertas GROUP BY ALL) x
  JOIN (SELECT licitacion_id, empresa_id, count(*) FILTER (WHERE resultado = 'GANADORA') AS w FROM ofertas GROUP BY ALL) y
    ON x.licitacion_id = y.licitacion_id AND x.empresa_id < y.empresa_id
  GROUP BY 1, 2"""


@query(with_tables("ofertas", "SELECT a AS empresa_a, b AS empresa_b, n AS co_presentismo FROM p", p=SHARED))
def co_presence(t: Tables) -> DataFrame:
    return collusion.co_presence(t.stored("ofertas"))


def _asymmetry_sql(threshold: int) -> str:
    return with_tables("ofertas", f"""
      SELECT a AS empresa_a, b AS empresa_b, n AS compartidas, CAST(wa AS BIGINT) AS victorias_a, CAST(wb AS BIGINT) AS victorias_b,
             {R("CASE WHEN wa + wb > 0 THEN 1 - abs(wa - wb)::DOUBLE / (wa + wb) ELSE 0 END", 3)} AS indice_alternancia
      FROM p WHERE n >= {threshold}""", p=SHARED)


@query(_asymmetry_sql(3))
def win_asymmetry(t: Tables) -> DataFrame:
    return collusion.win_asymmetry(t.stored("ofertas"))


@query(_asymmetry_sql(30))
def win_asymmetry_frequent(t: Tables) -> DataFrame:
    return collusion.win_asymmetry(t.stored("ofertas"), umbral_co_presentismo=30)


SHARE = """
  SELECT o.*, (CAST(o.monto_ofertado AS DOUBLE) - CAST(g.monto AS DOUBLE)) / nullif(CAST(g.monto AS DOUBLE), 0) AS pct
  FROM ofertas o LEFT JOIN (SELECT licitacion_id, max(monto_ofertado) AS monto FROM ofertas WHERE resultado = 'GANADORA'
                            GROUP BY 1) g USING (licitacion_id)"""


@query(with_tables("ofertas", f"""
  SELECT licitacion_id, empresa_id, {R("pct", 6)} AS porcentaje_sobre_ganadora FROM s""", s=SHARE))
def overbid_share(t: Tables) -> DataFrame:
    shares = collusion.overbid_share(t.ofertas())
    return round_columns(shares, 6, "porcentaje_sobre_ganadora").select(
        "licitacion_id", "empresa_id", "porcentaje_sobre_ganadora"
    )


@query(with_tables("ofertas", f"""
  SELECT empresa_id, {R("stddev_samp(pct)", 6)} AS desvio_estandar_pct, count(pct) AS n_ofertas, {R("avg(pct)", 6)} AS media_pct,
         coalesce(stddev_samp(pct) < 0.02 AND count(pct) >= 3, false) AS sospechoso
  FROM s WHERE resultado = 'PERDEDORA' GROUP BY 1""", s=SHARE))
def bid_variability(t: Tables) -> DataFrame:
    return round_columns(
        collusion.budget_variability(collusion.overbid_share(t.ofertas())), 6, "desvio_estandar_pct", "media_pct"
    )


@query(with_tables("pagos", f"""
  SELECT empresa_id, organismo_id, {R("e", 6)} AS dias_promedio_empresa, {R("o", 6)} AS dias_promedio_organismo,
         n_pagos, {R("o - e", 6)} AS dias_ahorrados, o - e > 0 AS priorizacion_detectada
  FROM (SELECT empresa_id, organismo_id, avg(dias_habiles_pago) AS e, count(*) AS n_pagos FROM pagos GROUP BY 1, 2)
  JOIN (SELECT organismo_id, avg(dias_habiles_pago) AS o FROM pagos GROUP BY 1) USING (organismo_id)"""))
def payment_bias(t: Tables) -> DataFrame:
    return round_columns(
        finance.payment_bias(t.pagos()), 6, "dias_promedio_empresa", "dias_promedio_organismo", "dias_ahorrados"
    )


SPEND = "SELECT organismo, proveedor, sum(monto_adjudicado) AS gasto FROM licitaciones GROUP BY 1, 2"
HHI = f"""
  SELECT organismo, {R("hhi", 2)} AS hhi, n_proveedores, proveedor_dominante, {R("cuota", 2)} AS cuota_dominante_pct,
         hhi > 2500 AS alta_concentracion
  FROM (SELECT organismo, sum(CASE WHEN proveedor IS NOT NULL THEN power(CAST(gasto AS DOUBLE) / total * 100, 2) END) AS hhi,
               count(proveedor) AS n_proveedores,
               arg_min(proveedor, {{'g': -gasto, 'p': proveedor}}) FILTER (WHERE proveedor IS NOT NULL) AS proveedor_dominante,
               max(CASE WHEN proveedor IS NOT NULL THEN CAST(gasto AS DOUBLE) / total * 100 END) AS cuota
        FROM gastos JOIN (SELECT organismo, CAST(sum(gasto) AS DOUBLE) AS total FROM gastos GROUP BY 1) USING (organismo)
        WHERE total > 0 GROUP BY 1) WHERE proveedor_dominante IS NOT NULL"""


@query(with_tables("licitaciones", "SELECT * FROM h", gastos=SPEND, h=HHI))
def hhi(t: Tables) -> DataFrame:
    return finance.hhi(t.licitaciones(dates=False))


def _top_sql(n: int, keys: str, where: str = "true") -> str:
    return with_tables("licitaciones", f"""
      SELECT {keys}, count(*) AS proveedores_top,
             {R("CAST(sum(gasto) AS DOUBLE) / any_value(total) * 100", 2)} AS concentracion_top{n}_pct
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY gasto DESC NULLS LAST, proveedor) AS puesto
            FROM g WHERE proveedor IS NOT NULL)
      JOIN (SELECT {keys}, CAST(sum(gasto) AS DOUBLE) AS total FROM g GROUP BY ALL HAVING sum(gasto) > 0) USING ({keys})
      WHERE puesto <= {n} GROUP BY {keys}""",
        g=f"""SELECT {keys}, proveedor, sum(monto_adjudicado) AS gasto
              FROM (SELECT *, CAST(year(fecha_adjudicacion) AS INTEGER) AS anio FROM licitaciones) WHERE {where} GROUP BY ALL""")


@query(_top_sql(3, "organismo"))
def top3(t: Tables) -> DataFrame:
    return finance.top_n_share(t.licitaciones(dates=False), 3)


@query(_top_sql(5, "organismo"))
def top5(t: Tables) -> DataFrame:
    return finance.top_n_share(t.licitaciones(dates=False), 5)


@query(_top_sql(3, "rubro"))
def top3_by_category(t: Tables) -> DataFrame:
    return finance.top_n_share(t.licitaciones(dates=False), 3, ("rubro",))


@query(_top_sql(3, "jurisdiccion, anio", "fecha_adjudicacion IS NOT NULL"))
def concentration_by_year(t: Tables) -> DataFrame:
    return finance.concentration_by_year(t.licitaciones(), 3, ("jurisdiccion",))


OVERRUN = """
  SELECT licitacion_id, organismo, monto_adjudicado, monto_adjudicado + coalesce(ajuste, 0) AS final,
         CASE WHEN monto_adjudicado > 0 THEN CAST(coalesce(ajuste, 0) AS DOUBLE) / CAST(monto_adjudicado AS DOUBLE) END AS r
  FROM licitaciones LEFT JOIN (SELECT licitacion_id, sum(monto_nuevo - monto_original) AS ajuste FROM adendas GROUP BY 1)
    USING (licitacion_id)"""


@query(with_tables("licitaciones adendas", f"""
  SELECT licitacion_id, organismo, CAST(monto_adjudicado AS DOUBLE) AS monto_adjudicado, CAST(final AS DOUBLE) AS monto_final_estimado,
         {R("r", 6)} AS low_balling_ratio FROM d""", d=OVERRUN))
def low_balling(t: Tables) -> DataFrame:
    found = finance.low_balling(t.licitaciones(dates=False), t.adendas())
    found = found.withColumns({c: F.col(c).cast("double") for c in ("monto_adjudicado", "monto_final_estimado")})
    return round_columns(found, 6, "low_balling_ratio")


@query(with_tables("licitaciones aportes", f"""
  SELECT empresa, CAST(aportado AS DOUBLE) AS monto_aportado, count(licitacion_id) AS n_contratos_posteriores,
         CAST(coalesce(sum(monto_adjudicado), 0) AS DOUBLE) AS monto_adjudicado_posterior,
         {R("CASE WHEN aportado > 0 THEN CAST(coalesce(sum(monto_adjudicado), 0) AS DOUBLE) / CAST(aportado AS DOUBLE) END", 2)}
           AS roi_politico
  FROM (SELECT aportante AS empresa, sum(monto) AS aportado, max(fecha) AS ultimo FROM aportes GROUP BY 1)
  LEFT JOIN licitaciones ON proveedor = empresa AND fecha_adjudicacion > ultimo AND fecha_adjudicacion <= ultimo + 730
  GROUP BY empresa, aportado"""))
def campaign_roi(t: Tables) -> DataFrame:
    found = finance.campaign_roi(t.aportes(), t.licitaciones())
    return found.withColumns({c: F.col(c).cast("double") for c in ("monto_aportado", "monto_adjudicado_posterior")})


@query(with_tables("pagos", """
  SELECT l_orderkey, l_linenumber, empresa_id, CAST(fecha_factura AS VARCHAR) AS fecha_factura, CAST(fecha_pago AS VARCHAR) AS fecha_pago,
         (SELECT count(*) FROM range(1, CAST(fecha_pago - fecha_factura + 1 AS BIGINT)) d(i)
          WHERE isodow(fecha_factura + CAST(i AS INTEGER)) <= 5) AS dias_habiles_pago
  FROM pagos"""))
def business_days(t: Tables) -> DataFrame:
    days = finance.with_payment_days(t.pagos().drop("dias_habiles_pago"))
    return as_text(days, "fecha_factura", "fecha_pago").select(
        "l_orderkey", "l_linenumber", "empresa_id", "fecha_factura", "fecha_pago",
        F.col("dias_habiles_pago").cast("long").alias("dias_habiles_pago"),
    )


@query(with_tables("tramites normas", f"""
  SELECT organismo, dependencia, tipo_tramite, {R("promedio", 6)} AS tiempo_promedio, {R("desvio", 6)} AS desvio, n AS n_tramites,
         tiempo_normativo, {R("promedio - tiempo_normativo", 6)} AS exceso_dias, {R("en", 6)} AS exceso_norm,
         {R("dn", 6)} AS desvio_norm, {R("0.7::DOUBLE * en + 0.3::DOUBLE * dn", 2)} AS sludge_score
  FROM (SELECT *, CASE WHEN emax > emin THEN (e - emin) / (emax - emin) * 100 ELSE 0 END AS en,
               CASE WHEN dmax > dmin THEN (d - dmin) / (dmax - dmin) * 100 ELSE 0 END AS dn
        FROM (SELECT *, min(e) OVER () AS emin, max(e) OVER () AS emax, min(d) OVER () AS dmin, max(d) OVER () AS dmax
              FROM (SELECT *, greatest(coalesce(promedio - tiempo_normativo, 0), 0) AS e, coalesce(desvio, 0) AS d FROM m)))""",
    m="""SELECT organismo, dependencia, tipo_tramite, avg(dias_transcurridos) AS promedio, stddev_samp(dias_transcurridos) AS desvio,
                count(*) AS n, any_value(tiempo_normativo) AS tiempo_normativo
         FROM tramites LEFT JOIN normas USING (tipo_tramite) GROUP BY 1, 2, 3"""))
def sludge(t: Tables) -> DataFrame:
    return round_columns(
        conduct.sludge(t.tramites(), t.normas()), 6, "tiempo_promedio", "desvio", "exceso_dias", "exceso_norm", "desvio_norm"
    )


@query(with_tables("auditorias", """
  SELECT empresa_id, CAST(date_trunc('second', max(fecha)) AS VARCHAR) AS ultima_auditoria, tiene_programa, score_efectividad,
         count(fecha) AS n_auditorias,
         coalesce(tiene_programa AND coalesce(score_efectividad, 0) < 40, false) AS compliance_de_papel
  FROM auditorias
  JOIN (SELECT empresa_id, tiene_programa_integridad AS tiene_programa FROM auditorias WHERE tiene_programa_integridad IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY empresa_id ORDER BY fecha DESC, tiene_programa_integridad DESC) = 1) USING (empresa_id)
  JOIN (SELECT empresa_id, score_efectividad FROM auditorias WHERE score_efectividad IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY empresa_id ORDER BY fecha DESC, score_efectividad DESC) = 1) s USING (empresa_id)
  GROUP BY empresa_id, tiene_programa, s.score_efectividad""".replace("tiene_programa, score_efectividad,", "tiene_programa, s.score_efectividad AS score_efectividad,", 1).replace("coalesce(score_efectividad, 0)", "coalesce(s.score_efectividad, 0)")))
def compliance_audit(t: Tables) -> DataFrame:
    found = conduct.compliance_audit(t.auditorias())
    return found.withColumn("ultima_auditoria", F.date_format("ultima_auditoria", "yyyy-MM-dd HH:mm:ss"))


@query(with_tables("encuestas", f"""
  SELECT dependencia, {R("CAST(sum(percepcion_agilizacion_informal * n_respuestas) AS DOUBLE) / nullif(sum(n_respuestas), 0)", 6)}
    AS percepcion_ponderada
  FROM encuestas GROUP BY 1"""))
def perception(t: Tables) -> DataFrame:
    return round_columns(conduct.informal_expectations(t.encuestas()), 6, "percepcion_ponderada")


@query(with_tables("causas", f"""
  SELECT fuero, jurisdiccion, count(*) AS total_causas, count(*) FILTER (WHERE estado = 'PRESCRIPTA') AS prescriptas,
         {R("count(*) FILTER (WHERE estado = 'PRESCRIPTA')::DOUBLE / count(*) * 100", 2)} AS tasa_prescripcion_pct
  FROM causas GROUP BY 1, 2"""))
def prescription_rate(t: Tables) -> DataFrame:
    return judicial.prescription_rate(t.causas())


SEVERITY = """
  SELECT causa_id, CASE
    WHEN regexp_matches(lower(texto_fallo), 'prisión efectiva|pena de prisión|inhabilitaci[oó]n perpetua|decomiso|reclusi[oó]n')
      THEN 'ALTA'
    WHEN regexp_matches(lower(texto_fallo), 'probation|suspensi[oó]n del juicio a prueba|multa|absoluci[oó]n|sobreseimiento')
      THEN 'BAJA'
    ELSE 'INDETERMINADA' END AS severidad_texto
  FROM causas"""


@query(with_tables("causas", "SELECT * FROM s", s=SEVERITY))
def ruling_severity(t: Tables) -> DataFrame:
    return judicial.ruling_severity(t.causas()).select("causa_id", "severidad_texto")


@query(with_tables("causas imputados", f"""
  SELECT rango_jerarquico, count(entidad_id) AS n_imputados, {R("avg(condena_meses)", 6)} AS condena_meses_promedio,
         {R("avg(CASE WHEN severidad_texto = 'ALTA' THEN 1.0 ELSE 0.0 END) * 100", 6)} AS pct_severidad_alta
  FROM imputados LEFT JOIN s USING (causa_id) GROUP BY 1""", s=SEVERITY))
def sanction_bias(t: Tables) -> DataFrame:
    found = judicial.sanction_bias(t.causas(), t.imputados())
    return round_columns(found, 6, "condena_meses_promedio", "pct_severidad_alta")


CROSSING = """
  SELECT v.legislador_id, empresa_id, tipo_vinculo, votacion_id, l.licitacion_id, l.monto_adjudicado
  FROM votos v JOIN empresas_relacionadas e ON e.legislador_id = v.legislador_id JOIN licitaciones l ON l.proveedor = e.empresa_id
  WHERE v.voto = 'AFIRMATIVO' AND l.fecha_adjudicacion >= v.fecha"""


@query(with_tables("votos empresas_relacionadas licitaciones", """
  SELECT legislador_id, empresa_id, tipo_vinculo, count(DISTINCT votacion_id) AS n_votos_favorables,
         CAST(sum(monto_adjudicado) AS DOUBLE) AS monto_adjudicado_posterior
  FROM c GROUP BY 1, 2, 3""", c=CROSSING))
def vote_contract(t: Tables) -> DataFrame:
    found = judicial.vote_contract(t.votos(), t.licitaciones(), t.empresas_relacionadas())
    return found.withColumn("monto_adjudicado_posterior", F.col("monto_adjudicado_posterior").cast("double"))


@query(with_tables("votos empresas_relacionadas licitaciones", """
  SELECT legislador_id, empresa_id, tipo_vinculo, any_value(n) AS n_votos_favorables,
         CAST(sum(monto_adjudicado) AS DOUBLE) AS monto_adjudicado_posterior
  FROM (SELECT DISTINCT legislador_id, empresa_id, tipo_vinculo, licitacion_id, monto_adjudicado FROM c)
  JOIN (SELECT legislador_id, empresa_id, tipo_vinculo, count(DISTINCT votacion_id) AS n FROM c GROUP BY 1, 2, 3)
    USING (legislador_id, empresa_id, tipo_vinculo)
  GROUP BY 1, 2, 3""", c=CROSSING))
def vote_contract_dedupe(t: Tables) -> DataFrame:
    found = judicial.vote_contract(t.votos(), t.licitaciones(), t.empresas_relacionadas(), dedupe=True)
    return found.withColumn("monto_adjudicado_posterior", F.col("monto_adjudicado_posterior").cast("double"))


RULE_POINTS = f"""
  SELECT l_orderkey, l_linenumber,
         CASE WHEN alta_concentracion THEN 30.0::DOUBLE END AS p1,
         CASE WHEN coalesce(low_balling_ratio, 0) > 0.15::DOUBLE
              THEN {R("25 * least(low_balling_ratio / 0.5::DOUBLE, 1)", 2)} END AS p2,
         CASE WHEN priorizacion_detectada THEN {R("20 * least(dias_ahorrados / 30, 1)", 2)} END AS p3,
         CASE WHEN indice_alternancia > 0.7::DOUBLE THEN {R("15 * indice_alternancia", 2)} END AS p4,
         CASE WHEN compliance_de_papel THEN 10.0::DOUBLE END AS p5
  FROM indicadores_riesgo"""


@query(with_tables("indicadores_riesgo", f"""
  SELECT l_orderkey, l_linenumber, {R("least(coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0) + coalesce(p4, 0) + coalesce(p5, 0), 100)", 2)}
           AS score_riesgo,
         p1 AS hhi_elevado, p2 AS adendas_repetidas, p3 AS cobro_veloz_tgn, p4 AS alternancia_sospechosa, p5 AS compliance_de_papel
  FROM p""", p=RULE_POINTS))
def rule_score(t: Tables) -> DataFrame:
    cards = risk.audit_cards(t.indicadores_riesgo())
    names = [r.nombre for r in risk.standard_rules()]
    return cards.select(
        "l_orderkey", "l_linenumber", "score_riesgo",
        *[F.try_element_at("audit_card", F.lit(n)).alias(n.lower()) for n in names],
    )


@query(with_tables("indicadores_riesgo", """
  SELECT regla, peso_maximo, coalesce(activaciones, 0)::BIGINT AS activaciones FROM (VALUES
    ('HHI_ELEVADO', 30.0::DOUBLE), ('ADENDAS_REPETIDAS', 25.0), ('COBRO_VELOZ_TGN', 20.0), ('ALTERNANCIA_SOSPECHOSA', 15.0),
    ('COMPLIANCE_DE_PAPEL', 10.0)) r(regla, peso_maximo)
  LEFT JOIN (SELECT unnest(['HHI_ELEVADO', 'ADENDAS_REPETIDAS', 'COBRO_VELOZ_TGN', 'ALTERNANCIA_SOSPECHOSA', 'COMPLIANCE_DE_PAPEL']) AS regla,
               unnest([count(p1), count(p2), count(p3), count(p4), count(p5)]) AS activaciones FROM p) USING (regla)""", p=RULE_POINTS))
def rule_catalogue(t: Tables) -> DataFrame:
    """The catalogue with the number of rows that activate each rule."""
    active = risk.audit_cards(t.indicadores_riesgo()).select(F.explode(F.map_keys("audit_card")).alias("regla"))
    counts = active.groupBy("regla").agg(F.count("*").alias("activaciones"))
    every = risk.rule_catalogue(t.spark).join(counts, "regla", "left")
    return every.select("regla", "peso_maximo", F.coalesce("activaciones", F.lit(0).cast("long")).alias("activaciones"))


PATTERN_FLAGS = """
  SELECT l.licitacion_id, l.organismo, l.proveedor,
    coalesce(CAST(p.gasto AS DOUBLE) / nullif(CASE WHEN o.total > 0 THEN CAST(o.total AS DOUBLE) END, 0) > 0.5, false) AS regla_001,
    coalesce(b.n = 1, false) AS regla_002,
    coalesce(p.veces >= 3, false) AS regla_003,
    l.licitacion_id IN (SELECT licitacion_id FROM ev WHERE campo = 'd') AS regla_004,
    l.licitacion_id IN (SELECT licitacion_id FROM ev WHERE campo = 'r') AS regla_005,
    coalesce(s.seguido, false) AS regla_006,
    coalesce(d.r > 0.15::DOUBLE, false) AS regla_007,
    coalesce(h.hhi > 2500 AND c.promedio <= 1.5::DOUBLE, false) AS regla_008
  FROM licitaciones l
  LEFT JOIN (SELECT organismo, proveedor, sum(monto_adjudicado) AS gasto, count(*) AS veces FROM licitaciones
             WHERE proveedor IS NOT NULL GROUP BY 1, 2) p ON p.organismo = l.organismo AND p.proveedor = l.proveedor
  LEFT JOIN (SELECT organismo, sum(monto_adjudicado) AS total FROM licitaciones GROUP BY 1) o ON o.organismo = l.organismo
  LEFT JOIN (SELECT licitacion_id, count(*) AS n FROM ofertas GROUP BY 1) b ON b.licitacion_id = l.licitacion_id
  LEFT JOIN (SELECT organismo, avg(n) AS promedio FROM licitaciones LEFT JOIN (SELECT licitacion_id, count(*) AS n FROM ofertas GROUP BY 1)
             USING (licitacion_id) GROUP BY 1) c ON c.organismo = l.organismo
  LEFT JOIN h ON h.organismo = l.organismo
  LEFT JOIN d ON d.licitacion_id = l.licitacion_id
  LEFT JOIN (SELECT licitacion_id, coalesce(fecha_adjudicacion - lag(fecha_adjudicacion) OVER w <= 30, false)
               OR coalesce(lead(fecha_adjudicacion) OVER w = fecha_adjudicacion, false) AS seguido
             FROM licitaciones WHERE proveedor IS NOT NULL AND fecha_adjudicacion IS NOT NULL
             WINDOW w AS (PARTITION BY organismo, proveedor ORDER BY fecha_adjudicacion, licitacion_id)) s
    ON s.licitacion_id = l.licitacion_id"""
EVIDENCE = """
  SELECT DISTINCT x.licitacion_id, e1.campo FROM ofertas x JOIN ofertas y ON x.licitacion_id = y.licitacion_id AND x.empresa_id < y.empresa_id
  JOIN en e1 ON e1.entidad_id = x.empresa_id JOIN en e2 ON e2.entidad_id = y.empresa_id AND e2.campo = e1.campo AND e2.valor = e1.valor"""
PARTS = dict(
    gastos=SPEND, h=HHI, d=OVERRUN,
    en="""SELECT entidad_id, 'd' AS campo, trim(lower(domicilio)) AS valor FROM entidades WHERE domicilio <> ''
          UNION ALL SELECT entidad_id, 'r', trim(lower(representante_tecnico)) FROM entidades WHERE representante_tecnico <> ''""",
    ev=EVIDENCE, f=PATTERN_FLAGS,
)
POINTS = ("CAST(20 * regla_001::INT + 15 * regla_002::INT + 15 * regla_003::INT + 10 * regla_004::INT + 10 * regla_005::INT"
          " + 10 * regla_006::INT + 10 * regla_007::INT + 10 * regla_008::INT AS DOUBLE)")
CODES = [f"REGLA-00{i}" for i in range(1, 9)]


def _patterns(t: Tables) -> DataFrame:
    """Evaluated and written once per query, however often it is used."""
    if "patrones" not in t.written:
        t.written["patrones"] = cut(patterns.evaluate_patterns(t.stored("licitaciones"), t.stored("ofertas"), t.adendas(), t.entidades()))
    return t.written["patrones"]


@query(with_tables("licitaciones adendas entidades", f"SELECT *, {POINTS} AS score_patrones FROM f", **PARTS))
def pattern_rules(t: Tables) -> DataFrame:
    return _patterns(t).select(
        "licitacion_id", "organismo", "proveedor", "score_patrones",
        *[F.map_contains_key("reglas_activadas", F.lit(c)).alias(c.lower().replace("-", "_")) for c in CODES],
    )


@query(with_tables("licitaciones adendas entidades", "\nUNION ALL ".join(
    f"SELECT '{c}' AS codigo, '{name}' AS regla, {w}::DOUBLE AS peso_maximo, count(*) FILTER (WHERE {c.lower().replace('-', '_')}) AS licitaciones FROM f"
    for c, name, _, w in patterns.CATALOGUE), **PARTS))
def pattern_catalogue(t: Tables) -> DataFrame:
    """The catalogue with the number of tenders that activate each rule."""
    active = _patterns(t).select(F.explode(F.map_keys("reglas_activadas")).alias("codigo"))
    counts = active.groupBy("codigo").agg(F.count("*").alias("licitaciones"))
    return patterns.pattern_catalogue(t.spark).join(counts, "codigo", "left").select(
        "codigo", "regla", "peso_maximo", F.coalesce("licitaciones", F.lit(0)).alias("licitaciones")
    )


@query(with_tables("licitaciones", f"""
  SELECT licitacion_id, n AS cantidad_ofertas, cuota_dominante_pct, hhi, alta_concentracion
  FROM licitaciones LEFT JOIN h USING (organismo)
  LEFT JOIN (SELECT licitacion_id, count(*) AS n FROM ofertas GROUP BY 1) USING (licitacion_id)""", gastos=SPEND, h=HHI))
def pattern_table(t: Tables) -> DataFrame:
    return patterns.pattern_table(t.licitaciones(dates=False), t.ofertas()).select(
        "licitacion_id", "cantidad_ofertas", "cuota_dominante_pct", "hhi", "alta_concentracion"
    )


ZSCORE = f"""
  SELECT licitacion_id, {R("least(abs(z), 3) / 3 * 100", 2)} AS anomaly_score, abs(z) > 1.5::DOUBLE AS atipico
  FROM (SELECT licitacion_id, (CAST(monto_adjudicado AS DOUBLE) - m) / s AS z FROM licitaciones,
          (SELECT avg(CAST(monto_adjudicado AS DOUBLE)) AS m, stddev_pop(CAST(monto_adjudicado AS DOUBLE)) AS s FROM licitaciones))"""
ANOMALY_LEVEL = "CASE WHEN anomaly_score >= 75 THEN 'alto' WHEN anomaly_score >= 40 THEN 'medio' ELSE 'bajo' END"


@query(with_tables("licitaciones", f"""
  SELECT licitacion_id, anomaly_score, {ANOMALY_LEVEL} AS nivel, CASE WHEN atipico THEN 'monto_atipico' ELSE '' END AS factores
  FROM z""", z=ZSCORE))
def anomaly_zscore(t: Tables) -> DataFrame:
    return risk.zscore_anomalies(t.licitaciones(dates=False)).withColumn("factores", F.array_join("factores", ","))


OPACITY = f"""
  SELECT licitacion_id, {R("((presupuesto_oficial IS NULL)::INT + (monto_adjudicado IS NULL)::INT + (fecha_apertura IS NULL)::INT + (fecha_adjudicacion IS NULL)::INT + (modalidad IS NULL)::INT + (rubro IS NULL)::INT) / 6::DOUBLE * 100", 2)} AS opacidad_score
  FROM licitaciones"""


@query(with_tables("licitaciones", "SELECT * FROM o", o=OPACITY))
def opacity(t: Tables) -> DataFrame:
    return risk.opacity(t.licitaciones())


def _institutional_sql(country: str) -> str:
    def part(name: str, formula: str) -> str:
        return f"""(SELECT greatest(0, least(100, {formula})) FROM indicadores
                    WHERE pais_iso3 = '{country}' AND indicador = '{name}' ORDER BY anio DESC LIMIT 1)"""
    both = f"""SELECT {part('CPI', '100 - valor')} AS a, {part('WGI_CONTROL_CORRUPCION', '(2.5 - valor) / 5 * 100')} AS b"""
    return f"""SELECT coalesce({R("(coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0)::DOUBLE", 2)}, 50.0) AS institucional_score
               FROM ({both})"""


@query(with_tables("indicadores", _institutional_sql("P07")))
def institutional(t: Tables) -> DataFrame:
    return risk.institutional_score(t.indicadores(), "P07")


@query(with_tables("indicadores", _institutional_sql("ZZZ")))
def institutional_unknown_country(t: Tables) -> DataFrame:
    return risk.institutional_score(t.indicadores(), "ZZZ")


# All six parts. The network score is the scaled number of partners: the other measures have no affordable SQL. The
# anomaly score is the distance of the amount from the mean, as the forest has none either.
COUNTRY = "P07"
DEGREES = """SELECT u, count(*) AS grado FROM (SELECT organismo AS u, proveedor AS v FROM licitaciones WHERE proveedor IS NOT NULL GROUP BY ALL
    UNION ALL SELECT proveedor, organismo FROM licitaciones WHERE proveedor IS NOT NULL GROUP BY ALL) GROUP BY 1"""
NETWORK = f"""SELECT u AS proveedor, {R("CASE WHEN mayor > menor THEN (grado - menor) / (mayor - menor)::DOUBLE ELSE 0 END * 100", 2)} AS network_score
  FROM grados, (SELECT min(grado) AS menor, max(grado) AS mayor FROM grados)"""
INDEX = f"""
  SELECT licitacion_id, organismo, proveedor, anomaly_score, opacidad_score, concentracion_score, network_score, score_patrones, institucional_score,
         {R("""greatest(0, least(100, (0.2::DOUBLE * anomaly_score + coalesce(0.2::DOUBLE * concentracion_score, 0) + coalesce(0.2::DOUBLE * network_score, 0)
            + 0.15::DOUBLE * score_patrones + 0.15::DOUBLE * opacidad_score + 0.1::DOUBLE * institucional_score)
            / (0.6::DOUBLE + CASE WHEN concentracion_score IS NULL THEN 0 ELSE 0.2 END + CASE WHEN network_score IS NULL THEN 0 ELSE 0.2 END)::DOUBLE))""", 2)} AS ircs
  FROM (SELECT licitacion_id, organismo, proveedor, least(hhi / 100, 100) AS concentracion_score FROM licitaciones LEFT JOIN h USING (organismo))
  LEFT JOIN redes USING (proveedor) CROSS JOIN inst
  JOIN z USING (licitacion_id) JOIN o USING (licitacion_id) JOIN (SELECT licitacion_id, {POINTS} AS score_patrones FROM f) USING (licitacion_id)"""
LEVEL = "CASE WHEN ircs >= 75 THEN 'ALTO' WHEN ircs >= 50 THEN 'MEDIO' ELSE 'BAJO' END"
RISK_PARTS = dict(PARTS, z=ZSCORE, o=OPACITY, grados=DEGREES, redes=NETWORK, inst=_institutional_sql(COUNTRY), i=INDEX)
RISK_TABLES = "licitaciones adendas entidades indicadores"


def partners(tenders: DataFrame) -> DataFrame:
    """entity, network_score: the number of partners, scaled over the graph."""
    degrees = graph.degree(graph.award_edges(tenders))
    span = statistics(degrees, low=F.min("degree").cast("double"), high=F.max("degree").cast("double"))
    score = rounded(scale_between(F.col("degree").cast("double"), F.col("_s.low"), F.col("_s.high")) * 100, 2)
    return degrees.withColumn("_s", span).select(F.col("nodo_id").alias("entity"), score.alias("network_score"))


def _risk(t: Tables) -> DataFrame:
    tenders = t.stored("licitaciones")
    return risk.risk_index(
        tenders, finance.hhi(tenders), partners(tenders), _patterns(t), risk.zscore_anomalies(tenders), t.indicadores(), COUNTRY
    )


@query(with_tables(RISK_TABLES, f"SELECT *, {LEVEL} AS nivel_ircs FROM i", **RISK_PARTS))
def risk_index(t: Tables) -> DataFrame:
    return _risk(t).drop("ircs_componentes")


@query(with_tables(RISK_TABLES, f"""
  SELECT *, {LEVEL.replace('ircs', 'ircs_maximo')} AS nivel_ircs FROM
    (SELECT proveedor, count(*) AS n_licitaciones, max(ircs) AS ircs_maximo, {R("avg(ircs)", 6)} AS ircs_promedio
     FROM i WHERE proveedor IS NOT NULL GROUP BY 1)""", **RISK_PARTS))
def risk_by_company(t: Tables) -> DataFrame:
    return round_columns(risk.by_company(_risk(t)), 6, "ircs_promedio")


@query(with_tables(RISK_TABLES, "\nUNION ALL ".join(
    f"""SELECT licitacion_id, '{c}' AS codigo, '{text}' AS descripcion, '{'ALTA' if w >= 20 else 'MEDIA' if w >= 15 else 'BAJA'}' AS severidad
        FROM f WHERE {c.lower().replace('-', '_')}""" for c, _, text, w in patterns.CATALOGUE) + f"""
  UNION ALL SELECT licitacion_id, 'IRCS', 'Índice de riesgo ' || {LEVEL}, CASE WHEN ircs >= 75 THEN 'ALTA' ELSE 'MEDIA' END
  FROM i WHERE ircs >= 50""", **RISK_PARTS))
def alerts(t: Tables) -> DataFrame:
    return risk.alerts(_patterns(t), _risk(t))


# The index on the real network score, which has SQL; the anomaly part is left out here and the weights are renormalised.
NETWORK_SCORES = dict(g=EDGES, k=ARCS, **MEASURES)
WHOLE = dict(
    {k: v for k, v in PARTS.items()}, o=OPACITY, inst=_institutional_sql(COUNTRY), **NETWORK_SCORES,
    i=f"""SELECT licitacion_id, organismo, proveedor, CAST(NULL AS DOUBLE) AS anomaly_score, opacidad_score, concentracion_score, network_score,
               score_patrones::DOUBLE AS score_patrones, institucional_score,
               {R("""greatest(0, least(100, (coalesce(0.2::DOUBLE * concentracion_score, 0) + coalesce(0.2::DOUBLE * network_score, 0)
                  + 0.15::DOUBLE * score_patrones + 0.15::DOUBLE * opacidad_score + 0.1::DOUBLE * institucional_score)
                  / (0.4::DOUBLE + CASE WHEN concentracion_score IS NULL THEN 0 ELSE 0.2 END + CASE WHEN network_score IS NULL THEN 0 ELSE 0.2 END)::DOUBLE))""", 2)} AS ircs
          FROM (SELECT licitacion_id, organismo, proveedor, least(hhi / 100, 100) AS concentracion_score FROM licitaciones LEFT JOIN h USING (organismo))
          LEFT JOIN (SELECT nodo_id AS proveedor, network_score FROM scores) USING (proveedor) CROSS JOIN inst
          JOIN o USING (licitacion_id) JOIN (SELECT licitacion_id, {POINTS} AS score_patrones FROM f) USING (licitacion_id)""",
)


def measured_network(tenders: DataFrame) -> DataFrame:
    return graph.entity_measures(graph.award_edges(tenders)).withColumnRenamed("nodo_id", "entity")


@query(with_tables(RISK_TABLES, f"SELECT *, {LEVEL} AS nivel_ircs FROM i", MEASURES_KEPT, **WHOLE))
def risk_index_network(t: Tables) -> DataFrame:
    """The risk index with degree, betweenness, closeness and PageRank behind its network score."""
    tenders = t.stored("licitaciones")
    found = risk.risk_index(tenders, finance.hhi(tenders), measured_network(tenders), _patterns(t), None, t.indicadores(), COUNTRY)
    return found.drop("ircs_componentes")


def whole_report(t: Tables) -> Report:
    tables = {"ofertas": t.stored("ofertas"), "licitaciones": t.stored("licitaciones"), "adendas": t.stored("adendas"), "entidades": t.entidades()}
    return Report(t.spark, tables)


@query(with_tables("licitaciones", "SELECT count(*) AS filas, 0 AS sin_parte, 0 AS otra_suma, 0 AS otro_nivel, 0 AS fuera FROM licitaciones"))
def risk_index_properties(t: Tables) -> DataFrame:
    """The report's own index on all six parts, forest, neighbours and communities included: its weighted mean and level hold."""
    found = whole_report(t).riesgo_ircs
    given = {name: F.col(f"ircs_componentes.{name}") for name in risk.WEIGHTS}
    weight = sum((F.when(v.isNotNull(), F.lit(risk.WEIGHTS[k])).otherwise(0.0) for k, v in given.items()), F.lit(0.0))
    mean = sum((F.coalesce(v * risk.WEIGHTS[k], F.lit(0.0)) for k, v in given.items()), F.lit(0.0)) / weight
    level = F.when(F.col("ircs") >= 75, "ALTO").when(F.col("ircs") >= 50, "MEDIO").otherwise("BAJO")
    count = lambda wrong, name: F.count_if(F.coalesce(wrong, F.lit(True))).cast("int").alias(name)
    supplied = F.col("proveedor").isNotNull()
    return found.agg(
        F.count("*").alias("filas"),
        count(given["anomalias"].isNull() | given["patrones"].isNull() | (supplied & (given["redes"].isNull() | given["concentracion"].isNull())), "sin_parte"),
        count(F.abs(F.col("ircs") - mean) > 0.00501, "otra_suma"), count(F.col("nivel_ircs") != level, "otro_nivel"),
        count(~F.col("ircs").between(0, 100), "fuera"),
    )


def _top_share(n: int) -> str:
    return R(f"CAST(sum(gasto) FILTER (WHERE puesto <= {n}) AS DOUBLE) / any_value(total) * 100", 2)


TOPS = f"""SELECT organismo, {_top_share(3)} AS t3, {_top_share(5)} AS t5
  FROM (SELECT *, row_number() OVER (PARTITION BY organismo ORDER BY gasto DESC NULLS LAST, proveedor) AS puesto FROM gastos WHERE proveedor IS NOT NULL)
  JOIN (SELECT organismo, CAST(sum(gasto) AS DOUBLE) AS total FROM gastos GROUP BY ALL HAVING sum(gasto) > 0) USING (organismo) GROUP BY organismo"""
# Per block of the report its rows and the sum of a figure that stands for its content.
FIGURES = {
    "co_presentismo": "sum(co_presentismo)", "asimetria_victorias": "sum(compartidas)", "hhi_por_organismo": "sum(hhi)",
    "low_balling": "sum(monto_final_estimado)", "concentracion_top3": "sum(concentracion_top3_pct)", "concentracion_top5": "sum(concentracion_top5_pct)",
    "redes": "sum(network_score)", "patrones": "sum(score_patrones)",
    "anomalias": "count_if(nivel IN ('alto', 'medio', 'bajo') AND anomaly_score BETWEEN 0 AND 100)",
    "riesgo_ircs": "sum(opacidad_score + score_patrones + coalesce(concentracion_score, 0) + coalesce(network_score, 0))",
}


@query(with_tables("ofertas licitaciones adendas entidades", f"""
  SELECT bloque, filas, {R("cifra", 3)} AS cifra FROM (
    SELECT 'co_presentismo' AS bloque, count(*) AS filas, sum(n)::DOUBLE AS cifra FROM p UNION ALL
    SELECT 'asimetria_victorias', count(*), sum(n)::DOUBLE FROM p WHERE n >= 3 UNION ALL
    SELECT 'hhi_por_organismo', count(*), sum(hhi)::DOUBLE FROM h UNION ALL
    SELECT 'low_balling', (SELECT count(*) FROM licitaciones), (SELECT sum(final) FROM d)::DOUBLE UNION ALL
    SELECT 'concentracion_top3', count(*), sum(t3)::DOUBLE FROM tops UNION ALL SELECT 'concentracion_top5', count(*), sum(t5)::DOUBLE FROM tops UNION ALL
    SELECT 'redes', count(*), sum(network_score)::DOUBLE FROM scores UNION ALL
    SELECT 'patrones', count(*), sum(score_patrones)::DOUBLE FROM i UNION ALL
    SELECT 'anomalias', count(*), count(*)::DOUBLE FROM licitaciones UNION ALL
    SELECT 'riesgo_ircs', count(*), sum(opacidad_score + score_patrones + coalesce(concentracion_score, 0) + coalesce(network_score, 0))::DOUBLE FROM i)""",
    MEASURES_KEPT, p=SHARED, **{k: v for k, v in WHOLE.items() if k not in ("i", "inst")},
    i=WHOLE["i"].replace("CROSS JOIN inst", "CROSS JOIN (SELECT 50.0 AS institucional_score)"), tops=TOPS))
def report_contents(t: Tables) -> DataFrame:
    """All ten blocks of the report: their rows and a figure of their content."""
    blocks = whole_report(t).blocks()
    rows = [df.agg(F.lit(name).alias("bloque"), F.count("*").alias("filas"), F.expr(FIGURES[name]).cast("double").alias("cifra")) for name, df in blocks.items()]
    return round_columns(reduce(DataFrame.unionByName, rows), 3, "cifra")


REPORTED = ("co_presentismo", "asimetria_victorias", "hhi_por_organismo", "low_balling", "concentracion_top3", "concentracion_top5", "patrones")


@query(with_tables("licitaciones", """
  SELECT 'co_presentismo' AS bloque, count(*) AS filas FROM p UNION ALL SELECT 'asimetria_victorias', count(*) FROM p WHERE n >= 3
  UNION ALL SELECT unnest(['hhi_por_organismo', 'concentracion_top3', 'concentracion_top5']), unnest([n, n, n])
    FROM (SELECT count(DISTINCT organismo) AS n FROM licitaciones WHERE proveedor IS NOT NULL)
  UNION ALL SELECT unnest(['low_balling', 'patrones']), unnest([n, n]) FROM (SELECT count(*) AS n FROM licitaciones)""", p=SHARED))
def report_blocks(t: Tables) -> DataFrame:
    """Rows of each relational block of the report."""
    tables = {"ofertas": t.stored("ofertas"), "licitaciones": t.stored("licitaciones"), "adendas": t.adendas(), "entidades": t.entidades()}
    blocks = Report(t.spark, tables).blocks(REPORTED)
    counted = [df.agg(F.lit(name).alias("bloque"), F.count("*").alias("filas")) for name, df in blocks.items()]
    return reduce(DataFrame.unionByName, counted)
