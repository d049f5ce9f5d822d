"""Domain tables derived from the given tables, each as a DataFrame and as the SQL of a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lictor.functions.numeric import MONEY, ratio
from lictor.session import cut


class Tables:
    """Lazy domain tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.written = spark, folder, {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stored(self, name: str) -> DataFrame:
        """A domain table as a user keeps it, written once per query, for operators that read it several times."""
        if name not in self.written:
            self.written[name] = cut(getattr(self, name)())
        return self.written[name]

    def lines(self, *columns: str) -> DataFrame:
        """Order lines dealt by their order, so that all that is worked out per order needs no further shuffle."""
        return self.raw("lineitem").select("l_orderkey", *columns).repartition("l_orderkey")

    def ofertas(self) -> DataFrame:
        bid = F.struct("monto_ofertado", "l_suppkey")
        bids = self.lines("l_suppkey", "l_extendedprice", "l_quantity").groupBy("l_orderkey", "l_suppkey").agg(
            F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("monto_ofertado"),
            F.sum("l_quantity").alias("cantidad"),
        )
        best = bids.withColumn("mejor", F.min(bid).over(Window.partitionBy("l_orderkey")))
        return best.filter("l_orderkey IS NOT NULL").select(
            F.col("l_orderkey").alias("licitacion_id"),
            F.concat(F.lit("EMP-"), F.col("l_suppkey")).alias("empresa_id"),
            "monto_ofertado",
            F.when(F.col("l_suppkey") == F.col("mejor.l_suppkey"), "GANADORA")
            .when(F.col("cantidad") < 4, "DESCALIFICADA").otherwise("PERDEDORA").alias("resultado"),
        )

    def licitaciones(self, dates: bool = True) -> DataFrame:
        lines, awarded = self.lines("l_suppkey", "l_extendedprice", *["l_shipdate"] * dates), []
        if dates:
            opened = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
            lines = lines.join(opened, "l_orderkey", "left")
            awarded = [F.min(F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate"))).alias("entregada")]
        offers = lines.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("monto"), *awarded)
        date = [F.min("entregada").cast("date").alias("fecha_adjudicacion")] if dates else []
        tenders = self.raw("orders").join(
            offers.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("monto", "l_suppkey")).alias("mejor"), *date),
            "o_orderkey", "left",
        )
        customers = self.raw("customer").join(
            self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).select(F.col("c_custkey").alias("o_custkey"), "n_name", "c_mktsegment")
        return tenders.join(customers, "o_custkey").select(
            F.col("o_orderkey").alias("licitacion_id"),
            F.concat(F.lit("ORG-"), F.col("o_custkey")).alias("organismo"),
            F.col("n_name").alias("jurisdiccion"),
            F.col("c_mktsegment").alias("rubro"),
            F.col("o_orderpriority").alias("modalidad"),
            F.concat(F.lit("EMP-"), F.col("mejor.l_suppkey")).alias("proveedor"),
            F.col("o_totalprice").cast(MONEY).alias("monto_adjudicado"),
            F.col("o_orderdate").cast("date").alias("fecha_apertura"),
            F.when(F.col("o_orderstatus") != "P", (F.col("o_totalprice").cast(MONEY) * 2).cast(MONEY))
            .alias("presupuesto_oficial"),
            *["fecha_adjudicacion"] * dates,
        )

    def adendas(self) -> DataFrame:
        growth = F.lit(1) + (F.col("l_tax") - F.col("l_discount") / 2).cast("decimal(6,3)")
        price = F.col("l_extendedprice").cast(MONEY)
        return self.raw("lineitem").filter("l_returnflag = 'R'").select(
            F.col("l_orderkey").alias("licitacion_id"),
            price.alias("monto_original"),
            (price * growth).cast(MONEY).alias("monto_nuevo"),
        )

    def pagos(self) -> DataFrame:
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
        customers = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        return (
            self.raw("lineitem").join(orders, "l_orderkey").filter("l_shipdate >= o_orderdate")
            .join(customers, "o_custkey")
            .select(
                F.concat(F.lit("EMP-"), F.col("l_suppkey")).alias("empresa_id"),
                F.col("c_nationkey").alias("organismo_id"),
                F.col("o_orderdate").cast("date").alias("fecha_factura"),
                F.col("l_shipdate").cast("date").alias("fecha_pago"),
                F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("dias_habiles_pago"),
                F.col("o_custkey"),
                F.col("l_orderkey"),
                F.col("l_linenumber"),
            )
        )

    def aportes(self) -> DataFrame:
        return self.raw("lineitem").filter("l_linenumber = 1 and l_shipdate < timestamp_ntz'1996-01-01'").select(
            F.concat(F.lit("EMP-"), F.col("l_suppkey")).alias("aportante"),
            F.col("l_shipdate").cast("date").alias("fecha"),
            F.col("l_extendedprice").cast(MONEY).alias("monto"),
        )

    def votos(self) -> DataFrame:
        vote = (
            F.when(F.col("event_type") == "purchase", "AFIRMATIVO").when(F.col("event_type") == "view", "NEGATIVO")
            .when(F.col("event_type") == "click", "ABSTENCION").otherwise("AUSENTE")
        )
        return self.raw("events").select(
            F.col("user_id").alias("legislador_id"),
            F.pmod("event_id", F.lit(50)).alias("votacion_id"),
            vote.alias("voto"),
            F.add_months(F.col("ts").cast("date"), -28 * 12).alias("fecha"),
        )

    def empresas_relacionadas(self) -> DataFrame:
        suppliers = self.raw("supplier").agg(F.count("*").alias("n")).scalar()
        return self.raw("events").select("user_id").distinct().select(
            F.col("user_id").alias("legislador_id"),
            F.concat(F.lit("EMP-"), F.pmod("user_id", suppliers)).alias("empresa_id"),
            F.concat(F.lit("VINCULO-"), F.pmod("user_id", F.lit(3))).alias("tipo_vinculo"),
        )

    def auditorias(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.pmod("user_id", F.lit(40)).alias("empresa_id"),
            F.col("ts").alias("fecha"),
            F.when(kind != "error", kind.isin("purchase", "click")).alias("tiene_programa_integridad"),
            F.when(kind != "view", F.least("value", F.lit(100.0))).alias("score_efectividad"),
        )

    def tramites(self) -> DataFrame:
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderpriority"
        )
        customers = self.raw("customer").join(
            self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).select(F.col("c_custkey").alias("o_custkey"), "n_name", "c_mktsegment")
        return (
            self.raw("lineitem").join(orders, "l_orderkey").filter("l_shipdate >= o_orderdate")
            .join(customers, "o_custkey")
            .select(
                F.col("n_name").alias("organismo"),
                F.col("c_mktsegment").alias("dependencia"),
                F.col("o_orderpriority").alias("tipo_tramite"),
                F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("dias_transcurridos"),
            )
        )

    def normas(self) -> DataFrame:
        """Norm per procedure from the table itself; one procedure has none."""
        return (
            self.raw("orders").filter("o_orderpriority <> '5-LOW'")
            .groupBy(F.col("o_orderpriority").alias("tipo_tramite"))
            .agg((F.length(F.min("o_orderpriority")) * 80).cast("double").alias("tiempo_normativo"))
        )

    def encuestas(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_type").alias("dependencia"),
            F.least("value", F.lit(10.0)).cast("decimal(10,2)").alias("percepcion_agilizacion_informal"),
            (F.get_json_object("props", "$.k").cast("long") + 1).alias("n_respuestas"),
        )

    def causas(self) -> DataFrame:
        state = F.when(F.pmod("doc_id", F.lit(5)) == 1, "PRESCRIPTA").when(F.pmod("doc_id", F.lit(5)) == 2, "ELEVADA")
        phrase = (
            F.when(F.pmod("doc_id", F.lit(4)) == 0, " Se dicta Pena de Prisión y decomiso.")
            .when(F.pmod("doc_id", F.lit(4)) == 1, " Se otorga probation y multa.")
            .when(F.pmod("doc_id", F.lit(4)) == 2, " Suspension del juicio a prueba.").otherwise("")
        )
        return self.raw("documents").select(
            F.col("doc_id").alias("causa_id"), F.col("lang").alias("fuero"), F.col("source").alias("jurisdiccion"),
            state.otherwise("EN_TRAMITE").alias("estado"), F.concat("text", phrase).alias("texto_fallo"),
        )

    def imputados(self) -> DataFrame:
        known = self.raw("labels").select(
            F.col("doc_id").alias("causa_id"), F.col("doc_id").alias("entidad_id"),
            F.concat(F.lit("RANGO-"), F.col("quality"), F.lit("-"), F.col("toxic")).alias("rango_jerarquico"),
            F.pmod("doc_id", F.lit(60)).alias("condena_meses"),
        )
        unmatched = self.raw("supplier").select(
            (-F.col("s_suppkey") - 1).alias("causa_id"), F.col("s_suppkey").alias("entidad_id"),
            F.lit("RANGO-0-0").alias("rango_jerarquico"), F.pmod("s_suppkey", F.lit(24)).alias("condena_meses"),
        )
        return known.unionByName(unmatched)

    def entidades(self) -> DataFrame:
        parts = self.raw("part").select(F.col("p_partkey").alias("s_suppkey"), "p_name", "p_type")
        return self.raw("supplier").join(parts, "s_suppkey", "left").select(
            F.concat(F.lit("EMP-"), F.col("s_suppkey")).alias("entidad_id"),
            F.col("p_name").alias("domicilio"),
            F.concat_ws(" ", "p_type", F.pmod("s_nationkey", F.lit(5))).alias("representante_tecnico"),
        )

    def indicadores(self) -> DataFrame:
        """Indices per nation and order year, on the scales of the two indices the risk score reads."""
        customers = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        per_year = (
            self.raw("orders").join(customers, "o_custkey")
            .groupBy(F.concat(F.lit("P"), F.lpad("c_nationkey", 2, "0")).alias("pais_iso3"), F.year("o_orderdate").alias("anio"))
            .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("suma"), F.count("*").alias("n"))
        )
        base = F.floor(ratio(F.col("suma"), F.col("n")) / 100)
        cpi = per_year.select("pais_iso3", "anio", F.lit("CPI").alias("indicador"),
                              F.pmod(base, F.lit(100)).cast("double").alias("valor"), F.lit("nacional").alias("fuente"))
        wgi = per_year.select("pais_iso3", "anio", F.lit("WGI_CONTROL_CORRUPCION").alias("indicador"),
                              (F.pmod(base, F.lit(5)) - 2).cast("double").alias("valor"), F.lit("nacional").alias("fuente"))
        return cpi.unionByName(wgi)

    def indicadores_riesgo(self) -> DataFrame:
        """Norm-table indicators of each supplier, one row per award."""
        t = F.col
        return self.raw("lineitem").select(
            t("l_orderkey"), t("l_linenumber"),
            F.when(t("l_returnflag") != "N", t("l_returnflag") == "A").alias("alta_concentracion"),
            F.when(t("l_linenumber") != 3, t("l_discount") * 8).alias("low_balling_ratio"),
            (t("l_quantity") > 30).alias("priorizacion_detectada"),
            t("l_quantity").alias("dias_ahorrados"),
            (t("l_tax") * 12).alias("indice_alternancia"),
            (t("l_linestatus") == "O").alias("compliance_de_papel"),
        )


# The same tables as SQL; a query names the ones it needs, dependencies included.
SQL = {
    "ofertas": ((), """
      SELECT l.l_orderkey AS licitacion_id, 'EMP-' || l.l_suppkey AS empresa_id, l.monto_ofertado,
             CASE WHEN row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.monto_ofertado, l.l_suppkey) = 1 THEN 'GANADORA'
                  WHEN l.cantidad < 4 THEN 'DESCALIFICADA' ELSE 'PERDEDORA' END AS resultado
      FROM (SELECT l_orderkey, l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS monto_ofertado,
                   sum(l_quantity) AS cantidad
            FROM lineitem GROUP BY l_orderkey, l_suppkey) l"""),
    "licitaciones": (("ofertas",), """
      SELECT o_orderkey AS licitacion_id, 'ORG-' || o_custkey AS organismo, n_name AS jurisdiccion, c_mktsegment AS rubro,
             o_orderpriority AS modalidad, g.empresa_id AS proveedor, CAST(o_totalprice AS DECIMAL(18,2)) AS monto_adjudicado,
             CAST(o_orderdate AS DATE) AS fecha_apertura, a.fecha AS fecha_adjudicacion,
             CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DECIMAL(18,2)) END
               AS presupuesto_oficial
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
      LEFT JOIN (SELECT * FROM ofertas WHERE resultado = 'GANADORA') g ON g.licitacion_id = o_orderkey
      LEFT JOIN (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS fecha FROM lineitem JOIN orders o2 ON o2.o_orderkey = l_orderkey
                 WHERE l_shipdate >= o_orderdate GROUP BY l_orderkey) a ON a.l_orderkey = o_orderkey"""),
    "adendas": ((), """
      SELECT l_orderkey AS licitacion_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS monto_original,
             CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l_tax - l_discount / 2 AS DECIMAL(6,3))) AS DECIMAL(18,2))
               AS monto_nuevo
      FROM lineitem WHERE l_returnflag = 'R'"""),
    "pagos": ((), """
      SELECT 'EMP-' || l_suppkey AS empresa_id, c_nationkey AS organismo_id, CAST(o_orderdate AS DATE) AS fecha_factura,
             CAST(l_shipdate AS DATE) AS fecha_pago, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS dias_habiles_pago,
             o_custkey, l_orderkey, l_linenumber
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      WHERE l_shipdate >= o_orderdate"""),
    "aportes": ((), """
      SELECT 'EMP-' || l_suppkey AS aportante, CAST(l_shipdate AS DATE) AS fecha, CAST(l_extendedprice AS DECIMAL(18,2)) AS monto
      FROM lineitem WHERE l_linenumber = 1 AND l_shipdate < TIMESTAMP '1996-01-01'"""),
    "votos": ((), """
      SELECT user_id AS legislador_id, event_id % 50 AS votacion_id,
             CASE event_type WHEN 'purchase' THEN 'AFIRMATIVO' WHEN 'view' THEN 'NEGATIVO' WHEN 'click' THEN 'ABSTENCION'
                  ELSE 'AUSENTE' END AS voto,
             CAST(CAST(ts AS DATE) - INTERVAL 28 YEAR AS DATE) AS fecha
      FROM events"""),
    "empresas_relacionadas": ((), """
      SELECT DISTINCT user_id AS legislador_id, 'EMP-' || (user_id % (SELECT count(*) FROM supplier)) AS empresa_id,
             'VINCULO-' || (user_id % 3) AS tipo_vinculo
      FROM events"""),
    "auditorias": ((), """
      SELECT user_id % 40 AS empresa_id, ts AS fecha,
             CASE WHEN event_type <> 'error' THEN event_type IN ('purchase', 'click') END AS tiene_programa_integridad,
             CASE WHEN event_type <> 'view' THEN least(value, 100.0::DOUBLE) END AS score_efectividad
      FROM events"""),
    "tramites": ((), """
      SELECT n_name AS organismo, c_mktsegment AS dependencia, o_orderpriority AS tipo_tramite,
             CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS dias_transcurridos
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      JOIN nation ON n_nationkey = c_nationkey WHERE l_shipdate >= o_orderdate"""),
    "normas": ((), """
      SELECT o_orderpriority AS tipo_tramite, CAST(length(o_orderpriority) * 80 AS DOUBLE) AS tiempo_normativo
      FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderpriority"""),
    "encuestas": ((), """
      SELECT event_type AS dependencia, CAST(least(value, 10.0::DOUBLE) AS DECIMAL(10,2)) AS percepcion_agilizacion_informal,
             CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS n_respuestas
      FROM events"""),
    "causas": ((), """
      SELECT doc_id AS causa_id, lang AS fuero, source AS jurisdiccion,
             CASE doc_id % 5 WHEN 1 THEN 'PRESCRIPTA' WHEN 2 THEN 'ELEVADA' ELSE 'EN_TRAMITE' END AS estado,
             text || CASE doc_id % 4 WHEN 0 THEN ' Se dicta Pena de Prisión y decomiso.' WHEN 1 THEN ' Se otorga probation y multa.'
                          WHEN 2 THEN ' Suspension del juicio a prueba.' ELSE '' END AS texto_fallo
      FROM documents"""),
    "imputados": ((), """
      SELECT doc_id AS causa_id, doc_id AS entidad_id, 'RANGO-' || quality || '-' || toxic AS rango_jerarquico,
             doc_id % 60 AS condena_meses FROM labels
      UNION ALL SELECT -s_suppkey - 1, s_suppkey, 'RANGO-0-0', s_suppkey % 24 FROM supplier"""),
    "entidades": ((), """
      SELECT 'EMP-' || s_suppkey AS entidad_id, p_name AS domicilio,
             concat_ws(' ', p_type, CAST(s_nationkey % 5 AS VARCHAR)) AS representante_tecnico
      FROM supplier LEFT JOIN part ON p_partkey = s_suppkey"""),
    "por_anio": ((), """
      SELECT 'P' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS pais_iso3, year(o_orderdate) AS anio,
             CAST(floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100) AS BIGINT) AS base
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"""),
    "indicadores": (("por_anio",), """
      SELECT pais_iso3, anio, 'CPI' AS indicador, CAST(base % 100 AS DOUBLE) AS valor, 'nacional' AS fuente FROM por_anio
      UNION ALL SELECT pais_iso3, anio, 'WGI_CONTROL_CORRUPCION', CAST(base % 5 - 2 AS DOUBLE), 'nacional' FROM por_anio"""),
    "indicadores_riesgo": ((), """
      SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS alta_concentracion,
             CASE WHEN l_linenumber <> 3 THEN l_discount * 8 END AS low_balling_ratio, l_quantity > 30 AS priorizacion_detectada,
             l_quantity AS dias_ahorrados, l_tax * 12 AS indice_alternancia, l_linestatus = 'O' AS compliance_de_papel
      FROM lineitem"""),
}


def with_tables(names: str, body: str, kept: str = "", **more: str) -> str:
    """`body` preceded by the named tables and, in order, the extra ones given as SQL; those in `kept` are worked out once."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in SQL[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({SQL[n][1]})" for n in ordered] + [f"{n} AS {'MATERIALIZED ' if n in kept.split() else ''}({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def sql_round(expression: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"
