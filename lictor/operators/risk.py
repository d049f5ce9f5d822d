"""Explainable risk scores: weighted rules, opacity, institutional risk and the six-part risk index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lictor.functions.numeric import clamp, ratio, rounded, statistics


@dataclass(frozen=True)
class Rule:
    """A scoring rule over an indicator table: where it holds, and how strongly (0..1)."""

    nombre: str
    descripcion: str
    peso_maximo: float
    needs: tuple[str, ...]
    condition: Column | None = None
    intensity: Column | None = None


def standard_rules() -> list[Rule]:
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    upto_one = lambda v: F.least(v, F.lit(1.0))
    # Rule names, descriptions, weights and thresholds.
    return [
        Rule("HHI_ELEVADO", "Alta concentración presupuestaria en el organismo (HHI > 2500)", 30.0,
             ("alta_concentracion",), F.col("alta_concentracion")),
        Rule("ADENDAS_REPETIDAS", "Low-balling ratio alto: sobrecosto significativo vía adendas", 25.0,
             ("low_balling_ratio",), value("low_balling_ratio") > 0.15, upto_one(value("low_balling_ratio") / 0.5)),
        Rule("COBRO_VELOZ_TGN", "Priorización de pago frente al promedio del organismo", 20.0,
             ("priorizacion_detectada", "dias_ahorrados"), F.col("priorizacion_detectada"),
             upto_one(value("dias_ahorrados") / 30)),
        Rule("ALTERNANCIA_SOSPECHOSA", "Alternancia de victorias con co-presentismo alto (posible cobertura)", 15.0,
             ("indice_alternancia",), value("indice_alternancia") > 0.7, value("indice_alternancia")),
        Rule("COMPLIANCE_DE_PAPEL", "Programa de integridad declarado sin efectividad real verificada", 10.0,
             ("compliance_de_papel",), F.col("compliance_de_papel")),
    ]


def audit_cards(indicators: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds score_riesgo (capped at 100) and audit_card, the points of each active rule.

    A rule is off where its evidence is null. A column the table lacks is read as null, as for a row without evidence.
    """
    rules = rules or standard_rules()
    absent = sorted({c for r in rules for c in r.needs} - set(indicators.columns))
    flags = {"alta_concentracion", "priorizacion_detectada", "compliance_de_papel"}
    known = indicators.withColumns(
        {c: F.lit(None).cast("boolean" if c in flags else "double") for c in absent}
    ) if absent else indicators
    points = [
        F.when(
            F.coalesce(r.condition, F.lit(False)),
            rounded(F.lit(r.peso_maximo) * (F.lit(1.0) if r.intensity is None else r.intensity), 2),
        )
        for r in rules
    ]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in points), F.lit(0.0))
    card = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(r.nombre) for r in rules]), F.array(*points)), lambda _, v: v.isNotNull()
    )
    return known.withColumns({"score_riesgo": rounded(F.least(total, F.lit(100.0)), 2), "audit_card": card}).drop(*absent)


def rule_catalogue(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    rows = [(r.nombre, r.descripcion, float(r.peso_maximo)) for r in rules or standard_rules()]
    return spark.createDataFrame(rows, "regla string, descripcion string, peso_maximo double")


def level(score: Column, high: tuple[str, float], middle: tuple[str, float], low: str) -> Column:
    return F.when(score >= high[1], high[0]).when(score >= middle[1], middle[0]).otherwise(low)


def anomaly_level(score: Column) -> Column:
    return level(score, ("alto", 75.0), ("medio", 40.0), "bajo")


def zscore_anomalies(tenders: DataFrame) -> DataFrame:
    """Fallback anomaly score: distance of the awarded amount from the mean in population deviations, 3 or more = 100."""
    amount = F.col("monto_adjudicado").cast("double")
    whole = statistics(tenders, media=F.avg(amount), desvio=F.stddev_pop(amount))
    spread = F.coalesce(F.col("_s.desvio"), F.lit(0.0))
    z = F.when(spread == 0, F.lit(0.0)).otherwise((amount - F.col("_s.media")) / F.nullif(spread, F.lit(0.0)))
    return (
        tenders.withColumn("_s", whole)
        .withColumn("z", z)
        .withColumn("anomaly_score", rounded(F.least(F.abs("z"), F.lit(3.0)) / 3 * 100, 2))
        .select(
            "licitacion_id",
            "anomaly_score",
            anomaly_level(F.col("anomaly_score")).alias("nivel"),
            F.when(F.abs("z") > 1.5, F.array(F.lit("monto_atipico")))
            .otherwise(F.array().cast("array<string>")).alias("factores"),
        )
    )


# The key fields of a tender file.
KEY_FIELDS = ["presupuesto_oficial", "monto_adjudicado", "fecha_apertura", "fecha_adjudicacion", "modalidad", "rubro"]


def opacity(tenders: DataFrame, fields: list[str] = KEY_FIELDS) -> DataFrame:
    """Share of the key fields present as columns that a tender leaves empty; 100 when none is published at all."""
    return tenders.select("licitacion_id", _opacity_of(tenders, fields).alias("opacidad_score"))


def _opacity_of(df: DataFrame, fields: list[str] = KEY_FIELDS) -> Column:
    present = [c for c in fields if c in df.columns]
    if not present:
        return F.lit(100.0)
    return rounded(sum((F.col(c).isNull().cast("int") for c in present), F.lit(0)) / len(present) * 100, 2)


def institutional_score(indicators: DataFrame, pais_iso3: str = "ARG") -> DataFrame:
    """One row with the institutional risk of a country, from the latest year of each index; 50 without data."""
    latest = lambda name: F.max_by(
        F.when(F.col("indicador") == name, F.col("valor")),
        F.when((F.col("indicador") == name) & F.col("valor").isNotNull(), F.col("anio")),
    )
    found = indicators.filter(F.col("pais_iso3") == pais_iso3).agg(
        latest("CPI").cast("double").alias("cpi"), latest("WGI_CONTROL_CORRUPCION").cast("double").alias("wgi")
    )
    parts = F.array_compact(
        F.array(clamp(100 - F.col("cpi"), 0.0, 100.0), clamp((2.5 - F.col("wgi")) / 5 * 100, 0.0, 100.0))
    )
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return found.select(
        F.when(F.size(parts) > 0, rounded(total / F.nullif(F.size(parts), F.lit(0)), 2)).otherwise(F.lit(50.0))
        .alias("institucional_score")
    )


# The weights of the risk index.
WEIGHTS = {
    "anomalias": 0.20,
    "concentracion": 0.20,
    "redes": 0.20,
    "patrones": 0.15,
    "opacidad": 0.15,
    "institucional": 0.10,
}


def ircs(parts: dict[str, Column]) -> Column:
    """The risk index of a row: the weighted mean of the parts that are present, null when there is none."""
    given = {k: v.cast("double") for k, v in parts.items()}
    total = sum((F.coalesce(v * WEIGHTS[k], F.lit(0.0)) for k, v in given.items()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, v in given.items()), F.lit(0.0))
    return F.when(weight > 0, rounded(clamp(total / F.nullif(weight, F.lit(0.0)), 0.0, 100.0), 2))


def ircs_level(score: Column) -> Column:
    return F.when(score.isNull(), "SIN_DATOS").otherwise(level(score, ("ALTO", 75.0), ("MEDIO", 50.0), "BAJO"))


def risk_index(
    tenders: DataFrame,
    concentration: DataFrame | None = None,
    network: DataFrame | None = None,
    patterns: DataFrame | None = None,
    anomalies: DataFrame | None = None,
    indicators: DataFrame | None = None,
    pais_iso3: str = "ARG",
) -> DataFrame:
    """The risk index of every tender from the results of the other operators; an absent table is an absent part.

    The institutional part is that of the country `pais_iso3`.
    """
    ids = ["licitacion_id", "organismo"] + (["proveedor"] if "proveedor" in tenders.columns else [])
    none = F.lit(None).cast("double")
    df = tenders.select(*ids, *[c for c in KEY_FIELDS if c in tenders.columns])
    df = df.withColumn("opacidad_score", _opacity_of(df))

    def attach(table: DataFrame | None, key: str, value: Column, name: str) -> None:
        nonlocal df
        if table is None or key not in df.columns:
            df = df.withColumn(name, none)
        else:
            df = df.join(table.select(key, value.cast("double").alias(name)), key, "left")

    attach(anomalies, "licitacion_id", F.col("anomaly_score"), "anomaly_score")
    attach(patterns, "licitacion_id", F.col("score_patrones"), "score_patrones")
    attach(concentration, "organismo", F.least(F.col("hhi") / 100, F.lit(100.0)), "concentracion_score")
    renamed = None if network is None else network.withColumnRenamed("entity", "proveedor")
    attach(renamed, "proveedor", F.col("network_score"), "network_score")
    institutional = F.lit(50.0) if indicators is None else institutional_score(indicators, pais_iso3).scalar()
    df = df.withColumn("institucional_score", institutional)
    parts = {
        "anomalias": F.col("anomaly_score"),
        "concentracion": F.col("concentracion_score"),
        "redes": F.col("network_score"),
        "patrones": F.col("score_patrones"),
        "opacidad": F.col("opacidad_score"),
        "institucional": F.col("institucional_score"),
    }
    return df.withColumn("ircs", ircs(parts)).select(
        *ids,
        *[c.alias(n) for n, c in (
            ("anomaly_score", parts["anomalias"]), ("opacidad_score", parts["opacidad"]),
            ("concentracion_score", parts["concentracion"]), ("network_score", parts["redes"]),
            ("score_patrones", parts["patrones"]), ("institucional_score", parts["institucional"]),
        )],
        "ircs",
        ircs_level(F.col("ircs")).alias("nivel_ircs"),
        F.struct(*[c.alias(n) for n, c in parts.items()]).alias("ircs_componentes"),
    )


def by_company(risk: DataFrame) -> DataFrame:
    """Tenders and the highest risk index of each company."""
    return (
        risk.filter(F.col("proveedor").isNotNull())
        .groupBy("proveedor")
        .agg(F.count("*").alias("n_licitaciones"), F.max("ircs").alias("ircs_maximo"), F.avg("ircs").alias("ircs_promedio"))
        .withColumn("nivel_ircs", ircs_level(F.col("ircs_maximo")))
    )


def company_view(risk: DataFrame, proveedor: str) -> DataFrame:
    """The summary of one company; no row when it is unknown."""
    return by_company(risk.filter(F.col("proveedor") == proveedor))


def alerts(patterns: DataFrame, risk: DataFrame) -> DataFrame:
    """One alert per activated pattern rule, and one per tender whose risk index is at least MEDIO."""
    from_rules = patterns.select(
        "licitacion_id", F.explode("reglas_activadas").alias("codigo", "regla")
    ).select(
        "licitacion_id", "codigo", F.col("regla.descripcion").alias("descripcion"),
        F.when(F.col("regla.puntos") >= 20, "ALTA").when(F.col("regla.puntos") >= 15, "MEDIA").otherwise("BAJA")
        .alias("severidad"),
    )
    from_index = risk.filter(F.col("nivel_ircs").isin("ALTO", "MEDIO")).select(
        "licitacion_id",
        F.lit("IRCS").alias("codigo"),
        F.concat(F.lit("Índice de riesgo "), F.col("nivel_ircs")).alias("descripcion"),
        F.when(F.col("nivel_ircs") == "ALTO", "ALTA").otherwise("MEDIA").alias("severidad"),
    )
    return from_rules.unionByName(from_index)
