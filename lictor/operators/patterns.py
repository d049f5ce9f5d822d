"""Eight business rules per tender. Repetition count, window and growth limit are this library's own choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lictor.functions.numeric import ratio
from lictor.operators.finance import HIGH_CONCENTRATION, concentration_of, hhi, low_balling, spend_by

# Code, name, description and weight of each rule.
CATALOGUE = [
    ("REGLA-001", "CONCENTRACION_PROVEEDOR", "El proveedor concentra más del 50% del gasto adjudicado del organismo", 20.0),
    ("REGLA-002", "OFERTA_UNICA", "La licitación recibió una sola oferta (ausencia de competencia real)", 15.0),
    ("REGLA-003", "GANADOR_REPETIDO", "La misma empresa gana repetidamente licitaciones del mismo organismo", 15.0),
    ("REGLA-004", "MISMO_DOMICILIO", "Empresas oferentes comparten domicilio fiscal declarado", 10.0),
    ("REGLA-005", "MISMO_REPRESENTANTE", "Empresas oferentes comparten representante técnico/apoderado", 10.0),
    ("REGLA-006", "CONTRATOS_CONSECUTIVOS",
     "La empresa recibe adjudicaciones consecutivas del mismo organismo en ventanas cortas", 10.0),
    ("REGLA-007", "INCREMENTO_ATIPICO", "El monto final vía adendas se desvía atípicamente del monto adjudicado", 10.0),
    ("REGLA-008", "CONCENTRACION_Y_BAJA_COMPETENCIA",
     "Alta concentración (HHI > 2500) combinada con baja competencia (promedio de ofertas del organismo <= 1.5)", 10.0),
]


def pattern_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "codigo string, regla string, descripcion string, peso_maximo double")


def bids_per_tender(bids: DataFrame) -> DataFrame:
    return bids.filter(F.col("licitacion_id").isNotNull()).groupBy("licitacion_id").agg(
        F.count("*").alias("cantidad_ofertas")
    )


def pattern_table(tenders: DataFrame, bids: DataFrame | None = None) -> DataFrame:
    """Tenders with cantidad_ofertas and the concentration of their organism."""
    shares = hhi(tenders).select("organismo", "hhi", "cuota_dominante_pct", "alta_concentracion")
    base = tenders.join(shares, "organismo", "left")
    if bids is None:
        return base.withColumn("cantidad_ofertas", F.lit(None).cast("long"))
    return base.join(bids_per_tender(bids), "licitacion_id", "left")


def shared_evidence(bids: DataFrame, entities: DataFrame, fields: list[str]) -> DataFrame:
    """(licitacion_id, a flag per field): tenders in which two different bidders declare the same value of a field.

    Grouping by the value needs no pairs of bidders; all fields go through one join and one grouping of the bids.
    """
    value = lambda field: F.nullif(F.trim(F.lower(F.col(field).cast("string"))), F.lit(""))
    declared = entities.filter(F.col("entidad_id").isNotNull()).select(
        F.col("entidad_id").alias("empresa_id"), *[value(field).alias(field) for field in fields]
    )
    each = [F.struct(F.lit(i).alias("campo"), F.col(field).alias("valor")) for i, field in enumerate(fields)]
    shared = (
        bids.select("licitacion_id", "empresa_id").join(declared, "empresa_id")
        .select("licitacion_id", "empresa_id", F.inline(F.array(*each)))
        .filter("valor IS NOT NULL")
        .groupBy("licitacion_id", "campo", "valor")
        .agg((F.min("empresa_id") < F.max("empresa_id")).alias("comparten"))
        .filter("comparten")
    )
    return shared.groupBy("licitacion_id").agg(*[F.max(F.col("campo") == i).alias(f"_{field}") for i, field in enumerate(fields)])


def evaluate_patterns(
    tenders: DataFrame,
    bids: DataFrame | None = None,
    addenda: DataFrame | None = None,
    entities: DataFrame | None = None,
    repeated_wins: int = 3,
    window_days: int = 30,
    max_growth: float = 0.15,
    few_bids: float = 1.5,
) -> DataFrame:
    """Per tender: score_patrones (0..100) and reglas_activadas, a map from rule code to name, description and points.

    A rule whose table or column is missing stays off.
    """
    pair = ["organismo", "proveedor"]
    day = F.col("fecha_adjudicacion").cast("date")
    columns = [c for c in ("licitacion_id", *pair, "monto_adjudicado", "fecha_adjudicacion") if c in tenders.columns]
    df = tenders.select(*columns)
    named = df.dropna(subset=pair)

    given = {"REGLA-004": "domicilio", "REGLA-005": "representante_tecnico"}
    evidence = {} if entities is None else {code: field for code, field in given.items() if field in entities.columns}

    spend = spend_by(df, ["organismo"], "proveedor")
    organisms = concentration_of(spend)
    # What hangs on the tender comes first, so that its rows are dealt by tender once.
    if bids is not None:
        df = df.join(bids_per_tender(bids), "licitacion_id", "left")
        competition = df.groupBy("organismo").agg(F.avg("cantidad_ofertas").alias("_ofertas_promedio"))
        organisms = organisms.join(competition, "organismo", "left")
        if evidence:
            df = df.join(shared_evidence(bids, entities, list(evidence.values())), "licitacion_id", "left")
    if addenda is not None:
        growth = low_balling(tenders, addenda).select("licitacion_id", F.col("low_balling_ratio").alias("_aumento"))
        df = df.join(growth, "licitacion_id", "left")
    df = df.join(spend.select(*pair, F.col("gasto").alias("_gasto"), F.col("veces").alias("_veces")), pair, "left")
    df = df.join(organisms.drop("n_proveedores", "proveedor_dominante", "cuota_dominante_pct", "alta_concentracion"),
                 "organismo", "left")
    holds: dict[str, Column] = {
        "REGLA-001": ratio(F.col("_gasto"), F.col("gasto_total")) > 0.5,
        "REGLA-003": F.col("_veces") >= repeated_wins,
    }

    if "fecha_adjudicacion" in columns:
        # One row per pair and award day, so the window of a pair is bounded by the calendar.
        days = named.filter(day.isNotNull()).groupBy(*pair, day.alias("_dia")).agg(F.count("*").alias("_mismo_dia"))
        before = F.lag("_dia").over(Window.partitionBy(*pair).orderBy("_dia"))
        days = days.withColumn("_seguido", (F.col("_mismo_dia") > 1) | (F.datediff("_dia", before) <= window_days))
        df = df.withColumn("_dia", day).join(days.select(*pair, "_dia", "_seguido"), [*pair, "_dia"], "left")
        holds["REGLA-006"] = F.col("_seguido")

    if bids is not None:
        holds["REGLA-002"] = F.col("cantidad_ofertas") == 1
        holds["REGLA-008"] = (F.col("hhi") > HIGH_CONCENTRATION) & (F.col("_ofertas_promedio") <= few_bids)
        holds |= {code: F.col(f"_{field}") for code, field in evidence.items()}

    if addenda is not None:
        holds["REGLA-007"] = F.col("_aumento") > max_growth

    active = {c: F.coalesce(holds.get(c, F.lit(False)), F.lit(False)) for c, *_ in CATALOGUE}
    points = sum((F.when(active[c], F.lit(w)).otherwise(0.0) for c, _, _, w in CATALOGUE), F.lit(0.0))
    found = F.map_from_entries(F.array_compact(F.array(*[
        F.when(active[c], F.struct(
            F.lit(c).alias("codigo"),
            F.struct(F.lit(name).alias("nombre"), F.lit(text).alias("descripcion"), F.lit(w).alias("puntos")).alias("regla"),
        ))
        for c, name, text, w in CATALOGUE
    ])))
    return df.select(
        "licitacion_id", *pair, F.least(points, F.lit(100.0)).alias("score_patrones"), found.alias("reglas_activadas")
    )
