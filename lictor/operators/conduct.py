"""Administrative friction, compliance audits and perception surveys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lictor.functions.numeric import ratio, rounded, scale_between, statistics


def sludge(procedures: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """Friction score 0..100 per (organismo, dependencia, tipo_tramite): 0.7 excess over the norm, 0.3 dispersion.

    `norms` has tipo_tramite and tiempo_normativo; a procedure without a norm has no excess.
    """
    keys = ["organismo", "dependencia", "tipo_tramite"]
    days = F.col("dias_transcurridos").cast("double")
    measured = procedures.dropna(subset=keys).groupBy(*keys).agg(
        F.avg(days).alias("tiempo_promedio"), F.stddev_samp(days).alias("desvio"), F.count(days).alias("n_tramites")
    )
    if norms is None:
        measured = measured.withColumn("tiempo_normativo", F.lit(None).cast("double"))
    else:
        measured = measured.join(norms.select("tipo_tramite", "tiempo_normativo"), "tipo_tramite", "left")
    measured = measured.withColumn("exceso_dias", F.col("tiempo_promedio") - F.col("tiempo_normativo"))
    excess = F.greatest(F.coalesce("exceso_dias", F.lit(0.0)), F.lit(0.0))
    spread = F.coalesce("desvio", F.lit(0.0))
    span = statistics(
        measured, exceso_min=F.min(excess), exceso_max=F.max(excess), desvio_min=F.min(spread), desvio_max=F.max(spread)
    )
    s = lambda field: F.col("_s").getField(field)
    return (
        measured.withColumn("_s", span)
        .withColumn("exceso_norm", scale_between(excess, s("exceso_min"), s("exceso_max")) * 100)
        .withColumn("desvio_norm", scale_between(spread, s("desvio_min"), s("desvio_max")) * 100)
        .withColumn("sludge_score", rounded(0.7 * F.col("exceso_norm") + 0.3 * F.col("desvio_norm"), 2))
        .select(
            *keys, "tiempo_promedio", "desvio", "n_tramites", "tiempo_normativo", "exceso_dias",
            "exceso_norm", "desvio_norm", "sludge_score",
        )
    )


def compliance_audit(audits: DataFrame, min_score: float = 40) -> DataFrame:
    """Latest known programme flag and score per company; a declared programme scoring under `min_score` is on paper only."""
    # Undated audits sort last, and equal dates are settled by the value itself.
    latest = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(
        F.col(c).isNotNull(), F.struct(F.col("fecha").isNull().alias("sin_fecha"), "fecha", F.col(c).alias("valor"))
    ))
    last = audits.filter(F.col("empresa_id").isNotNull()).groupBy("empresa_id").agg(
        F.max("fecha").alias("ultima_auditoria"),
        latest("tiene_programa_integridad").alias("tiene_programa"),
        latest("score_efectividad").alias("score_efectividad"),
        F.count("fecha").alias("n_auditorias"),
    )
    on_paper = F.col("tiene_programa") & (F.coalesce("score_efectividad", F.lit(0)) < min_score)
    return last.withColumn("compliance_de_papel", F.coalesce(on_paper, F.lit(False)))


def informal_expectations(surveys: DataFrame) -> DataFrame:
    """Perceived informal speed-up payments per office, weighted by the number of answers."""
    answers = F.col("n_respuestas")
    weighted = F.col("percepcion_agilizacion_informal") * answers
    return (
        surveys.filter(F.col("dependencia").isNotNull())
        .groupBy("dependencia")
        .agg(ratio(F.sum(weighted), F.sum(answers)).alias("percepcion_ponderada"))
    )
