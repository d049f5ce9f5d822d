"""Public-finance indicators: concentration, payment priority, overruns, donations and payment delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lictor.functions.numeric import ratio, rounded

HIGH_CONCENTRATION = 2500


def payment_bias(payments: DataFrame) -> DataFrame:
    """Mean payment delay of a company at an organism against the organism's own mean."""
    days = F.col("dias_habiles_pago")
    pairs = (
        payments.filter(F.col("empresa_id").isNotNull() & F.col("organismo_id").isNotNull())
        .groupBy("empresa_id", "organismo_id")
        .agg(F.sum(days).cast("double").alias("suma"), F.count(days).alias("n_pagos"))
    )
    # Payments without a company still weigh in the organism's mean.
    organisms = (
        payments.filter(F.col("organismo_id").isNotNull())
        .groupBy("organismo_id")
        .agg(F.avg(days.cast("double")).alias("dias_promedio_organismo"))
    )
    saved = F.col("dias_promedio_organismo") - F.col("dias_promedio_empresa")
    return (
        pairs.join(organisms, "organismo_id")
        .withColumn("dias_promedio_empresa", ratio(F.col("suma"), F.col("n_pagos")))
        .withColumn("dias_ahorrados", saved)
        .select(
            "empresa_id", "organismo_id", "dias_promedio_empresa", "dias_promedio_organismo", "n_pagos", "dias_ahorrados",
            F.coalesce(F.col("dias_ahorrados") > 0, F.lit(False)).alias("priorizacion_detectada"),
        )
    )


def spend_by(tenders: DataFrame, by: list[str], supplier: str) -> DataFrame:
    """Money per group and supplier; a missing supplier keeps its own row because it counts in the group's total."""
    keyed = tenders.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in by], F.lit(0)) == 0)
    return keyed.groupBy(*by, F.col(supplier).alias("proveedor")).agg(
        F.sum("monto_adjudicado").alias("gasto"), F.count("*").alias("veces")
    )


def hhi(tenders: DataFrame, adjudicatario_col: str = "proveedor", by: str = "organismo") -> DataFrame:
    """Herfindahl-Hirschman index (0..10000) of each organism's spend, with its dominant supplier."""
    return concentration_of(spend_by(tenders, [by], adjudicatario_col), by).drop("gasto_total")


def concentration_of(spend: DataFrame, by: str = "organismo") -> DataFrame:
    """`hhi` from a table made by `spend_by`, plus the group's total."""
    named = F.col("proveedor").isNotNull()
    part = F.when(named, F.coalesce(F.col("gasto").cast("double"), F.lit(0.0)))
    totals = spend.groupBy(by).agg(
        F.sum("gasto").cast("double").alias("total"),
        F.sum(part * part).alias("cuadrados"),
        F.count("proveedor").alias("n_proveedores"),
        # Ties on money go to the smallest name.
        F.min(F.when(named, F.struct((-part).alias("menos_gasto"), "proveedor"))).alias("primero"),
    )
    value = F.col("cuadrados") / (F.col("total") * F.col("total")) * 10000
    return totals.filter((F.col("total") > 0) & F.col("primero").isNotNull()).select(
        by,
        F.col("total").alias("gasto_total"),
        rounded(value, 2).alias("hhi"),
        "n_proveedores",
        F.col("primero.proveedor").alias("proveedor_dominante"),
        rounded(-F.col("primero.menos_gasto") / F.col("total") * 100, 2).alias("cuota_dominante_pct"),
        (value > HIGH_CONCENTRATION).alias("alta_concentracion"),
    )


def top_n_share(tenders: DataFrame, n: int, by: tuple[str, ...] = ("organismo",)) -> DataFrame:
    """Share of the n largest suppliers in each group's spend."""
    keys = list(by)
    spend = spend_by(tenders, keys, "proveedor")
    totals = spend.groupBy(*keys).agg(F.sum("gasto").cast("double").alias("total")).filter(F.col("total") > 0)
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("gasto"), F.asc("proveedor"))
    top = (
        spend.filter(F.col("proveedor").isNotNull())
        .withColumn("puesto", F.row_number().over(order))
        .filter(F.col("puesto") <= n)
        .groupBy(*keys)
        .agg(F.sum("gasto").cast("double").alias("gasto_top"), F.count("*").alias("proveedores_top"))
    )
    return top.join(totals, keys).select(
        *keys, "proveedores_top", rounded(F.col("gasto_top") / F.col("total") * 100, 2).alias(f"concentracion_top{n}_pct")
    )


def concentration_by_year(tenders: DataFrame, n: int = 3, by: tuple[str, ...] = ("organismo",)) -> DataFrame:
    """Evolution of the top-n share over award years."""
    dated = tenders.filter(F.col("fecha_adjudicacion").isNotNull()).withColumn("anio", F.year("fecha_adjudicacion"))
    return top_n_share(dated, n, (*by, "anio"))


def low_balling(tenders: DataFrame, addenda: DataFrame) -> DataFrame:
    """Overrun through addenda relative to the awarded amount."""
    added = addenda.groupBy("licitacion_id").agg(
        F.sum(F.col("monto_nuevo") - F.col("monto_original")).alias("ajuste_total_adendas")
    )
    adjustment = F.coalesce(F.col("ajuste_total_adendas"), F.lit(0))
    awarded = F.col("monto_adjudicado")
    return tenders.join(added, "licitacion_id", "left").select(
        "licitacion_id",
        "organismo",
        "monto_adjudicado",
        (awarded + adjustment).alias("monto_final_estimado"),
        F.when(awarded > 0, ratio(adjustment, awarded)).alias("low_balling_ratio"),
    )


def campaign_roi(donations: DataFrame, tenders: DataFrame, ventana_dias_post_eleccion: int = 730) -> DataFrame:
    """Awards a donor won in the window after its last donation, relative to what it gave."""
    donors = (
        donations.filter(F.col("aportante").isNotNull())
        .groupBy(F.col("aportante").alias("empresa"))
        .agg(F.sum("monto").alias("monto_aportado"), F.max(F.col("fecha").cast("date")).alias("ultimo_aporte"))
    )
    # One row per company and award day: a company with very many awards shrinks before the shuffle.
    awards = (
        tenders.filter(F.col("proveedor").isNotNull() & F.col("fecha_adjudicacion").isNotNull())
        .groupBy(F.col("proveedor").alias("empresa"), F.col("fecha_adjudicacion").cast("date").alias("dia"))
        .agg(F.count("*").alias("contratos"), F.sum("monto_adjudicado").alias("monto"))
    )
    inside = (F.col("dia") > F.col("ultimo_aporte")) & (
        F.col("dia") <= F.date_add("ultimo_aporte", ventana_dias_post_eleccion)
    )
    won = (
        awards.join(donors.select("empresa", "ultimo_aporte"), "empresa")
        .filter(inside)
        .groupBy("empresa")
        .agg(F.sum("contratos").alias("contratos"), F.sum("monto").alias("monto"))
    )
    obtained = F.coalesce(F.col("monto"), F.lit(0))
    return donors.join(won, "empresa", "left").select(
        "empresa",
        "monto_aportado",
        F.coalesce("contratos", F.lit(0)).alias("n_contratos_posteriores"),
        obtained.alias("monto_adjudicado_posterior"),
        rounded(F.when(F.col("monto_aportado") > 0, ratio(obtained, F.col("monto_aportado"))), 2).alias("roi_politico"),
    )


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays after `start` up to and including `end`; negative when `end` comes first."""
    # Weekdays elapsed since a fixed Monday, as a closed form; no day is ever generated.
    def elapsed(day: Column) -> Column:
        weekday = F.weekday(day)
        monday = F.datediff(F.date_sub(day, weekday), F.lit("1970-01-05").cast("date"))
        return F.floor(monday / 7) * 5 + F.least(weekday + 1, F.lit(5))

    return (elapsed(end) - elapsed(start)).cast("int")


def with_payment_days(payments: DataFrame) -> DataFrame:
    """Adds dias_habiles_pago from fecha_factura and fecha_pago."""
    return payments.withColumn(
        "dias_habiles_pago", business_days(F.col("fecha_factura").cast("date"), F.col("fecha_pago").cast("date"))
    )
