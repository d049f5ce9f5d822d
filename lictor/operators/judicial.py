"""Court cases and the link between legislative votes and later awards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lictor.functions.numeric import ratio, rounded

# The severity lexicon.
HIGH_SEVERITY = ["prisión efectiva", "pena de prisión", "inhabilitaci[oó]n perpetua", "decomiso", "reclusi[oó]n"]
LOW_SEVERITY = ["probation", "suspensi[oó]n del juicio a prueba", "multa", "absoluci[oó]n", "sobreseimiento"]


def prescription_rate(cases: DataFrame) -> DataFrame:
    """Share of the cases of each court that expired."""
    known = cases.dropna(subset=["fuero", "jurisdiccion"])
    counted = known.groupBy("fuero", "jurisdiccion").agg(
        F.count("causa_id").alias("total_causas"), F.count_if(F.col("estado") == "PRESCRIPTA").alias("prescriptas")
    )
    share = ratio(F.col("prescriptas"), F.col("total_causas")) * 100
    return counted.withColumn("tasa_prescripcion_pct", rounded(share, 2))


def severity(text: Column, high: list[str] = HIGH_SEVERITY, low: list[str] = LOW_SEVERITY) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(lowered.rlike("|".join(high)), "ALTA").when(lowered.rlike("|".join(low)), "BAJA").otherwise("INDETERMINADA")
    )


def ruling_severity(cases: DataFrame, high: list[str] = HIGH_SEVERITY, low: list[str] = LOW_SEVERITY) -> DataFrame:
    return cases.withColumn("severidad_texto", severity(F.col("texto_fallo"), high, low))


def sanction_bias(cases: DataFrame, defendants: DataFrame) -> DataFrame:
    """Sentences by rank; a defendant without a known case stays in the denominator."""
    classified = ruling_severity(cases).select("causa_id", "severidad_texto")
    joined = defendants.filter(F.col("rango_jerarquico").isNotNull()).join(classified, "causa_id", "left")
    return joined.groupBy("rango_jerarquico").agg(
        F.count("entidad_id").alias("n_imputados"),
        F.avg("condena_meses").alias("condena_meses_promedio"),
        (F.avg(F.when(F.col("severidad_texto") == "ALTA", 1.0).otherwise(0.0)) * 100).alias("pct_severidad_alta"),
    )


def vote_contract(votes: DataFrame, tenders: DataFrame, related: DataFrame, dedupe: bool = False) -> DataFrame:
    """Favourable votes of a legislator against later awards of related companies.

    An award counts once per earlier favourable vote, or once in all with `dedupe`. The vote x award combinations are
    never produced: both sides are reduced to days, and one running count of votes over the days of a (legislator,
    company) pair gives every award its number of earlier votes.
    """
    pair = ["legislador_id", "empresa_id", "tipo_vinculo"]
    yes = votes.filter(
        (F.col("voto") == "AFIRMATIVO") & F.col("legislador_id").isNotNull() & F.col("fecha").isNotNull()
    ).withColumn("dia", F.col("fecha").cast("date"))
    first_vote = (
        yes.filter(F.col("votacion_id").isNotNull())
        .groupBy("legislador_id", "votacion_id")
        .agg(F.min("dia").alias("dia"))
        .groupBy("legislador_id", "dia")
        .agg(F.count("*").alias("primeros"))
    )
    vote_days = (
        yes.groupBy("legislador_id", "dia").agg(F.count("*").alias("votos"))
        .join(first_vote, ["legislador_id", "dia"], "left")
    )
    links = related.dropna(subset=pair).groupBy(*pair).agg(F.count("*").alias("veces"))
    award_days = (
        tenders.filter(F.col("proveedor").isNotNull() & F.col("fecha_adjudicacion").isNotNull())
        .groupBy(F.col("proveedor").alias("empresa_id"), F.col("fecha_adjudicacion").cast("date").alias("dia"))
        .agg(F.sum("monto_adjudicado").alias("monto"), F.count("*").alias("contratos"))
    )
    of_votes = links.join(vote_days, "legislador_id").select(
        *pair, "dia", "veces", "votos", "primeros",
        F.lit(None).cast(award_days.schema["monto"].dataType).alias("monto"), F.lit(0).cast("long").alias("contratos"),
    )
    of_awards = links.join(award_days, "empresa_id").select(
        *pair, "dia", "veces", F.lit(0).cast("long").alias("votos"), F.lit(0).cast("long").alias("primeros"),
        "monto", "contratos",
    )
    # At most two rows per calendar day and pair; the default range frame includes votes of the award's own day.
    past = Window.partitionBy(*pair).orderBy("dia")
    timeline = (
        of_votes.unionByName(of_awards)
        .withColumn("votos_previos", F.sum("votos").over(past))
        .withColumn("votaciones_previas", F.sum("primeros").over(past))
        .filter((F.col("contratos") > 0) & (F.col("votos_previos") > 0))
    )
    times = F.lit(1) if dedupe else F.col("votos_previos") * F.col("veces")
    return timeline.groupBy(*pair).agg(
        F.max("votaciones_previas").alias("n_votos_favorables"),
        F.coalesce(F.sum(F.col("monto") * times), F.lit(0)).alias("monto_adjudicado_posterior"),
    )
