"""Rounding, scaling and whole-table statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Parts into which the second sketch of a median cuts the bracket of the first.
GRID = 1000


def rounded(value: Column, digits: int) -> Column:
    """Round half up in decimal arithmetic, so that 1.005 does not depend on its binary form."""
    return F.round(value.cast("decimal(38,12)"), digits).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating quotient, null for a zero or missing denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def scale_between(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling to 0..1; a constant column becomes 0."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def statistics(df: DataFrame, **aggregates: Column) -> Column:
    """Whole-table aggregates as one scalar subquery, a struct usable in any expression over any table."""
    return df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias("statistics")).scalar()


def exact_medians(df: DataFrame, columns: list[str], accuracy: int = 10_000) -> DataFrame:
    """(columna, mediana): the exact median of each column, without holding or ordering a column in one place.

    A quantile sketch with a guaranteed rank error brackets the middle (about 0.1 % of the rows). A second sketch cuts the
    bracket into `GRID` parts whose rows are counted; only the distinct values of the one or two parts that hold the
    middle are ordered, about a millionth of the rows.
    """
    margin = 4.0 / accuracy
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "columna", "valor"
    ).filter(F.col("valor").isNotNull() & ~F.isnan("valor"))
    bounds = long.groupBy("columna").agg(
        F.percentile_approx("valor", F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), accuracy).alias("limites"),
        F.count("*").alias("n"),
    ).select("columna", "n", F.col("limites")[0].alias("bajo"), F.col("limites")[1].alias("alto"))
    # One row per column name: the broadcast sides here have len(columns) rows, or twice as many.
    marked = long.join(F.broadcast(bounds), "columna").filter(F.col("valor") <= F.col("alto"))
    # Everything below the bracket is one row, equal values are one row.
    value = F.when(F.col("valor") >= F.col("bajo"), F.col("valor"))
    counts = marked.groupBy("columna", "n", value.alias("valor")).agg(F.count("*").alias("filas"))
    shares = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    grid = counts.groupBy("columna").agg(F.percentile_approx("valor", shares, accuracy).alias("cortes"))
    part = F.when(F.col("valor").isNull(), -1).otherwise(F.size(F.filter("cortes", lambda c: c < F.col("valor"))))
    counts = counts.join(F.broadcast(grid), "columna").select("columna", "n", "valor", "filas", part.alias("parte"))
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda rank: (F.col("desde") < rank) & (rank <= F.col("hasta"))
    parts = counts.groupBy("columna", "n", "parte").agg(F.sum("filas").alias("filas"))
    parts = parts.withColumn("hasta", F.sum("filas").over(Window.partitionBy("columna").orderBy("parte")))
    parts = parts.withColumn("desde", F.col("hasta") - F.col("filas")).filter(holds(lower) | holds(upper))
    counts = counts.join(F.broadcast(parts.select("columna", "parte", F.col("desde").alias("antes"))), ["columna", "parte"])
    upto = Window.partitionBy("columna", "parte").orderBy("valor")
    ranked = counts.withColumn("hasta", F.col("antes") + F.sum("filas").over(upto)).withColumn("desde", F.col("hasta") - F.col("filas"))
    return ranked.groupBy("columna").agg(
        ((F.max(F.when(holds(lower), F.col("valor"))) + F.max(F.when(holds(upper), F.col("valor")))) / 2).alias("mediana")
    )


def median_struct(df: DataFrame, columns: list[str]) -> Column:
    """The exact medians as one scalar struct with a field per column."""
    found = exact_medians(df, columns)
    return found.agg(
        F.struct(*[F.max(F.when(F.col("columna") == c, F.col("mediana"))).alias(c) for c in columns]).alias("medianas")
    ).scalar()
