"""Merges into stored tables and run histories. A merge returns the next snapshot; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lictor.schemas import MONEY

ORGANISM, COMPANY = "ORGANISMO_PUBLICO", "EMPRESA"


def key_id(*parts: Column) -> Column:
    """An id that depends on the key alone, so that a retried task produces the same one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def entities_of(tenders: DataFrame, source: str = "pipeline") -> DataFrame:
    """The organisms and suppliers named by tenders, as entity rows."""
    kinds = [("organismo", ORGANISM), ("proveedor", COMPANY)]
    parts = [
        tenders.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("nombre"), F.lit(kind).alias("tipo"))
        for c, kind in kinds
        if c in tenders.columns
    ]
    named = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    none = F.lit(None).cast("string")
    return named.distinct().select(
        "nombre", "tipo", F.lit(source).alias("fuente"), none.alias("identificador_fiscal"), none.alias("domicilio")
    )


_ENTITY = ["entidad_id", "tipo", "nombre", "identificador_fiscal", "domicilio", "fuente"]


def merge_entities(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds unknown entities; a known one stays as it is.

    A row with a tax id matches by it, any other by name and kind. Within a batch, rows with a tax id come first and
    the smallest row of a key is kept.
    """
    rest = ["tipo", "nombre", "identificador_fiscal", "domicilio", "fuente"]
    given = F.coalesce(F.col("identificador_fiscal"), F.lit("")) != ""
    one = lambda df, *key: df.groupBy(*key).agg(
        F.min(F.struct(*[F.col(c) for c in rest])).alias("fila")
    ).select("fila.*")
    by_tax_id = one(incoming.filter(given), "identificador_fiscal").join(
        current.select("identificador_fiscal"), "identificador_fiscal", "left_anti"
    )
    by_tax_id = by_tax_id.withColumn("entidad_id", key_id(F.lit("fiscal"), F.col("identificador_fiscal")))
    known = current.select(*_ENTITY).unionByName(by_tax_id.select(*_ENTITY))
    by_name = one(incoming.filter(~given), "nombre", "tipo").join(
        known.select("nombre", "tipo"), ["nombre", "tipo"], "left_anti"
    )
    by_name = by_name.withColumn("entidad_id", key_id(F.lit("nombre"), F.col("nombre"), F.col("tipo")))
    return known.unionByName(by_name.select(*_ENTITY))


def ids_by_name(entities: DataFrame) -> DataFrame:
    """(nombre, entidad_id): a name that is both an organism and a company stands for the company."""
    company = F.col("tipo") == COMPANY
    return entities.filter(F.col("tipo").isin(ORGANISM, COMPANY)).groupBy("nombre").agg(
        F.min_by("entidad_id", F.struct((~company).alias("otro"), "entidad_id")).alias("entidad_id")
    )


_TENDER = [
    "fuente_id_externo", "organismo_id", "objeto", "rubro", "presupuesto_oficial", "fecha_apertura", "fecha_adjudicacion",
    "monto_adjudicado", "modalidad", "fuente",
]


def merge_tenders(
    current: DataFrame, incoming: DataFrame, entities: DataFrame, order_col: str | None = None, source: str = "pipeline"
) -> DataFrame:
    """Insert or replace by external id; tenders of an unknown organism are skipped, unreadable values become null.

    Of rows with the same id the last in `order_col` wins, or the largest row without one.
    """
    text = lambda c: F.col(c).cast("string") if c in incoming.columns else F.lit(None).cast("string")
    amount = lambda c: text(c).try_cast(MONEY)
    day = lambda c: F.to_date(text(c).try_cast("timestamp"))
    order = F.col(order_col) if order_col else F.lit(0)
    organisms = ids_by_name(entities).select(F.col("nombre").alias("_organismo"), F.col("entidad_id").alias("organismo_id"))
    rows = (
        incoming.select(
            text("licitacion_id").alias("fuente_id_externo"), text("organismo").alias("_organismo"), text("objeto").alias("objeto"),
            text("rubro").alias("rubro"), amount("presupuesto_oficial").alias("presupuesto_oficial"),
            day("fecha_apertura").alias("fecha_apertura"), day("fecha_adjudicacion").alias("fecha_adjudicacion"),
            amount("monto_adjudicado").alias("monto_adjudicado"), text("modalidad").alias("modalidad"),
            F.lit(source).alias("fuente"), order.alias("_orden"),
        )
        .filter(F.col("fuente_id_externo").isNotNull())
        .join(organisms, "_organismo")
        .groupBy("fuente_id_externo")
        .agg(F.max(F.struct("_orden", *_TENDER[1:])).alias("_nueva"))
    )
    old = current.select("licitacion_id", *_TENDER)
    merged = old.withColumn("_vieja", F.struct(*_TENDER[1:])).select("fuente_id_externo", "licitacion_id", "_vieja").join(
        rows, "fuente_id_externo", "full_outer"
    )
    replaced = F.col("_nueva").isNotNull()
    return merged.select(
        F.coalesce("licitacion_id", key_id(F.lit("licitacion"), F.col("fuente_id_externo"))).alias("licitacion_id"),
        "fuente_id_externo",
        *[F.when(replaced, F.col(f"_nueva.{c}")).otherwise(F.col(f"_vieja.{c}")).alias(c) for c in _TENDER[1:]],
    )


def merge_macro(current: DataFrame, incoming: DataFrame, order_col: str | None = None) -> DataFrame:
    """Insert or replace by country, year and index; rows without a full key are skipped, a missing source is kept."""
    key = ["pais_iso3", "anio", "indicador"]
    order = F.col(order_col) if order_col else F.lit(0)
    new = incoming.dropna(subset=key).groupBy(*key).agg(F.max(F.struct(order.alias("orden"), "valor", "fuente")).alias("_nueva"))
    old = current.select(*key, F.struct("valor", "fuente").alias("_vieja"))
    return old.join(new, key, "full_outer").select(
        *key,
        F.when(F.col("_nueva").isNotNull(), F.col("_nueva.valor")).otherwise(F.col("_vieja.valor")).alias("valor"),
        F.coalesce("_nueva.fuente", "_vieja.fuente", F.lit("pipeline")).alias("fuente"),
    )


def edge_history(edges: DataFrame, entities: DataFrame, run_id: str, relation: str = "ADJUDICACION") -> DataFrame:
    """Edges between known entities as rows of one run; a missing or zero weight becomes 1."""
    ids = ids_by_name(entities)
    end = lambda column, name: ids.select(F.col("nombre").alias(column), F.col("entidad_id").alias(name))
    weight = F.coalesce(F.nullif(F.col("peso").cast("double"), F.lit(0.0)), F.lit(1.0)) if "peso" in edges.columns else F.lit(1.0)
    return (
        edges.select(F.col("origen_id").alias("_o"), F.col("destino_id").alias("_d"), weight.alias("peso"))
        .join(end("_o", "origen_id"), "_o")
        .join(end("_d", "destino_id"), "_d")
        .select("origen_id", "destino_id", F.lit(relation).alias("tipo_relacion"), "peso", F.lit(run_id).alias("run_id"))
    )


def score_history(scores: DataFrame, tenders: DataFrame, run_id: str) -> DataFrame:
    """Risk indices of stored tenders as rows of one run."""
    stored = tenders.select(F.col("fuente_id_externo").alias("_externo"), "licitacion_id")
    parts = "ircs_componentes"
    names = scores.schema[parts].dataType.names if parts in scores.columns else []
    card = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"{parts}.{n}").cast("double"))]) if names else F.lit(None)
    return (
        scores.filter(F.col("ircs").isNotNull())
        .select(F.col("licitacion_id").cast("string").alias("_externo"), F.col("ircs").cast("double").alias("score"),
                card.cast("map<string,double>").alias("desglose"))
        .join(stored, "_externo")
        .select("licitacion_id", F.lit("TOTAL").alias("capa"), "score", "desglose", F.lit(run_id).alias("run_id"))
    )


def append_run(rows: DataFrame, folder: str) -> None:
    """Add a run to a history; repeating a run replaces its own partition only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)


def write_snapshot(df: DataFrame, folder: str, name: str) -> str:
    """Write the next snapshot beside the one being read, and return its path for the reader to switch to."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path
