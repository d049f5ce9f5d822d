"""Landed files as DataFrames, and the harmonisation of heterogeneous exports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lictor.schemas import FILES


def read_file(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A CSV file or folder with a header, or Parquet; known columns get their types, an unreadable value becomes null.

    Quoted values may hold line breaks, so a CSV file is read by one task: land large tables as several files or Parquet.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    # Read as text by header name: a declared schema would be applied by position.
    df = spark.read.csv(path, header=True, mode="PERMISSIVE", multiLine=True, escape='"')
    types = {c: t for c, t in FILES.get(kind or "", {}).items() if c in df.columns}
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()}) if types else df


def read_report_inputs(spark: SparkSession, **paths: str | None) -> dict[str, DataFrame]:
    """The given tables of licitaciones, ofertas, adendas and entidades; a path left out is an absent table."""
    return {kind: read_file(spark, path, kind) for kind, path in paths.items() if path}


def tidy_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[str(c).strip().lower().replace(" ", "_") for c in df.columns])


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of the names that is a column, whatever it holds; null if none is."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None).cast("string"))


# Accepted headers of a tender export, and its source label.
TENDER_ALIASES = {
    "fuente_id_externo": ["numero_proceso", "nro_proceso", "expediente", "id"],
    "organismo": ["organismo", "organismo_contratante", "reparticion"],
    "objeto": ["objeto", "objeto_contratacion", "descripcion"],
    "proveedor": ["proveedor", "razon_social", "empresa_adjudicataria"],
    "monto_adjudicado": ["monto_adjudicado", "monto", "importe_adjudicado"],
    "fecha_apertura": ["fecha_apertura", "fecha_publicacion"],
    "fecha_adjudicacion": ["fecha_adjudicacion", "fecha_resolucion"],
}
TENDER_SOURCE = "DATOS_GOB_AR_COMPRAS_PUBLICAS"


def harmonise_tenders(df: DataFrame, source: str | Column) -> DataFrame:
    """One layout for tender exports with different headers; `source` is the origin's address or a column of it."""
    tidy = tidy_headers(df)
    picked = {field: first_present(tidy, names) for field, names in TENDER_ALIASES.items()}
    picked["fuente_id_externo"] = picked["fuente_id_externo"].cast("string")
    origin = F.lit(source) if isinstance(source, str) else source
    return tidy.select(
        *[c.alias(f) for f, c in picked.items()], origin.alias("url_origen"), F.lit(TENDER_SOURCE).alias("fuente")
    )


def read_tenders(spark: SparkSession, path: str) -> DataFrame:
    """A tender export as landed, with the file each row came from. One layout of headers per path."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", escape='"').withColumn("_origen", F.col("_metadata.file_path"))
    return harmonise_tenders(raw, F.col("_origen"))


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """The first of the present columns that is neither null nor blank."""
    present = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


# Source labels and texts read as false.
AUDIT_SOURCE, VOTE_SOURCE = "MEACI", "HCDN_VOTACIONES"
FALSE_TEXTS = ["", "0", "0.0", "false", "no"]


def harmonise_audits(df: DataFrame) -> DataFrame:
    """Compliance-audit exports. A real score of 0 is kept; a missing programme column means no programme."""
    tidy = tidy_headers(df)
    if "programa_integridad" in tidy.columns:
        text = F.lower(F.trim(F.col("programa_integridad").cast("string")))
        programme = F.when(text.isNotNull(), ~text.isin(FALSE_TEXTS))
    else:
        programme = F.lit(False)
    return tidy.select(
        first_filled(tidy, ["empresa", "razon_social"]).alias("empresa"),
        first_filled(tidy, ["fecha_auditoria", "fecha"]).alias("fecha"),
        programme.alias("tiene_programa_integridad"),
        first_filled(tidy, ["score_efectividad", "score"]).try_cast("double").alias("score_efectividad"),
        first_present(tidy, ["hallazgos"]).alias("hallazgos"),
        F.lit(AUDIT_SOURCE).alias("fuente"),
    )


def harmonise_votes(df: DataFrame) -> DataFrame:
    """Vote files, one row per legislator and vote."""
    tidy = tidy_headers(df)
    return tidy.select(
        F.lit("DIPUTADOS").alias("camara"),
        first_filled(tidy, ["expediente", "id_votacion"]).alias("expediente"),
        first_filled(tidy, ["titulo", "asunto"]).alias("titulo"),
        first_present(tidy, ["fecha"]).alias("fecha"),
        first_filled(tidy, ["diputado", "legislador"]).alias("legislador"),
        first_present(tidy, ["voto"]).alias("voto"),
        first_present(tidy, ["bloque"]).alias("bloque"),
        F.lit(VOTE_SOURCE).alias("fuente"),
    )


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Path -> its first line, of the files that exist and are not empty. Only the first bytes of each file are read."""
    java, headers = spark._jvm.java, {}
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(place):
            reader = java.io.BufferedReader(java.io.InputStreamReader(system.open(place), "UTF-8"))
            header = reader.readLine()
            reader.close()
            if header is not None:
                headers[path] = header
    return headers


def read_votes(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Vote files with differing headers, harmonised, and the paths that were skipped as missing or empty.

    Files with the same header are one scan. Any other problem with a file is raised, not hidden.
    """
    headers = _headers(spark, paths)
    layouts: dict[str, list[str]] = {}
    for path, header in headers.items():
        layouts.setdefault(header, []).append(path)
    found = [harmonise_votes(spark.read.csv(files, header=True, mode="PERMISSIVE", multiLine=True, escape='"')) for files in layouts.values()]
    votes = reduce(DataFrame.unionByName, found) if found else None
    return votes, [p for p in paths if p not in headers]


def digits_in(header: str) -> str:
    return re.sub(r"\D", "", header)
