"""Entities in official text, as Column expressions over whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The extraction patterns and word lists. (?U) gives letters and word boundaries their Unicode meaning.
TAX_ID = r"(?U)\b\d{2}-\d{7,8}-\d\b"
CASE_FILE = r"(?U)\bEX-\d{4}-\d{6,10}-\s*-?[A-Z]{2,10}[\w#-]*\b"
MONEY = r"(?Ui)(?:\$|PESOS)\s?[\d\.]{1,15}(?:,\d{1,2})?"
LEGAL_FORMS = [r"S\.?A\.?", r"S\.?R\.?L\.?", r"S\.?A\.?S\.?", r"S\.?A\.?C\.?I\.?", r"S\.?C\.?A\.?", r"U\.?T\.?E\.?"]
COMPANY = r"(?U)\b((?:[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑ.&\-]*\s){1,6}(?:" + "|".join(LEGAL_FORMS) + r"))\b"
BODY_WORDS = [
    "Ministerio", "Secretar[ií]a", "Subsecretar[ií]a", "Direcci[oó]n Nacional", "Direcci[oó]n General", "Instituto Nacional",
    "Administraci[oó]n Nacional", "Administraci[oó]n Federal", "Agencia Nacional", "Ente Nacional", "Jefatura de Gabinete",
    "Presidencia de la Naci[oó]n", "Poder Ejecutivo Nacional", "Sindicatura General", "Auditoría General", "Superintendencia",
]
PUBLIC_BODY = (
    r"(?U)\b((?:(?i:" + "|".join(BODY_WORDS) + r"))(?:\s+(?:(?i:de|del|nacional))?\s*[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑ]*){0,6})"
)
ACRONYMS = ["ANSES", "AFIP", "PAMI", "INDEC", "ANMAT", "SENASA", "RENAPER", "AABE", "ONABE", "IGJ", "CNV", "BCRA"]
TITLES = [r"Sr\.", r"Sra\.", r"Dr\.", r"Dra\.", r"Lic\.", r"Ing\.", r"Cdor\.", r"Cdora\."]
PERSON = (
    r"(?U)\b(?:" + "|".join(TITLES) + r")\s+([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,3})"
)
PERSON_ENGINE = "heuristico_titulos"


def collapsed(text: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def _found(clean: Column, pattern: str, group: int = 0) -> Column:
    matches = F.regexp_extract_all(clean, F.lit(pattern), F.lit(group))
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.trim(m))))


def _bodies(clean: Column) -> Column:
    acronyms = r"(?U)\b(?:" + "|".join(ACRONYMS) + r")\b"
    return F.array_sort(F.array_union(_found(clean, PUBLIC_BODY, 1), _found(clean, acronyms)))


# Type of each entity and how it is found in collapsed text, in the order of the result.
EXTRACTORS = {
    "persona": lambda clean: _found(clean, PERSON, 1),
    "empresa": lambda clean: _found(clean, COMPANY, 1),
    "organismo": _bodies,
    "cuit": lambda clean: _found(clean, TAX_ID),
    "monto": lambda clean: _found(clean, MONEY),
    "expediente": lambda clean: _found(clean, CASE_FILE),
}


def persons(text: Column) -> Column:
    return EXTRACTORS["persona"](collapsed(text))


def companies(text: Column) -> Column:
    return EXTRACTORS["empresa"](collapsed(text))


def public_bodies(text: Column) -> Column:
    return EXTRACTORS["organismo"](collapsed(text))


def tax_ids(text: Column) -> Column:
    return EXTRACTORS["cuit"](collapsed(text))


def amounts(text: Column) -> Column:
    return EXTRACTORS["monto"](collapsed(text))


def case_files(text: Column) -> Column:
    return EXTRACTORS["expediente"](collapsed(text))


def extract_entities(documents: DataFrame) -> DataFrame:
    """(documento, motor_personas, entidades) from (documento, texto): a projection, each document on its own."""
    clean = F.col("_limpio")
    tagged = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("tipo"), n.alias("nombre")))
    return documents.select("documento", collapsed(F.col("texto")).alias("_limpio")).select(
        "documento",
        F.when(clean != "", PERSON_ENGINE).alias("motor_personas"),
        F.concat(*[tagged(kind, find(clean)) for kind, find in EXTRACTORS.items()]).alias("entidades"),
    )


def entity_rows(documents: DataFrame) -> DataFrame:
    """The same as one row (documento, tipo, nombre) per entity."""
    # The plain generator would add a filter on the array's size below it, and so extract everything twice.
    return extract_entities(documents).select("documento", F.inline_outer("entidades")).filter(F.col("tipo").isNotNull())
