"""Text, sources, pages and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lictor.functions import text
from lictor.operators import finance, graph, risk
from lictor.session import cut, shared_folder
from lictor.sinks import tables as sinks
from lictor.sources import macro, pages
from lictor.sources import tables as sources
from registry.adapters import Tables, with_tables
from registry.base import query

# Every document gets a sentence with one entity of each kind, made from its id.
ID = "lpad(CAST(doc_id AS VARCHAR), 8, '0')"
DOCUMENTS = f"""
  SELECT doc_id AS documento, text || ' La empresa CONSTRUCTORA DEL SUR S.A. (CUIT 30-' || {ID} || '-' || (doc_id % 10)
    || '), representada por el Sr. Juan Carlos Perez, cobra  $ ' || doc_id || '.000,50 del Ministerio de Obras segun EX-2024-' || {ID}
    || '- -APN-DGD#MEC y la ANSES.' AS texto
  FROM documents"""
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
COLLAPSED = f"SELECT documento, trim(regexp_replace(texto, '{SPACES}', ' ', 'g')) AS texto FROM d"


def documents(t: Tables) -> DataFrame:
    number, padded = F.col("doc_id").cast("string"), F.lpad(F.col("doc_id").cast("string"), 8, "0")
    sentence = F.concat(
        F.lit(" La empresa CONSTRUCTORA DEL SUR S.A. (CUIT 30-"), padded, F.lit("-"), F.pmod("doc_id", F.lit(10)),
        F.lit("), representada por el Sr. Juan Carlos Perez, cobra  $ "), number,
        F.lit(".000,50 del Ministerio de Obras segun EX-2024-"), padded, F.lit("- -APN-DGD#MEC y la ANSES."),
    )
    return t.raw("documents").select(F.col("doc_id").alias("documento"), F.concat("text", sentence).alias("texto"))


def _found_sql(pattern: str) -> str:
    return f"""WITH d AS ({DOCUMENTS}), c AS ({COLLAPSED})
      SELECT DISTINCT documento, trim(unnest(regexp_extract_all(texto, '{pattern}'))) AS nombre FROM c"""


def _found(t: Tables, extract) -> DataFrame:
    return documents(t).select("documento", F.explode_outer(extract(F.col("texto"))).alias("nombre")).dropna()


@query(f"WITH d AS ({DOCUMENTS}), c AS ({COLLAPSED}) SELECT documento, length(texto) AS largo, md5(texto) AS huella FROM c")
def text_collapsed(t: Tables) -> DataFrame:
    clean: Column = text.collapsed(F.col("texto"))
    return documents(t).select("documento", F.length(clean).cast("long").alias("largo"), F.md5(clean).alias("huella"))


@query(_found_sql(r"\b\d{2}-\d{7,8}-\d\b"))
def text_tax_id(t: Tables) -> DataFrame:
    return _found(t, text.tax_ids)


@query(_found_sql(r"(?i)(?:\$|PESOS)\s?[\d\.]{1,15}(?:,\d{1,2})?"))
def text_money(t: Tables) -> DataFrame:
    return _found(t, text.amounts)


@query(_found_sql(r"\bEX-\d{4}-\d{6,10}-\s*-?[A-Z]{2,10}[\w#-]*\b"))
def text_case_file(t: Tables) -> DataFrame:
    return _found(t, text.case_files)


# RE2's \w and \b know ASCII only, so words are spelled out by Unicode class; the word list is stated anew.
WORD = r"\p{L}\p{N}\p{M}_"
FORMS = r"S\.?A\.?|S\.?R\.?L\.?|S\.?A\.?S\.?|S\.?A\.?C\.?I\.?|S\.?C\.?A\.?|U\.?T\.?E\.?"
BODIES = (
    "Ministerio|Secretar[ií]a|Subsecretar[ií]a|Direcci[oó]n Nacional|Direcci[oó]n General|Instituto Nacional"
    "|Administraci[oó]n Nacional|Administraci[oó]n Federal|Agencia Nacional|Ente Nacional|Jefatura de Gabinete"
    "|Presidencia de la Naci[oó]n|Poder Ejecutivo Nacional|Sindicatura General|Auditoría General|Superintendencia"
)
COMPANY = rf"\b((?:[A-ZÁÉÍÓÚÑ][{WORD}.&\-]*\s){{1,6}}(?:{FORMS}))\b"
BODY = rf"\b((?:(?i:{BODIES}))(?:\s+(?:(?i:de|del|nacional))?\s*[A-ZÁÉÍÓÚÑ][{WORD}]*){{0,6}})"
ACRONYM = r"\b(?:ANSES|AFIP|PAMI|INDEC|ANMAT|SENASA|RENAPER|AABE|ONABE|IGJ|CNV|BCRA)\b"
PERSON = (
    r"\b(?:Sr\.|Sra\.|Dr\.|Dra\.|Lic\.|Ing\.|Cdor\.|Cdora\.)\s+"
    "([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,3})"
)
EVERY = {
    "persona": (PERSON, 1),
    "empresa": (COMPANY, 1),
    "organismo": (BODY, 1),
    "cuit": (r"\b\d{2}-\d{7,8}-\d\b", 0),
    "monto": (r"(?i)(?:\$|PESOS)\s?[\d\.]{1,15}(?:,\d{1,2})?", 0),
    "expediente": (r"\bEX-\d{4}-\d{6,10}-\s*-?[A-Z]{2,10}[\w#-]*\b", 0),
}


def _kinds_sql() -> str:
    parts = [(kind, *found) for kind, found in EVERY.items()] + [("organismo", ACRONYM, 0)]
    rows = " UNION ".join(
        f"SELECT documento, '{k}' AS tipo, trim(unnest(regexp_extract_all(texto, '{p}', {g}))) AS nombre FROM c" for k, p, g in parts
    )
    return f"WITH d AS ({DOCUMENTS}), c AS ({COLLAPSED}), e AS ({rows}) SELECT DISTINCT documento, tipo, nombre FROM e"


def _kind_sql(kind: str) -> str:
    return f"SELECT documento, nombre FROM ({_kinds_sql()}) WHERE tipo = '{kind}'"


@query(_kind_sql("empresa"))
def text_company(t: Tables) -> DataFrame:
    return _found(t, text.companies)


@query(_kind_sql("organismo"))
def text_public_body(t: Tables) -> DataFrame:
    return _found(t, text.public_bodies)


@query(_kind_sql("persona"))
def text_person(t: Tables) -> DataFrame:
    return _found(t, text.persons)


@query(_kinds_sql())
def text_entities(t: Tables) -> DataFrame:
    return text.entity_rows(documents(t))


PADDED_PAGE = "lpad(CAST(page_id AS VARCHAR), 6, '0')"


def stored_pages(t: Tables) -> DataFrame:
    """Every page with the blocks of all known layouts added; a page with an odd id also links a data file."""
    number = F.lpad(F.col("page_id").cast("string"), 6, "0")
    blocks = F.concat(
        F.lit('<div class="resultado-aviso card-aviso"><span class="titulo">Aviso '), number,
        F.lit('</span><span class="fecha">05/08/2026</span><span class="organismo">Ministerio</span><a href="/detalleAviso/'),
        number, F.lit('">Ver</a></div><article><h3>Causa '), number,
        F.lit(" c/ Estado</h3><p>Resuelto el 10/06/2026.</p></article><table><tr><th>Fecha</th><th>Expediente</th><th>Asunto</th>"
              "<th>Diputado</th><th>Bloque</th><th>Voto</th></tr><tr><td>01/08/2026</td><td>"),
        number, F.lit("-D-2026</td><td>Ley</td><td>Ana Pérez</td><td>A</td><td>AFIRMATIVO</td></tr></table>"),
        F.when(F.pmod("page_id", F.lit(2)) == 1, F.concat(F.lit('<a class="x" href="/actas/'), number, F.lit('.csv">Acta</a>')))
        .otherwise(""),
    )
    return t.raw("pages").select("page_id", "url", F.concat("html", blocks).alias("html"))


@query(rf"""
  WITH p AS (SELECT page_id, html || CASE WHEN page_id % 2 = 1
                    THEN '<a class="x" href="/actas/' || {PADDED_PAGE} || '.csv">Acta</a>' ELSE '' END AS html FROM pages),
  v AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g') AS html FROM p),
  h AS (SELECT page_id, replace(unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"'']*)["'']', 1)),
                                '&amp;', '&') AS href FROM v)
  SELECT page_id, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://datos.example' || href END AS url
  FROM h WHERE regexp_matches(lower(href), '\.(csv|xlsx|xls)$')""")
def links_in_pages(t: Tables) -> DataFrame:
    return pages.data_links(stored_pages(t), "https://datos.example")


# The raw pages hold none of the layouts, so the added blocks are all there is to find.
@query(f"""SELECT page_id, 'Aviso ' || {PADDED_PAGE} AS titulo, '05/08/2026' AS fecha, 'Ministerio' AS organismo,
                  '/detalleAviso/' || {PADDED_PAGE} AS url, 'BORA' AS fuente FROM pages""")
def gazette_pages(t: Tables) -> DataFrame:
    return pages.gazette_notices(stored_pages(t))


@query(f"""SELECT page_id, 'Causa ' || {PADDED_PAGE} || ' c/ Estado' AS caratula, CAST(NULL AS VARCHAR) AS fuero, '10/06/2026' AS fecha_resolucion,
                  'Causa ' || {PADDED_PAGE} || ' c/ Estado Resuelto el 10/06/2026.' AS texto_fallo, 'SAIJ_PODER_JUDICIAL' AS fuente
           FROM pages""")
def ruling_pages(t: Tables) -> DataFrame:
    return pages.court_rulings(stored_pages(t))


def shaped_pages(t: Tables, shapes: list[str]) -> DataFrame:
    """Every page in one of the shapes, by its id; # stands for the id and @ for the url."""
    shape = F.element_at(F.array(*map(F.lit, shapes)), (F.pmod("page_id", F.lit(len(shapes))) + 1).cast("int"))
    number = F.lpad(F.col("page_id").cast("string"), 6, "0")
    return t.raw("pages").select("page_id", F.replace(F.replace(shape, F.lit("#"), number), F.lit("@"), F.col("url")).alias("html"))


@query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Aviso ' || n WHEN 1 THEN 'Fila' WHEN 2 THEN 'Solo' || n ELSE url END AS titulo,
                  CASE page_id % 4 WHEN 0 THEN '05/08/2026' WHEN 1 THEN '7/8/2026' WHEN 3 THEN '03/08/2026' END AS fecha,
                  CAST(NULL AS VARCHAR) AS organismo, CASE page_id % 4 WHEN 1 THEN '/detalle/' WHEN 2 THEN '/detalleAviso/' ELSE '/aviso/' END || n AS url, 'BORA' AS fuente
           FROM (SELECT *, {PADDED_PAGE} AS n FROM pages)""")
def gazette_page_shapes(t: Tables) -> DataFrame:
    """Links in list items, rows of tables in sections, without any block, and behind stray closing tags."""
    return pages.gazette_notices(shaped_pages(t, [
        '<ul><li>05/08/2026<div>Sub</div><a href="/aviso/#">Aviso #</a></li></ul>',
        "<div>01/01/2020<div>@</div><table><tr><td>7/8/2026<td><a href='/detalle/#'>Fila</a></tr></table></div>",
        "<p>09/08/2026</p><a class=x href=/detalleAviso/#><b>Solo</b> #</a>",
        "</div><div>03/08/2026 <span>x</span></li><a href='/aviso/#'>@</a></div><p>04/04/2026</p>",
    ]))


@query(f"""WITH p AS (SELECT *, {PADDED_PAGE} AS n FROM pages),
  r AS (SELECT page_id, 'Caso ' || n || ' contra B' AS caratula, '10/06/2026' AS fecha_resolucion,
               'Sala I de ' || url || ' Caso ' || n || ' contra B Fallo del 10/06/2026, prescripta.' AS texto_fallo FROM p WHERE page_id % 4 = 0
        UNION ALL SELECT page_id, 'Asunto ' || n, '1/2/2026', 'Asunto ' || n || ' Otro caso 1/2/2026 firme fin' FROM p WHERE page_id % 4 = 1
        UNION ALL SELECT page_id, 'Otrocaso', '1/2/2026', 'Otro caso 1/2/2026 firme' FROM p WHERE page_id % 4 = 1
        UNION ALL SELECT page_id, 'Sin bloque alguno ' || n, NULL, 'Sin bloque alguno ' || n FROM p WHERE page_id % 4 = 2)
  SELECT page_id, caratula, CAST(NULL AS VARCHAR) AS fuero, fecha_resolucion, texto_fallo, 'SAIJ_PODER_JUDICIAL' AS fuente FROM r""")
def ruling_page_shapes(t: Tables) -> DataFrame:
    """Headings behind closed sections, in sections in sections, without a section, and too short ones."""
    return pages.court_rulings(shaped_pages(t, [
        "<article><div>Sala I de @</div><h3>Caso # contra B</h3><p>Fallo del 10/06/2026, prescripta.</p></article>",
        "<div><h2>Asunto #</h2><ul><li><h4>Otro <i>caso</i></h4> 1/2/2026 firme</li></ul>fin</div>",
        "<h2>Sin bloque alguno #</h2> 11/11/2026", "<div><h3>Corto</h3></div>",
    ]))


@query(f"""SELECT page_id, 'DIPUTADOS' AS camara, {PADDED_PAGE} || '-D-2026' AS expediente, 'Ley' AS titulo, '01/08/2026' AS fecha,
                  'Ana Pérez' AS legislador, 'AFIRMATIVO' AS voto, 'A' AS bloque, 'HCDN_VOTACIONES' AS fuente
           FROM pages WHERE page_id % 2 = 0""")
def roll_call_pages(t: Tables) -> DataFrame:
    return pages.roll_calls(stored_pages(t))


@query(f"""SELECT page_id, 'SENADORES' AS camara, '01/08/2026' AS fecha, {PADDED_PAGE} || '-D-2026' AS expediente, 'Ley' AS titulo,
                  'Ana Pérez' AS resultado, 'SENADO_VOTACIONES' AS fuente FROM pages""")
def senate_pages(t: Tables) -> DataFrame:
    return pages.senate_votes(stored_pages(t))


@query(with_tables("licitaciones", """
  SELECT CAST(licitacion_id AS VARCHAR) AS fuente_id_externo, organismo, modalidad AS objeto, proveedor,
         CAST(monto_adjudicado AS DOUBLE) AS monto_adjudicado, CAST(fecha_apertura AS VARCHAR) AS fecha_apertura,
         CAST(fecha_adjudicacion AS VARCHAR) AS fecha_adjudicacion, 'orders' AS url_origen,
         'DATOS_GOB_AR_COMPRAS_PUBLICAS' AS fuente
  FROM licitaciones"""))
def tender_columns(t: Tables) -> DataFrame:
    export = t.licitaciones().select(
        F.col("licitacion_id").alias(" Nro Proceso "), F.col("organismo").alias("Reparticion"), F.col("modalidad").alias("Descripcion"),
        F.col("proveedor").alias("Razon Social"), F.col("monto_adjudicado").alias("Importe Adjudicado"),
        F.col("fecha_apertura").alias("Fecha Publicacion"), F.col("fecha_adjudicacion").alias("FECHA_RESOLUCION"),
    )
    found = sources.harmonise_tenders(export, "orders")
    return found.withColumns({
        "monto_adjudicado": F.col("monto_adjudicado").cast("double"),
        "fecha_apertura": F.col("fecha_apertura").cast("string"),
        "fecha_adjudicacion": F.col("fecha_adjudicacion").cast("string"),
    })


@query(with_tables("licitaciones", """
  SELECT CAST(licitacion_id AS VARCHAR) AS licitacion_id, organismo, proveedor, CAST(monto_adjudicado AS DOUBLE) AS monto_adjudicado,
         CAST(fecha_apertura AS VARCHAR) AS fecha_apertura, modalidad || chr(10) || '"' || rubro || '", x' AS rubro
  FROM licitaciones"""))
def csv_round_trip(t: Tables) -> DataFrame:
    """Tenders written as CSV files and read back, with quotes and line breaks inside a value."""
    folder = f"{shared_folder(t.spark).rstrip('/')}/lictor/csv-{uuid.uuid4().hex}"
    rows = t.licitaciones().select(
        "licitacion_id", "organismo", "proveedor", "monto_adjudicado", "fecha_apertura",
        F.concat("modalidad", F.lit('\n"'), "rubro", F.lit('", x')).alias("rubro"),
    )
    rows.write.csv(folder, header=True, escape='"', quoteAll=True)
    found = sources.read_file(t.spark, folder, "licitaciones")
    return found.withColumns({
        "licitacion_id": F.col("licitacion_id").cast("string"), "monto_adjudicado": F.col("monto_adjudicado").cast("double"),
        "fecha_apertura": F.col("fecha_apertura").cast("string"),
    })


@query(with_tables("auditorias", """
  SELECT CAST(empresa_id AS VARCHAR) AS empresa, strftime(fecha, '%Y-%m-%d') AS fecha, tiene_programa_integridad, score_efectividad,
         CAST(NULL AS VARCHAR) AS hallazgos, 'MEACI' AS fuente
  FROM auditorias"""))
def audit_columns(t: Tables) -> DataFrame:
    export = t.auditorias().select(
        F.lit("").alias("Empresa"), F.col("empresa_id").alias("Razon Social"), F.date_format("fecha", "yyyy-MM-dd").alias("Fecha"),
        F.col("tiene_programa_integridad").cast("string").alias("Programa Integridad"),
        F.lit(None).cast("string").alias("Score Efectividad"), F.col("score_efectividad").alias("Score"),
    )
    return sources.harmonise_audits(export)


@query(with_tables("votos", """
  SELECT 'DIPUTADOS' AS camara, CAST(votacion_id AS VARCHAR) AS expediente, 'Ley ' || votacion_id AS titulo,
         CAST(fecha AS VARCHAR) AS fecha, CAST(legislador_id AS VARCHAR) AS legislador, voto, CAST(NULL AS VARCHAR) AS bloque,
         'HCDN_VOTACIONES' AS fuente
  FROM votos"""))
def vote_columns(t: Tables) -> DataFrame:
    export = t.votos().select(
        F.col("votacion_id").alias("Id Votacion"), F.concat(F.lit("Ley "), "votacion_id").alias("Asunto"),
        F.col("fecha").cast("string").alias("Fecha"), F.col("legislador_id").alias("Diputado"), F.col("voto").alias("Voto"),
    )
    return sources.harmonise_votes(export)


@query(with_tables("votos", """
  SELECT 'DIPUTADOS' AS camara, CAST(votacion_id AS VARCHAR) AS expediente,
         CASE WHEN votacion_id % 2 = 0 THEN 'Ley "' || votacion_id || '", con coma' || chr(10) || 'y renglon' ELSE 'Ley ' || votacion_id END AS titulo,
         CAST(fecha AS VARCHAR) AS fecha, CAST(legislador_id AS VARCHAR) AS legislador, voto,
         CASE WHEN votacion_id % 2 = 0 THEN 'B' || legislador_id END AS bloque, 'HCDN_VOTACIONES' AS fuente
  FROM votos"""))
def vote_files(t: Tables) -> DataFrame:
    """Votes from many CSV files in two layouts, with quotes and line breaks, a missing file among them."""
    folder = f"{shared_folder(t.spark).rstrip('/')}/lictor/votos-{uuid.uuid4().hex}"
    rows, even = t.votos(), F.pmod("votacion_id", F.lit(2)) == 0
    date = F.col("fecha").cast("string")
    old = rows.filter(~even).select(F.col("votacion_id").alias("Expediente"), F.concat(F.lit("Ley "), "votacion_id").alias("Titulo"), date.alias("Fecha"),
                                    F.col("legislador_id").alias("Diputado"), F.col("voto").alias("Voto"))
    title = F.concat(F.lit('Ley "'), "votacion_id", F.lit('", con coma\ny renglon'))
    new = rows.filter(even).select(F.concat(F.lit("B"), "legislador_id").alias("Bloque"), F.col("voto").alias("VOTO"), F.col("legislador_id").alias("Legislador"),
                                   date.alias("fecha"), title.alias("Asunto"), F.col("votacion_id").alias("Id Votacion"))
    paths = [f"{folder}/no-hay.csv"]
    for name, table in (("viejo", old), ("nuevo", new)):
        table.repartition(4).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/{name}")
        paths += t.spark.read.text(f"{folder}/{name}").inputFiles()
    votes, skipped = sources.read_votes(t.spark, paths)
    if not set(skipped) <= {paths[0]}:
        raise AssertionError(skipped)
    return votes



@query(with_tables("indicadores", """
  SELECT pais_iso3, CAST(anio AS INTEGER) AS anio, 'CPI' AS indicador, valor, 'TRANSPARENCY_INTERNATIONAL_CPI' AS fuente
  FROM indicadores WHERE indicador = 'CPI'"""))
def cpi_unpivot(t: Tables) -> DataFrame:
    cpi = t.indicadores().filter("indicador = 'CPI'")
    years = [r[0] for r in cpi.select("anio").distinct().orderBy("anio").collect()]
    wide = cpi.groupBy(F.col("pais_iso3").alias(" ISO3 ")).agg(
        *[F.max(F.when(F.col("anio") == y, F.col("valor"))).alias(f"CPI score {y}") for y in years]
    )
    return macro.unpivot_perception_index(wide)


GOVERNANCE = """
  SELECT pais_iso3, CAST(anio AS INTEGER) AS anio, CASE WHEN anio % 2 = 0 THEN 'WGI_CONTROL_CORRUPCION' ELSE 'XX.EST' END AS indicador,
         valor, 'WORLD_BANK_WGI' AS fuente
  FROM indicadores WHERE indicador = 'WGI_CONTROL_CORRUPCION' AND valor <> 0"""


def governance_answers(t: Tables) -> DataFrame:
    """One JSON answer per country; a value of 0 is left out as null."""
    item = F.struct(
        F.col("pais_iso3").alias("countryiso3code"), F.col("anio").cast("string").alias("date"),
        F.struct(F.when(F.col("anio") % 2 == 0, "CC.EST").otherwise("XX.EST").alias("id")).alias("indicator"),
        F.when(F.col("valor") != 0, F.col("valor")).alias("value"),
    )
    per_country = t.indicadores().filter("indicador = 'WGI_CONTROL_CORRUPCION'").groupBy("pais_iso3").agg(
        F.to_json(F.collect_list(item)).alias("items")
    )
    return per_country.select(F.concat(F.lit('[{"page": 1}, '), "items", F.lit("]")).alias("value"))


@query(with_tables("indicadores", GOVERNANCE))
def governance_flatten(t: Tables) -> DataFrame:
    return macro.flatten_governance(governance_answers(t))


@query(with_tables("indicadores", GOVERNANCE + " AND pais_iso3 IN ('P03', 'P07')"))
def governance_countries(t: Tables) -> DataFrame:
    return macro.flatten_governance(governance_answers(t), ("P03", "P07"))


CPI_ROWS = """SELECT * FROM (VALUES ('ARG', 2024, 'CPI', 37.0::DOUBLE, 'Transparency International CPI 2024'),
  ('ARG', 2025, 'CPI', 36.0, 'Transparency International CPI 2025')) c(pais_iso3, anio, indicador, valor, fuente)"""


@query(with_tables("indicadores", f"{CPI_ROWS} UNION ALL SELECT * FROM g", g=GOVERNANCE))
def macro_with_live(t: Tables) -> DataFrame:
    return macro.macro_with_fallback(t.spark, macro.flatten_governance(governance_answers(t)))


@query(with_tables("indicadores", f"""{CPI_ROWS} UNION ALL SELECT * FROM (VALUES
  ('ARG', 2022, 'WGI_CONTROL_CORRUPCION', -0.45::DOUBLE, 'World Bank WGI'), ('ARG', 2023, 'WGI_CONTROL_CORRUPCION', -0.36, 'World Bank WGI')) w
  WHERE NOT EXISTS (SELECT 1 FROM indicadores WHERE pais_iso3 = 'ZZZ')"""))
def macro_without_live(t: Tables) -> DataFrame:
    return macro.macro_with_fallback(t.spark, macro.flatten_governance(governance_answers(t), ("ZZZ",)))


@query(with_tables("indicadores", "SELECT * REPLACE (CAST(anio AS INTEGER) AS anio) FROM indicadores WHERE pais_iso3 = 'P07' AND indicador = 'CPI'"))
def macro_lookup(t: Tables) -> DataFrame:
    return macro.macro_lookup(t.indicadores(), "p07", "CPI")


@query(with_tables("indicadores", """
  SELECT pais_iso3, CAST(anio AS INTEGER) AS anio, indicador,
         CASE WHEN n.valor IS NOT NULL THEN n.valor ELSE v.valor END AS valor, coalesce(v.fuente, 'pipeline') AS fuente
  FROM (SELECT * FROM indicadores WHERE anio <= 1996) v FULL JOIN (SELECT pais_iso3, anio, indicador, valor + 1 AS valor FROM indicadores
       WHERE anio >= 1996) n USING (pais_iso3, anio, indicador)"""))
def macro_upsert(t: Tables) -> DataFrame:
    stored = t.indicadores().filter("anio <= 1996")
    batch = t.indicadores().filter("anio >= 1996").withColumn("valor", F.col("valor") + 1)
    return sinks.merge_macro(stored, batch.withColumn("fuente", F.lit(None).cast("string")))


NAMED = """SELECT DISTINCT organismo AS nombre, 'ORGANISMO_PUBLICO' AS tipo FROM licitaciones WHERE organismo IS NOT NULL
  UNION ALL SELECT DISTINCT proveedor, 'EMPRESA' FROM licitaciones WHERE proveedor IS NOT NULL"""
STORED = "SELECT sha256('nombre|' || nombre || '|' || tipo) AS entidad_id, nombre, tipo FROM n"


@query(with_tables("licitaciones", "SELECT nombre, tipo, 'pipeline' AS fuente FROM n", n=NAMED))
def entities_from_tenders(t: Tables) -> DataFrame:
    return sinks.entities_of(t.licitaciones(dates=False)).select("nombre", "tipo", "fuente")


def stored_entities(t: Tables) -> DataFrame:
    """The entities of all tenders merged into an empty store."""
    found = sinks.entities_of(t.licitaciones(dates=False))
    return sinks.merge_entities(found.select(F.lit("").alias("entidad_id"), "*").filter("false"), found)


@query(with_tables("licitaciones", f"""
  SELECT entidad_id, nombre, tipo, CAST(NULL AS VARCHAR) AS identificador_fiscal, 'pipeline' AS fuente FROM ({STORED})
  UNION ALL SELECT DISTINCT sha256('fiscal|' || 30000000 + p_partkey // 2), min(p_name) , 'EMPRESA', CAST(30000000 + p_partkey // 2 AS VARCHAR), 'partes'
  FROM part GROUP BY p_partkey // 2""", n=NAMED))
def entity_upsert(t: Tables) -> DataFrame:
    """A second batch: known names again, and companies with a tax id each of which comes twice."""
    taxed = t.raw("part").select(
        F.col("p_name").alias("nombre"), F.lit("EMPRESA").alias("tipo"), F.lit("partes").alias("fuente"),
        (F.lit(30000000) + F.floor(F.col("p_partkey") / 2)).cast("string").alias("identificador_fiscal"),
        F.lit(None).cast("string").alias("domicilio"),
    )
    again = sinks.entities_of(t.licitaciones(), "otra")
    merged = sinks.merge_entities(stored_entities(t), again.unionByName(taxed))
    return merged.select("entidad_id", "nombre", "tipo", "identificador_fiscal", "fuente")


@query(with_tables("licitaciones", """
  SELECT sha256('licitacion|' || licitacion_id) AS licitacion_id, CAST(licitacion_id AS VARCHAR) AS fuente_id_externo, e.entidad_id AS organismo_id,
         rubro, CAST(presupuesto_oficial AS DOUBLE) AS presupuesto_oficial, CAST(fecha_apertura AS VARCHAR) AS fecha_apertura,
         CAST(fecha_adjudicacion AS VARCHAR) AS fecha_adjudicacion,
         CAST(monto_adjudicado AS DOUBLE) * CASE WHEN licitacion_id % 3 = 0 THEN 2 ELSE 1 END AS monto_adjudicado,
         modalidad, CASE WHEN licitacion_id % 3 = 0 THEN 'segunda' ELSE 'primera' END AS fuente
  FROM licitaciones JOIN e ON e.nombre = organismo AND tipo = 'ORGANISMO_PUBLICO'""", n=NAMED, e=STORED))
def tender_upsert(t: Tables) -> DataFrame:
    """All tenders, then a batch that changes every third one twice; the later change wins."""
    entities, tenders = cut(stored_entities(t)), t.stored("licitaciones").withColumn("objeto", F.lit(None).cast("string"))
    nothing = tenders.sparkSession.createDataFrame([], STORED_TENDER)
    first = sinks.merge_tenders(nothing, tenders, entities, source="primera")
    third = tenders.filter(F.pmod("licitacion_id", F.lit(3)) == 0)
    batch = third.withColumn("vez", F.explode(F.array(F.lit(1), F.lit(2))))
    batch = batch.withColumn("monto_adjudicado", F.when(F.col("vez") == 2, F.col("monto_adjudicado") * 2).otherwise(0))
    return _plain_tenders(sinks.merge_tenders(first, batch, entities, "vez", "segunda"))


STORED_TENDER = (
    "licitacion_id string, fuente_id_externo string, organismo_id string, objeto string, rubro string, presupuesto_oficial decimal(18,2), "
    "fecha_apertura date, fecha_adjudicacion date, monto_adjudicado decimal(18,2), modalidad string, fuente string"
)


def _plain_tenders(df: DataFrame) -> DataFrame:
    return df.drop("objeto").withColumns({
        **{c: F.col(c).cast("double") for c in ("presupuesto_oficial", "monto_adjudicado")},
        **{c: F.col(c).cast("string") for c in ("fecha_apertura", "fecha_adjudicacion")},
    })


@query(with_tables("licitaciones", """
  SELECT o.entidad_id AS origen_id, d.entidad_id AS destino_id, 'ADJUDICACION' AS tipo_relacion,
         CASE WHEN peso = 0 THEN 1 ELSE peso END AS peso, 'r1' AS run_id
  FROM (SELECT organismo, proveedor, CAST(sum(monto_adjudicado) AS DOUBLE) AS peso FROM licitaciones
        WHERE proveedor IS NOT NULL GROUP BY 1, 2)
  JOIN e o ON o.nombre = organismo JOIN e d ON d.nombre = proveedor""", n=NAMED, e=STORED))
def edges_append(t: Tables) -> DataFrame:
    return sinks.edge_history(graph.award_edges(t.licitaciones()), stored_entities(t), "r1")


@query(with_tables("licitaciones", """
  SELECT sha256('licitacion|' || licitacion_id) AS licitacion_id, 'TOTAL' AS capa, opacidad AS opacidad, 'r1' AS run_id
  FROM (SELECT licitacion_id, CAST(round(((presupuesto_oficial IS NULL)::INT + (fecha_adjudicacion IS NULL)::INT) / 6::DOUBLE * 100, 2) AS DOUBLE)
          AS opacidad FROM licitaciones)"""))
def scores_append(t: Tables) -> DataFrame:
    tenders = t.stored("licitaciones")
    nothing = tenders.sparkSession.createDataFrame([], STORED_TENDER)
    stored = sinks.merge_tenders(nothing, tenders.withColumn("objeto", F.lit(None).cast("string")), stored_entities(t))
    history = sinks.score_history(risk.risk_index(tenders, finance.hhi(tenders)), stored, "r1")
    return history.select("licitacion_id", "capa", F.try_element_at("desglose", F.lit("opacidad")).alias("opacidad"), "run_id")
