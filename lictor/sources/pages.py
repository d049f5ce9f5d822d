"""Records in stored HTML pages, with Column expressions only: cut out blocks, rows and cells, then explode them.

The layouts are flat lists of records. A block of a known class runs from its opening tag to the closing tag that balances
it (or to the page's end); a table row or cell to the next one. Where records are found by their links or headings, the page
becomes a sequence of tags and texts, one row each, and running sums over it tell which element is open where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Class names, link paths and source labels of the known page layouts.
NOTICE_CLASSES = ("resultado-aviso", "aviso-item", "card-aviso")
NOTICE_LINK = r"/(?:detalleAviso|aviso|detalle)/"
RULING_CLASSES = ("resultado-documento", "doc-item")
DATE = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
GAZETTE, COURTS, DEPUTIES, SENATE = "BORA", "SAIJ_PODER_JUDICIAL", "HCDN_VOTACIONES", "SENADO_VOTACIONES"

HIDDEN = r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>"
HREF = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"


def _visible() -> Column:
    return F.regexp_replace("html", HIDDEN, "")


def _decoded(value: Column) -> Column:
    """The character references that the layouts use."""
    for name, letter in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("amp", "&")):
        value = F.replace(value, F.lit(f"&{name};"), F.lit(letter))
    return value


def _text(markup: Column, separator: str = "") -> Column:
    """The trimmed pieces of text between tags; null stays null."""
    pieces = F.transform(F.split(markup, r"<[^>]*>"), lambda piece: F.regexp_replace(_decoded(piece), r"^[\s ]+|[\s ]+$", ""))
    return F.array_join(F.filter(pieces, lambda piece: piece != ""), separator)


def _or_null(value: Column) -> Column:
    return F.when(value != "", value)


def _starting(markup: Column, opening: str) -> Column:
    """The page from each matching opening tag up to the next one; what stands before the first is left out."""
    parts = F.split(markup, f"(?i)(?={opening})")
    return F.filter(parts, lambda part: part.rlike(f"(?i)^{opening}"))


def _pieces(markup: Column) -> Column:
    """Cut before every closing tag of the name that the markup begins with."""
    return F.split(markup, F.concat(F.lit("(?i)(?=</"), F.regexp_extract(markup, r"^<(\w+)", 1), F.lit(r"\b)")))


def _opens(markup: Column, pieces: Column) -> Column:
    tag = F.regexp_extract(markup, r"^<(\w+)", 1)
    return F.transform(pieces, lambda piece: F.regexp_count(piece, F.concat(F.lit("(?i)<"), tag, F.lit(r"\b"))))


def _block(pieces: Column, opens: Column) -> Column:
    """The pieces up to the first place with no more openings than pieces, or all."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("open"), F.lit(False).alias("done"))
    step = lambda a, x: F.struct(
        (a["n"] + F.when(a["done"], 0).otherwise(1)).alias("n"), (a["open"] + F.when(a["done"], 0).otherwise(x)).alias("open"),
        (a["done"] | (a["open"] + x <= a["n"] + 1)).alias("done"))
    return F.array_join(F.slice(pieces, 1, F.greatest(F.lit(1), F.aggregate(opens, start, step, lambda a: a["n"]))), "")


def _balanced(markup: Column) -> Column:
    """From the opening tag at the start to the closing tag that balances it, for short markup."""
    return _block(_pieces(markup), _opens(markup, _pieces(markup)))


def _with_block(df: DataFrame, markup: str) -> DataFrame:
    """The same in steps of their own, so that long markup is cut once: the column is replaced by its block."""
    return (
        df.withColumn("_pieces", _pieces(F.col(markup))).withColumn("_opens", _opens(F.col(markup), F.col("_pieces")))
        .withColumn(markup, _block(F.col("_pieces"), F.col("_opens"))).drop("_pieces", "_opens")
    )


def _classed(names: str, whole: bool) -> str:
    """An opening tag with a class that is one of the names, or that contains one of them."""
    value = (lambda q: rf"(?:[^{q}]*\s)?(?:{names})(?:\s[^{q}]*)?") if whole else (lambda q: rf"[^{q}]*(?:{names})[^{q}]*")
    bare = rf"(?:{names})(?=[\s>])" if whole else rf"[^\s>\"']*(?:{names})[^\s>\"']*"
    return rf"<\w+\b[^>]*?\sclass\s*=\s*(?:\"{value(chr(34))}\"|'{value(chr(39))}'|{bare})[^>]*>"


def _field(block: Column, names: str, separator: str = "") -> Column:
    """Text of the first element whose class contains one of the names."""
    found = F.regexp_substr(block, F.lit(f"(?is){_classed(names, False)}.*"))
    return F.when(found.isNotNull(), _text(_balanced(found), separator))


def _href(markup: Column) -> Column:
    """The first link's target."""
    found = [_or_null(F.regexp_extract(markup, HREF, i)) for i in (1, 2, 3)]
    return _decoded(F.coalesce(*found))


def _first_date(text: Column) -> Column:
    return F.regexp_substr(text, F.lit(DATE))


def _sequence(pages: DataFrame) -> DataFrame:
    """(page_id, at, size, part, name, delta, texto): a page's tags in order, each with the text behind it.

    delta is 1 for an opening tag and -1 for a closing one; texto is null where there is none; size is the page's number of parts.
    """
    parts = F.split("html", "(?=<)")
    rows = pages.select("page_id", F.size(parts).alias("size"), F.posexplode(parts).alias("at", "part"))
    name = F.lower(F.regexp_extract("part", r"^</?(\w+)", 1))
    delta = F.when(F.col("part").startswith("</"), -1).otherwise(1)
    return rows.select("page_id", "at", "size", "part", name.alias("name"), F.when(name != "", delta).otherwise(0).alias("delta"), _or_null(_text(F.col("part"))).alias("texto"))


def _opened(sequence: DataFrame, names: tuple[str, ...], seen_from: DataFrame | None = None) -> DataFrame:
    """(page_id, name, at, fin): where each element of the names begins and ends; an open one ends with its page.

    With `seen_from` (page_id, at) instead (page_id, at, desde, fin): the element of the names that is innermost at each of these
    places, if any. A closing tag closes the last open tag of its name, and is ignored if there is none. The depth of a
    name is its running sum of tags; an element is open as long as the depth does not fall below its own.
    """
    rows = sequence.filter(F.col("name").isin(*names)).select("page_id", "size", "name", "at", "delta")
    if seen_from is not None:
        places = seen_from.select("page_id", F.lit(None).cast("int").alias("size"), F.explode(F.array(*map(F.lit, names))).alias("name"), "at", F.lit(0).alias("delta"))
        rows = rows.unionByName(places)
    order = Window.partitionBy("page_id", "name").orderBy("at", F.abs("delta"))
    rows = rows.withColumn("suma", F.sum("delta").over(order))
    rows = rows.withColumn("minimo", F.least(F.lit(0), F.min("suma").over(order)))
    rows = rows.withColumn("antes", F.least(F.lit(0), F.lag("minimo", 1, 0).over(order)))
    rows = rows.filter("minimo = antes")  # without closing tags that close nothing
    depth = F.col("suma") - F.col("minimo") + F.when(F.col("delta") < 0, 1).otherwise(0)
    level = Window.partitionBy("page_id", "name", "nivel").orderBy("at", F.abs("delta"))
    rows = rows.withColumn("nivel", depth)
    ends = rows.filter("delta <> 0").withColumn("fin", F.coalesce(F.lead("at").over(level), F.col("size"))).filter("delta = 1")
    if seen_from is None:
        return ends.select("page_id", "name", "at", "fin")
    last = F.last(F.when(F.col("delta") == 1, F.col("at")), ignorenulls=True).over(level)
    inside = rows.withColumn("desde", last).filter("delta = 0 AND nivel > 0").select("page_id", "name", "at", "desde")
    inside = inside.join(ends.select("page_id", "name", F.col("at").alias("desde"), "fin"), ["page_id", "name", "desde"])
    return inside.groupBy("page_id", "at").agg(F.max(F.struct("desde", "fin")).alias("m")).select("page_id", "at", "m.desde", "m.fin")


def _joined_texts(spans: DataFrame, sequence: DataFrame, separator: str) -> DataFrame:
    """(page_id, desde, texto) of the spans [desde, fin) of a page: their texts joined. Rows grow with what is returned."""
    places = spans.select("page_id", "desde", F.explode(F.sequence("desde", F.col("fin") - 1)).alias("at"))
    pieces = places.join(sequence.filter("texto IS NOT NULL").select("page_id", "at", "texto"), ["page_id", "at"])
    texts = pieces.groupBy("page_id", "desde").agg(F.sort_array(F.collect_list(F.struct("at", "texto"))).alias("piezas"))
    return texts.select("page_id", "desde", F.array_join(F.col("piezas.texto"), separator).alias("texto"))


def _enclosed(pages: DataFrame, names: tuple[str, ...], around: tuple[str, ...], wanted: Column) -> DataFrame:
    """(page_id, part, propio, bloque): elements of the names whose tag fits, their text, and that of the innermost element
    of `around` about them (or their own); null where there is none."""
    sequence = _sequence(pages)
    found = _opened(sequence, names).join(sequence.select("page_id", "at", "part").filter(wanted), ["page_id", "at"])
    block = _opened(sequence, around, found)
    found = found.join(block.withColumnRenamed("fin", "hasta"), ["page_id", "at"], "left")
    found = found.withColumn("hasta", F.coalesce("hasta", "fin")).withColumn("desde", F.coalesce("desde", "at"))
    own = _joined_texts(found.select("page_id", F.col("at").alias("desde"), "fin"), sequence, "")
    text = _joined_texts(found.select("page_id", "desde", F.col("hasta").alias("fin")).distinct(), sequence, " ")
    own = own.select("page_id", F.col("desde").alias("at"), F.col("texto").alias("propio"))
    return found.join(own, ["page_id", "at"], "left").join(text.withColumnRenamed("texto", "bloque"), ["page_id", "desde"], "left").select("page_id", "part", "propio", "bloque")


def gazette_notices(pages: DataFrame) -> DataFrame:
    """Notices in blocks of the known classes, or else links to notices with the first date around them."""
    marked = pages.select("page_id", _visible().alias("html"))
    marked = marked.select("page_id", "html", _starting(F.col("html"), _classed("|".join(NOTICE_CLASSES), True)).alias("known"))
    block = F.col("block")
    known = _with_block(marked.select("page_id", F.explode("known").alias("block")), "block").select(
        "page_id", _field(block, "titulo|denominacion").alias("titulo"), _field(block, "fecha").alias("fecha"),
        _field(block, "organismo|rubro").alias("organismo"), _href(block).alias("url"),
    )
    # Without known blocks: links to notices, with the innermost list item, section or row around them.
    notice = F.col("part").rlike(r"(?i)^<a\s") & _href(F.col("part")).rlike(f"(?i){NOTICE_LINK}")
    linked = _enclosed(marked.filter(F.size("known") == 0), ("a",), ("li", "div", "article", "tr"), notice).select(
        "page_id", F.col("propio").alias("titulo"), _first_date(F.col("bloque")).alias("fecha"),
        F.lit(None).cast("string").alias("organismo"), _href(F.col("part")).alias("url"))
    return known.unionByName(linked).withColumn("fuente", F.lit(GAZETTE))


def court_rulings(pages: DataFrame) -> DataFrame:
    """Rulings in blocks of the known classes, or else headings with their enclosing block of 15 or more characters."""
    marked = pages.select("page_id", _visible().alias("html"))
    marked = marked.select("page_id", "html", _starting(F.col("html"), _classed("|".join(RULING_CLASSES), True)).alias("known"))
    block = F.col("block")
    known = _with_block(marked.select("page_id", F.explode("known").alias("block")), "block").select(
        "page_id", _field(block, "caratula").alias("caratula"), _field(block, "fuero").alias("fuero"),
        _field(block, "fecha").alias("fecha_resolucion"), _field(block, "texto-fallo|sumario", " ").alias("texto_fallo"),
    )
    # Without known blocks: headings, with the innermost section or list item around them.
    headed = _enclosed(marked.filter(F.size("known") == 0), ("h2", "h3", "h4"), ("article", "li", "div"), F.col("part").rlike(r"(?i)^<h[234]\b"))
    headed = headed.filter(F.length("bloque") >= 15).select(
        "page_id", F.coalesce("propio", F.lit("")).alias("caratula"), F.lit(None).cast("string").alias("fuero"),
        _first_date(F.col("bloque")).alias("fecha_resolucion"), F.col("bloque").alias("texto_fallo"))
    return known.unionByName(headed).withColumn("fuente", F.lit(COURTS))


def _tables(pages: DataFrame) -> DataFrame:
    """page_id, at, headers and rows of cells; every table up to its end or the next one. A table's first row is its head."""
    table = F.posexplode(F.transform(_starting(_visible(), r"<table\b"), lambda t: F.element_at(F.split(t, r"(?i)</table\b"), 1)))
    found = pages.select("page_id", table.alias("at", "table"))
    after = lambda markup, tag: F.slice(F.split(markup, rf"(?i)<{tag}\b[^>]*>"), 2, F.length(markup))
    cell = lambda markup: _text(F.element_at(F.split(markup, r"(?i)<(?:/?t[dhr]\b|/table\b)"), 1))
    headers = F.transform(after(F.col("table"), "th"), lambda h: F.lower(cell(h)))
    rows = F.transform(F.slice(after(F.col("table"), "tr"), 2, F.length("table")), lambda r: F.transform(after(r, "td"), cell))
    return found.select("page_id", "at", headers.alias("headers"), F.filter(rows, lambda r: F.size(r) > 0).alias("rows"))


def roll_calls(pages: DataFrame) -> DataFrame:
    """Votes in the first table whose headers name deputies or votes, of pages that link no data file."""
    files = F.regexp_extract_all(_visible(), F.lit(HREF.replace("([^", "[^").replace("]*)", "]*").replace("]+)", "]+")), F.lit(0))
    plain = pages.filter(~F.exists(files, lambda f: F.lower(f).rlike(r"\.(?:csv|xlsx|xls)[\"']?$")))
    named = _tables(plain).filter(F.array_join("headers", " ").rlike("diputado|legislador|voto"))
    first = named.groupBy("page_id").agg(F.min_by(F.struct("headers", "rows"), "at").alias("t"))
    rows = first.select("page_id", F.col("t.headers").alias("headers"), F.explode("t.rows").alias("cells"))
    cell = lambda *names: F.coalesce(*[F.get("cells", (F.array_position("headers", n) - 1).cast("int")) for n in names], F.lit(None).cast("string"))
    return rows.select(
        "page_id", F.lit("DIPUTADOS").alias("camara"), cell("expediente").alias("expediente"), cell("titulo", "asunto").alias("titulo"),
        cell("fecha").alias("fecha"), cell("diputado", "legislador").alias("legislador"), cell("voto").alias("voto"),
        cell("bloque").alias("bloque"), F.lit(DEPUTIES).alias("fuente"),
    )


def senate_votes(pages: DataFrame) -> DataFrame:
    """Rows of the first table with three or more cells, by position."""
    rows = _tables(pages).filter("at = 0").select("page_id", F.explode("rows").alias("cells")).filter(F.size("cells") >= 3)
    places = {"fecha": 0, "expediente": 1, "titulo": 2, "resultado": 3}
    return rows.select("page_id", F.lit("SENADORES").alias("camara"), *[F.get("cells", F.lit(i)).alias(c) for c, i in places.items()], F.lit(SENATE).alias("fuente"))


def data_links(pages: DataFrame, base_url: str) -> DataFrame:
    """Links to CSV and Excel files, made absolute."""
    hrefs = F.regexp_extract_all(_visible(), F.lit(r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    href = F.regexp_replace("href", "&amp;", "&")
    return (
        pages.select("page_id", F.explode_outer(hrefs).alias("href"))
        .withColumn("href", href)
        .filter(F.lower("href").rlike(r"\.(csv|xlsx|xls)$"))
        .select("page_id", F.when(F.col("href").startswith("http"), F.col("href")).otherwise(
            F.concat(F.lit(base_url), "href")).alias("url"))
    )
