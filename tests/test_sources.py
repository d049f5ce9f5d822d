import json

from lictor.functions import text
from lictor.plans.report import Report, write_report
from lictor.sinks import tables as sinks
from lictor.sources import macro, pages
from lictor.sources import tables as sources

NOTICE = """El Decreto 9/2025 trata el Expediente EX-2023-87654321- -APN-SG#JGM. La firma VIALES DEL
OESTE S.A. (CUIT 30-70111222-3), representada por la Dra. María Laura Núñez, cobra $ 3.500.000,75 del MINISTERIO DE
ECONOMÍA y de la SECRETARIA DE ENERGIA; AGRO SUR S.R.L., CUIT 33-7011122-9, figura ante la ANSES."""


def test_six_kinds_of_entities(table):
    df = table("documento string, texto string", ("d", NOTICE), ("e", "  \n"), ("f", None))
    found = {r["documento"]: r for r in text.extract_entities(df).collect()}
    names = {}
    for e in found["d"]["entidades"]:
        names.setdefault(e["tipo"], []).append(e["nombre"])
    assert names["cuit"] == ["30-70111222-3", "33-7011122-9"]
    assert names["monto"] == ["$ 3.500.000,75"] and names["persona"] == ["María Laura Núñez"]
    assert names["expediente"] == ["EX-2023-87654321- -APN-SG#JGM"]
    assert any(e.endswith("VIALES DEL OESTE S.A") for e in names["empresa"]) and "AGRO SUR S.R.L" in names["empresa"]
    assert {"ANSES", "MINISTERIO DE ECONOMÍA", "SECRETARIA DE ENERGIA"} <= set(names["organismo"])
    assert found["d"]["motor_personas"] == "heuristico_titulos"
    assert found["e"]["entidades"] == [] == found["f"]["entidades"] and found["e"]["motor_personas"] is None


def read(table, rows, parse, html):
    return [{k: v for k, v in r.items() if k != "page_id"} for r in rows(parse(table("page_id long, html string", (1, html), (2, None))), "page_id")]


def test_notices(table, rows):
    block = '<div class="aviso-item"><b class="denominacion">Uno<br>Dos</b><i class=Fecha>1/2/2025</i><a href="/x?a=1&amp;b=2">v</a></div>'
    assert read(table, rows, pages.gazette_notices, f"<body>{block}<div class='card-aviso'>") == [
        {"titulo": "UnoDos", "fecha": "1/2/2025", "organismo": None, "url": "/x?a=1&b=2", "fuente": "BORA"},
        {"titulo": None, "fecha": None, "organismo": None, "url": None, "fuente": "BORA"},
    ]
    plain = "<ul><li>Resolución del 3/08/2025 <a href='/detalleAviso/7'>Texto</a><li>Otra <a href='/otra/7'>No</a></ul>"
    assert read(table, rows, pages.gazette_notices, plain) == [
        {"titulo": "Texto", "fecha": "3/08/2025", "organismo": None, "url": "/detalleAviso/7", "fuente": "BORA"}
    ]


def test_rulings(table, rows):
    known = "<div class='doc-item'><span class='caratula'>A c/ B</span><p class='sumario'>Se dicta <b>pena</b><script>x</script></p></div>"
    assert read(table, rows, pages.court_rulings, known)[0]["texto_fallo"] == "Se dicta pena"
    plain = "<article><h3>Corto</h3></article><article><h2>C c/ D</h2><p>Resuelto el 10/06/2025</article>"
    assert read(table, rows, pages.court_rulings, plain) == [
        {"caratula": "C c/ D", "fuero": None, "fecha_resolucion": "10/06/2025", "texto_fallo": "C c/ D Resuelto el 10/06/2025",
         "fuente": "SAIJ_PODER_JUDICIAL"}
    ]


def test_the_innermost_open_element_is_taken(table, rows):
    """Closed neighbours, elements inside elements, stray closing tags, and links and headings without any."""
    dates = lambda html: sorted((r["titulo"], r["fecha"]) for r in read(table, rows, pages.gazette_notices, html))
    assert dates("<li>05/08/2026<div>Sub</div><a href='/aviso/1'>Titulo</a></li>") == [("Titulo", "05/08/2026")]
    assert dates("<div>1/1/2020<div>x</div><table><tr><td>7/8/2026<td><a href='/detalle/1'>Fila</a></tr></table></div>") == [("Fila", "7/8/2026")]
    assert dates("<p>9/8/2026</p><a href=/aviso/1><b>So</b> lo</a>") == [("Solo", None)]
    assert dates("</div><div>3/8/2026 </li><a href='/aviso/1'>T</a></div>4/4/2026<a href='/aviso/2'>U</a>") == [("T", "3/8/2026"), ("U", None)]
    assert dates("<div><div>2/2/2026</div><div>x</div><a href='/aviso/1'>A</a> 3/3/2026</div>") == [("A", "2/2/2026")]
    cases = lambda html: [(r["caratula"], r["fecha_resolucion"], r["texto_fallo"]) for r in read(table, rows, pages.court_rulings, html)]
    page = "<article><div>Sala I de la camara</div><h3>Caso A contra B</h3><p>Fallo del 10/06/2026, prescripta.</p></article>"
    assert cases(page) == [("Caso A contra B", "10/06/2026", "Sala I de la camara Caso A contra B Fallo del 10/06/2026, prescripta.")]
    nested = "<div><h2>Primer asunto</h2><ul><li><h4>Otro <i>caso</i></h4> 1/2/2026 firme</li></ul>fin</div><h3>Sin bloque alguno</h3> 3/3/2026"
    assert sorted(cases(nested)) == [
        ("Otrocaso", "1/2/2026", "Otro caso 1/2/2026 firme"), ("Primer asunto", "1/2/2026", "Primer asunto Otro caso 1/2/2026 firme fin"),
        ("Sin bloque alguno", None, "Sin bloque alguno")]
    assert cases("<div><h3>Corto</h3></div><h3></h3>") == []


def test_long_pages_stay_linear(table, rows):
    """One block with many links, and tags that are never closed."""
    many = "<div>1/1/2026" + "".join(f"<a href='/aviso/{i}'>t{i}</a>" for i in range(3000)) + "</div>"
    found = read(table, rows, pages.gazette_notices, many)
    assert len(found) == 3000 and {r["fecha"] for r in found} == {"1/1/2026"}
    deep = "<div>" * 3000 + "2/2/2026<a href='/aviso/1'>t</a>"
    assert [r["fecha"] for r in read(table, rows, pages.gazette_notices, deep)] == ["2/2/2026"]


VOTES = ("<table><tr><th>Otra</table><table><tr><th>Fecha<th>Asunto<th>Diputado<th>Voto<tr><td>1/8<td>Ley<td>Ana<td>SI"
         "<tr><td>1/8<td>Ley</table>")


def test_vote_tables(table, rows):
    found = read(table, rows, pages.roll_calls, VOTES)
    assert [(r["fecha"], r["titulo"], r["legislador"], r["voto"], r["expediente"]) for r in found] == [
        ("1/8", "Ley", "Ana", "SI", None), ("1/8", "Ley", None, None, None)
    ]
    assert read(table, rows, pages.roll_calls, VOTES + "<a href='/acta.CSV'>x</a>") == []
    assert read(table, rows, pages.roll_calls, "<p>nada") == [] == read(table, rows, pages.senate_votes, "<p>nada")
    senate = "<table><tr><th>F</tr><tr><td>2/8</td><td>S-1</td></tr><tr><td>2/8</td><td>S-2</td><td>Convenio</td><td>APROBADO</td></tr></table>"
    assert [(r["expediente"], r["resultado"]) for r in read(table, rows, pages.senate_votes, senate)] == [("S-2", "APROBADO")]


def test_data_links(table, rows):
    html = "<!-- <a href='/no.csv'> --><A class=x HREF='/a.csv'>1</A> <a href=\"https://z/b.XLSX\">2</a><a href='/c.pdf'>3</a>"
    found = rows(pages.data_links(table("page_id long, html string", (1, html)), "https://base"), "url")
    assert [r["url"] for r in found] == ["https://base/a.csv", "https://z/b.XLSX"]


def test_csv_by_header_name(spark, tmp_path, rows):
    (tmp_path / "l.csv").write_text("proveedor,licitacion_id,monto_adjudicado,fecha_apertura\nX,1,10.5,2024-01-01\nY,2,mal,nunca\n")
    found = rows(sources.read_file(spark, str(tmp_path / "l.csv"), "licitaciones"), "licitacion_id")
    assert [(r["proveedor"], r["monto_adjudicado"] and float(r["monto_adjudicado"])) for r in found] == [("X", 10.5), ("Y", None)]
    assert str(found[0]["fecha_apertura"]) == "2024-01-01" and found[1]["fecha_apertura"] is None
    assert sources.read_tenders(spark, str(tmp_path / "l.csv")).first()["url_origen"].endswith("l.csv")
    votes = tmp_path / "v.csv"
    votes.write_text("Diputado,Voto,Id Votacion,Expediente\nAna,SI,7,\n")
    (tmp_path / "w x.csv").write_text('Legislador,Voto,Expediente\n"Luis\nPaz",NO,8-D\n')
    (tmp_path / "y.csv").write_text("Diputado,Voto,Id Votacion,Expediente\nEva,SI,9,\n")
    (tmp_path / "empty.csv").write_text("")
    names = [str(tmp_path / n) for n in ("v.csv", "missing.csv", "w x.csv", "empty.csv", "y.csv")]
    found, skipped = sources.read_votes(spark, names)
    assert [(r["legislador"], r["expediente"]) for r in rows(found, "expediente")] == [("Ana", "7"), ("Luis\nPaz", "8-D"), ("Eva", "9")]
    assert skipped == [str(tmp_path / "missing.csv"), str(tmp_path / "empty.csv")]
    assert sources.read_votes(spark, [str(tmp_path / "missing.csv")]) == (None, [str(tmp_path / "missing.csv")])
    (tmp_path / "m.csv").write_text('licitacion_id,organismo\n1,"Obra\nnueva"\n')
    assert [r["organismo"] for r in rows(sources.read_file(spark, str(tmp_path / "m.csv"), "licitaciones"), "licitacion_id")] == ["Obra\nnueva"]


def test_report_with_tenders_of_every_kind(spark, table, rows, tmp_path):
    tenders = table(
        "licitacion_id string, organismo string, proveedor string, monto_adjudicado double, fecha_apertura string, fecha_adjudicacion string",
        *[(f"L{i}", "AB"[i % 2], "XYZ"[i % 3], [100.0, 0.0, 250.0, 90.0][i % 4] * (i != 5), "2024-01-01", "2024-02-01") for i in range(8)],
        ("L8", "C", "W", 0.0, "2024-01-01", None))
    bids = table("licitacion_id string, empresa_id string, monto_ofertado double, resultado string",
                 *[(f"L{i}", e, 100.0 + i, "GANADORA" if e == "XYZ"[i % 3] else "PERDEDORA") for i in range(8) for e in "XY"])
    addenda = table("licitacion_id string, monto_original double, monto_nuevo double", ("L0", 100.0, 150.0))
    entities = table("entidad_id string, domicilio string", ("X", "calle 1"), ("Y", "calle 1"))
    report = Report(spark, {"licitaciones": tenders, "ofertas": bids, "adendas": addenda, "entidades": entities})
    summary = write_report(report, str(tmp_path / "out"))
    assert {r["bloque"] for r in summary.collect() if r["disponible"]} == set(Report.BLOCKS)
    risk = rows(spark.read.json(f"{tmp_path}/out/riesgo_ircs"), "licitacion_id")
    assert len(risk) == 9 and all(0 <= r["ircs"] <= 100 and r["network_score"] is not None and r["anomaly_score"] is not None for r in risk)
    assert {r["entity"] for r in rows(spark.read.json(f"{tmp_path}/out/redes"), "entity")} == set("ABCXYZW")
    assert spark.read.json(f"{tmp_path}/out/anomalias").count() == 9


def test_first_alias_present_wins_even_if_null(table, rows):
    df = table("`ID ` int, organismo string, reparticion string", (7, None, "R"))
    found = rows(sources.harmonise_tenders(df, "u"), "url_origen")[0]
    assert found["organismo"] is None and found["fuente_id_externo"] == "7" and found["proveedor"] is None


def test_indices(spark, table, rows, tmp_path):
    wide = table("Country string, `ISO3` string, `CPI score 2023` string, `CPI Score` string, `cpi_score 2024` string",
                 ("A", " ARG ", "37", "1", None), ("B", None, "1", "1", "1"))
    assert [(r["pais_iso3"], r["anio"], r["valor"]) for r in rows(macro.unpivot_perception_index(wide), "anio")] == [("ARG", 2023, 37.0)]
    assert macro.unpivot_perception_index(wide.drop("ISO3")) is None
    items = [{"countryiso3code": "ARG", "date": "2023", "indicator": {"id": i, "value": "x"}, "value": v} for i, v in [("CC.EST", -0.4), ("ZZ", 1), ("CC.EST", None)]]
    (tmp_path / "arg.json").write_text(json.dumps([{"page": 1}, items], indent=1))
    (tmp_path / "bra.json").write_text(json.dumps([{"message": "none"}]))
    live = macro.read_governance(spark, str(tmp_path))
    assert [(r["indicador"], r["valor"]) for r in rows(live, "indicador")] == [("WGI_CONTROL_CORRUPCION", -0.4), ("ZZ", 1.0)]
    assert macro.macro_with_fallback(spark, live).count() == 4
    assert rows(macro.macro_with_fallback(spark, live.filter("false")), "valor")[0]["valor"] == -0.45
    assert macro.macro_lookup(live, "arg", "ZZ").count() == 1


def test_merges_are_idempotent(spark, table, rows):
    empty = table("entidad_id string, tipo string, nombre string, identificador_fiscal string, domicilio string, fuente string")
    incoming = table("nombre string, tipo string, fuente string, identificador_fiscal string, domicilio string",
                     ("E", "EMPRESA", "t", "30-1", "old"), ("E", "EMPRESA", "t", None, None), ("O", "ORGANISMO_PUBLICO", "t", "", None))
    once = sinks.merge_entities(empty, incoming)
    renamed = table(incoming.schema, ("Other", "EMPRESA", "t", "30-1", "new"), ("O", "ORGANISMO_PUBLICO", "t", None, None))
    assert rows(once, "nombre") == rows(sinks.merge_entities(once, renamed), "nombre") and once.count() == 2

    none = table("pais_iso3 string, anio int, indicador string, valor double, fuente string")
    first = sinks.merge_macro(none, table(none.schema, ("TST", 2099, "CPI", 50.0, "t"), ("TST", None, "CPI", 1.0, "t")))
    again = sinks.merge_macro(first, table(none.schema, ("TST", 2099, "CPI", 60.0, None)))
    assert rows(again, "anio") == [{"pais_iso3": "TST", "anio": 2099, "indicador": "CPI", "valor": 60.0, "fuente": "t"}]


def test_run_histories(table, rows, tmp_path, spark):
    tenders = table("licitacion_id string, organismo string, proveedor string", ("L1", "O", "E"))
    found = sinks.entities_of(tenders)
    store = sinks.merge_entities(found.selectExpr("'' AS entidad_id", "*").filter("false"), found)
    edges = table("origen_id string, destino_id string, peso double", ("O", "E", 0.0), ("O", "?", 1.0))
    for run in ("r1", "r2", "r2"):
        sinks.append_run(sinks.edge_history(edges, store, run), str(tmp_path / "edges"))
    kept = rows(spark.read.parquet(str(tmp_path / "edges")), "run_id")
    assert [(r["run_id"], r["peso"]) for r in kept] == [("r1", 1.0), ("r2", 1.0)]
    stored = table("fuente_id_externo string, licitacion_id string", ("L1", "id1"))
    scores = table("licitacion_id string, ircs double, ircs_componentes struct<redes: double>", ("L1", 72.5, (100.0,)), ("L2", 1.0, (1.0,)))
    assert rows(sinks.score_history(scores, stored, "r1"), "score")[0]["desglose"] == {"redes": 100.0}


def test_report_without_tenders(spark, table, tmp_path, rows):
    bids = table("licitacion_id string, empresa_id string, resultado string", ("L1", "X", "GANADORA"), ("L1", "Y", "PERDEDORA"))
    summary = write_report(Report(spark, {"ofertas": bids}), str(tmp_path))
    assert {r["bloque"] for r in summary.filter("disponible").collect()} == {"co_presentismo"}
    assert spark.read.json(str(tmp_path / "co_presentismo")).first()["co_presentismo"] == 1
    assert spark.read.json(str(tmp_path / "reglas_patrones")).count() == 8
