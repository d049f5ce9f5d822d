import datetime as dt

import pytest
from pyspark.sql import functions as F

from lictor.operators import collusion, conduct, finance, judicial, patterns, risk
from registry.adapters import Tables

TENDER = "licitacion_id string, organismo string, proveedor string, monto_adjudicado double"
BID = "licitacion_id string, empresa_id string, resultado string"


def test_hhi_of_one_and_of_two_equal_suppliers(table, rows):
    found = rows(finance.hhi(table(
        TENDER, ("1", "A", "X", 100.0), ("2", "A", "X", 200.0), ("3", "B", "X", 100.0), ("4", "B", "Y", 100.0),
        ("5", "C", None, 50.0), ("6", "C", "X", 50.0), ("7", "D", "X", 0.0), ("8", None, "X", 5.0),
    )), "organismo")
    assert [(r["organismo"], r["hhi"], r["alta_concentracion"]) for r in found] == [
        ("A", 10000.0, True), ("B", 5000.0, True), ("C", 2500.0, False)
    ]
    assert [r["proveedor_dominante"] for r in found] == ["X", "X", "X"]
    assert found[2]["n_proveedores"] == 1 and found[2]["cuota_dominante_pct"] == 50.0


def test_hhi_of_an_empty_table_is_empty(table):
    assert finance.hhi(table(TENDER)).count() == 0


@pytest.mark.parametrize("block", [1, 1000])
def test_co_presence_counts_pairs(table, rows, block):
    bids = table(BID, *[(t, c, None) for t, c in [("L1", "X"), ("L1", "Y"), ("L2", "X"), ("L2", "Y"), ("L2", "Z"), ("L2", "Z")]])
    found = {(r["empresa_a"], r["empresa_b"]): r["co_presentismo"] for r in rows(collusion.co_presence(bids, block=block), "empresa_a")}
    assert found == {("X", "Y"): 2, ("X", "Z"): 1, ("Y", "Z"): 1}


@pytest.mark.parametrize("block", [2, 1000])
def test_alternation_with_a_crowded_tender(table, rows, block):
    crowd = [("HOT", f"E{i}", "PERDEDORA") for i in range(8)]
    shared = [(f"L{i}", e, "GANADORA" if (i % 2 == 0) == (e == "E0") else "PERDEDORA") for i in range(4) for e in ("E0", "E1")]
    found = rows(collusion.win_asymmetry(table(BID, *crowd, *shared), 3, block), "empresa_a")
    assert found == [{"empresa_a": "E0", "empresa_b": "E1", "compartidas": 5, "victorias_a": 2, "victorias_b": 2, "indice_alternancia": 1.0}]


def test_variability_needs_three_bids(table, rows):
    bids = table(
        "empresa_id string, resultado string, porcentaje_sobre_ganadora double",
        *[("A", "PERDEDORA", 0.10 + i / 1000) for i in range(3)], ("B", "PERDEDORA", 0.1), ("A", "DESCALIFICADA", 9.0),
    )
    found = rows(collusion.budget_variability(bids), "empresa_id")
    assert [(r["empresa_id"], r["n_ofertas"], r["sospechoso"]) for r in found] == [("A", 3, True), ("B", 1, False)]
    assert found[1]["desvio_estandar_pct"] is None


def test_low_balling(table, rows):
    tenders = table(TENDER, ("L1", "A", "X", 1000.0), ("L2", "A", "X", 0.0), ("L3", "A", "X", 10.0))
    addenda = table("licitacion_id string, monto_original double, monto_nuevo double", ("L1", 1000.0, 1500.0), ("L1", None, 3.0))
    assert [r["low_balling_ratio"] for r in rows(finance.low_balling(tenders, addenda), "licitacion_id")] == [0.5, None, 0.0]


def test_roi_window_is_open_at_its_start(table, rows):
    day = dt.date(2020, 1, 1)
    donations = table("aportante string, fecha date, monto double", ("X", day, 100.0), ("Y", day, 0.0), ("Z", day, 5.0))
    tenders = table(
        "proveedor string, fecha_adjudicacion date, monto_adjudicado double",
        ("X", day, 1.0), ("X", day + dt.timedelta(1), 150.0), ("X", day + dt.timedelta(730), 100.0), ("X", day + dt.timedelta(731), 9.0),
    )
    found = rows(finance.campaign_roi(donations, tenders), "empresa")
    assert [(r["n_contratos_posteriores"], r["roi_politico"]) for r in found] == [(2, 2.5), (0, None), (0, 0.0)]


def test_business_days(table, rows):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(20)]
    pairs = table("fecha_factura date, fecha_pago date", *[(a, b) for a in days for b in days if a <= b])
    for r in rows(finance.with_payment_days(pairs), "fecha_factura", "fecha_pago"):
        span = (r["fecha_pago"] - r["fecha_factura"]).days
        expected = sum((r["fecha_factura"] + dt.timedelta(i)).weekday() < 5 for i in range(1, span + 1))
        assert r["dias_habiles_pago"] == expected


def test_payment_bias(table, rows):
    payments = table("empresa_id string, organismo_id string, dias_habiles_pago int", ("X", "O", 10), ("Y", "O", 30), ("X", None, 1))
    found = rows(finance.payment_bias(payments), "empresa_id")
    assert [(r["dias_ahorrados"], r["priorizacion_detectada"]) for r in found] == [(10.0, True), (-10.0, False)]


def test_sludge_of_a_constant_table_is_zero(table, rows):
    procedures = table("organismo string, dependencia string, tipo_tramite string, dias_transcurridos int", ("O", "D", "T", 5), ("O", "D", "U", 5))
    assert [r["sludge_score"] for r in rows(conduct.sludge(procedures), "tipo_tramite")] == [0.0, 0.0]
    norms = table("tipo_tramite string, tiempo_normativo double", ("T", 1.0))
    assert [r["sludge_score"] for r in rows(conduct.sludge(procedures, norms), "tipo_tramite")] == [70.0, 0.0]


def test_audits_take_the_last_known_value(table, rows):
    d = dt.date
    audits = table(
        "empresa_id string, fecha date, tiene_programa_integridad boolean, score_efectividad double",
        ("A", d(2020, 1, 1), True, 90.0), ("A", d(2021, 1, 1), None, 10.0), ("B", d(2020, 1, 1), True, 80.0), ("B", None, True, 5.0),
        ("C", d(2020, 1, 1), None, None),
    )
    found = rows(conduct.compliance_audit(audits), "empresa_id")
    assert [(r["tiene_programa"], r["score_efectividad"], r["n_auditorias"], r["compliance_de_papel"]) for r in found] == [
        (True, 10.0, 2, True), (True, 5.0, 1, True), (None, None, 1, False)
    ]


def test_zero_weights_give_no_perception(table, rows):
    surveys = table("dependencia string, percepcion_agilizacion_informal double, n_respuestas int", ("D", 4.0, 1), ("D", 8.0, 3), ("E", 4.0, 0))
    assert [r["percepcion_ponderada"] for r in rows(conduct.informal_expectations(surveys), "dependencia")] == [7.0, None]


def test_severity_and_sanction_bias(table, rows):
    cases = table("causa_id string, texto_fallo string", ("1", "Se dicta PRISIÓN EFECTIVA y multa"), ("2", "probation"), ("3", None))
    assert [r["severidad_texto"] for r in rows(judicial.ruling_severity(cases), "causa_id")] == ["ALTA", "BAJA", "INDETERMINADA"]
    people = table("causa_id string, entidad_id string, rango_jerarquico string, condena_meses int", ("1", "a", "ALTO", 10), ("9", "b", "ALTO", None))
    assert rows(judicial.sanction_bias(cases, people), "rango_jerarquico")[0]["pct_severidad_alta"] == 50.0


def test_votes_and_awards(table, rows):
    d = dt.date
    votes = table("legislador_id string, votacion_id string, voto string, fecha date", ("l", "1", "AFIRMATIVO", d(2020, 1, 1)),
                  ("l", "2", "AFIRMATIVO", d(2020, 1, 3)), ("l", "1", "AFIRMATIVO", d(2020, 1, 2)), ("l", "3", "NEGATIVO", d(2020, 1, 1)))
    tenders = table("proveedor string, fecha_adjudicacion date, monto_adjudicado double", ("e", d(2020, 1, 2), 10.0), ("e", d(2020, 1, 3), 1.0),
                    ("e", d(2019, 1, 1), 500.0))
    related = table("legislador_id string, empresa_id string, tipo_vinculo string", ("l", "e", "socio"))
    expected = {False: (2, 2 * 10.0 + 3 * 1.0), True: (2, 11.0)}
    for dedupe, values in expected.items():
        found = rows(judicial.vote_contract(votes, tenders, related, dedupe), "empresa_id")
        assert [(r["n_votos_favorables"], r["monto_adjudicado_posterior"]) for r in found] == [values]


def test_audit_card_adds_active_rules(table, rows):
    found = rows(risk.audit_cards(table("alta_concentracion boolean, low_balling_ratio double", (True, 0.5), (None, 0.15))), F.desc("score_riesgo"))
    assert found[0]["audit_card"] == {"HHI_ELEVADO": 30.0, "ADENDAS_REPETIDAS": 25.0} and found[0]["score_riesgo"] == 55.0
    assert found[1]["audit_card"] == {} and found[1]["score_riesgo"] == 0.0


def test_risk_index_renormalises(spark, rows):
    parts = {"concentracion": F.lit(100.0), "redes": F.lit(100.0), "patrones": F.lit(None), "opacidad": F.lit(None)}
    found = spark.range(1).select(risk.ircs(parts).alias("todo"), risk.ircs({"redes": F.lit(None)}).alias("nada")).withColumn(
        "nivel", risk.ircs_level(F.col("nada"))).first()
    assert (found["todo"], found["nada"], found["nivel"]) == (100.0, None, "SIN_DATOS")


def test_institutional_takes_the_latest_year(table):
    indices = table("pais_iso3 string, anio int, indicador string, valor double", ("ARG", 2025, "CPI", 36.0), ("ARG", 2024, "CPI", 90.0),
                    ("ARG", 2023, "WGI_CONTROL_CORRUPCION", -0.5))
    assert risk.institutional_score(indices).first()[0] == 62.0
    assert risk.institutional_score(indices, "URY").first()[0] == 50.0


def test_opacity_counts_only_published_columns(table, rows):
    tenders = table("licitacion_id string, rubro string, modalidad string", ("1", None, "x"), ("2", None, None))
    assert [r["opacidad_score"] for r in rows(risk.opacity(tenders), "licitacion_id")] == [50.0, 100.0]
    assert risk.opacity(tenders.select("licitacion_id")).first()["opacidad_score"] == 100.0


def test_patterns_alerts_and_company_view(table, rows):
    d = dt.date
    tenders = table(
        "licitacion_id string, organismo string, proveedor string, monto_adjudicado double, fecha_adjudicacion date",
        ("1", "O", "X", 90.0, d(2020, 1, 1)), ("2", "O", "X", 1.0, d(2020, 1, 20)), ("3", "O", "X", 1.0, d(2020, 6, 1)), ("4", "O", "Y", 8.0, None),
    )
    bids = table(BID, ("1", "X", None), ("2", "X", None), ("2", "Y", None), ("3", "X", None), ("4", "Y", None))
    people = table("entidad_id string, domicilio string", ("X", "Calle 1"), ("Y", "CALLE 1 "))
    addenda = table("licitacion_id string, monto_original double, monto_nuevo double", ("3", 1.0, 2.0))
    found = patterns.evaluate_patterns(tenders, bids, addenda, people)
    codes = {r["licitacion_id"]: {c[-1] for c in r["reglas_activadas"]} for r in rows(found, "licitacion_id")}
    assert codes == {"1": set("1238"), "2": set("13468"), "3": set("12378"), "4": set("28")}
    alone = {r["licitacion_id"]: set(r["reglas_activadas"]) for r in rows(patterns.evaluate_patterns(tenders.drop("fecha_adjudicacion")), "licitacion_id")}
    assert alone["4"] == set() and alone["1"] == {"REGLA-001", "REGLA-003"}
    index = risk.risk_index(tenders, finance.hhi(tenders), None, found)
    assert {r["codigo"] for r in rows(risk.alerts(found, index), "codigo")} >= {"REGLA-001", "REGLA-007"}
    assert risk.company_view(index, "X").first()["n_licitaciones"] == 3 and risk.company_view(index, "Q").count() == 0


def test_both_catalogues(spark):
    assert risk.rule_catalogue(spark).count() == 5 and patterns.pattern_catalogue(spark).count() == 8


def shuffles(df) -> int:
    """Exchanges by key in the plan, reused ones included."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_bids_and_tenders_deal_the_order_lines_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert shuffles(t.ofertas()) == 1
    for tenders in (t.licitaciones(), t.licitaciones(dates=False)):
        lines = [r for r in plan(tenders).splitlines() if "Relation [" in r and "l_linenumber" in r]
        assert len(lines) == 1


def test_evidence_of_all_fields_goes_through_one_join(table, rows):
    bids = table("licitacion_id string, empresa_id string", ("L1", "X"), ("L1", "Y"), ("L1", "X"), ("L2", "X"), ("L2", "X"), ("L3", "Y"), ("L3", "Z"))
    entities = table("entidad_id string, domicilio string, representante_tecnico string",
                     ("X", "Calle 1", "Ana"), ("Y", " calle 1", ""), ("Z", None, ""), ("X", "Calle 1", "Ana"))
    found = patterns.shared_evidence(bids, entities, ["domicilio", "representante_tecnico"])
    assert rows(found, "licitacion_id") == [{"licitacion_id": "L1", "_domicilio": True, "_representante_tecnico": False}]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_pairs_of_few_items_are_dealt_over_all_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        items = spark.range(300).selectExpr("id % 30 AS g", "id AS x")
        pairs = collusion.pairs_in_groups(items, ["g"], "x", block=4)
        assert pairs.rdd.getNumPartitions() == 7
        assert pairs.count() == 30 * 45 == pairs.distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
