"""Declared types of the stored tables."""

from __future__ import annotations

MONEY = "decimal(18,2)"

# Stored tables, as schema texts for a reader.
TABLES: dict[str, str] = {
    "entidad": "entidad_id string, tipo string, nombre string, identificador_fiscal string, pais string, jurisdiccion string, "
    "domicilio string, lat double, lon double, metadata string, fuente string, creado_en timestamp, actualizado_en timestamp",
    "entidad_alias": "entidad_id string, entidad_relacionada_id string, metodo string, score_similitud decimal(5,4), "
    "evidencia string, creado_en timestamp",
    "licitacion": f"licitacion_id string, fuente_id_externo string, organismo_id string, objeto string, rubro string, "
    f"presupuesto_oficial {MONEY}, fecha_apertura date, fecha_adjudicacion date, monto_adjudicado {MONEY}, "
    f"monto_ejecutado_final {MONEY}, modalidad string, fuente string",
    "oferta": f"licitacion_id string, empresa_id string, monto_ofertado {MONEY}, porcentaje_sobre_ganadora decimal(8,4), "
    "resultado string",
    "adenda": f"licitacion_id string, fecha date, monto_original {MONEY}, monto_nuevo {MONEY}, motivo string",
    "pago_tgn": f"empresa_id string, organismo_id string, fecha_factura date, fecha_pago date, dias_habiles_pago int, "
    f"monto {MONEY}",
    "aporte_campana": f"aportante_id string, partido_id string, eleccion string, monto {MONEY}, fecha date",
    "votacion": "votacion_id string, camara string, expediente string, titulo string, fecha date",
    "voto_individual": "votacion_id string, legislador_id string, voto string",
    "causa_judicial": "causa_id string, caratula string, fuero string, jurisdiccion string, estado string, fecha_inicio date, "
    "fecha_resolucion date, texto_fallo string, fuente string",
    "imputado": "causa_id string, entidad_id string, rango_jerarquico string, condena_meses int",
    "auditoria_compliance": "empresa_id string, fecha date, tiene_programa_integridad boolean, score_efectividad decimal(5,2), "
    "hallazgos string",
    "grafo_arista": "origen_id string, destino_id string, tipo_relacion string, peso decimal(12,4), fecha date, fuente string",
    "indicador_macro": "pais_iso3 string, anio int, indicador string, valor decimal(10,4), fuente string",
    "score_riesgo": "entidad_id string, licitacion_id string, capa string, score decimal(6,2), desglose map<string,double>, "
    "calculado_en timestamp",
}

# Files a user brings use names instead of stored ids; a column missing here is read as text.
FILES: dict[str, dict[str, str]] = {
    "licitaciones": {
        "presupuesto_oficial": MONEY, "monto_adjudicado": MONEY, "fecha_apertura": "date", "fecha_adjudicacion": "date",
    },
    "ofertas": {"monto_ofertado": MONEY, "porcentaje_sobre_ganadora": "double"},
    "adendas": {"fecha": "date", "monto_original": MONEY, "monto_nuevo": MONEY},
    "entidades": {},
    "pagos": {"fecha_factura": "date", "fecha_pago": "date", "dias_habiles_pago": "int", "monto": MONEY},
    "aportes": {"fecha": "date", "monto": MONEY},
}
