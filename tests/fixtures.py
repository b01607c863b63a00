"""Small literal relations with the columns of the conformed layer."""

from __future__ import annotations

from datetime import datetime

from corredor.plans.silver import AM, MR, TM, TU

_MONEY = "tarifa_quetzales decimal(18,4)"
SCHEMAS = {
    TM: f"bronze_record_id string, tarjeta_id string, fecha_hora timestamp_ntz, {_MONEY}, estacion_id string, linea string",
    TU: f"bronze_record_id string, id_tarjeta string, fecha_hora timestamp_ntz, {_MONEY}, cod_parada string, ruta string",
    AM: f"bronze_record_id string, user_hash string, fecha_hora timestamp_ntz, {_MONEY}, station_code string, eje string",
    MR: "bronze_record_id string, tarjeta_mr string, fecha_hora_ingreso timestamp_ntz, fecha_hora_salida timestamp_ntz, "
    f"{_MONEY}, origen_estacion_id string, destino_estacion_id string, duracion_minutos decimal(10,2)",
}


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _money(value):
    from decimal import Decimal

    return Decimal(str(value))


def silver(spark, tm=(), tu=(), am=(), mr=()):
    """Rows: (id, card, time, fare, point); train rows carry entry and exit."""
    flat = {TM: tm, TU: tu, AM: am}
    out = {
        op: spark.createDataFrame([(i, k, at(t), _money(f), p, "L1") for i, k, t, f, p in rows], SCHEMAS[op])
        for op, rows in flat.items()
    }
    trips = [(i, k, at(a), at(b), _money(f), p, p, _money(1)) for i, k, a, b, f, p in mr]
    return {**out, MR: spark.createDataFrame(trips, SCHEMAS[MR])}


def quarantine(spark, rows=()):
    return spark.createDataFrame(list(rows), "fuente string, id_registro_crudo string")


def history(spark, rows=()):
    return spark.createDataFrame(
        [(k, op, at(t)) for k, op, t in rows], "tarjeta_id string, operacion string, valid_from timestamp_ntz"
    )


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())
