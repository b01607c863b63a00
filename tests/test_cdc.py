from fixtures import at, rows

from corredor.operators import cdc, quality
from corredor.plans import silver

LOG = [
    ("1", "2024-01-01T00:00:00", "INSERT", "TC-00000001", "general", "Zona 1", "ACTIVA"),
    ("2", "2024-01-02T00:00:00", "UPDATE", "TC-00000001", "", "Zona 4", "ACTIVA"),
    ("5", "2024-01-05T00:00:00", "DELETE", "TC-00000001", "", "", ""),
    ("9", "2024-01-09T00:00:00", "update", "TC-00000001", "estudiante", "", "ACTIVA"),
    ("3", "2024-01-03T00:00:00", "DELETE", "TC-00000002", "", "", ""),
    ("10", "2024-01-10T00:00:00", "INSERT", "0000000003", "general", "", "ACTIVA"),
    ("11", "2024-01-11T00:00:00", "INSERT", "SIN-TARJETA", "general", "", "ACTIVA"),
]
SCHEMA = "seq string, commit_ts string, op string, tarjeta string, perfil string, zona_residencia string, estado string"


def log(spark):
    return cdc.type_cdc(spark.createDataFrame(LOG, SCHEMA))


def test_fold_keeps_attributes_and_orders_numerically(spark):
    got = rows(cdc.current_state(log(spark)), "tarjeta", "perfil", "zona_residencia", "estado", "ultima_seq")
    assert got == [
        ("TC-00000001", "estudiante", "Zona 4", "ACTIVA", 9),
        ("TC-00000002", None, None, "INACTIVA", 3),
    ]


def test_history_reads_the_log_once(spark, tmp_path):
    log(spark).write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    for hot, scans in ((1, 0), (1_000_000, 1)):  # with a hot card the log is read when its slots are stored
        history = silver.card_history(stored, slot_width=2, hot_rows=hot)
        assert history._jdf.queryExecution().executedPlan().toString().count("FileScan") == scans
        assert history.count() == 5


def test_history_one_version_per_event(spark):
    for hot in (1, 1_000_000):
        history = cdc.scd2(log(spark), slot_width=2, hot_rows=hot)
        got = rows(history, "tarjeta_id", "valid_from_seq", "perfil_usuario", "zona_residencia", "estado_tarjeta")
        assert got == [
            ("TC-00000001", 1, "general", "Zona 1", "ACTIVA"),
            ("TC-00000001", 2, "general", "Zona 4", "ACTIVA"),
            ("TC-00000001", 5, "general", "Zona 4", "INACTIVA"),
            ("TC-00000001", 9, "estudiante", "Zona 4", "ACTIVA"),
            ("TC-00000002", 3, None, None, "INACTIVA"),
        ]
        ends = {r["valid_from_seq"]: (r["valid_to_seq"], r["vigente"]) for r in history.collect()}
        assert ends == {1: (2, False), 2: (5, False), 5: (9, False), 9: (None, True), 3: (None, True)}
        assert quality.history_matches_state(history, cdc.current_state(log(spark))).count() == 0
        assert quality.history_intervals(history, log(spark)).count() == 0


def test_unsupported_operations_are_found(spark):
    bad = spark.createDataFrame([("1", "MERGE"), ("x", "INSERT"), ("2", None), ("3", "delete")], "seq string, op string")
    assert rows(cdc.check_ops(bad), "seq", "problema") == [
        ("1", "OPERACION_NO_SOPORTADA"), ("2", "OPERACION_NO_SOPORTADA"), ("x", "SEQ_NO_NUMERICA"),
    ]


def test_key_kinds(spark):
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([("TC-12345678",), ("TC-1",), ("0123456789",), ("MR1234567",), ("SIN-TARJETA",), ("",)], "k string")
    got = [r["t"] for r in keys.select(cdc.classify_key(F.col("k")).alias("t")).collect()]
    assert got == ["TRANSMETRO", "OTRO", "TRANSURBANO", "METRORIEL", "SIN_TARJETA", "OTRO"]


def test_any_earlier_delete_excludes_even_after_reactivation(spark):
    history = cdc.scd2(log(spark))
    units = spark.createDataFrame(
        [("Transmetro", "TC-00000001", at("2024-01-20")), ("Transmetro", "TC-00000001", at("2024-01-05")),
         ("Transurbano", "TC-00000001", at("2024-01-20"))],
        "operador string, llave_operacional string, fecha_corte timestamp_ntz",
    )
    kept = rows(cdc.exclude_deleted(units, history), "operador", "fecha_corte")
    # the DELETE exactly at the cut-off does not exclude, and other operators are untouched
    assert kept == [("Transmetro", at("2024-01-05")), ("Transurbano", at("2024-01-20"))]
