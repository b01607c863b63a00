import json
import random

from fixtures import rows, silver as frames
from pyspark.sql import functions as F

from corredor.operators import quality
from corredor.operators.sets import symmetric_diff
from corredor.plans import gold, guards, layers, silver, views
from corredor.queries.bindings import Warehouse

SF = "/root/testdata/sf0.001"


def bus(spark, data):
    schema = "fecha string, hora string, num_tarjeta string, cod_parada string, ruta string, monto_centavos bigint, bronze_record_id string, ingesta_timestamp string"
    return spark.createDataFrame(data, schema)


def stops(spark):
    return spark.createDataFrame([("P1", "uno", "R1", "Z7")], "cod_parada string, descripcion string, ruta string, sector string")


BUS = [
    ("01/06/2026", "08:00:00", "1", "P1", "R1", 110, "h:1", "t"),
    ("01/06/2026", "08:00:00", "1", "P1", "R1", 110, "h:2", "t"),
    ("2026-06-01", "08:00:00", "1", "", "R1", 110, "h:3", "t"),
    ("02/06/2026", "08:00:00", "2", None, "", 500, "h:4", "t"),
    ("01/12/2027", "08:00:00", "2", "P1", "R1", 100, "h:5", "t"),
    ("sin fecha", "08:00:00", "3", "P1", "R1", 100, "h:6", "t"),
    ("01/10/2026", "00:00:00", "3", "P2", "R1", 100, "h:7", "t"),
]


def test_numbers_leave_gaps_and_zones_default(spark):
    for seed in range(3):
        data = random.Random(seed).sample(BUS, len(BUS))
        got = rows(silver.tu_transactions(bus(spark, data), stops(spark)), "id_transaccion", "bronze_record_id", "zona_conformada")
        assert got == [("TU-1", "h:1", "Zona 7"), ("TU-2", "h:2", "Zona 7"), ("TU-5", "h:7", "Desconocida")]


def test_accepted_and_quarantined_rows_are_complements(spark):
    tm = spark.createDataFrame(
        [("TC-1", "e1", "2026-06-01 08:00:00", "a", "t1"), ("TC-1", "e1", "2026-06-01 08:00:00", "b", "t0"),
         ("TC-1", "e2", "2026-06-01 08:00:00", "c", "t0")],
        "tarjeta string, estacion_id string, fecha_hora string, bronze_record_id string, ingesta_timestamp string",
    )
    mr = spark.createDataFrame(
        [(1, "MR1", 1, None, None, "m1"), (2, "MR1", 1, 2, "2026-06-01 09:00:00", "m2")],
        "trip_id bigint, card string, entry_station bigint, exit_station bigint, exit_ts string, bronze_record_id string",
    )
    rejected = silver.quarantine(tm, bus(spark, BUS), mr, "2026-06-02 00:00:00")
    got = rows(rejected, "fuente", "id_registro_crudo", "motivo_rechazo")
    assert got == [
        ("MetroRiel", "m1", "VIAJE_SIN_EXIT"),
        ("Transmetro", "a", "DUPLICADO_TORNIQUETE"),
        ("Transurbano", "h:3", "COD_PARADA_NULO"),
        ("Transurbano", "h:4", "COD_PARADA_NULO"),
        ("Transurbano", "h:5", "FECHA_FUTURA"),
        ("Transurbano", "h:6", "FECHA_FUTURA"),
    ]
    kept = {r["bronze_record_id"] for r in silver.tu_transactions(bus(spark, BUS), stops(spark), numbered=False).collect()}
    assert kept | {r[1] for r in got if r[0] == "Transurbano"} == {r[6] for r in BUS}
    payload = {r["id_registro_crudo"]: json.loads(r["payload"]) for r in rejected.collect()}
    assert payload["h:4"] == {"num_tarjeta": "2", "ruta": "", "fecha": "02/06/2026", "hora": "08:00:00"}
    metrics = rows(silver.quality_metrics(rejected), "motivo_rechazo", "total_violaciones", "registros_unicos_fuente")
    assert ("FECHA_FUTURA", 2, 4) in metrics


def points(spark):
    return spark.createDataFrame(
        [("Transmetro", "p", "Zona 1"), ("Transurbano", "p", "Zona 4"), ("MetroRiel", "1", "Zona 6"), ("Aerometro", "p", "Zona 1")],
        "modo string, codigo_punto string, zona_conformada string",
    ).withColumns({"nombre_punto": F.lit("x"), "servicio_codigo": F.lit("s"), "latitud": F.lit(None).cast("decimal(12,6)"),
                   "longitud": F.lit(None).cast("decimal(12,6)")})


def test_transfers_need_adjacent_events_of_other_modes(spark):
    data = frames(
        spark,
        tm=[("a", "TC-00000001", "2026-06-01T08:00", 1, "p"), ("c", "TC-00000001", "2026-06-01T10:00", 1, "p"),
            ("e", "TC-00000002", "2026-06-01T23:50", 1, "p"), ("g", "TC-00000003", "2026-06-01T08:00", 1, "p")],
        tu=[("b", "0000000001", "2026-06-01T08:30", 2, "p"), ("f", "0000000002", "2026-06-02T01:20", 2, "p"),
            ("h", "0000000003", "2026-06-01T08:00", 2, "p")],
    )
    zones = gold.dim_zone(silver.zone_universe(points(spark)))
    boardings = gold.fact_boardings(data, points(spark), "k")
    trips = gold.fact_trips(data["MetroRiel"], points(spark), "k")
    events = gold.user_events(boardings, trips, zones)
    for hot in (1, 1_000_000):
        found = gold.transfers(events, hot_rows=hot)
        got = rows(found, "bronze_record_id_origen", "bronze_record_id_destino", "combinacion_modos")
        # b-c is adjacent at exactly 90 minutes, e-f crosses midnight, g-h happen at once
        assert got == [("a", "b", "Transmetro -> Transurbano"), ("b", "c", "Transurbano -> Transmetro"),
                       ("e", "f", "Transmetro -> Transurbano")]
        assert quality.transfer_rules(found).count() == 0
        assert quality.transfer_sequence(found, events).count() == 0
    assert quality.transfer_sequence(gold.transfers(events, 60), events).count() == 2


def test_transfers_read_their_events_once(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.range(300).select(
        F.when(F.col("id") % 2 == 0, F.lit("u")).otherwise(F.col("id").cast("string")).alias("usuario_sk"),
        F.element_at(F.array(F.lit("Transmetro"), F.lit("Transurbano")), (F.col("id") % 4 < 2).cast("int") + 1).alias("modo"),
        F.lit("Zona 1").alias("zona"),
        (F.lit("2026-06-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("fecha_hora"),
        F.lit(1).cast("decimal(10,2)").alias("tarifa_quetzales"), F.format_string("%03d", "id").alias("bronze_record_id"),
    ).write.parquet(path)
    found = []
    for hot, scans in ((20, 0), (1_000_000, 1)):
        pairs = gold.transfers(spark.read.parquet(path), hot_rows=hot)
        assert pairs._jdf.queryExecution().executedPlan().toString().count("FileScan") == scans
        found.append(rows(pairs, "bronze_record_id_origen", "bronze_record_id_destino"))
    assert found[0] == found[1] and len(found[0]) == 149


def test_derived_and_joined_identities_agree(spark):
    w = Warehouse(spark, SF)
    joined = gold.fact_boardings(w.silver, w.points, "k", bridge=w.bridge)
    derived = gold.fact_boardings(w.silver, w.points, "k")
    assert symmetric_diff(joined, derived).count() == 0
    a = silver.user_features(w.silver, w.points)
    b = silver.user_features(w.silver, w.points, bridge=w.bridge)
    assert symmetric_diff(a, b).count() == 0


def test_active_days_count_a_day_of_two_zones_once(spark):
    when = ["1969-12-31T23:00", "1970-01-01T08:00", "2026-06-01T08:00", "2026-06-01T21:00", "2026-06-02T08:00", "2026-09-30T08:00"]
    data = frames(
        spark,
        tm=[(f"a{i}", "TC-00000001", t, 1, "p") for i, t in enumerate(when)],
        tu=[("b", "0000000001", "2026-06-01T09:00", 2, "p"), ("c", "0000000001", "2026-06-05T09:00", 2, "gone")],
    )
    found = silver.user_features(data, points(spark), "2026-10-01 00:00:00")
    got = found.select("total_eventos", "dias_activos", "zona_origen_frecuente", "eventos_ultimos_7_dias").collect()
    assert [tuple(r) for r in got] == [(8, 6, "Zona 1", 1)]
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def _one_more(column, row=None):
    """The relation with one more in a column, of one row or of all."""
    return lambda df: df.withColumn(column, (F.col(column) + (1 if row is None else F.when(row, 1).otherwise(0))).cast(df.schema[column].dataType))


# for each guard a relation and a damage that it must report
DAMAGE = {
    "cobertura_reconciliada": ("gold.mart_cobertura", _one_more("eventos_transmetro")),
    "tren_grano": ("gold.mart_metroriel_zonas", lambda df: df.limit(1)),
    "tren_reconciliado": ("gold.mart_metroriel_zonas", _one_more("viajes_metroriel_iniciados")),
    "tren_ranking": ("gold.mart_metroriel_zonas", _one_more("ranking_demanda_otros_modos")),
    "vistas_totales": ("gold.v_cobertura", _one_more("viajes_mr_iniciados")),
    "vista_metroriel": ("gold.v_metroriel", _one_more("areas_en_ranking_red")),
    "vista_multimodalidad": ("gold.v_multimodalidad", _one_more("usuarios_multimodales_total")),
    "vista_transbordos": ("gold.v_transbordos", _one_more("tiempo_promedio_transferencia_minutos")),
    "vistas_sin_identidad": ("gold.v_multimodalidad", lambda df: df.withColumn("user_hash", F.lit("h"))),
}


def broken_guards(tables):
    """Guards that report their damage."""
    found = set()
    for name, (relation, damage) in DAMAGE.items():
        changed = dict(tables.tables) | {relation: damage(tables[relation])}
        if not guards.published(changed)[name].isEmpty():
            found.add(name)
    return found


def test_layers_pass_its_checks_and_repeats_itself(spark, tmp_path):
    w = Warehouse(spark, SF)
    first = layers.run(w.staging, str(tmp_path / "a"), w.settings)
    failed = [r["prueba"] for r in quality.summary(layers.checks(first, w.settings)).collect() if r["violaciones"]]
    assert failed == []
    assert broken_guards(first) == DAMAGE.keys()
    second = layers.run({n: df.repartition(5) for n, df in w.staging.items()}, str(tmp_path / "b"), w.settings)
    same = [n for n in first.tables if n.startswith(("silver.", "gold."))]
    assert quality.runs_equal({n: first[n] for n in same}, {n: second[n] for n in same}).count() == 0
    abc = [
        views.demand_from_fact(first["gold.fact_abordajes"], first["gold.dim_zona"], first["gold.dim_modo"]),
        views.demand_by_mode_zone_hour(first["gold.mart_demanda_hora"], "cantidad_eventos"),
        views.demand_by_mode_zone_hour(first["gold.v_demanda_abordajes"], "cantidad_abordajes"),
    ]
    assert symmetric_diff(abc[0], abc[1]).count() == 0 and symmetric_diff(abc[1], abc[2]).count() == 0


def test_equal_counts_with_other_content_are_noticed(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(1, "y")], "i int, s string")
    assert quality.runs_equal({"t": a}, {"t": b}).count() == 1
    assert quality.runs_equal({"t": a.withColumn("now", F.current_timestamp())}, {"t": a.withColumn("now", F.lit(None))}, ["now"]).count() == 0
