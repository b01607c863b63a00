from datetime import timedelta
from decimal import Decimal

import pytest
from fixtures import at, history, quarantine, rows, silver

from corredor.functions import scalars as fx
from corredor.operators import quality
from corredor.plans import pit
from corredor.plans.silver import AM, MR, TM, card_uses, identity_bridge

CUT = at("2026-07-01")
CUTS = [("A", CUT), ("C", at("2026-08-30"))]


def population(spark, cuts=CUTS, deleted=(), rejected=(), **events):
    frames = silver(spark, **events)
    uses = card_uses(frames, quarantine(spark, rejected))
    return pit.card_population(uses, history(spark, deleted), cuts), uses


def uses_at(*times, card="TC-1"):
    return [(f"{card}:{i}", card, t, 1, "p") for i, t in enumerate(times)]


TWO = ("2026-06-10", "2026-06-20")


@pytest.mark.parametrize(
    "times, expected",
    [
        (TWO, [("A", 2, 0, 1)]),
        (TWO[:1], []),
        ((*TWO, "2026-07-01"), [("A", 2, 1, 0)]),
        ((*TWO, "2026-07-31"), [("A", 2, 0, 1)]),
        ((*TWO, "2026-07-30T23:59:59"), [("A", 2, 1, 0)]),
        (("2026-06-03", "2026-06-20"), [("A", 2, 0, 1)]),
        (("2026-06-02T23:59:59", "2026-06-20"), []),
    ],
)
def test_windows_are_half_open(spark, times, expected):
    pop, _ = population(spark, tm=uses_at(*times))
    assert rows(pop, "corte", "eventos_previos_28d", "eventos_futuros_30d", "etiqueta") == expected


def test_deletes(spark):
    def kept(moment, card="TC-1", op="tm"):
        return population(spark, deleted=[(card, "DELETE", moment)], **{op: uses_at(*TWO)})[0].count()

    assert kept("2026-06-30T23:59:59") == 0
    assert kept("2026-07-01") == 1
    assert kept("2026-06-01", op="tu") == 1


def test_quarantined_uses_count_nowhere(spark):
    times = (*TWO, "2026-06-21", "2026-07-02")
    pop, _ = population(spark, tm=uses_at(*times), rejected=[(TM, "TC-1:2"), (TM, "TC-1:2"), (TM, "TC-1:3")])
    assert rows(pop, "eventos_previos_28d", "eventos_futuros_30d") == [(2, 0)]


def test_trips_count_once_and_only_when_known(spark):
    def trip(i, start, end):
        return (f"m{i}", "MR1", start, end, 2, "1")

    known = [trip(1, "2026-06-10", "2026-06-10T00:30"), trip(2, "2026-06-11", "2026-06-11T00:30")]
    late = trip(3, "2026-06-30T23:50", "2026-07-01")
    past_horizon = trip(4, "2026-07-30T23:50", "2026-07-31T00:10")
    pop, _ = population(spark, mr=[*known, late, past_horizon])
    assert rows(pop, "operador", "eventos_previos_28d", "eventos_futuros_30d") == [(MR, 2, 0)]


def test_future_events_change_neither_population_nor_unit(spark):
    before, _ = population(spark, tm=uses_at(*TWO))
    after, _ = population(spark, tm=uses_at(*TWO, "2027-01-01", "2027-01-02"))
    columns = ("unidad_id", "corte", "eventos_previos_28d")
    assert rows(before, *columns) == rows(after, *columns)


def test_open_cut_has_no_label(spark):
    pop, _ = population(spark, tm=uses_at("2026-08-20", "2026-08-21", "2026-08-31"))
    assert rows(pop, "corte", "eventos_futuros_30d", "etiqueta") == [("C", None, None)]
    assert quality.population_rules(pop).count() == 0


def test_cost_uses_operators_of_the_identity(spark):
    tm = uses_at(*TWO, card="TC-00000007") + uses_at(*TWO, card="TC-00000008")
    tu = uses_at("2026-07-05", card="0000000007")
    pop, uses = population(spark, tm=tm, tu=tu, am=uses_at(*TWO, card="ab"))
    bridge = identity_bridge(silver(spark, tm=tm, tu=tu, am=uses_at(*TWO, card="ab")))
    cost = pit.card_cost(pop, uses, bridge, CUTS)
    got = rows(cost, "corte", "poblacion", "positivos", "positivos_con_actividad_otro_operador", "positivos_aerometro")
    assert got == [("A", 3, 3, 1, 1)]


def test_empty_population_has_null_rates(spark):
    pop, uses = population(spark, tm=uses_at("2020-01-01"))
    cost = pit.card_cost(pop, uses, identity_bridge(silver(spark)), CUTS).head()
    assert (cost["poblacion"], cost["tasa_positiva"], cost["proporcion_costo"]) == (0, None, None)


def at_cut(spark, moment, rejected=(), **events):
    """Population and uses at one cut-off of its own."""
    cuts = [("A", at(moment))]
    data = silver(spark, **events)
    uses = card_uses(data, quarantine(spark, rejected))
    return cuts, pit.card_population(uses, history(spark, []), cuts), uses


def test_features_at_the_borders_of_their_windows(spark):
    card = "TC-00004410"
    rides = [
        ("half an hour early", card, "2026-02-14T23:30", 80, "n9"),
        ("first instant", card, "2026-02-15T00:00", 4.5, "n1"),
        ("monday evening", card, "2026-03-02T17:15", 6.25, "n2"),
        ("tuesday morning", card, "2026-03-10T07:45", 6.25, "n2"),
        ("rejected", card, "2026-03-12T12:00", 500, "n7"),
        ("saturday", card, "2026-03-14T06:00", 3, "n3"),
        ("at the cut", card, "2026-03-15T00:00", 70, "n8"),
    ]
    cuts, pop, uses = at_cut(spark, "2026-03-15", [(TM, "rejected")], tm=rides)
    features = pit.card_features(pop, uses, cuts)
    row = features.head()
    assert (row["viajes_28d"], row["viajes_14d"], row["viajes_7d"]) == (4, 3, 2)
    assert (row["gasto_28d_gtq"], row["tarifa_media_gtq"]) == (20, 5)
    assert (row["puntos_origen_28d"], row["dias_activos_28d"], row["etiqueta"]) == (3, 4, 0)
    assert row["dias_desde_ultimo_uso"] == Decimal("0.75")
    assert float(row["proporcion_fin_semana"]) == 0.5
    busy = sum(fx.PEAK_HOURS.count(h) for h in (17, 7))
    assert float(row["proporcion_hora_pico"]) == busy / 4
    assert quality.card_feature_rules(features, pop).count() == 0


def test_windows_longer_than_two_months(spark):
    rides = [(f"r{d}", "TC-00000031", str(at("2026-03-15") - timedelta(days=d, hours=-1))[:19].replace(" ", "T"), 1, "n") for d in (1, 20, 59, 60, 61, 62, 100, 130)]
    cuts, pop, uses = at_cut(spark, "2026-03-15", tm=rides)
    assert pit.card_features(pop, uses, cuts, windows=(120, 7, 61)).head()["dias_activos_120d"] == 7


def test_an_open_trip_at_the_cut_is_not_a_feature(spark):
    trips = [("x1", "MR0440", "2026-02-20T09:00", "2026-02-20T09:40", 11, "4"), ("x2", "MR0440", "2026-03-01T21:00", "2026-03-01T21:30", 2, "9"),
             ("x3", "MR0440", "2026-03-14T23:50", "2026-03-15T00:00", 40, "4")]
    cuts, pop, uses = at_cut(spark, "2026-03-15", mr=trips)
    row = pit.card_features(pop, uses, cuts).head()
    assert (row["viajes_28d"], row["gasto_28d_gtq"], row["puntos_origen_28d"]) == (2, 13, 2)


def _build(cuts):
    def build(sources):
        uses = card_uses({op: sources[op] for op in (TM, "Transurbano", MR, AM)}, sources["cuarentena"])
        pop = pit.card_population(uses, sources["historia"], cuts)
        return pit.card_features(pop, uses, cuts)

    return build


def test_audits_find_nothing_and_catch_a_planted_leak(spark):
    cut = [("C", at("2026-08-30"))]
    frames = silver(
        spark, tm=uses_at("2026-08-01T00:00:01", "2026-08-20", "2026-08-21"),
        mr=[("m1", "MR1", "2026-08-10", "2026-08-10T01:00", 3, "1"), ("m2", "MR1", "2026-08-11", "2026-08-11T01:00", 5, "1")],
    )
    sources = {**frames, "cuarentena": quarantine(spark), "historia": history(spark, [("TC-9", "INSERT", "2026-08-01")])}
    keys, ignore = ["unidad_id", "fecha_corte"], ["corte", "etiqueta"]
    from pyspark.sql import functions as F

    future = pit.future_rows(sources, cut[0][1], 3)
    clean = quality.invariance_audit(sources, future, _build(cut), keys, ignore)
    assert sum(r["diferencias"] for r in clean.collect()) == 0
    # a positive control: moving the appended rows before the cut-off must be noticed
    moved = {n: df.withColumn("fecha_hora", F.col("fecha_hora") - timedelta(days=10)) for n, df in future.items() if "fecha_hora" in df.columns}
    dirty = quality.invariance_audit(sources, moved, _build(cut), keys, ignore)
    assert sum(r["diferencias"] for r in dirty.collect()) > 0
    times = {TM: ["fecha_hora"], MR: ["fecha_hora_ingreso", "fecha_hora_salida"]}
    audit = quality.leakage_audit(sources, times, "2026-08-30", _build(cut), keys, ignore)
    assert sum(r["diferencias"] for r in audit.collect()) == 0


def test_one_cut_reads_the_events_once_and_gives_the_same_units(spark):
    from pyspark.sql import functions as F

    from corredor.queries.bindings import Warehouse

    w = Warehouse(spark, "/root/testdata/sf0.001")
    for cut in ("A",):
        own = w.at_cut(cut)
        for name in ("population", "features"):
            whole, one = getattr(w, name).filter(F.col("corte") == cut), getattr(own, name)
            assert whole.count() > 0 and whole.exceptAll(one).isEmpty() and one.exceptAll(whole).isEmpty()
            assert not [f for f in one.inputFiles() if "events.parquet" in f]


def test_assertions_over_several_layers_read_stored_events(spark):
    from corredor.queries import registry
    from corredor.queries.bindings import Warehouse

    registry.load_all()
    own = Warehouse(spark, "/root/testdata/sf0.001").stored
    for df in (*own.silver.values(), own.events, own.tu_transactions_raw):
        assert not [f for f in df.inputFiles() if "events.parquet" in f]
    found = registry.QUERIES["Q23_scoring_input_rules"](spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "events.parquet" in f and "sf0.001" in f]
