import hashlib
import hmac
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corredor.functions import scalars as fx


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    df = spark.createDataFrame([tuple(values.values()) or ("x",)], schema)
    return df.select(expr.alias("r")).head()["r"]


@pytest.mark.parametrize(
    "raw, zone",
    [
        (None, "Desconocida"), ("  ", "Desconocida"), ("Z7", "Zona 7"), ("z18", "Zona 18"), ("zona  4", "Zona 4"),
        (" ZONA 12 ", "Zona 12"), ("district 7", "Zona 7"), ("District9", "Zona 9"), ("VILLA NUEVA", "Villa Nueva"),
        ("san miguel petapa", "San Miguel Petapa"), ("o'brien-lane", "O'Brien-Lane"), ("Zona Viva", "Zona Viva"),
    ],
)
def test_zones(spark, raw, zone):
    assert one(spark, fx.normalize_zone(F.col("z")), z=raw) == zone


@pytest.mark.parametrize(
    "raw, day",
    [
        ("03/02/2024", date(2024, 2, 3)), ("2024-02-03", date(2024, 2, 3)), ("31/02/2024", None),
        ("2024/02/03", None), ("3/2/2024", None), ("", None), (None, None),
    ],
)
def test_dates(spark, raw, day):
    assert one(spark, fx.parse_date_any(F.col("d")), d=raw) == day


def test_bad_clock_is_null(spark):
    day = fx.parse_date_any(F.col("d"))
    assert one(spark, fx.date_time(day, F.col("h")), d="03/02/2024", h="08:09:10") == datetime(2024, 2, 3, 8, 9, 10)
    assert one(spark, fx.date_time(day, F.col("h")), d="03/02/2024", h="25:00:00") is None


@pytest.mark.parametrize("key", ["corta", "x" * 64, "y" * 100, "clavé-ñ"])
def test_hmac_equals_the_standard_library(spark, key):
    for text in ("USR-00000001", "", "ñandú"):
        expected = hmac.new(key.encode(), text.encode(), hashlib.sha256).hexdigest()
        assert one(spark, fx.hmac_sha256(F.col("v"), key), v=text) == expected


@pytest.mark.parametrize(
    "op, key, identity",
    [
        ("Transmetro", "TC-00000012", "USR-00000012"), ("Transurbano", "0000000012", "USR-00000012"),
        ("MetroRiel", "MR0000012", "USR-00000012"), ("Aerometro", "ab12", "AM-ab12"),
        ("Transmetro", "SIN-TARJETA", "SIN-TARJETA-" + hashlib.md5(b"SIN-TARJETA").hexdigest()),
        ("Transurbano", "0000000000", "USR-00000000"),
    ],
)
def test_identities(spark, op, key, identity):
    assert one(spark, fx.canonical_id(F.col("o"), F.col("k")), o=op, k=key) == identity


def test_keys_propagate_null(spark):
    assert one(spark, fx.md5_key(F.col("a"), F.col("b")), a="x", b="y") == hashlib.md5(b"x:y").hexdigest()
    assert one(spark, fx.md5_key(F.col("a"), F.col("b")), a="x", b=None) is None


def test_time_key_round_trip_in_any_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # this wall clock does not exist in New York
        gap = F.col("t").cast("timestamp_ntz")
        assert one(spark, fx.ts_key(gap), t="2024-03-10 02:30:00.5") == 20240310023000
        assert one(spark, fx.ts_from_key(fx.ts_key(gap)), t="2024-03-10 02:30:00") == datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_local_time(spark):
    assert one(spark, fx.to_local(F.col("t")), t="2024-01-01T03:00:00Z") == datetime(2023, 12, 31, 21)


@pytest.mark.parametrize(
    "text, good",
    [
        ('{"a": 1}', True), ('{"a": 1', False), ('{"a": 1} x', False), ('{"a": 1}{', False), ('{"a": 1}}', False),
        ('{"a": 1}]', False), ('{"a": 1},{"b": 2}', False), ("1],[2", False), ('1},{"v":2', False), ("[1]", True),
    ],
)
def test_json_validity_covers_the_whole_text(spark, text, good):
    assert one(spark, fx.is_json(F.col("j")), j=text) is good


def test_money(spark):
    assert one(spark, fx.money(F.col("m"), "3.00"), m="") == Decimal("3.0000")
    assert one(spark, fx.money(F.col("m"), divisor=100), m="130") == Decimal("1.3000")
    assert one(spark, fx.minutes_from_seconds(F.col("m").cast("int")), m="130") == Decimal("2.17")


def test_peak_hours(spark):
    def peak(t):
        return one(spark, fx.is_peak(F.col("t").cast("timestamp_ntz")), t=t)

    assert peak("2024-01-05 06:00:00") and peak("2024-01-05 19:59:59")
    assert not peak("2024-01-05 09:00:00") and not peak("2024-01-06 08:00:00")


def test_ratio_over_zero_is_null(spark):
    assert one(spark, fx.ratio(F.lit(1), F.lit(0))) is None
