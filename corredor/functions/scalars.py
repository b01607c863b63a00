"""Scalar expressions on one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Official time zone, fallback labels and peak hours of the data contract.
LOCAL_ZONE = "America/Guatemala"
UNKNOWN_ZONE = "Desconocida"
ZONE_FALLBACK = "ZONA_DESCONOCIDA"
SERVICE_FALLBACK = "SIN_SERVICIO"
PEAK_HOURS = (6, 7, 8, 17, 18, 19)
DATE_FORMATS = [
    (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd/MM/yyyy"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
]
# The sixteen areas of the network and their kind.
AREAS = [
    ("Zona 1", "zona"),
    ("Zona 4", "zona"),
    ("Zona 6", "zona"),
    ("Zona 7", "zona"),
    ("Zona 8", "zona"),
    ("Zona 9", "zona"),
    ("Zona 10", "zona"),
    ("Zona 11", "zona"),
    ("Zona 12", "zona"),
    ("Zona 13", "zona"),
    ("Zona 17", "zona"),
    ("Zona 18", "zona"),
    ("Mixco", "municipio"),
    ("Villa Nueva", "municipio"),
    ("San Miguel Petapa", "municipio"),
    ("Santa Catarina Pinula", "municipio"),
]
# Default cut-off dates of the churn study.
DEFAULT_CUTS = {"A": "2026-07-01", "B": "2026-07-31", "C": "2026-08-30"}


def to_local(value: Column, from_tz: str = "UTC", to_tz: str = LOCAL_ZONE) -> Column:
    """Wall clock of ``from_tz`` (timestamp or ISO text) as wall clock of ``to_tz``."""
    return F.convert_timezone(F.lit(from_tz), F.lit(to_tz), value.cast("timestamp_ntz"))


def parse_date_any(value: Column, formats: Sequence[tuple[str, str]] = DATE_FORMATS) -> Column:
    """The first format whose pattern matches; anything else, or an impossible day, is NULL."""
    return F.coalesce(
        *[F.when(value.rlike(pattern), F.try_to_date(value, fmt)) for pattern, fmt in formats]
    )


def date_time(day: Column, clock: Column) -> Column:
    """Date plus ``HH:mm:ss`` text; an unreadable clock is NULL."""
    return F.concat(day.cast("string"), F.lit(" "), clock).try_cast("timestamp_ntz")


def title_case(value: Column) -> Column:
    """Capital after every non-alphanumeric character (``initcap`` only looks at blanks)."""
    pieces = F.split(F.lower(value), r"(?<=[^\p{Alnum}])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def normalize_zone(value: Column) -> Column:
    """One spelling per area; numbered zones from any of the operators' notations.

    The value flows through once, which keeps the generated code small.
    """
    text = F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(UNKNOWN_ZONE))
    unified = F.regexp_replace(text, r"(?i)^(z|zona\s*|district\s*)([0-9]+)$", "zona $2")
    return title_case(unified)


def money(value: Column, default: str | None = None, divisor: int = 1, scale: int = 4) -> Column:
    """Text or number as ``decimal(18, scale)``, blank as the default, minor units divided."""
    amount = F.nullif(F.trim(value.cast("string")), F.lit(""))
    if divisor != 1:
        amount = amount.cast("decimal(18,0)") / F.lit(divisor).cast("decimal(9,0)")
    amount = amount.cast(f"decimal(18,{scale})")
    return F.coalesce(amount, F.lit(default).cast(f"decimal(18,{scale})")) if default else amount


def minutes_from_seconds(seconds: Column) -> Column:
    """Duration in minutes, two decimals."""
    return F.round(seconds.cast("decimal(18,4)") / F.lit(60).cast("decimal(9,0)"), 2)


def canonical_id(operator: Column, key: Column) -> Column:
    """Identity shared by the operators whose card numbers follow the numeric pattern."""
    digits = F.regexp_replace(key, "[^0-9]", "")
    patterns = {"Transmetro": "^TC-[0-9]+", "Transurbano": "^[0-9]+", "MetroRiel": "^MR[0-9]+"}
    number = F.when(operator == "Transurbano", F.ltrim(key, F.lit("0"))).otherwise(digits)
    numeric = reduce(
        lambda a, b: a | b, [(operator == op) & key.rlike(rx) for op, rx in patterns.items()]
    )
    return (
        F.when(operator == "Aerometro", F.concat(F.lit("AM-"), key))
        .when(numeric, F.concat(F.lit("USR-"), F.lpad(number, 8, "0")))
        .otherwise(F.concat(F.lit("SIN-TARJETA-"), F.md5(key)))
    )


def hmac_sha256(value: Column, key: str) -> Column:
    """Keyed pseudonym in hex, as two SHA-256 passes over padded input.

    The pads are literals, so the key is visible in plans: keep it out of ``explain`` logs.
    """
    import hashlib

    raw = key.encode("utf-8")
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner_pad, outer_pad = (F.lit(bytearray(b ^ mask for b in block)) for mask in (0x36, 0x5C))
    inner = F.sha2(F.concat(inner_pad, F.encode(value.cast("string"), "UTF-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def md5_key(*parts: Column) -> Column:
    """``a:b`` surrogate key; NULL when any part is NULL."""
    joined = [parts[0]]
    for part in parts[1:]:
        joined += [F.lit(":"), part]
    return F.md5(F.concat(*joined) if len(joined) > 1 else joined[0])


def ts_key(ts: Column) -> Column:
    """Timestamp as a ``yyyyMMddHHmmss`` number.

    Read from the ISO text, so no session zone is involved and the value is referenced once.
    """
    digits = F.translate(ts.cast("string"), "- :.", "")
    return F.substring(digits, 1, 14).cast("long")


def ts_from_key(key: Column) -> Column:
    """Inverse of :func:`ts_key`, so facts reach calendar attributes without a join."""

    def digits(divisor: int, modulus: int) -> Column:
        return (F.floor(key / F.lit(divisor)) % modulus).cast("int")

    return F.make_timestamp_ntz(
        digits(10**10, 10**4),
        digits(10**8, 100),
        digits(10**6, 100),
        digits(10**4, 100),
        digits(10**2, 100),
        (key % 100).cast("int"),
    )


def date_from_key(day: Column) -> Column:
    """Date of a ``yyyyMMdd`` number."""
    return F.make_date(
        F.floor(day / 10_000).cast("int"), (F.floor(day / 100) % 100).cast("int"), (day % 100).cast("int")
    )


def iso_dow(ts: Column) -> Column:
    return F.weekday(ts) + 1


def is_business_day(ts: Column) -> Column:
    return iso_dow(ts).between(1, 5)


def is_peak(ts: Column) -> Column:
    """Weekday rush hours."""
    return is_business_day(ts) & F.hour(ts).isin(*PEAK_HOURS)


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """P10: calendar attributes of a timestamp column."""
    t = F.col(ts)
    return df.withColumns(
        {
            "fecha": t.cast("date"),
            "anio": F.year(t),
            "mes": F.month(t),
            "dia": F.day(t),
            "dia_semana_iso": iso_dow(t),
            "hora": F.hour(t),
            "minuto": F.minute(t),
            "segundo": F.second(t).cast("int"),
            "es_dia_habil": is_business_day(t),
            "es_hora_pico": is_peak(t),
        }
    )


def not_blank(value: Column) -> Column:
    """Neither NULL nor only blanks."""
    return value.isNotNull() & (F.trim(value) != "")


def json_payload(*cols: Column) -> Column:
    """JSON object that keeps NULL members."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def is_json(text: Column) -> Column:
    """The whole text is one JSON value.

    The parser stops after the first value, so the text is tried as an array element and as an
    object member: whatever trails it breaks at least one of the two.
    """
    as_element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return as_element.isNotNull() & as_member.isNotNull()


def label(value: Column, mapping: Mapping[object, str], default: str | None = None) -> Column:
    """Fixed code-to-label mapping."""
    chain = reduce(
        lambda acc, item: acc.when(value == F.lit(item[0]), F.lit(item[1])),
        list(mapping.items())[1:],
        F.when(value == F.lit(next(iter(mapping))), F.lit(next(iter(mapping.values())))),
    )
    return chain.otherwise(F.lit(default))


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month").cast("timestamp_ntz")


def month_window(ts: Column, start: Column) -> Column:
    """Inside the half-open month that begins at ``start``."""
    return (ts >= start) & (ts < start + F.expr("INTERVAL 1 MONTH"))


def elapsed(begin: Column, end: Column, unit: str) -> Column:
    """Difference in ``minutes`` or ``days`` (fractional) or ``whole_days`` (floored)."""
    micros = F.timestamp_diff("MICROSECOND", begin, end)
    if unit == "whole_days":
        return F.floor(micros / F.lit(86_400_000_000)).cast("int")
    divisor = {"minutes": 60_000_000, "days": 86_400_000_000}[unit]
    return micros.cast("decimal(20,0)") / F.lit(divisor).cast("decimal(11,0)")


def constant_relation(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Inline relation."""
    return spark.createDataFrame(list(rows), schema)


def cutoffs(
    cuts: Mapping[str, str] | None = None, include_unlabelled: bool = False, unlabelled: Sequence[str] = ("C",)
) -> list[tuple[str, datetime]]:
    """Cut-off names and instants by name; those of ``unlabelled`` only on request."""
    chosen = dict(cuts or DEFAULT_CUTS)
    names = [n for n in sorted(chosen) if include_unlabelled or n not in unlabelled]
    return [(n, datetime.fromisoformat(str(chosen[n]))) for n in names]


def cut_array(cuts: Sequence[tuple[str, datetime]]) -> Column:
    """The cut-offs as an array of structs, ready to be filtered and exploded per row."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("corte"),
                F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz").alias("fecha_corte"),
            )
            for name, moment in cuts
        ]
    )


def as_of(df: DataFrame, ts_cols: Sequence[str], cut: datetime | str) -> DataFrame:
    """Rows whose every listed moment lies before the cut."""
    moment = F.lit(str(cut)).cast("timestamp_ntz")
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) < moment for c in ts_cols]))


def differs(a: Column, b: Column) -> Column:
    """NULL-safe inequality."""
    return ~a.eqNullSafe(b)


def blank_to(value: Column, default: str) -> Column:
    """P20: empty or NULL text as a default code."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def valid_only(df: DataFrame, predicates: Sequence[Column]) -> DataFrame:
    """Rows that satisfy all predicates."""
    return df.filter(reduce(lambda a, b: a & b, predicates))


def has_prefix(value: Column, prefix: str) -> Column:
    """Literal prefix."""
    return value.startswith(prefix)


def pair_label(a: Column, b: Column) -> Column:
    """``a -> b``."""
    return F.concat(a, F.lit(" -> "), b)


def ratio(num: Column, den: Column, digits: int | None = None) -> Column:
    """Exact quotient; NULL over zero."""
    value = num.cast("decimal(20,4)") / F.nullif(den.cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))
    return value if digits is None else F.round(value, digits)
