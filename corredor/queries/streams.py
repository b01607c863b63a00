"""Streaming queries: ``events`` published as messages, drained, validated and deduplicated."""

from __future__ import annotations

from pyspark.sql import functions as F

from corredor.queries.bindings import Warehouse
from corredor.queries.registry import query
from corredor.session import work_dir
from corredor.sources.staging import unwrap_payload
from corredor.streaming import events as st

c = F.col
AT = "2024-02-01T00:00:00"
SCHEMA = "event_id bigint, user_id bigint, event_type string"
_ID = "sha256('archivo:' || (event_id + 1))"


def _messages(w: Warehouse, source="eventos", kind: str | None = None):
    events = w.events if kind is None else w.events.filter(c("event_type") == kind)
    rows = events.select(
        F.lit("archivo").alias("_source_sha256"), (c("event_id") + 1).alias("_record_number"), "event_id", "user_id", "event_type"
    )
    return st.to_events(rows, source, AT, ["event_id", "user_id", "event_type"])


def _with_noise(w: Warehouse):
    """All messages, replays of the purchases, broken JSON for views and lost ids for errors."""
    replays = _messages(w, kind="purchase")
    broken = _messages(w, kind="view").withColumn("value", F.substring_index("value", ",", 2))
    no_id = _messages(w, kind="error").withColumn("value", F.regexp_replace("value", '"_event_id"', '"id"'))
    return _messages(w).unionByName(replays).unionByName(broken).unionByName(no_id)


def _drain(w: Warehouse, messages=None, batches: int | None = None, order: str | None = None):
    base = work_dir(w.spark, "stream")
    topic = f"{base}/topic"
    if order:
        st.publish_log(messages, order, topic)
    else:
        st.publish(messages if messages is not None else _with_noise(w), topic)
    drain = st.consume(w.spark, topic, f"{base}/bronze", f"{base}/rejected", f"{base}/checkpoint", AT, batches)
    return base, drain


def _bronze(w: Warehouse, base: str):
    return w.spark.read.parquet(f"{base}/bronze")


@query("T01_to_events", f"SELECT {_ID} AS clave, event_id, event_type FROM ev")
def t01(w: Warehouse):
    return _messages(w).select(
        c("key").alias("clave"),
        F.get_json_object("value", "$.data.event_id").cast("long").alias("event_id"),
        F.get_json_object("value", "$.data.event_type").alias("event_type"),
    )


@query("T02_event_stream", "SELECT event_id, user_id FROM ev")
def t02(w: Warehouse):
    base, _ = _drain(w, _messages(w))
    return unwrap_payload(_bronze(w, base).select("raw_json"), SCHEMA).select("event_id", "user_id")


@query(
    "T03_split_valid",
    """SELECT 'validos' AS grupo, count(*) AS n FROM ev
       UNION ALL SELECT 'rechazados', count(*) FROM ev WHERE event_type IN ('view', 'error')""",
)
def t03(w: Warehouse):
    base, _ = _drain(w)
    count = F.count(F.lit(1)).alias("n")
    good = _bronze(w, base).agg(F.lit("validos").alias("grupo"), count)
    return good.unionByName(w.spark.read.parquet(f"{base}/rejected").agg(F.lit("rechazados").alias("grupo"), count))


@query("T04_dedup_events", f"SELECT {_ID} AS _event_id, event_id + 1 AS _record_number FROM ev")
def t04(w: Warehouse):
    base, _ = _drain(w)
    # the same messages arrive again after a restart on the same checkpoint
    st.publish(_messages(w), f"{base}/topic")
    st.consume(w.spark, f"{base}/topic", f"{base}/bronze", f"{base}/rejected", f"{base}/checkpoint", AT)
    return _bronze(w, base).select("_event_id", "_record_number")


@query("T05_max_per_batch", "SELECT count(*) AS eventos, CAST(2 AS BIGINT) AS lotes FROM ev")
def t05(w: Warehouse):
    """Four files, two a batch: two batches."""
    messages = _messages(w).repartition(4)
    base, _ = _drain(w, messages, batches=2)
    return _bronze(w, base).agg(F.count(F.lit(1)).alias("eventos"), F.countDistinct("_lote").alias("lotes"))


@query("T06_drain", "SELECT count(*) AS filas, count(DISTINCT user_id) AS usuarios FROM ev")
def t06(w: Warehouse):
    base, drain = _drain(w, _messages(w))
    if drain.query.isActive:
        raise RuntimeError("the drain did not stop")
    rows = unwrap_payload(_bronze(w, base).select("raw_json"), SCHEMA)
    return rows.agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("user_id").alias("usuarios"))


@query("T07_write_batch", "SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def t07(w: Warehouse):
    base, _ = _drain(w, _messages(w).repartition(4), batches=1)
    return unwrap_payload(_bronze(w, base).select("raw_json"), SCHEMA).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "T08_stream_metrics",
    """SELECT * FROM (SELECT 'consumidos' AS metrica, count(*) + count(CASE WHEN event_type IN ('purchase', 'view', 'error') THEN 1 END) AS valor FROM ev
       UNION ALL SELECT 'nuevos', count(*) FROM ev
       UNION ALL SELECT 'duplicados', count(*) FROM ev WHERE event_type = 'purchase'
       UNION ALL SELECT 'invalidos', count(*) FROM ev WHERE event_type IN ('view', 'error'))""",
)
def t08(w: Warehouse):
    noisy = _with_noise(w)
    _, drain = _drain(w, noisy)
    metrics = st.stream_metrics(w.spark, drain, published=noisy.count())
    return st.metrics_frame(w.spark, metrics).filter(c("metrica") != "lotes")


@query(
    "T09_envelope",
    f"""SELECT {_ID} AS _kafka_key, event_id - (SELECT min(event_id) FROM ev) AS _kafka_offset, CAST(1 AS BIGINT) AS particiones,
        'eventos' AS _source_name, '{AT}' AS _consumed_at FROM ev""",
)
def t09(w: Warehouse):
    """One partition in the order of the events, in segments: the offset of a message is its place in the log."""
    ordered = _messages(w).withColumn("n", F.get_json_object("value", "$._record_number").cast("long"))
    base, _ = _drain(w, ordered, order="n")
    rows = _bronze(w, base)
    parts = rows.agg(F.countDistinct("_kafka_partition").alias("particiones"))
    from corredor.operators.joins import with_scalar

    return with_scalar(rows.select("_kafka_key", "_kafka_offset", "_source_name", "_consumed_at"), parts)


@query("T10_second_source", "SELECT boarding_id, strftime(utc, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc FROM am_raw")
def t10(w: Warehouse):
    rows = w.am_boardings_raw.withColumns({"_source_sha256": F.lit("am"), "_record_number": c("boarding_id")})
    base, _ = _drain(w, st.to_events(rows, "aerometro", AT, ["boarding_id", "user_hash", "station_code", "timestamp_utc", "fare"]))
    # times stay in UTC in Bronze
    payload = unwrap_payload(_bronze(w, base).select("raw_json"), "boarding_id bigint, timestamp_utc string")
    return payload.select("boarding_id", "timestamp_utc")
