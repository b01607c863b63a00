from pyspark.sql import functions as F

from corredor.sources.staging import unwrap_payload
from corredor.streaming import events as st

AT = "2024-01-01T00:00:00"


def messages(spark, data):
    rows = spark.createDataFrame(data, "_source_sha256 string, _record_number bigint, card string, fare double")
    return st.to_events(rows, "tm", AT, ["card", "fare"])


def run(spark, base):
    return st.consume(spark, f"{base}/topic", f"{base}/bronze", f"{base}/dead", f"{base}/cp", AT)


def test_replays_are_dropped_and_equal_business_rows_survive(spark, tmp_path):
    base = str(tmp_path)
    first = messages(spark, [("f", 1, "c", 1.0), ("f", 2, "c", 1.0), ("f", 1, "c", 1.0)])
    st.publish(first, f"{base}/topic")
    noise = spark.createDataFrame([("{not json",), ('{"data": {}}',), ('{"_event_id": "", "data": {}}',), ('{"_event_id": "x"} y',)], "value string")
    st.publish(noise, f"{base}/topic")
    metrics = st.stream_metrics(spark, run(spark, base), published=7)
    assert {k: metrics[k] for k in ("consumidos", "nuevos", "duplicados", "invalidos")} == {
        "consumidos": 7, "nuevos": 2, "duplicados": 1, "invalidos": 4,
    }
    # the same messages after a restart add nothing; a new one does
    st.publish(first, f"{base}/topic")
    st.publish(messages(spark, [("f", 3, "d", 2.0)]), f"{base}/topic")
    run(spark, base)
    stored = spark.read.parquet(f"{base}/bronze")
    assert sorted(r["_record_number"] for r in stored.collect()) == [1, 2, 3]
    assert spark.read.parquet(f"{base}/dead").count() == 4
    payload = unwrap_payload(stored.select("_event_id", "raw_json"), "card string, fare double")
    assert payload.filter(F.col("card") == "c").count() == 2


def test_invalid_utf8_is_rejected(spark):
    raw = spark.createDataFrame([(bytearray(b'{"_event_id": "\xff"}'),), (bytearray(b'{"_event_id": "a"}'),)], "_bytes binary")
    assert [r["_valid"] for r in st.decode(raw).collect()] == [False, True]


def test_ids_are_deterministic(spark):
    a = messages(spark, [("f", 1, "c", 1.0)]).head()["key"]
    b = messages(spark, [("f", 1, "other", 9.0)]).head()["key"]
    c = messages(spark, [("g", 1, "c", 1.0)]).head()["key"]
    assert a == b != c


def test_horizon_drops_recent_replays_and_loses_no_late_row(spark, tmp_path):
    base = str(tmp_path)
    rows = messages(spark, [("f", 1, "c", 1.0), ("f", 2, "c", 1.0)])
    st.publish(rows.unionByName(rows), f"{base}/topic")
    st.consume(spark, f"{base}/topic", f"{base}/bronze", f"{base}/dead", f"{base}/cp", AT, horizon="7 days")
    data = spark.createDataFrame([("g", i, "c", 1.0) for i in range(10)], "_source_sha256 string, _record_number bigint, card string, fare double")
    late = st.to_events(data, "tm", "2023-06-01T00:00:00", ["card", "fare"])
    st.publish(rows.unionByName(late), f"{base}/topic")
    again = st.consume(spark, f"{base}/topic", f"{base}/bronze", f"{base}/dead", f"{base}/cp", "2024-01-02", horizon="7 days")
    assert spark.read.parquet(f"{base}/bronze").count() == 12
    got = st.stream_metrics(spark, again)
    assert (got["nuevos"], got["duplicados"], got["invalidos"]) == (10, 2, 0)


def test_counts_are_exact_over_more_batches_than_progress_keeps(spark, tmp_path):
    base = str(tmp_path)
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        for i in range(6):
            st.publish(messages(spark, [("f", 10 * i + k, "c", 1.0) for k in range(5)]).coalesce(1), f"{base}/topic")
        drain = st.consume(spark, f"{base}/topic", f"{base}/bronze", f"{base}/dead", f"{base}/cp", AT, max_per_batch=1)
        got = st.stream_metrics(spark, drain, published=30)
        assert got == {"consumidos": 30, "nuevos": 30, "duplicados": 0, "invalidos": 0, "lotes": 6}
    finally:
        spark.conf.set(name, before)


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "sink")
    st.write_batch(spark.range(3), path, 1)
    st.write_batch(spark.range(5), path, 2)
    st.write_batch(spark.range(3), path, 1)
    assert spark.read.parquet(path).count() == 8


def test_offsets_are_lines_of_their_file(spark, tmp_path):
    base = str(tmp_path)
    st.publish(messages(spark, [("f", k, "c", 1.0) for k in range(7)]).coalesce(1), f"{base}/topic")
    run(spark, base)
    got = {r["_record_number"]: r["_kafka_offset"] for r in spark.read.parquet(f"{base}/bronze").collect()}
    assert got == {k: k for k in range(7)}


def test_a_log_in_segments_is_one_partition_with_offsets_that_count_on(spark, tmp_path):
    for per_batch in (None, 3):
        base = str(tmp_path / f"log{per_batch}")
        rows = messages(spark, [("f", (k * 37) % 100, "c", 1.0) for k in range(100)])
        st.publish_log(rows.withColumn("n", F.get_json_object("value", "$._record_number").cast("long")), "n", f"{base}/topic", rows=16)
        assert len(list((tmp_path / f"log{per_batch}" / "topic").glob("base_offset=*/*.txt"))) > 4  # no task writes the whole log
        st.consume(spark, f"{base}/topic", f"{base}/bronze", f"{base}/dead", f"{base}/cp", AT, max_per_batch=per_batch)
        got = spark.read.parquet(f"{base}/bronze").collect()
        assert sorted((r["_record_number"], r["_kafka_offset"]) for r in got) == [(k, k) for k in range(100)]
        assert len({r["_kafka_partition"] for r in got}) == 1


def test_a_batch_opens_only_buckets_and_lots_that_its_ids_hit(spark, tmp_path):
    base = str(tmp_path)
    bronze, index, lots, buckets = f"{base}/bronze", f"{base}/bronze_ids", 100, 8
    schema = "_event_id string, _published_at string, _lote bigint"
    made = spark.createDataFrame([(f"{n}:{k}", AT, n) for n in range(lots) for k in range(4)], schema).coalesce(1)
    made.write.partitionBy("_lote").parquet(bronze)
    for n in range(lots):
        st.index_batch(made.filter(F.col("_lote") == n), index, n, buckets)

    def asked(ids, batch=lots):
        events = spark.createDataFrame([(i,) for i in ids], "_event_id string")
        found = st.stored_candidates(spark, events, bronze, index, batch, buckets)
        return sorted({int(f.split("_lote=")[1].split("/")[0]) for f in found.inputFiles()})

    assert asked(["new", "other"]) == []
    assert asked(["new", "7:2", "93:0"]) == [7, 93]
    assert asked(["7:2"], batch=7) == []
    # of the index only the bucket of the id is opened, at most one file a lot
    rows = st.index_rows(spark, index, range(lots), [3])
    opened = rows.select(F.col("_metadata.file_path").alias("f")).distinct()
    assert opened.filter("f NOT LIKE '%/_cubo=3/%'").count() == 0 and 0 < opened.count() <= lots
    # a lot without a finished index is asked itself, and so are all once the index is gone
    (tmp_path / "bronze_ids" / "_lote=5" / "_SUCCESS").unlink()
    assert asked(["new"]) == [5]
    assert st.stored_candidates(spark, made.limit(1), bronze, f"{base}/none", lots).count() == 4 * lots


def test_replays_of_any_age_are_found_through_the_index(spark, tmp_path):
    base = str(tmp_path)
    for i in range(5):
        st.publish(messages(spark, [("f", 10 * i + k, "c", 1.0) for k in range(5)]).coalesce(1), f"{base}/topic")
        run(spark, base)
    st.publish(messages(spark, [("f", 0, "c", 1.0), ("f", 44, "c", 1.0), ("f", 99, "c", 1.0)]), f"{base}/topic")
    run(spark, base)
    stored = spark.read.parquet(f"{base}/bronze")
    assert stored.count() == stored.select("_event_id").distinct().count() == 26
    assert spark.read.parquet(f"{base}/bronze_ids").count() == 26


def test_noise_is_made_of_the_events_it_needs(spark):
    from pyspark.sql import functions as F

    from corredor.queries import streams
    from corredor.queries.bindings import Warehouse

    w = Warehouse(spark, "/root/testdata/sf0.001")
    noisy = streams._with_noise(w)
    assert "$.data.event_type" not in noisy._jdf.queryExecution().optimizedPlan().toString()
    m = streams._messages(w)
    kind = F.get_json_object("value", "$.data.event_type")
    for one in ("purchase", "view", "error"):
        assert streams._messages(w, kind=one).exceptAll(m.filter(kind == one)).isEmpty()
        assert streams._messages(w, kind=one).count() == m.filter(kind == one).count() > 0
