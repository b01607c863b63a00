import pytest
from pyspark.sql import functions as F

from corredor.sources import bronze, raw, snapshot, staging
from fixtures import at, rows, silver


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_text_keeps_blanks_and_drops_the_mark(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿id,nombre,zona\n007,"x, ""y""",\n2,"",NA\n')
    got = rows(raw.csv_text_scan(spark, path), "id", "nombre", "zona")
    assert got == [("007", 'x, "y"', ""), ("2", "", "NA")]


def test_record_numbers_across_splits(spark, tmp_path):
    path = write(tmp_path / "n.txt", "".join(f"{i:06d}\n" for i in range(1, 3001)))
    other = write(tmp_path / "m.txt", "".join(f"{i:06d}\n" for i in range(1, 11)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = raw.with_record_number(raw.text_scan(spark, [path, other]))
        assert numbered.filter(F.col("value").cast("int") != F.col("_record_number")).count() == 0
        assert numbered.count() == 3010
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_record_numbers_survive_another_split_layout(spark, tmp_path):
    path = write(tmp_path / "big.txt", "".join(f"{i:07d}\n" for i in range(1, 60001)))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "300000")
        numbered = raw.with_record_number(raw.text_scan(spark, path))
        spark.conf.set(names[0], "20000")
        spark.conf.set(names[1], "1")
        assert numbered.filter(F.col("value").cast("int") != F.col("_record_number")).count() == 0
        assert numbered.select("_record_number").distinct().count() == 60000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_json_lines_keep_original_numbers_and_reject_bad_lines(spark, tmp_path):
    good = write(tmp_path / "g.jsonl", '{"a":1}\n\n  \n{"a":2}\n')
    assert rows(raw.jsonl_raw_scan(spark, good), "_record_number", "raw_json") == [(1, '{"a":1}'), (4, '{"a":2}')]
    bad = write(tmp_path / "b.jsonl", '{"a":1}\n{"a":\n')
    with pytest.raises(Exception, match="invalid JSON"):
        raw.jsonl_raw_scan(spark, bad).collect()


def ingest(spark, tmp_path, path, at_, force=False):
    return bronze.ingest_once(
        spark, "s", path, str(tmp_path / "bronze"), str(tmp_path / "manifest"), at_[:10], at_, force=force
    ).count()


def entered(spark, tmp_path, latest_batch=False):
    return bronze.read_bronze(spark, str(tmp_path / "bronze"), latest_batch, str(tmp_path / "manifest"))


def test_ingestion_is_idempotent_by_content(spark, tmp_path):
    write(tmp_path / "in" / "uno año.csv", "id,v\n1,a\n2,b\n")
    folder = str(tmp_path / "in")
    assert ingest(spark, tmp_path, folder, "2024-01-01T00:00:00") == 1
    assert ingest(spark, tmp_path, folder, "2024-01-02T00:00:00") == 0
    # a renamed copy has the same content; a changed one does not
    write(tmp_path / "in" / "copy.csv", "id,v\n1,a\n2,b\n")
    write(tmp_path / "in" / "two.csv", "id,v\n1,a\n2,c\n")
    assert ingest(spark, tmp_path, folder, "2024-01-03T00:00:00") == 1
    assert entered(spark, tmp_path).count() == 4
    assert ingest(spark, tmp_path, folder, "2024-01-03T09:00:00", force=True) == 2
    stored = entered(spark, tmp_path)
    # of the forced day the last entry of a file counts
    assert stored.filter("fecha_ingesta = '2024-01-03'").select("_ingestion_ts").distinct().count() == 1
    assert stored.count() == 6
    latest = entered(spark, tmp_path, latest_batch=True)
    assert latest.count() == 4 and latest.select("_source_sha256").distinct().count() == 2
    sha = latest.filter("v = 'c'").head()["_source_sha256"]
    assert bronze.trace(latest, f"{sha}:2").head()["id"] == "2"


def test_a_delivery_of_three_files_is_one_batch(spark, tmp_path):
    for name in "abc":
        write(tmp_path / "in" / f"{name}.csv", "id,v\n" + "".join(f"{i},{name}\n" for i in range(10)))
    assert ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00") == 3
    assert entered(spark, tmp_path, latest_batch=True).count() == 30


def test_blank_lines_and_header_only_files(spark, tmp_path):
    write(tmp_path / "in" / "blank.csv", "id,v\n1,a\n\n2,b\n\n")
    write(tmp_path / "in" / "head.csv", "id,v\n")
    assert ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00") == 2
    assert ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-02T00:00:00") == 0
    assert sorted((r["id"], r["_record_number"]) for r in entered(spark, tmp_path).collect()) == [("1", 1), ("2", 2)]
    only = tmp_path / "only"
    write(only / "in" / "head.csv", "id,v\n")
    assert ingest(spark, only, str(only / "in"), "2024-01-01T00:00:00") == 1


def test_lost_rows_raise_and_leave_nothing_visible(spark, tmp_path, monkeypatch):
    write(tmp_path / "in" / "a.csv", "id,v\n1,a\n2,b\n")
    write(tmp_path / "in" / "b.csv", "id,v\n3,a\n")
    full = bronze.write_bronze
    monkeypatch.setattr(bronze, "write_bronze", lambda df, *a: full(df.filter("id <> '3'"), *a))
    with pytest.raises(RuntimeError, match="differ"):
        ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00")
    monkeypatch.undo()
    assert ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00") == 2
    assert entered(spark, tmp_path).count() == 3


def test_two_deliveries_of_one_time_keep_all_rows(spark, tmp_path):
    write(tmp_path / "in" / "a.csv", "id,v\n" + "".join(f"{i},a\n" for i in range(10)))
    assert ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00") == 1
    write(tmp_path / "in" / "b.csv", "id,v\n" + "".join(f"{i},b\n" for i in range(7)))
    assert ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00") == 1
    entries = spark.read.parquet(str(tmp_path / "manifest"))
    assert entered(spark, tmp_path).count() == 17 and entries.agg(F.sum("filas")).head()[0] == 17
    assert entered(spark, tmp_path, latest_batch=True).count() == 7


def test_a_crash_before_the_log_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    write(tmp_path / "in" / "a.csv", "id,v\n1,a\n2,b\n")
    real = bronze.write_once
    monkeypatch.setattr(bronze, "write_once", lambda df, name: (_ for _ in ()).throw(OSError("crash")) if name == "manifest-entry" else real(df, name))
    with pytest.raises(OSError, match="crash"):
        ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00")
    monkeypatch.undo()
    assert len(bronze.deliveries(spark, str(tmp_path / "bronze"))) == 1
    assert ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00") == 1
    assert entered(spark, tmp_path).count() == 2 and len(bronze.deliveries(spark, str(tmp_path / "bronze"))) == 2


def test_two_calls_at_once_count_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    write(tmp_path / "in" / "a.csv", "id,v\n1,a\n2,b\n")
    with ThreadPoolExecutor(2) as pool:
        calls = [pool.submit(ingest, spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00") for _ in range(2)]
        assert all(c.result() in (0, 1) for c in calls)
    assert entered(spark, tmp_path).count() == 2


def test_vanished_output_is_ingested_again_and_named_batches_are_refused(spark, tmp_path):
    import shutil

    write(tmp_path / "in" / "a.csv", "id,v\n1,a\n2,b\n")
    write(tmp_path / "in" / "head.csv", "id,v\n")
    assert ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00") == 2
    shutil.rmtree(tmp_path / "bronze")
    assert ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-02T00:00:00") == 1
    assert entered(spark, tmp_path).count() == 2
    call = lambda: bronze.ingest_once(
        spark, "s", str(tmp_path / "in"), str(tmp_path / "bronze"), str(tmp_path / "manifest"), "2024-01-01", "t", force=True, batch="lote"
    ).count()
    assert call() == 2
    with pytest.raises(ValueError, match="lote"):
        call()
    (date, name), = [d for d in bronze.deliveries(spark, str(tmp_path / "bronze")) if d[1].startswith("lote")]
    with pytest.raises(Exception, match="already exists"):
        bronze.write_bronze(spark.range(1), str(tmp_path / "bronze"), date, name)


def test_ingestion_leaves_no_scratch(spark, tmp_path):
    from corredor import session

    write(tmp_path / "in" / "a.csv", "id,v\n1,a\n")
    before = session.scratch_mark(spark)
    assert ingest(spark, tmp_path, str(tmp_path / "in"), "2024-01-01T00:00:00") == 1
    assert session.scratch_mark(spark) == before


def test_scratch_copies_can_be_released(spark, tmp_path):
    from corredor import session

    path = write(tmp_path / "n.txt", "a\nb\n")
    assert raw.with_record_number(raw.text_scan(spark, path)).count() == 2
    assert session.release_scratch(spark) >= 2 and session.release_scratch(spark) == 0


def test_reordered_lines_are_other_content(spark, tmp_path):
    write(tmp_path / "x" / "a.csv", "id\n1\n2\n")
    write(tmp_path / "x" / "b.csv", "id\n2\n1\n")
    prints = raw.file_fingerprints(spark, str(tmp_path / "x"))
    assert prints.select("_source_sha256").distinct().count() == 2


def test_payload_audit(spark, tmp_path):
    path = write(tmp_path / "p.csv", "id,v\n1,a\n2,b\n")
    scan = raw.with_record_number(raw.csv_text_scan(spark, path)).withColumn("_source_file", raw.file_name(F.col("_file")))
    assert bronze.audit_payload(scan, scan, ["id", "v"]).count() == 0
    altered = scan.withColumn("v", F.lit("a"))
    assert rows(bronze.audit_payload(altered, scan, ["id", "v"]), "_record_number") == [(2,)]


def test_contract(spark, tmp_path):
    write(tmp_path / "r" / "ok.csv", "﻿a,b\n1,2\n")
    write(tmp_path / "r" / "bad.csv", "b,a\n1,2\n")
    write(tmp_path / "r" / "t.jsonl", '{"k":1,"z":2}\n{"z":2}\n{oops\n')
    write(tmp_path / "r" / "extra.txt", "x\n")
    contract = {
        "ok.csv": {"columns": ["a", "b"], "rows": 1}, "bad.csv": {"columns": ["a", "b"], "rows": 5},
        "t.jsonl": {"keys": ["k", "z"]}, "gone.csv": {"columns": ["a"]},
    }
    assert rows(raw.validate_raw(spark, str(tmp_path / "r"), contract)) == [
        ("bad.csv", "cabecera", "1"), ("bad.csv", "filas", "1"), ("extra.txt", "sobra", ""), ("gone.csv", "falta", ""),
        ("t.jsonl", "claves", "1"), ("t.jsonl", "json_invalido", "1"),
    ]


def test_trips_are_flattened_null_safe(spark):
    df = spark.createDataFrame([('{"trip_id":1,"card":"MR1","entry":{"station":5,"ts":"t"},"exit":null,"fare_gtq":2.5,"duration_s":null}',)], "raw_json string")
    row = staging.flatten_trips(df).head()
    assert (row["entry_station"], row["exit_station"], row["exit_ts"]) == (5, None, None)


def test_missing_contract_columns_fail(spark):
    with pytest.raises(ValueError, match="missing columns"):
        staging.project_contract(spark.range(1), ["id", "otra"])


def test_rebuild_publishes_only_complete_versions(spark, tmp_path):
    base = str(tmp_path / "stg")
    staging.rebuild_staging({"t": spark.range(3)}, base)
    with pytest.raises(RuntimeError):
        staging.rebuild_staging({"t": spark.range(5)}, base, expected={"t": 6})
    assert staging.read_staging(spark, base, "t").count() == 3


def test_rebuild_runs_each_input_once_and_keeps_few_versions(spark, tmp_path):
    import os

    ran = spark.sparkContext.accumulator(0)
    counted = spark.sparkContext.parallelize(range(3), 2).map(lambda i: (ran.add(1), (i,))[1])
    base = str(tmp_path / "stg")
    tables = {"t": spark.createDataFrame(counted, "id long").filter("id >= 0"), "vacia": spark.range(5).filter("id < 0"), "nada": spark.range(0)}
    staging.rebuild_staging(tables, base, keep=2)
    assert ran.value == 3
    for _ in range(3):
        last = staging.rebuild_staging({"t": spark.range(7), "vacia": spark.range(0)}, base, keep=2)
    assert staging.read_staging(spark, base, "t").count() == 7 and staging.read_staging(spark, base, "vacia").count() == 0
    left = [n for n in os.listdir(f"{base}/t") if n.startswith("version=")]
    assert len(left) == 2 and f"version={last}" in left


def test_snapshot_round_trip_and_tampering(spark, tmp_path):
    data = silver(spark, tm=[("a", "TC-1", "2026-06-01T08:00:00.250000", 1, "p,\"q"), ("b", "TC-1", "2026-09-01", 1, "p")],
                  mr=[("m", "MR1", "2026-08-29T23:50", "2026-08-30", 1, "1")])
    extra = {
        snapshot.HISTORY: spark.createDataFrame([("TC-1", "INSERT", at("2026-01-01"))], "tarjeta_id string, operacion string, valid_from timestamp_ntz"),
        snapshot.QUARANTINE: spark.createDataFrame([("Transmetro", "z")], "fuente string, id_registro_crudo string"),
    }
    out = str(tmp_path / "snap")
    cut = "2026-08-30"
    counts = {r["fuente"]: r["filas"] for r in snapshot.export_snapshot({**data, **extra}, cut, out).collect()}
    assert counts == {"Transmetro": 1, "Transurbano": 0, "Aerometro": 0, "MetroRiel": 0, "historia": 1, "cuarentena": 1}
    tables = snapshot.import_snapshot(spark, out, cut)
    assert rows(tables["Transmetro"], "bronze_record_id", "estacion_id", "fecha_hora") == [("a", 'p,"q', at("2026-06-01T08:00:00.250000"))]
    extra[snapshot.QUARANTINE].write.mode("append").option("header", True).csv(f"{out}/{snapshot.QUARANTINE}")
    with pytest.raises(ValueError, match="manifest"):
        snapshot.import_snapshot(spark, out, cut)


def test_the_contract_file_is_written_without_narrowing_its_join(spark, monkeypatch):
    from corredor.queries import registry

    registry.load_all()

    def narrowed(self, n):
        raise AssertionError("coalesce puts the join before it into the same tasks")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", narrowed)
    found = {r["problema"]: r["detalle"] for r in registry.QUERIES["S24_validate_raw"](spark, "/root/testdata/sf0.001").collect()}
    assert set(found) == {"claves", "json_invalido", "filas", "falta"} and int(found["filas"]) > int(found["claves"]) > 0
