"""Scans, ingestion, staging and snapshots: the driver's tables written as raw files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corredor.plans.silver import TM
from corredor.queries.bindings import Warehouse
from corredor.queries.oracle import ts
from corredor.queries.registry import query
from corredor.session import work_dir
from corredor.sources import bronze, raw, snapshot, staging

c = F.col
DATE, STAMP = "2024-02-01", "2024-02-01T00:00:00"


def _raw_csv(w: Warehouse, df, name: str, files: int = 3) -> str:
    path = work_dir(w.spark, name)
    df.repartition(files, df.columns[0]).sortWithinPartitions(df.columns[0]).write.option("header", True).option(
        "escape", '"'
    ).csv(path)
    return path


def _tu_csv(w: Warehouse) -> str:
    """Bus transactions as CSV files, one record per event."""
    rows = w.tu_transactions_raw.select(
        F.substring("bronze_record_id", 4, 20).alias("id"), "fecha", "hora", "num_tarjeta", "cod_parada", "ruta", "monto_centavos"
    )
    return _raw_csv(w, rows, "tu")


def _trip_json(w: Warehouse):
    """Train trips as nested JSON; an open trip has ``exit: null``."""
    trips = w.mr_trips_raw
    closed = c("exit_ts").isNotNull()
    end = F.when(closed, F.struct(c("exit_station").alias("station"), c("exit_ts").alias("ts")))
    doc = F.to_json(
        F.struct(
            "trip_id",
            "card",
            F.struct(c("entry_station").alias("station"), c("entry_ts").alias("ts")).alias("entry"),
            end.alias("exit"),
            c("fare_gtq").cast("double").alias("fare_gtq"),
            "duration_s",
        ),
        {"ignoreNullFields": "false"},
    )
    return trips.select("trip_id", doc.alias("value"))


def _trip_file(w: Warehouse) -> str:
    """JSON lines with a blank line after every trip that is still open."""
    rows = _trip_json(w)
    padded = rows.withColumn("value", F.when(c("value").contains('"exit":null'), F.concat("value", F.lit("\n"))).otherwise(c("value")))
    path = work_dir(w.spark, "mr")
    padded.repartitionByRange(2, "trip_id").sortWithinPartitions("trip_id").select("value").write.text(path)
    return path


_TU_SQL = """SELECT CAST(event_id AS VARCHAR) AS id, t.fecha, t.hora, t.num_tarjeta, coalesce(t.cod_parada, '') AS cod_parada, t.ruta,
       CAST(t.monto_centavos AS VARCHAR) AS monto_centavos FROM (SELECT *, CAST(substr(bronze_record_id, 4) AS BIGINT) AS event_id FROM tu_raw) t"""


@query("S01_csv_text_scan", _TU_SQL)
def s01(w: Warehouse):
    return raw.csv_text_scan(w.spark, _tu_csv(w)).drop("_file", "_block")


@query(
    "S02_jsonl_raw_scan",
    """SELECT CAST(trip_id AS BIGINT) AS trip_id, card FROM mr_raw""",
)
def s02(w: Warehouse):
    lines = raw.jsonl_raw_scan(w.spark, _trip_file(w))
    return lines.select(
        F.get_json_object("raw_json", "$.trip_id").cast("long").alias("trip_id"),
        F.get_json_object("raw_json", "$.card").alias("card"),
    )


@query(
    "S03_with_record_number",
    """SELECT event_id, row_number() OVER (PARTITION BY 1 ORDER BY event_id) AS numero FROM ev""",
)
def s03(w: Warehouse):
    path = work_dir(w.spark, "numbered")
    ordered = w.events.select(c("event_id").cast("string").alias("value"), "event_id")
    ordered.repartitionByRange(1, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return raw.with_record_number(raw.text_scan(w.spark, path), "numero").select(
        c("value").cast("long").alias("event_id"), "numero"
    )


@query(
    "S04_add_bronze_metadata",
    f"SELECT CAST(substr(bronze_record_id, 4) AS VARCHAR) AS id, 'tu' AS _source_name, '{STAMP}' AS _ingestion_ts, CAST(64 AS BIGINT) AS largo FROM tu_raw",
)
def s04(w: Warehouse):
    path = _tu_csv(w)
    numbered = raw.with_record_number(raw.csv_text_scan(w.spark, path))
    joined = numbered.join(raw.file_fingerprints(w.spark, path), "_file")
    return raw.add_bronze_metadata(joined, "tu", STAMP).select(
        "id", "_source_name", "_ingestion_ts", F.length("_source_sha256").alias("largo")
    )


def _ingested(w: Warehouse, path: str, kind="csv", base: str | None = None, at: str = STAMP, force=False, date: str = DATE):
    base = base or work_dir(w.spark, "bronze")
    run = bronze.ingest_once(w.spark, "tu", path, f"{base}/tu", f"{base}/manifest", date, at, kind, force)
    return base, run


def _entered(w: Warehouse, base: str, latest_batch: bool = False):
    return bronze.read_bronze(w.spark, f"{base}/tu", latest_batch, f"{base}/manifest")


@query("S05_write_bronze", f"SELECT '{DATE}' AS fecha_ingesta, count(*) AS filas FROM tu_raw")
def s05(w: Warehouse):
    base, _ = _ingested(w, _tu_csv(w))
    stored = w.spark.read.parquet(f"{base}/tu")
    return stored.groupBy(c("fecha_ingesta").cast("string").alias("fecha_ingesta")).agg(F.count(F.lit(1)).alias("filas"))


@query("S06_ingest_once", "SELECT (SELECT count(*) FROM tu_raw) AS primera, CAST(0 AS BIGINT) AS segunda, (SELECT count(*) FROM tu_raw) AS filas")
def s06(w: Warehouse):
    path = _tu_csv(w)
    base, first = _ingested(w, path)
    _, second = _ingested(w, path, base=base, at="2024-02-02T00:00:00")
    total = w.spark.read.parquet(f"{base}/tu").agg(F.count(F.lit(1)).alias("filas"))

    def rows(run, name):
        return run.agg(F.coalesce(F.sum("filas"), F.lit(0)).alias(name))

    from corredor.operators.joins import with_scalar

    return with_scalar(with_scalar(total, rows(first, "primera")), rows(second, "segunda"))


@query(
    "S06_same_time",
    """SELECT (SELECT count(*) FROM tu_raw) + count(*) AS filas, (SELECT count(*) FROM tu_raw) + count(*) AS en_manifiesto, CAST(2 AS BIGINT) AS entregas
       FROM tu_raw WHERE monto_centavos > 5000""",
)
def s06_same_time(w: Warehouse):
    """Two deliveries of one time stamp: both stay, and the manifest's rows are the rows that are there."""
    rows = w.tu_transactions_raw.select(F.substring("bronze_record_id", 4, 20).alias("id"), "monto_centavos")
    base, _ = _ingested(w, _raw_csv(w, rows, "all"))
    _ingested(w, _raw_csv(w, rows.filter(c("monto_centavos") > 5000), "dear"), base=base)
    from corredor.operators.joins import with_scalar

    entered = w.spark.read.parquet(f"{base}/manifest").agg(F.sum("filas").alias("en_manifiesto"), F.countDistinct("_batch").alias("entregas"))
    return with_scalar(_entered(w, base).agg(F.count(F.lit(1)).alias("filas")), entered)


@query("S07_force_reingest", "SELECT '2024-02-02T00:00:00' AS _ingestion_ts, count(*) AS filas FROM tu_raw")
def s07(w: Warehouse):
    path = _tu_csv(w)
    base, _ = _ingested(w, path)
    _ingested(w, path, base=base, at="2024-02-02T00:00:00", force=True)
    return _entered(w, base).groupBy("_ingestion_ts").agg(F.count(F.lit(1)).alias("filas"))


@query("S08_assert_written", "SELECT count(*) AS filas FROM orders")
def s08(w: Warehouse):
    path = work_dir(w.spark, "orders")
    orders = w.table("orders")
    orders.write.parquet(path)
    bronze.assert_written(w.spark, path, orders.count())
    return w.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("filas"))


@query("S06_blank_lines", "SELECT count(*) AS filas, CAST(count(*) AS BIGINT) AS distintas FROM tu_raw")
def s06_blank(w: Warehouse):
    """Every record followed by a blank line: blank lines are no records, and nothing is lost."""
    path = work_dir(w.spark, "blank")
    lines = w.tu_transactions_raw.select(F.concat(F.substring("bronze_record_id", 4, 20), F.lit(","), "fecha", F.lit("\n")).alias("value"))
    header = w.spark.range(1).select(F.lit("id,fecha").alias("value"))
    header.unionAll(lines).coalesce(1).write.text(path)
    base, _ = _ingested(w, path)
    return _entered(w, base).agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("id", "_record_number").alias("distintas"))


@query("S06_header_only", "SELECT CAST(0 AS BIGINT) AS filas, CAST(1 AS BIGINT) AS archivos, CAST(0 AS BIGINT) AS despues UNION ALL SELECT count(*), 3, 0 FROM tu_raw")
def s06_header(w: Warehouse):
    """A file with only its header is entered with 0 rows and is known from then on."""
    path = work_dir(w.spark, "header")
    w.spark.range(1).select(F.lit("id,fecha,hora,num_tarjeta,cod_parada,ruta,monto_centavos").alias("value")).coalesce(1).write.text(path)
    base, first = _ingested(w, path)
    _, again = _ingested(w, path, base=base, at="2024-02-02T00:00:00")
    _, rest = _ingested(w, _tu_csv(w), base=base, at="2024-02-03T00:00:00")

    def entries(run, later):
        return run.agg(F.sum("filas").alias("filas"), F.count(F.lit(1)).alias("archivos")).select("filas", "archivos", F.lit(later).cast("long").alias("despues"))

    return entries(first, again.count()).unionAll(entries(rest, 0))


@query("S09_read_bronze", "SELECT substr(bronze_record_id, 4) AS id FROM tu_raw UNION ALL SELECT substr(bronze_record_id, 4) FROM tu_raw WHERE monto_centavos > 5000")
def s09(w: Warehouse):
    return _entered(w, _two_deliveries(w)).select("id")


def _two_deliveries(w: Warehouse) -> str:
    """A first delivery with all bus rows and one a day later with the dear ones, three files each."""
    rows = w.tu_transactions_raw.select(F.substring("bronze_record_id", 4, 20).alias("id"), "monto_centavos")
    base, _ = _ingested(w, _raw_csv(w, rows, "all"))
    _ingested(w, _raw_csv(w, rows.filter(c("monto_centavos") > 5000), "dear"), base=base, at="2024-02-02T00:00:00", date="2024-02-02")
    return base


@query("S10_latest_batch", "SELECT substr(bronze_record_id, 4) AS id FROM tu_raw WHERE monto_centavos > 5000")
def s10(w: Warehouse):
    return _entered(w, _two_deliveries(w), latest_batch=True).select("id")


@query(
    "S11_unwrap_payload",
    "SELECT event_id, user_id, event_type FROM ev",
)
def s11(w: Warehouse):
    row = F.struct("event_id", "user_id", "event_type")
    wrapped = F.to_json(F.struct(row.alias("data"), F.lit("x").alias("_event_id")))
    message = F.when(c("event_type") == "view", F.to_json(row)).otherwise(wrapped)
    messages = w.events.select(message.alias("raw_json"))
    return staging.unwrap_payload(messages, "event_id bigint, user_id bigint, event_type string")


@query(
    "S12_flatten_trips",
    f"""SELECT trip_id, card, entry_station, {ts('entry_ts')}, exit_station, {ts('exit_ts')}, CAST(fare_gtq AS DOUBLE) AS fare_gtq, duration_s FROM mr_raw""",
)
def s12(w: Warehouse):
    return staging.flatten_trips(raw.jsonl_raw_scan(w.spark, _trip_file(w))).drop("_file", "_record_number")


@query("S13_project_contract", "SELECT p_partkey, p_brand, p_size FROM (SELECT p_partkey, p_brand, CAST(nullif(p_size, 7) AS DOUBLE) AS p_size FROM part)")
def s13(w: Warehouse):
    size = F.when(c("p_size") == 7, F.lit(float("nan"))).otherwise(c("p_size").cast("double"))
    return staging.project_contract(w.table("part").withColumn("p_size", size), ["p_partkey", "p_brand", "p_size"])


@query("S14_with_lineage_id", "SELECT 'abc:' || o_orderkey AS bronze_record_id, 'x' AS ingesta_timestamp FROM orders UNION ALL SELECT 'e' || event_id, strftime(t, '%Y-%m-%d %H:%M:%S') FROM ev")
def s14(w: Warehouse):
    batch = w.table("orders").select(
        F.lit("abc").alias("_source_sha256"), c("o_orderkey").alias("_record_number"), F.lit("x").alias("_ingestion_ts")
    )
    stream = w.events.select(F.concat(F.lit("e"), "event_id").alias("_event_id"), c("t").alias("_consumed_at"))
    cols = ["bronze_record_id", "ingesta_timestamp"]
    return staging.with_lineage_id(batch).select(*cols).unionByName(staging.with_lineage_id(stream).select(*cols))


@query("S15_nan_to_null", "SELECT event_id, CASE WHEN value >= 1 THEN value END AS value FROM events")
def s15(w: Warehouse):
    value = F.when(c("value") < 1, F.lit(float("nan"))).otherwise(c("value"))
    return staging.project_contract(w.table("events").withColumn("value", value), ["event_id", "value"])


@query("S16_min_user_catalog", "SELECT DISTINCT num_tarjeta FROM tu_raw")
def s16(w: Warehouse):
    return staging.min_user_catalog(w.tu_transactions_raw, "num_tarjeta")


@query("S17_rebuild_staging", "SELECT 'cliente' AS tabla, count(*) AS filas FROM customer UNION ALL SELECT 'pieza', count(*) FROM part")
def s17(w: Warehouse):
    base = work_dir(w.spark, "staging")
    staging.rebuild_staging({"cliente": w.table("nation"), "pieza": w.table("part")}, base)
    staging.rebuild_staging({"cliente": w.table("customer"), "pieza": w.table("part")}, base)
    counts = [
        staging.read_staging(w.spark, base, n).agg(F.lit(n).alias("tabla"), F.count(F.lit(1)).alias("filas"))
        for n in ("cliente", "pieza")
    ]
    return counts[0].unionByName(counts[1])


@query("S18_materialize", "SELECT r_name, n FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) WHERE n > 0")
def s18(w: Warehouse):
    joined = w.table("nation").join(w.table("region"), c("n_regionkey") == c("r_regionkey"))
    per_region = joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    target = work_dir(w.spark, "por_region")
    table = staging.materialize(f"por_region_{target[-12:]}", per_region, "table", path=target)
    return staging.materialize("v_por_region", table.filter(c("n") > 0), "view")


def _sources(w: Warehouse):
    return {**w.silver, snapshot.HISTORY: w.history, snapshot.QUARANTINE: w.quarantine}


_CUT = "2024-01-20 00:00:00"
_SNAPSHOT_SQL = f"""SELECT 'Transmetro' AS fuente, count(*) AS filas FROM tm WHERE fecha_hora < TIMESTAMP '{_CUT}'
   UNION ALL SELECT 'Transurbano', count(*) FROM tu WHERE fecha_hora < TIMESTAMP '{_CUT}'
   UNION ALL SELECT 'Aerometro', count(*) FROM am WHERE fecha_hora < TIMESTAMP '{_CUT}'
   UNION ALL SELECT 'MetroRiel', count(*) FROM mr WHERE ingreso < TIMESTAMP '{_CUT}' AND salida < TIMESTAMP '{_CUT}'
   UNION ALL SELECT 'historia', count(*) FROM scd WHERE commit_ts < TIMESTAMP '{_CUT}'
   UNION ALL SELECT 'cuarentena', count(*) FROM quarantine"""


@query("S19_export_snapshot", _SNAPSHOT_SQL)
def s19(w: Warehouse):
    return snapshot.export_snapshot(_sources(w), _CUT, work_dir(w.spark, "snapshot")).select("fuente", "filas")


@query("S20_import_snapshot", f"SELECT bronze_record_id, {ts('fecha_hora')}, CAST(tarifa AS DOUBLE) AS tarifa_quetzales FROM tm WHERE fecha_hora < TIMESTAMP '{_CUT}'")
def s20(w: Warehouse):
    out = work_dir(w.spark, "snapshot")
    snapshot.export_snapshot(_sources(w), _CUT, out)
    tables = snapshot.import_snapshot(w.spark, out, _CUT)
    return tables[TM].select("bronze_record_id", "fecha_hora", "tarifa_quetzales")


@query("S21_trace", "SELECT min(event_id) AS id FROM ev WHERE event_type = 'view'")
def s21(w: Warehouse):
    path = work_dir(w.spark, "one-file")
    rows = w.events.filter(c("event_type") == "view").select(c("event_id").alias("id"))
    rows.repartitionByRange(1, "id").sortWithinPartitions("id").write.option("header", True).csv(path)
    base, _ = _ingested(w, path)
    stored = w.spark.read.parquet(f"{base}/tu")
    sha = stored.select("_source_sha256").limit(1).head()[0]
    return bronze.trace(stored, f"{sha}:1").select(c("id").cast("long").alias("id"))


@query(
    "S22_sample_lineage",
    """SELECT bronze_record_id, hora, ruta FROM (SELECT f.id AS bronze_record_id, hora, ruta FROM facts f JOIN tu_raw r
       ON r.bronze_record_id = f.id WHERE modo = 'Transurbano' ORDER BY 1 LIMIT 1)""",
)
def s22(w: Warehouse):
    mine = w.boardings.filter(c("fuente_evento") == "Transurbano")
    return staging.sample_lineage(mine, w.tu_transactions_raw, ["hora", "ruta"])


@query("S22_sample_ids", "SELECT modo AS fuente_evento, min(id) AS bronze_record_id FROM facts GROUP BY 1 UNION ALL SELECT 'MetroRiel', min(id) FROM ftrips")
def s22b(w: Warehouse):
    return staging.sample_ids(w.boardings, "fuente_evento").unionByName(staging.sample_ids(w.trips, "fuente_evento"))


@query("S23_audit_payload", "SELECT count(*) AS diferencias FROM tu_raw WHERE monto_centavos > 20000")
def s23(w: Warehouse):
    path = _tu_csv(w)
    base, _ = _ingested(w, path)
    stored = w.spark.read.parquet(f"{base}/tu")
    dear = c("monto_centavos").cast("long") > 20000
    altered = stored.withColumn("ruta", F.when(dear, F.concat("ruta", F.lit("*"))).otherwise(c("ruta")))
    again = raw.with_record_number(raw.csv_text_scan(w.spark, path)).withColumn("_source_file", raw.file_name(c("_file")))
    found = bronze.audit_payload(altered, again, ["id", "fecha", "hora", "num_tarjeta", "cod_parada", "ruta", "monto_centavos"])
    return found.agg(F.count(F.lit(1)).alias("diferencias"))


@query(
    "S24_validate_raw",
    """SELECT 'claves' AS problema, CAST(count(*) AS VARCHAR) AS detalle FROM mr_raw WHERE exit_ts IS NULL
       UNION ALL SELECT 'json_invalido', CAST(count(*) AS VARCHAR) FROM mr_raw WHERE duration_s > 3000
       UNION ALL SELECT 'filas', CAST(count(*) AS VARCHAR) FROM mr_raw
       UNION ALL SELECT 'falta', ''""",
)
def s24(w: Warehouse):
    path = work_dir(w.spark, "contract")
    rows = _trip_json(w).join(w.mr_trips_raw.select("trip_id", "exit_ts", "duration_s"), "trip_id")
    broken = (
        F.when(c("exit_ts").isNull(), F.regexp_replace("value", '"card"', '"tarjeta"'))
        .when(c("duration_s") > 3000, F.concat("value", F.lit("{")))
        .otherwise(c("value"))
    )
    # one file behind a shuffle: its writer streams rows, and the join stays in many tasks
    rows.select(broken.alias("value")).repartition(1).write.text(path)
    listing = w.spark.read.format("binaryFile").load(path).select(raw.file_name(c("path")).alias("n"))
    name = listing.filter(c("n").startswith("part-")).head()[0]
    contract = {
        name: {"keys": ["trip_id", "card", "entry", "exit", "fare_gtq", "duration_s"], "rows": 1},
        "otra.csv": {"columns": ["a", "b"]},
    }
    return raw.validate_raw(w.spark, path, contract).select("problema", "detalle")

