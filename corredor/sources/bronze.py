"""Bronze layer: idempotent ingestion, batches, lineage lookups."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corredor.sources.raw import (
    add_bronze_metadata,
    csv_text_scan,
    file_fingerprints,
    file_name,
    jsonl_raw_scan,
    with_record_number,
)
from corredor.session import scratch_scope, write_once

MANIFEST = (
    "_source_sha256 string, _source_file string, _source_name string, filas bigint, _ingestion_ts string, "
    "fecha_ingesta string, _batch string, _path string, _bytes bigint, _modified timestamp, _orden bigint"
)


def write_bronze(df: DataFrame, path: str, date: str, batch: str) -> None:
    """Snappy Parquet by ingestion date and delivery. A delivery is written once: one that exists is an error.

    The delivery is written into its own folder, so calls that run at once do not share a commit.
    """
    df.write.mode("errorifexists").option("compression", "snappy").parquet(f"{path}/fecha_ingesta={date}/_batch={batch}")


_PLACE = re.compile(r"/fecha_ingesta=([^/]+)/_batch=([^/]+)/")


def deliveries(spark: SparkSession, path: str) -> set[tuple[str, str]]:
    """(date, batch) of the deliveries that have files; read from the file listing, no file is opened."""
    try:
        files = spark.read.parquet(path).inputFiles()
    except AnalysisException:
        return set()
    return {(unquote(m[1]), unquote(m[2])) for m in map(_PLACE.search, files) if m}


def delivery_name(label: str) -> str:
    """A name that no other call has, so attempts never meet: the label and a random part."""
    return f"{label}-a{uuid.uuid4().hex[:12]}"


def entered_files(spark: SparkSession, manifest: str, bronze: str) -> DataFrame:
    """Manifest entries whose delivery is still there; files of a vanished one count as not ingested.

    Entries without rows have no files to lose. Deliveries are few, and the driver lists their files in any case.
    """
    there = spark.createDataFrame(sorted(deliveries(spark, bronze)), "fecha_ingesta string, _batch string")
    entries = read_or_empty(spark, manifest, MANIFEST)
    empty = entries.filter(F.col("filas") == 0)
    return entries.filter(F.col("filas") > 0).join(there, ["fecha_ingesta", "_batch"], "left_semi").select(*empty.columns).unionAll(empty)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def assert_written(spark: SparkSession, path: str, expected: int, condition=None) -> int:
    """Rows read back from the sink; raises when they are not the expected number."""
    written = spark.read.parquet(path)
    rows = (written if condition is None else written.filter(condition)).count()
    if rows != expected:
        raise RuntimeError(f"{path}: {rows} rows written, {expected} expected")
    return rows


def _listing(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Path, size and modification time of each file; no content is read."""
    return spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_size").alias("_bytes"),
        F.col("_metadata.file_modification_time").alias("_modified"),
    )


def ingest_once(
    spark: SparkSession,
    source: str,
    paths: str | Sequence[str],
    bronze: str,
    manifest: str,
    date: str,
    ingested_at: str,
    kind: str = "csv",
    force: bool = False,
    batch: str | None = None,
) -> DataFrame:
    """Ingest the files whose content is not in the manifest, or all of them if forced.

    Every call is an attempt of its own and writes a delivery that no other call has: ``batch`` (default: the time of
    ingestion) with a random part, so two calls of one time, a retry and parallel calls never touch each other's rows.
    The manifest is an append-only log, written last, and says which delivery of a file counts (``read_bronze``): what
    failed before it is never visible, and of a content that two calls ingested at once the last entry counts. A ``batch``
    that was named before is refused. Files of a delivery that has vanished are ingested again. Only files whose path, size
    or time changed are hashed. Returns the manifest rows of this run; a file without records is entered with 0 rows.
    Scratch copies are removed when the run ends, also by an error.
    """
    label = re.sub(r"\W+", "-", batch or ingested_at)
    with scratch_scope(spark):
        return _ingest(spark, source, paths, bronze, manifest, date, ingested_at, kind, force, label, batch is not None)


def _ingest(spark, source, paths, bronze, manifest, date, ingested_at, kind, force, label, named) -> DataFrame:
    entered = entered_files(spark, manifest, bronze)
    if named and entered.filter(F.col("_batch").rlike(f"^{re.escape(label)}-a[0-9a-f]{{12}}$")).take(1):
        raise ValueError(f"the manifest already has a delivery {label}")
    batch = delivery_name(label)
    listed = _listing(spark, paths)
    if not force:
        listed = listed.join(entered.select("_path", "_bytes", "_modified"), ["_path", "_bytes", "_modified"], "left_anti")
    # the reader takes a list of paths; the driver lists the files in any case
    changed = {r["_path"]: r for r in listed.collect()}
    if not changed:
        return spark.createDataFrame([], MANIFEST)
    found = file_fingerprints(spark, [unquote(p) for p in changed])
    if not force:
        found = found.join(entered.select("_source_sha256"), "_source_sha256", "left_anti")
    first = Window.partitionBy("_source_sha256").orderBy("_file")  # of equal files of a delivery one counts
    found = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    todo = write_once(found.join(listed.withColumnRenamed("_path", "_file"), "_file"), "to-ingest")
    new_paths = [unquote(r["_file"]) for r in todo.select("_file").collect()]
    if not new_paths:
        return spark.createDataFrame([], MANIFEST)
    scan = with_record_number(csv_text_scan(spark, new_paths)) if kind == "csv" else jsonl_raw_scan(spark, new_paths)
    rows = add_bronze_metadata(scan.join(todo.select("_file", "_source_sha256"), "_file"), source, ingested_at)
    write_bronze(rows, bronze, date, batch)
    stored = read_or_empty(spark, bronze, "_source_sha256 string, fecha_ingesta string, _batch string")
    counts = (
        stored.filter((F.col("fecha_ingesta") == date) & (F.col("_batch") == batch))
        .groupBy("_source_sha256")
        .agg(F.count(F.lit(1)).alias("filas"))
    )
    order = (read_or_empty(spark, manifest, MANIFEST).agg(F.max("_orden")).first()[0] or 0) + 1
    entry = todo.join(counts, "_source_sha256", "left").select(
        "_source_sha256",
        file_name(F.col("_file")).alias("_source_file"),
        F.lit(source).alias("_source_name"),
        F.coalesce("filas", F.lit(0)).cast("bigint").alias("filas"),
        F.lit(ingested_at).alias("_ingestion_ts"),
        F.lit(date).alias("fecha_ingesta"),
        F.lit(batch).alias("_batch"),
        F.col("_file").alias("_path"),
        "_bytes",
        "_modified",
        F.lit(order).cast("bigint").alias("_orden"),
        # the header of a CSV is a line but no record; blank lines are none in either format
        (F.col("registros") - (1 if kind == "csv" else 0)).alias("_expected"),
    )
    entry = write_once(entry, "manifest-entry")
    lost = entry.filter(F.col("filas") != F.greatest("_expected", F.lit(0))).select("_path", "_expected", "filas").take(1)
    if lost:
        raise RuntimeError(f"{source}: written rows differ from the lines read: {lost[0]}")
    # an entry per folder: entries written at once do not share a commit either
    entry.drop("_expected", "_batch").write.mode("errorifexists").parquet(f"{manifest}/_batch={batch}")
    return spark.read.schema(MANIFEST).parquet(manifest).filter(F.col("_batch") == batch)


def read_bronze(spark: SparkSession, path: str, latest_batch: bool = False, manifest: str | None = None) -> DataFrame:
    """All deliveries, or only the latest by (date, modification time, batch).

    With ``manifest`` only entered files count, and of a file entered twice on a date the last entry.
    The choice of a delivery is a scalar subquery on the partition columns, so others are pruned.
    """
    df = spark.read.parquet(path)
    if manifest is not None:
        last = (
            spark.read.schema(MANIFEST).parquet(manifest)
            .groupBy("_source_sha256", "fecha_ingesta")
            .agg(F.max_by("_batch", F.struct("_ingestion_ts", "_orden", "_batch")).alias("_batch"))
            .select("_source_sha256", F.col("fecha_ingesta").cast(df.schema["fecha_ingesta"].dataType), F.col("_batch").cast(df.schema["_batch"].dataType))
        )
        df = df.join(last, ["_source_sha256", "fecha_ingesta", "_batch"], "left_semi")
    if not latest_batch:
        return df
    batches = (
        spark.read.parquet(path)
        .select("fecha_ingesta", "_batch", F.col("_metadata.file_modification_time").alias("_mtime"))
        .groupBy("fecha_ingesta", "_batch")
        .agg(F.max("_mtime").alias("_mtime"))
    )
    if manifest is not None:
        batches = batches.join(last, ["fecha_ingesta", "_batch"], "left_semi")
    newest = batches.agg(
        F.max_by(
            F.concat_ws("/", F.col("fecha_ingesta").cast("string"), F.col("_batch").cast("string")),
            F.struct("fecha_ingesta", "_mtime", "_batch"),
        )
    )
    here = F.concat_ws("/", F.col("fecha_ingesta").cast("string"), F.col("_batch").cast("string"))
    return df.filter(here == newest.scalar())


def trace(df: DataFrame, record_id: str) -> DataFrame:
    """The Bronze record of a lineage id, ``event_id`` or ``sha:record_number``.

    The comparisons are on stored columns, so Parquet statistics skip other row groups.
    """
    if "_event_id" in df.columns:
        return df.filter(F.col("_event_id") == record_id)
    sha, number = record_id.rsplit(":", 1)
    return df.filter((F.col("_source_sha256") == sha) & (F.col("_record_number") == int(number)))


def audit_payload(bronze: DataFrame, raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Records whose Bronze columns differ from the re-read raw row (or exist on one side only).

    ``raw`` is a numbered scan; both sides are matched on (file, record number).
    """
    keys = ["_source_file", "_record_number"]
    left = bronze.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    right = raw.select(*keys, F.lit(True).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"b_{c}").eqNullSafe(F.col(f"r_{c}")) for c in columns],
        F.col("_b").isNotNull() & F.col("_r").isNotNull(),
    )
    return left.join(right, keys, "full").filter(~same).select(*keys)
