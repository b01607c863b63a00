"""Staging: payload decoding, contracts and versioned rebuilds."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corredor.sources.bronze import assert_written, read_or_empty

TRIP_SCHEMA = (
    "trip_id bigint, card string, entry struct<station: bigint, ts: string>, "
    "exit struct<station: bigint, ts: string>, fare_gtq double, duration_s bigint"
)


def unwrap_payload(df: DataFrame, schema: str, raw: str = "raw_json") -> DataFrame:
    """Business columns of a stream message, from its ``data`` member or from the root."""
    wrapped = F.from_json(raw, f"data struct<{_members(schema)}>")["data"]
    root = F.from_json(raw, schema)
    rest = [c for c in df.columns if c != raw]
    return df.select(*rest, F.coalesce(wrapped, root).alias("_row")).select(*rest, "_row.*")


def _members(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def flatten_trips(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Nested train trips as flat columns; a missing entry or exit gives NULLs."""
    rest = [c for c in df.columns if c != raw]
    parsed = df.select(*rest, F.from_json(raw, TRIP_SCHEMA).alias("j"))
    return parsed.select(
        *rest,
        "j.trip_id",
        "j.card",
        F.col("j.entry.station").alias("entry_station"),
        F.col("j.entry.ts").alias("entry_ts"),
        F.col("j.exit.station").alias("exit_station"),
        F.col("j.exit.ts").alias("exit_ts"),
        "j.fare_gtq",
        "j.duration_s",
    )


def project_contract(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The contract's columns, with NaN as NULL; missing columns are an error."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def clean(name):
        if isinstance(kinds[name], (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(name), F.col(name)).alias(name)
        return F.col(name)

    return df.select(*[clean(c) for c in columns], *keep)


def with_lineage_id(df: DataFrame) -> DataFrame:
    """``bronze_record_id`` and ``ingesta_timestamp`` of a stream or batch record."""
    if "_event_id" in df.columns:
        record, moment = F.col("_event_id"), F.col("_consumed_at")
    else:
        record = F.concat("_source_sha256", F.lit(":"), F.col("_record_number").cast("string"))
        moment = F.col("_ingestion_ts")
    return df.withColumns({"bronze_record_id": record, "ingesta_timestamp": moment.cast("string")})


def min_user_catalog(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys of one operator."""
    return df.select(key).dropDuplicates()


_LOG = "version string, numero int"


def rebuild_staging(
    tables: Mapping[str, DataFrame], base: str, expected: Mapping[str, int] | None = None, keep: int | None = None
) -> str:
    """Write every table under a new version and publish it once all of them check out.

    All inputs are analysed before anything is written. Readers follow the version log, so they
    see the old tables until the last check passes; nothing is renamed. Each input plan runs once: its rows are
    counted while they are written and compared with what is read back, and with ``expected`` where it is given.
    With ``keep`` only the newest published versions stay (at least the new one); without it none is deleted.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        target = f"{base}/{name}/version={version}"
        seen = Observation(f"{name}-{version}")
        df.observe(seen, F.count(F.lit(1)).alias("filas")).write.mode("errorifexists").parquet(target)
        written = seen.get["filas"]
        wanted = (expected or {}).get(name, written)
        if written != wanted:
            raise RuntimeError(f"{target}: {written} rows written, {wanted} expected")
        assert_written(spark, target, written)
    log = read_or_empty(spark, f"{base}/_versions", _LOG)
    number = (log.agg(F.max("numero")).first()[0] or 0) + 1  # one row per rebuild; nothing reads the clock
    log = spark.createDataFrame([(version, number)], _LOG)
    log.coalesce(1).write.mode("append").parquet(f"{base}/_versions")
    if keep is not None:
        prune_staging(spark, base, list(tables), keep)
    return version


def prune_staging(spark: SparkSession, base: str, names: Sequence[str], keep: int) -> list[str]:
    """Deletes the tables of all published versions but the ``keep`` newest; versions that were never published stay.

    Jobs that still read an older version fail: keep as many as rebuilds can pass during the longest job.
    """
    log = read_or_empty(spark, f"{base}/_versions", _LOG)
    old = [r["version"] for r in log.orderBy(F.desc("numero"), "version").collect()][max(keep, 1):]  # one row per rebuild
    context = spark.sparkContext
    for version in old:
        for name in names:
            target = context._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/version={version}")
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    return old


def read_staging(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The published version of a staging table."""
    log = read_or_empty(spark, f"{base}/_versions", _LOG)
    newest = log.agg(F.max_by("version", "numero").alias("v")).head()
    if newest is None or newest["v"] is None:
        raise FileNotFoundError(f"no published version under {base}")
    return spark.read.parquet(f"{base}/{name}/version={newest['v']}")


def materialize(name: str, df: DataFrame, kind: str, layer: str | None = None, path: str | None = None) -> DataFrame:
    """A model as a table of its layer, or as a view; returns it for further use."""
    spark = df.sparkSession
    if kind == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    full = f"{layer}.{name}" if layer else name
    if layer:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(full)
    return spark.table(full)


def sample_lineage(fact: DataFrame, staging: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The first fact in lineage order with its staging columns."""
    key = "bronze_record_id"
    return fact.select(key).join(staging.select(key, *columns), key).orderBy(key, *columns).limit(1)


def sample_ids(fact: DataFrame, source: str) -> DataFrame:
    """Smallest lineage id per source."""
    return fact.groupBy(source).agg(F.min("bronze_record_id").alias("bronze_record_id"))
