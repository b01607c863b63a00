"""Event producer, stream source, validation, deduplication and sink.

One set of functions serves every stream; what differs between sources is an argument. The
file source stands in for a broker where no connector is installed; with one, pass
``fmt="kafka"`` and its options, the columns are the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corredor.functions.scalars import is_json
from corredor.session import finished_folders, release_scratch, scratch_mark, write_once
from corredor.sources.bronze import read_or_empty
from corredor.sources.raw import with_record_number

ENVELOPE = (
    "_event_id string, _record_number bigint, _source_file string, _source_name string, "
    "_source_sha256 string, _published_at string"
)


def to_events(df: DataFrame, source: str, published_at: str, columns: Sequence[str]) -> DataFrame:
    """``(key, value)`` messages with a deterministic id per source row.

    ``df`` carries ``_source_sha256`` and ``_record_number``; publishing the same file again
    gives the same ids.
    """
    event_id = F.sha2(F.concat_ws(":", "_source_sha256", F.col("_record_number").cast("string")), 256)
    file = F.col("_source_file") if "_source_file" in df.columns else F.lit(None).cast("string")
    body = F.struct(
        F.col("_event_id"),
        F.col("_record_number"),
        file.alias("_source_file"),
        F.lit(source).alias("_source_name"),
        F.col("_source_sha256"),
        F.lit(published_at).alias("_published_at"),
        F.struct(*columns).alias("data"),
    )
    named = df.withColumn("_event_id", event_id)
    return named.select(
        F.col("_event_id").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value")
    )


def publish(messages: DataFrame, target: str, fmt: str = "text", **options: str) -> None:
    """Append messages to a topic, or to a folder of JSON lines."""
    if fmt == "kafka":
        messages.write.format("kafka").options(**options).option("topic", target).save()
    else:
        messages.select("value").write.mode("append").format(fmt).save(target)


#: Messages of one segment of a published log.
SEGMENT = 1 << 16


def publish_log(messages: DataFrame, order: str, target: str, rows: int = SEGMENT) -> None:
    """Messages as one partition of a topic in the order of column ``order``, kept as a broker keeps it.

    The log is cut into segments of some ``rows`` messages, each a file in a folder named by the offset of its first message;
    every segment is ordered and written by a task, so no task holds the log.
    """
    parts = 1 + messages.count() // rows
    # range bounds are sampled: the cut is stored once
    dealt = messages.repartitionByRange(parts, order).select("value", F.col(order).alias("_order"), F.spark_partition_id().alias("_part"))
    cut = write_once(dealt, "log-cut")
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per segment
    bases = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("base_offset"))
    placed = cut.join(bases, cut["_part"] == bases["_p"]).repartition(parts, "base_offset").sortWithinPartitions("base_offset", "_order")
    placed.select("value", "base_offset").write.mode("error").partitionBy("base_offset").text(target)


def event_stream(
    spark: SparkSession, source: str, fmt: str = "text", max_per_batch: int | None = None, **options: str
) -> DataFrame:
    """Messages from the earliest position with their envelope columns.

    Progress lives in the query's checkpoint and is committed only after a batch is persisted.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        reader = reader.option("subscribe", source).option("startingOffsets", "earliest").options(**options)
        if max_per_batch:
            reader = reader.option("maxOffsetsPerTrigger", max_per_batch)
        raw = reader.load()
        return raw.select(
            F.col("topic").alias("_kafka_topic"),
            F.col("partition").alias("_kafka_partition"),
            F.col("offset").alias("_kafka_offset"),
            F.col("key").cast("string").alias("_kafka_key"),
            F.col("value").alias("_bytes"),
        )
    if max_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_per_batch)
    raw = reader.options(**options).load(source)
    return raw.select(
        F.lit(source).alias("_kafka_topic"),
        F.get_json_object("value", "$._event_id").alias("_kafka_key"),
        F.col("value").cast("binary").alias("_bytes"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def with_position(messages: DataFrame) -> DataFrame:
    """Of a file source, a file is a partition and the line in it the offset; a broker gives its own.

    The segments of a published log are one partition, and offsets count on from the one that names the segment.
    """
    if "_file" not in messages.columns:
        return messages
    segment = r"/base_offset=([0-9]+)/[^/]*$"
    base = F.regexp_extract("_file", segment, 1)
    numbered = with_record_number(messages, "_line")
    return numbered.withColumns(
        {
            "_kafka_partition": F.hash(F.regexp_replace("_file", segment, "")),
            "_kafka_offset": F.col("_line") - 1 + F.when(base == "", 0).otherwise(base.try_cast("bigint")),
        }
    ).drop("_file", "_line")


def decode(messages: DataFrame) -> DataFrame:
    """Message text and identity fields; ``_valid`` is false for bad UTF-8, bad JSON or a missing id."""
    text = F.try_validate_utf8(F.col("_bytes").cast("string"))
    parsed = messages.withColumns({"raw_json": text}).withColumn("_m", F.from_json("raw_json", ENVELOPE))
    event_id = F.col("_m._event_id")
    whole = F.coalesce(is_json(F.col("raw_json")), F.lit(False))
    return parsed.withColumn("_valid", whole & event_id.isNotNull() & (F.trim(event_id) != ""))


def split_valid(messages: DataFrame, consumed_at: str) -> tuple[DataFrame, DataFrame]:
    """The enveloped events, and the rejected messages for a dead-letter sink."""
    decoded = decode(messages)
    envelope = ["_kafka_topic", "_kafka_partition", "_kafka_offset", "_kafka_key"]
    good = decoded.filter("_valid").select(
        "_m.*", *envelope, F.lit(consumed_at).alias("_consumed_at"), "raw_json"
    )
    bad = decoded.filter("NOT _valid").select(*envelope, "_bytes")
    return good, bad


def dedup_events(events: DataFrame, stored: DataFrame, horizon: str | None = None) -> DataFrame:
    """First message per ``_event_id`` that ``stored`` does not hold; equal business rows with other ids are all kept.

    Only the ids of the batch travel: the stored ids are filtered by them where they lie. Ids may be
    replayed at any time, so all of ``stored`` is asked; ``horizon`` (an interval such as ``7 days``)
    asks only rows published at most that long before the batch's oldest. No message is dropped for being late.
    """
    first = events.groupBy("_event_id").agg(
        F.min_by(F.struct(*events.columns), F.struct("_kafka_partition", "_kafka_offset")).alias("m")
    ).select("m.*")
    if horizon:
        oldest = first.agg(F.min("_published_at").alias("t")).select(
            (F.to_timestamp("t") - F.expr(f"INTERVAL {horizon}")).cast("timestamp")
        )
        stored = stored.filter(F.to_timestamp("_published_at") >= oldest.scalar())
    known = stored.join(first.select("_event_id"), "_event_id", "left_semi").select("_event_id").distinct()
    return first.join(known, "_event_id", "left_anti")


#: Hash buckets of a lot in the id index.
ID_BUCKETS = 16

_STORED = "_event_id string, _published_at string, _lote bigint"
_INDEX = "_huella bigint, _lote bigint, _cubo int"


def _mark(buckets: int) -> list:
    """The 64-bit hash of an id and its bucket."""
    mark = F.xxhash64("_event_id")
    return [mark.alias("_huella"), F.pmod(mark, F.lit(buckets)).cast("int").alias("_cubo")]


def index_batch(events: DataFrame, index: str, batch: int, buckets: int = ID_BUCKETS) -> None:
    """The ids of a stored lot as sorted 64-bit hashes by hash bucket; an unfinished lot lacks its ``_SUCCESS`` and does not count."""
    (
        events.select(*_mark(buckets)).hint("rebalance", "_cubo").sortWithinPartitions("_cubo", "_huella")
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_cubo").parquet(f"{index}/_lote={batch}")
    )


def index_rows(spark: SparkSession, index: str, lots: Sequence[int], buckets: Sequence[int]) -> DataFrame:
    """Hashes of the given lots in the given buckets; files of other lots and buckets are not opened."""
    if not lots:
        return spark.createDataFrame([], _INDEX)
    found = spark.read.schema(_INDEX).option("basePath", index).parquet(*[f"{index}/_lote={n}" for n in sorted(lots)])
    return found.filter(F.col("_cubo").isin(list(buckets)))


def stored_candidates(
    spark: SparkSession, events: DataFrame, bronze: str, index: str, batch: int, buckets: int = ID_BUCKETS
) -> DataFrame:
    """Ids of the stored lots that may hold one of ``events``; the lot of ``batch`` itself is left out.

    A batch of new events reads eight bytes per stored id, of the buckets its own ids fall into, and no Bronze file. Lots
    whose index holds a hash of the batch are read in full, so equal hashes of other ids only cost time; so are lots that
    have no finished index (a crash before it was written, Bronze from before there was an index). Only bucket numbers and
    lot numbers reach the driver, which lists the folders of the lots in any case.
    """
    lots = {int(n) for n in finished_folders(spark, bronze, "_lote=")} - {batch}
    indexed = lots & {int(n) for n in finished_folders(spark, index, "_lote=", "_SUCCESS")}
    marks = events.select(*_mark(buckets)).distinct()
    hit = set()
    if indexed:
        wanted = [r["_cubo"] for r in marks.select("_cubo").distinct().collect()]
        same = index_rows(spark, index, sorted(indexed), wanted).join(marks.select("_huella"), "_huella", "left_semi")
        hit = {r["_lote"] for r in same.select("_lote").distinct().collect()}
    asked = sorted((lots - indexed) | hit)
    if not asked:
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).option("basePath", bronze).parquet(*[f"{bronze}/_lote={n}" for n in asked])


@dataclass(frozen=True)
class Drain:
    """A finished drain: its query, and where the counts of its batches are stored."""

    query: StreamingQuery
    counts: str
    consumed_at: str


_COUNTS = "consumidos bigint, nuevos bigint, duplicados bigint, invalidos bigint, _consumed_at string, _lote bigint"


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """A batch's rows as a partition of their own; a repeated batch replaces it."""
    (
        df.withColumn("_lote", F.lit(batch).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_lote").parquet(path)
    )


def consume(
    spark: SparkSession,
    source: str,
    bronze: str,
    rejected: str,
    checkpoint: str,
    consumed_at: str,
    max_per_batch: int | None = None,
    fmt: str = "text",
    horizon: str | None = None,
    **options: str,
) -> Drain:
    """Drain what is available into Bronze and its dead letters, exactly once, and stop.

    Each batch is read and decoded once for both sinks, its counts are stored with it, and progress is
    committed after all three are written. The index of stored ids lies beside Bronze (``<bronze>_ids``); it follows the lot
    it describes and may be deleted, then the lots are asked themselves.
    """
    counts, index = f"{checkpoint}/counts", f"{bronze.rstrip('/')}_ids"

    def store(batch: DataFrame, number: int) -> None:
        session, mark = batch.sparkSession, scratch_mark(batch.sparkSession)
        messages = write_once(with_position(batch), "stream-batch")
        good, bad = split_valid(messages, consumed_at)
        stored = stored_candidates(session, good, bronze, index, number)
        fresh = write_once(dedup_events(good, stored, horizon), "stream-fresh")
        write_batch(fresh, bronze, number)
        index_batch(fresh, index, number)
        write_batch(bad, rejected, number)
        consumed, valid, new = messages.count(), good.count(), fresh.count()
        row = session.createDataFrame(
            [(consumed, new, valid - new, consumed - valid, consumed_at)], _COUNTS.rpartition(", ")[0]
        )
        write_batch(row, counts, number)
        release_scratch(session, mark)

    query = (
        event_stream(spark, source, fmt, max_per_batch, **options)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{checkpoint}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return Drain(query, counts, consumed_at)


def stream_metrics(spark: SparkSession, drain: Drain, published: int | None = None) -> dict[str, int]:
    """Counters of one drain, summed over the stored counts of all its batches; raises when messages were lost."""
    names = ["consumidos", "nuevos", "duplicados", "invalidos"]
    rows = read_or_empty(spark, drain.counts, _COUNTS).filter(F.col("_consumed_at") == drain.consumed_at)
    total = rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.count(F.lit(1)).alias("lotes")).first()
    metrics = total.asDict()
    if published is not None and metrics["consumidos"] < published:
        raise RuntimeError(f"{metrics['consumidos']} messages consumed, {published} published")
    return metrics


def metrics_frame(spark: SparkSession, metrics: Mapping[str, int]) -> DataFrame:
    """The counters as ``(metrica, valor)`` rows."""
    return spark.createDataFrame(list(metrics.items()), "metrica string, valor bigint")
