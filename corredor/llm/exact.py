"""Exact deduplication by an extendible-hash index on shared files; DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Each map task first chains equal texts of its
own (partial aggregation), so a group with a third of all rows reaches the owners as one row per task.
Owners compare whole texts, not hashes. The classes are written as index files: a directory over the
leading key bits doubles until no bucket holds more than ``bucket_rows`` classes (or the bits end),
neighbouring buckets form the key range of an owner, and each owner writes its range sorted by key.
Every document then probes the index; a hot class is a skewed join side that adaptive execution splits.

Null text counts as empty. A null id never stays while its group has another id; a group of null ids
keeps all its rows (``keep_id`` null). Repeated rows of one id share its result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corredor.llm.util import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Longest directory prefix: bounds the directory, which is broadcast, to 2**MAX_BITS rows.
MAX_BITS = 16


def normalised(text) -> F.Column:
    """Null as empty; A-Z lower-cased, other letters as they are."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def directory(classes: DataFrame, bucket_rows: int, bits: int) -> DataFrame:
    """(prefix, bucket, depth): for each of the leading ``bits`` the bucket it lies in.

    A bucket is the shortest prefix with at most ``bucket_rows`` classes: doubling the directory
    splits only the buckets that are still overfull.
    """
    counted = classes.groupBy(_prefix(bits).alias("prefix")).agg(F.count("*").alias("n"))
    every = counted.select("prefix", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    start = F.expr(f"shiftleft(shiftright(prefix, {bits} - depth), {bits} - depth)")
    every = every.withColumn("bucket", start)
    fits = every.groupBy("depth", "bucket").agg(F.sum("n").alias("n"))
    fits = fits.filter((F.col("n") <= bucket_rows) | (F.col("depth") == bits)).drop("n")
    return (
        every.join(fits, ["depth", "bucket"])
        .groupBy("prefix")
        .agg(F.min(F.struct("depth", "bucket")).alias("b"))
        .select("prefix", "b.bucket", "b.depth")
    )


def _prefix(bits: int) -> F.Column:
    return F.expr(f"CAST(shiftrightunsigned(key, {64 - bits}) AS INT)")


def build_index(docs: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """Classes (bucket, key, sha, keep_id, group_size) in shared files, one key range for each owner."""
    text = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("body"))
    classes = (
        text.groupBy(F.xxhash64("body").alias("key"), "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("key", F.sha2(F.col("body"), 256).alias("sha"), "keep_id", "group_size")
    )
    classes = written(classes, "exact-classes")
    rows = classes.count()
    bits = min(MAX_BITS, max(1, (2 * rows // bucket_rows).bit_length() + 3))
    placed = classes.withColumn("prefix", _prefix(bits)).join(
        F.broadcast(directory(classes, bucket_rows, bits)), "prefix"  # at most 2**MAX_BITS rows
    )
    owned = placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    return written(owned.select("bucket", "depth", "key", "sha", "keep_id", "group_size"), "exact-index")


def exact_groups(docs: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. An empty table gives no rows."""
    index = build_index(docs, bucket_rows).select("key", "sha", "keep_id", "group_size")
    body = normalised(F.col("text"))
    probe = docs.select("doc_id", F.xxhash64(body).alias("key"), F.sha2(body, 256).alias("sha"))
    return probe.join(index, ["key", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the dropped copies, all columns as they were."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
