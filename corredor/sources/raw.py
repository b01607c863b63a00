"""Raw text scans with per-file record numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corredor.functions.scalars import is_json
from corredor.operators.sets import union_all
from corredor.session import write_once

def csv_text_scan(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Every field as text. Blank fields stay ``''`` and a byte-order mark is ignored."""
    reader = spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST")
    if columns:
        schema = ", ".join(f"`{c}` STRING" for c in columns)
        reader = reader.schema(schema).option("enforceSchema", False)
    df = reader.csv(path)
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).na.fill("", subset=df.columns)


def text_scan(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files with their place in the file."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def with_record_number(scan: DataFrame, name: str = "_record_number") -> DataFrame:
    """1-based position of each record in its file.

    Split borders follow the parallelism of the moment, so the tagged rows are written once and every
    pass reads that copy. A row's position is its index inside the split plus the rows of the file's
    earlier splits; only one row per split is ever ordered, and a row without its split is an error.
    ``scan`` must come straight from a scan of this module.
    """
    tagged = write_once(scan.withColumn("_mid", F.monotonically_increasing_id()), "numbered-scan")
    splits = tagged.groupBy("_file", "_block").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    # one row per split, stored: Spark's own size check decides between broadcast and shuffle
    offsets = write_once(offsets.withColumnsRenamed({"_file": "_f", "_block": "_b"}), "split-offsets")
    place = (tagged["_file"] == offsets["_f"]) & (tagged["_block"] == offsets["_b"])
    missing = F.raise_error(F.concat(F.lit("no offset for a split of "), F.col("_file"))).cast("bigint")
    number = F.coalesce(F.col("_before") + F.col("_mid") - F.col("_first") + 1, missing)
    return (
        tagged.join(offsets, place, "left")
        .withColumn(name, number)
        .drop("_mid", "_first", "_before", "_block", "_f", "_b")
    )


def jsonl_raw_scan(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Non-blank JSON lines with their text and original line number; bad JSON is an error."""
    lines = with_record_number(text_scan(spark, path)).filter(F.trim("value") != "")
    valid = is_json(F.col("value"))
    message = F.concat(F.lit("invalid JSON in "), F.col("_file"), F.lit(" line "), F.col("_record_number"))
    checked = F.when(valid, F.col("value")).otherwise(F.raise_error(message).cast("string"))
    return lines.select(checked.alias("raw_json"), "_file", "_record_number")


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def add_bronze_metadata(df: DataFrame, source: str, ingested_at: str, sha=None) -> DataFrame:
    """Lineage columns of a numbered scan."""
    return df.withColumns(
        {
            "_source_file": file_name(F.col("_file")),
            "_source_name": F.lit(source),
            "_source_sha256": F.col("_source_sha256") if sha is None else sha,
            "_ingestion_ts": F.lit(ingested_at),
        }
    ).drop("_file")


def file_fingerprints(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Content identity, lines and non-blank lines per file (``_source_sha256``, ``lineas``, ``registros``).

    Two independent sums of hashes of (line number, line): a file is read in splits by many tasks
    and never held whole, so its size does not matter.
    """
    lines = with_record_number(text_scan(spark, path))
    hashes = [
        F.sum(F.xxhash64(F.lit(seed), F.col("_record_number"), F.col("value")).cast("decimal(38,0)"))
        for seed in (1, 2)
    ]
    counted = lines.groupBy("_file").agg(
        F.count(F.lit(1)).alias("lineas"), F.count_if(F.trim("value") != "").alias("registros"), hashes[0].alias("_h1"), hashes[1].alias("_h2")
    )
    digest = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("lineas", "_h1", "_h2")]), 256)
    return counted.select("_file", digest.alias("_source_sha256"), "lineas", "registros")


def validate_raw(
    spark: SparkSession, directory: str, contract: Mapping[str, Mapping], tolerate_extra: bool = False
) -> DataFrame:
    """Contract violations as ``(archivo, problema, detalle)``.

    ``contract``: file name -> ``{"columns": [...]}`` for CSV or ``{"keys": [...]}`` for JSON
    lines, optionally with ``rows``. Headers are compared exactly, keys are checked on every line.
    """
    listing = (
        spark.read.format("binaryFile").load(directory).select(file_name(F.col("path")).alias("archivo"))
    )
    expected = spark.createDataFrame([(n,) for n in contract], "archivo string")
    problems = [
        expected.join(listing, "archivo", "left_anti").select(
            "archivo", F.lit("falta").alias("problema"), F.lit("").alias("detalle")
        )
    ]
    if not tolerate_extra:
        problems.append(
            listing.join(expected, "archivo", "left_anti").select(
                "archivo", F.lit("sobra").alias("problema"), F.lit("").alias("detalle")
            )
        )
    rules = spark.createDataFrame(
        [
            (n, ",".join(r["columns"]) if "columns" in r else None, list(r.get("keys", [])), r.get("rows"))
            for n, r in contract.items()
        ],
        "archivo string, cabecera string, claves array<string>, esperadas bigint",
    )
    lines = with_record_number(text_scan(spark, directory)).withColumn("archivo", file_name(F.col("_file")))
    lines = lines.join(F.broadcast(rules), "archivo").filter(
        F.col("cabecera").isNotNull() | (F.trim("value") != "")
    )
    json_lines = F.col("cabecera").isNull()
    header = F.regexp_replace("value", "^﻿|\r$", "")
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    valid = is_json(F.col("value"))
    checked = lines.withColumns(
        {
            "_header": ~json_lines & (F.col("_record_number") == 1),
            "_bad_header": ~json_lines & (F.col("_record_number") == 1) & (header != F.col("cabecera")),
            "_bad_json": json_lines & ~valid,
            "_bad_keys": json_lines & valid & (F.size(F.array_except("claves", keys)) > 0),
        }
    )
    per_file = checked.groupBy("archivo").agg(
        F.count_if("_bad_header").alias("cabecera"),
        F.count_if("_bad_json").alias("json_invalido"),
        F.count_if("_bad_keys").alias("claves"),
        (F.count(F.lit(1)) - F.count_if("_header")).alias("_filas"),
        F.first("esperadas").alias("_esperadas"),
    )
    found = per_file.select(
        "archivo",
        F.expr(
            "stack(4, 'cabecera', cabecera, 'json_invalido', json_invalido, 'claves', claves, 'filas', "
            "if(_filas <> _esperadas, _filas, 0)) AS (problema, n)"
        ),
    ).filter(F.col("n") > 0)
    problems.append(found.select("archivo", "problema", F.col("n").cast("string").alias("detalle")))
    return union_all(problems)
