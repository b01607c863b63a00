"""Portable CSV snapshot of the conformed sources at a cut-off."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corredor.functions.scalars import as_of
from corredor.operators.aggregates import fingerprint
from corredor.operators.sets import union_all
from corredor.plans.silver import AM, MR, TM, TU

HISTORY, QUARANTINE = "historia", "cuarentena"
# Columns and types of the snapshot files.
SNAPSHOT = {
    TM: "bronze_record_id string, tarjeta_id string, fecha_hora timestamp_ntz, tarifa_quetzales decimal(18,4), estacion_id string",
    TU: "bronze_record_id string, id_tarjeta string, fecha_hora timestamp_ntz, tarifa_quetzales decimal(18,4), cod_parada string",
    AM: "bronze_record_id string, user_hash string, fecha_hora timestamp_ntz, tarifa_quetzales decimal(18,4), station_code string",
    MR: "bronze_record_id string, tarjeta_mr string, fecha_hora_ingreso timestamp_ntz, fecha_hora_salida timestamp_ntz, "
    "tarifa_quetzales decimal(18,4), origen_estacion_id string",
    HISTORY: "tarjeta_id string, operacion string, valid_from timestamp_ntz",
    QUARANTINE: "fuente string, id_registro_crudo string",
}
# moments that must lie before the cut-off
KNOWN_BEFORE = {
    TM: ["fecha_hora"],
    TU: ["fecha_hora"],
    AM: ["fecha_hora"],
    MR: ["fecha_hora_ingreso", "fecha_hora_salida"],
    HISTORY: ["valid_from"],
}


def _columns(name: str) -> list[str]:
    return T.StructType.fromDDL(SNAPSHOT[name]).fieldNames()


def snapshot(sources: Mapping[str, DataFrame], cut: str) -> dict[str, DataFrame]:
    """Projected sources as known at the cut-off."""
    return {
        name: (as_of(df, KNOWN_BEFORE[name], cut) if name in KNOWN_BEFORE else df).select(
            *[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(SNAPSHOT[name]).fields]
        )
        for name, df in sources.items()
    }


def _manifest(spark, tables: Mapping[str, DataFrame], cut: str) -> DataFrame:
    return union_all(
        [
            fingerprint(df).select(F.lit(name).alias("fuente"), "filas", "huella", F.lit(cut).alias("fecha_corte"))
            for name, df in tables.items()
        ]
    )


def export_snapshot(sources: Mapping[str, DataFrame], cut: str, out: str) -> DataFrame:
    """One CSV folder per source and a manifest of counts and fingerprints."""
    tables = snapshot(sources, cut)
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        writer = df.write.mode("errorifexists").option("header", True).option("escape", '"')
        writer.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{out}/{name}")
    manifest = f"{out}/manifest"
    _manifest(spark, tables, cut).coalesce(1).write.mode("errorifexists").parquet(manifest)
    return spark.read.parquet(manifest)


def import_snapshot(spark: SparkSession, path: str, cut: str) -> dict[str, DataFrame]:
    """The sources of a snapshot; header, rows and content must agree with the manifest."""
    manifest = spark.read.parquet(f"{path}/manifest")
    tables = {}
    for name, schema in SNAPSHOT.items():
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        reader = reader.option("escape", '"').option("mode", "FAILFAST")
        tables[name] = reader.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{path}/{name}")
    problems = verify_snapshot(tables, manifest, cut).collect()  # at most one row per source
    if problems:
        raise ValueError(f"snapshot differs from its manifest: {[tuple(p) for p in problems]}")
    return tables


def verify_snapshot(tables: Mapping[str, DataFrame], manifest: DataFrame, cut: str) -> DataFrame:
    """Sources whose rows, content or cut-off differ from the manifest."""
    found = _manifest(manifest.sparkSession, tables, cut)
    keys = ["fuente", "filas", "huella", "fecha_corte"]
    return found.join(manifest, keys, "left_anti").select("fuente", "filas").unionByName(
        manifest.join(found, keys, "left_anti").select("fuente", "filas")
    ).distinct()
