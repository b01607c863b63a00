"""Change log folding and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corredor.functions.scalars import blank_to_null
from corredor.operators.windows import HOT_ROWS, ordered_context

# Key types and their patterns, and the operations of the change log.
KEY_PATTERNS = {
    "TRANSMETRO": r"^TC-\d{8}$",
    "TRANSURBANO": r"^\d{10}$",
    "METRORIEL": r"^MR\d{7}$",
    "SIN_TARJETA": r"^SIN-TARJETA$",
}
OTHER_KEY = "OTRO"
OPERATIONS = ("INSERT", "UPDATE", "DELETE")
SEQ_SLOT = 1_000_000


def classify_key(key: Column) -> Column:
    """Kind of an ambiguous key, by its form."""
    kinds = [F.when(key.rlike(rx), F.lit(kind)) for kind, rx in KEY_PATTERNS.items()]
    return F.coalesce(*kinds, F.lit(OTHER_KEY))


def type_cdc(cdc: DataFrame) -> DataFrame:
    """Raw change log with typed order columns, upper-case operation and NULL for blanks."""
    return cdc.select(
        F.col("seq").cast("long").alias("seq"),
        F.col("commit_ts").cast("timestamp_ntz").alias("commit_ts"),
        F.upper("op").alias("op"),
        F.col("tarjeta"),
        blank_to_null(F.col("perfil")).alias("perfil"),
        blank_to_null(F.col("zona_residencia")).alias("zona_residencia"),
        classify_key(F.col("tarjeta")).alias("tipo_llave"),
    )


def check_ops(cdc: DataFrame) -> DataFrame:
    """Log rows with an unsupported operation or a sequence that is not a number."""
    bad_op = ~F.coalesce(F.upper("op").isin(*OPERATIONS), F.lit(False))
    bad_seq = F.col("seq").cast("string").try_cast("long").isNull()
    problem = F.when(bad_op, "OPERACION_NO_SOPORTADA").when(bad_seq, "SEQ_NO_NUMERICA")
    return cdc.withColumn("problema", problem).filter(F.col("problema").isNotNull())


def _carried(cdc: DataFrame, name: str) -> Column:
    """Attribute value when the event may set it."""
    return F.when(F.col("op").isin("INSERT", "UPDATE"), F.col(name))


def current_state(cdc: DataFrame, kind: str = "TRANSMETRO") -> DataFrame:
    """Registry after the last event of each key; DELETE only deactivates.

    ``cdc`` is typed (see :func:`type_cdc`). Every column is a ``max_by``: the fold is an
    aggregation with partial results, not an ordered pass over each card.
    """
    seq = F.col("seq")
    attributes = [
        F.max_by(_carried(cdc, c), F.when(_carried(cdc, c).isNotNull(), seq)).alias(c)
        for c in ("perfil", "zona_residencia")
    ]
    folded = (
        cdc.filter(F.col("tipo_llave") == kind)
        .groupBy("tarjeta")
        .agg(
            *attributes,
            F.max(seq).alias("ultima_seq"),
            F.max_by("commit_ts", seq).alias("ultimo_commit_ts"),
            F.max_by("op", seq).alias("ultima_operacion"),
        )
    )
    state = F.when(F.col("ultima_operacion") == "DELETE", "INACTIVA").otherwise("ACTIVA")
    return folded.withColumn("estado", state).select(
        "tarjeta", "perfil", "zona_residencia", "estado",
        "ultima_seq", "ultimo_commit_ts", "ultima_operacion",
    )


def scd2(
    cdc: DataFrame, kind: str = "TRANSMETRO", slot_width: int = SEQ_SLOT, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One version per event, valid until the next event of the card.

    Attributes persist from the last event that set them. A card with a large share of the log
    is spread over sequence slots.
    """
    events = cdc.filter(F.col("tipo_llave") == kind)
    context = ordered_context(
        events,
        ["tarjeta"],
        ["seq"],
        F.floor(F.col("seq") / slot_width),
        following=["seq", "commit_ts"],
        running_last={
            "perfil_usuario": _carried(events, "perfil"),
            "zona_vigente": _carried(events, "zona_residencia"),
        },
        hot_rows=hot_rows,
    )
    return context.select(
        F.concat_ws(":", "tarjeta", F.col("seq").cast("string")).alias("version_id"),
        F.col("tarjeta").alias("tarjeta_id"),
        F.col("seq").alias("valid_from_seq"),
        F.col("next.seq").alias("valid_to_seq"),
        F.col("commit_ts").alias("valid_from"),
        F.col("next.commit_ts").alias("valid_to"),
        F.col("next.seq").isNull().alias("vigente"),
        F.col("op").alias("operacion"),
        F.when(F.col("op") == "DELETE", "INACTIVA").otherwise("ACTIVA").alias("estado_tarjeta"),
        "perfil_usuario",
        F.col("zona_vigente").alias("zona_residencia"),
    )


def exclude_deleted(pop: DataFrame, history: DataFrame, operator: str = "Transmetro") -> DataFrame:
    """Drop units of the operator with any DELETE before their cut-off.

    Later reactivation does not matter and the current flag is never read. The history is first
    reduced to the earliest DELETE per card, so the join is one row per card.
    """
    first_delete = (
        history.filter(F.col("operacion") == "DELETE")
        .groupBy(F.col("tarjeta_id").alias("_card"))
        .agg(F.min("valid_from").alias("_deleted"))
    )
    condition = (
        (F.col("llave_operacional") == F.col("_card"))
        & (F.col("operador") == operator)
        & (F.col("_deleted") < F.col("fecha_corte"))
    )
    return pop.join(first_delete, condition, "left_anti")


def cdc_metrics(cdc: DataFrame, kind: str = "TRANSMETRO") -> DataFrame:
    """``(metrica, valor)``: events per operation and key type, final card states."""
    by_op = cdc.groupBy(F.concat(F.lit("op:"), "op").alias("metrica"))
    by_type = cdc.groupBy(F.concat(F.lit("tipo:"), "tipo_llave").alias("metrica"))
    n = F.count(F.lit(1)).cast("long").alias("valor")
    state = current_state(cdc, kind)
    inactive = F.col("estado") == "INACTIVA"
    finals = state.agg(
        F.count(F.lit(1)).alias("tarjetas"),
        F.count_if(F.col("estado") == "ACTIVA").alias("activas"),
        F.count_if(inactive).alias("inactivas"),
        F.count_if(
            inactive & F.col("perfil").isNull() & F.col("zona_residencia").isNull()
        ).alias("delete_sin_cuerpo"),
    ).select(
        F.expr(
            "stack(4, 'tarjetas', tarjetas, 'activas', activas, 'inactivas', inactivas, "
            "'delete_sin_cuerpo', delete_sin_cuerpo) AS (metrica, valor)"
        )
    )
    return by_op.agg(n).unionByName(by_type.agg(n)).unionByName(finals)
