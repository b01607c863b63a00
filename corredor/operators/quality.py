"""Assertions (Q01-Q25). Each returns the violating rows; an empty result means it holds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corredor.functions import scalars as fx
from corredor.operators.aggregates import fingerprint
from corredor.operators.joins import reconcile, with_scalar
from corredor.operators.sets import symmetric_diff, union_all
from corredor.operators.windows import prefix_sum

Violations = DataFrame


def _any(conditions: Sequence[Column]) -> Column:
    """True when a condition holds; NULL counts as not violated, as in a WHERE clause."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def not_null(df: DataFrame, col: str) -> Violations:
    """Q01."""
    return df.filter(F.col(col).isNull())


def unique(df: DataFrame, cols: Sequence[str]) -> Violations:
    """Q02: repeated keys and their count."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("filas")).filter(F.col("filas") > 1)


def foreign_key(df: DataFrame, col: str, ref: DataFrame, ref_col: str) -> Violations:
    """Q03: values without a row in the referenced relation; NULL references nothing."""
    values = df.filter(F.col(col).isNotNull())
    keys = ref.select(F.col(ref_col).alias(col)).distinct()
    return values.join(keys, col, "left_anti")


def accepted(df: DataFrame, col: str, values: Sequence) -> Violations:
    """Q04: unexpected values and their frequency."""
    return df.filter(~F.col(col).isin(*values)).groupBy(col).agg(F.count(F.lit(1)).alias("filas"))


def counts_match(expected: DataFrame, actual: DataFrame, by: Sequence[str]) -> Violations:
    """Q05: groups whose row counts differ between two relations."""

    def counted(df):
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("filas"))

    return reconcile(counted(expected), counted(actual), by, ["filas"]).withColumnsRenamed(
        {"filas_a": "esperado", "filas_b": "obtenido"}
    )


def forbidden_columns(relations: Mapping[str, DataFrame], names: Sequence[str]) -> Violations:
    """Q06: raw identifiers exposed as columns, as ``(relacion, columna)``."""
    found = [(r, c) for r, df in relations.items() for c in df.columns if c in set(names)]
    spark = next(iter(relations.values())).sparkSession
    return spark.createDataFrame(found, "relacion string, columna string")


def grain(df: DataFrame, keys: Sequence[str], size: int | None = None) -> Violations:
    """Q07: repeated grain keys, and the total when it is not the expected size."""
    as_text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    repeated = unique(df, keys).select(F.lit("clave_repetida").alias("problema"), as_text.alias("detalle"))
    if size is None:
        return repeated
    total = df.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") != size)
    wrong = total.select(F.lit("filas_distintas").alias("problema"), F.col("_n").cast("string").alias("detalle"))
    return repeated.unionByName(wrong)


def totals_match(a: DataFrame, b: DataFrame, measures: Mapping[str, tuple[Column, Column]]) -> Violations:
    """Q08: one row with both totals when any additive measure differs."""
    left = a.agg(*[F.coalesce(F.sum(m[0]), F.lit(0)).alias(f"{n}_a") for n, m in measures.items()])
    right = b.agg(*[F.coalesce(F.sum(m[1]), F.lit(0)).alias(f"{n}_b") for n, m in measures.items()])
    differing = [fx.differs(F.col(f"{n}_a"), F.col(f"{n}_b")) for n in measures]
    return with_scalar(left, right).filter(_any(differing))


def parts_sum(df: DataFrame, parts: Sequence[str], total: str) -> Violations:
    """Q09: rows whose parts do not add up to the total."""
    return df.filter(sum((F.col(p) for p in parts), F.lit(0)) != F.col(total))


def parts_match_catalog(
    df: DataFrame, parts: Mapping[str, str], catalog: DataFrame, by: str
) -> Violations:
    """Q09: part totals (column -> catalogue value) that differ from the catalogue's counts."""
    pairs = ", ".join(f"'{v}', `{c}`" for c, v in parts.items())
    totals = df.agg(*[F.sum(c).alias(c) for c in parts]).select(
        F.expr(f"stack({len(parts)}, {pairs}) AS ({by}, n)")
    )
    counted = catalog.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return totals.alias("t").join(counted.alias("c"), by, "left").filter(
        fx.differs(F.col("t.n"), F.col("c.n"))
    ).select(by, F.col("t.n").alias("en_zonas"), F.col("c.n").alias("en_catalogo"))


def coverage_consistent(df: DataFrame) -> Violations:
    """Q10: areas with service and no use, or the reverse."""
    return df.filter("inconsistencia_cobertura").select("nombre_zona", "tiene_servicio", "eventos_totales")


def rank_valid(df: DataFrame, col: str, rank: str) -> Violations:
    """Q11: ranks that are not one plus the number of greater rows.

    Greater rows are counted per distinct value from the top, not by comparing rows pairwise.
    """
    per_value = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    upto = prefix_sum(per_value, [F.col(col).desc_nulls_last()], {"_n": "_upto"})
    expected = upto.select(
        F.col(col).alias("_value"), (F.col("_upto") - F.col("_n") + 1).alias("ranking_esperado")
    )
    joined = df.join(expected, df[col].eqNullSafe(expected["_value"])).drop("_value")
    return joined.filter(fx.differs(F.col(rank).cast("long"), F.col("ranking_esperado").cast("long")))


def transfer_rules(df: DataFrame, max_gap_minutes: int = 90, isolated: str = "Aerometro") -> Violations:
    """Q12: transfers that break a rule of the mart."""
    start, end = F.col("momento_inicio_transbordo"), F.col("momento_fin_transbordo")
    minutes = F.col("tiempo_transferencia_minutos")
    key = fx.md5_key(F.col("usuario_sk"), F.col("bronze_record_id_origen"), F.col("bronze_record_id_destino"))
    touches = (F.col("modo_origen") == isolated) | (F.col("modo_destino") == isolated)
    return df.filter(
        _any(
            [
                F.col("modo_origen") == F.col("modo_destino"),
                ~((end > start) & (end - start <= F.make_dt_interval(mins=F.lit(max_gap_minutes)))),
                minutes != F.round(fx.elapsed(start, end, "minutes"), 2),
                F.col("transbordo_sk") != key,
                F.col("incluye_aerometro") != touches,
                F.col("cantidad_transbordos") != 1,
            ]
        )
    ).select("transbordo_sk")


def transfer_sequence(df: DataFrame, events: DataFrame, max_gap_minutes: int = 90) -> Violations:
    """Q13: transfers missing from, or not supported by, the event sequence of the facts.

    Neighbours are found a second way, by places in one total order of all events and a join of
    each place with the next; the mart's own operator takes no part.
    """
    from corredor.operators.windows import number_rows

    columns = ["usuario_sk", "bronze_record_id_origen", "bronze_record_id_destino"]
    order = ["usuario_sk", "fecha_hora", "modo", "bronze_record_id"]
    placed = number_rows(events.select(*order), order, "_n")
    before = placed.select(
        (F.col("_n") + 1).alias("_n"), "usuario_sk", F.col("fecha_hora").alias("_t"), F.col("modo").alias("_m"),
        F.col("bronze_record_id").alias("bronze_record_id_origen"),
    )
    gap = F.col("fecha_hora") - F.col("_t")
    expected = placed.join(before, ["_n", "usuario_sk"]).filter(
        (F.col("modo") != F.col("_m")) & (F.col("fecha_hora") > F.col("_t")) & (gap <= F.make_dt_interval(mins=F.lit(max_gap_minutes)))
    )
    expected = expected.withColumnRenamed("bronze_record_id", "bronze_record_id_destino").select(*columns)
    return symmetric_diff(expected, df.select(*columns))


def same_rows(a: DataFrame, b: DataFrame) -> Violations:
    """Q14: rows of one relation that the other lacks, with multiplicity."""
    return symmetric_diff(a, b.select(*a.columns))


def history_matches_state(history: DataFrame, state: DataFrame) -> Violations:
    """Q15: cards whose current version differs from the folded state."""
    current = history.filter("vigente").select(
        F.col("tarjeta_id").alias("tarjeta"),
        F.col("estado_tarjeta").alias("estado"),
        F.col("perfil_usuario").alias("perfil"),
        "zona_residencia",
        F.col("valid_from_seq").alias("ultima_seq"),
    )
    columns = ["estado", "perfil", "zona_residencia", "ultima_seq"]
    return reconcile(current, state, ["tarjeta"], columns).select("tarjeta")


def history_intervals(history: DataFrame, cdc: DataFrame, kind: str = "TRANSMETRO") -> Violations:
    """Q16: versions repeated, overlapping, or not one per change event."""
    keys = ["tarjeta_id", "valid_from_seq"]
    repeated = unique(history, keys).select(*keys, F.lit("repetida").alias("problema"))
    overlapping = history.filter(F.col("valid_to_seq") <= F.col("valid_from_seq"))
    events = cdc.filter(F.col("tipo_llave") == kind).select(
        F.col("tarjeta").alias("tarjeta_id"), F.col("seq").alias("valid_from_seq")
    )
    missing = reconcile(history, events, keys, [])
    return union_all(
        [
            repeated,
            overlapping.select(*keys, F.lit("solapada").alias("problema")),
            missing.select(*keys, F.lit("sin_pareja").alias("problema")),
        ]
    )


def user_feature_rules(df: DataFrame) -> Violations:
    """Q17: invariants of the user features."""
    c = F.col
    modes = [c(f"eventos_{m}") for m in ("transmetro", "transurbano", "aerometro", "metroriel")]
    total = c("total_eventos")
    windows = [F.lit(0), *[c(f"eventos_ultimos_{n}_dias") for n in (7, 30, 90)], total]
    isolated = c("metodo_match") == "HASH_AISLADO"
    return df.filter(
        _any(
            [
                total <= 0,
                ~c("modos_utilizados").between(1, 4),
                c("es_multimodal") != (c("modos_utilizados") > 1),
                c("usa_aerometro") != (c("eventos_aerometro") > 0),
                total != sum(modes[1:], modes[0]),
                *[small > large for small, large in zip(windows, windows[1:])],
                ~c("proporcion_eventos_hora_pico").between(0, 1),
                c("primer_evento") > c("ultimo_evento"),
                c("ultimo_evento") > c("fecha_corte"),
                c("dias_desde_ultimo_evento") != fx.elapsed(c("ultimo_evento"), c("fecha_corte"), "whole_days"),
                c("span_dias_uso") != fx.elapsed(c("primer_evento"), c("ultimo_evento"), "whole_days"),
                isolated & ((c("modos_utilizados") != 1) | ~c("usa_aerometro")),
            ]
        )
    ).select("usuario_canonico_id")


def user_features_recomputed(df: DataFrame, silver: Mapping[str, DataFrame], bridge: DataFrame, points: DataFrame) -> Violations:
    """Q18: identities whose features differ from a plain recomputation without pre-aggregation."""
    from corredor.operators.aggregates import mode_of
    from corredor.plans.silver import operations

    cut = df.agg(F.min("fecha_corte").alias("corte"))
    ops = with_scalar(operations(silver), cut).filter(
        (F.col("fecha_uso") <= F.col("corte")) & (F.col("disponible_desde") <= F.col("corte"))
    )
    who = bridge.select(
        F.col("sistema_origen").alias("operador"), F.col("llave_origen").alias("llave_operacional"), "usuario_canonico_id"
    )
    where = points.select(
        F.col("modo").alias("operador"), F.col("codigo_punto").alias("punto_origen"), "zona_conformada"
    )
    events = (
        ops.join(who, ["operador", "llave_operacional"])
        .join(where, ["operador", "punto_origen"], "left")
        .withColumn("zona", F.coalesce("zona_conformada", F.lit(fx.ZONE_FALLBACK)))
    )
    used, key = F.col("fecha_uso"), ["usuario_canonico_id"]

    def recent(days):
        return F.sum(F.when(used > F.col("corte") - F.make_dt_interval(F.lit(days)), 1).otherwise(0))

    expected = events.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_eventos"),
        F.countDistinct("operador").alias("modos_utilizados"),
        F.min(used).alias("primer_evento"),
        F.max(used).alias("ultimo_evento"),
        F.countDistinct(used.cast("date")).alias("dias_activos"),
        *[recent(d).alias(f"eventos_ultimos_{d}_dias") for d in (7, 30, 90)],
        F.round(F.sum("tarifa_quetzales"), 2).alias("gasto_total_gtq"),
        fx.ratio(F.sum("tarifa_quetzales"), F.count("tarifa_quetzales"), 2).alias("tarifa_promedio_gtq"),
        fx.ratio(F.sum(F.when(fx.is_peak(used), 1).otherwise(0)), F.count(F.lit(1))).alias("proporcion_eventos_hora_pico"),
    )
    columns = [n for n in expected.columns if n not in key]
    expected = expected.join(mode_of(events, key, "operador", "modo_mas_usado"), key).join(
        mode_of(events, key, "zona", "zona_origen_frecuente"), key
    )
    columns += ["modo_mas_usado", "zona_origen_frecuente"]
    return reconcile(expected, df, key, columns).select(*key)


def population_rules(df: DataFrame, prior_days: int = 28, label_days: int = 30) -> Violations:
    """Q19: invariants of the population and its labels."""
    prior, future = F.col(f"eventos_previos_{prior_days}d"), F.col(f"eventos_futuros_{label_days}d")
    label, open_cut = F.col("etiqueta"), F.col("corte") == "C"
    expected = F.when(future == 0, 1).otherwise(0)
    bad = df.filter(
        _any(
            [
                prior < 2,
                future < 0,
                ~open_cut & (label.isNull() | (label != expected)),
                open_cut & (label.isNotNull() | future.isNotNull()),
                F.col("unidad_id") != fx.md5_key(F.col("operador"), F.col("llave_operacional")),
            ]
        )
    ).select("corte", "unidad_id")
    repeated = unique(df, ["corte", "unidad_id"]).select("corte", "unidad_id")
    split_unit = (
        df.groupBy("corte", "operador", "llave_operacional")
        .agg(F.min("unidad_id").alias("unidad_id"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .select("corte", "unidad_id")
    )
    return union_all([bad, repeated, split_unit])


def card_feature_rules(df: DataFrame, pop: DataFrame, prior_days: int = 28) -> Violations:
    """Q20: features that disagree with the population or leave their ranges."""
    p = pop.select(
        "unidad_id", "fecha_corte", F.lit(True).alias("_p"), F.col("etiqueta").alias("_label"),
        F.col(f"eventos_previos_{prior_days}d").alias("_prior"),
    )
    c = F.col
    joined = df.withColumn("_f", F.lit(True)).join(p, ["unidad_id", "fecha_corte"], "full")
    bad = joined.filter(
        _any(
            [
                c("_f").isNull(),
                c("_p").isNull(),
                fx.differs(c("etiqueta"), c("_label")),
                fx.differs(c("viajes_28d"), c("_prior")),
                c("viajes_7d") < 0,
                c("viajes_7d") > c("viajes_14d"),
                c("viajes_14d") > c("viajes_28d"),
                ~c("dias_activos_28d").between(1, 28),
                (c("dias_desde_ultimo_uso") <= 0) | (c("dias_desde_ultimo_uso") > 28),
                ~c("proporcion_hora_pico").between(0, 1),
                ~c("proporcion_fin_semana").between(0, 1),
                (c("corte") == "C") & c("etiqueta").isNotNull(),
            ]
        )
    )
    return bad.select("unidad_id").unionByName(unique(df, ["unidad_id", "fecha_corte"]).select("unidad_id"))


def load_counts(expected: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame]) -> DataFrame:
    """Q21: expected and loaded rows per relation with the signed difference."""

    def counted(relations, name):
        return union_all(
            [df.agg(F.lit(r).alias("relacion"), F.count(F.lit(1)).alias(name)) for r, df in relations.items()]
        )

    return (
        counted(expected, "esperadas")
        .join(counted(loaded, "cargadas"), "relacion", "full")
        .withColumn("diferencia", F.coalesce("cargadas", F.lit(0)) - F.coalesce("esperadas", F.lit(0)))
    )


def runs_equal(
    run_a: Mapping[str, DataFrame], run_b: Mapping[str, DataFrame], exclude: Sequence[str] = ()
) -> Violations:
    """Q22: relations whose count or content fingerprint differs between two runs."""

    def prints(run):
        return union_all(
            [
                fingerprint(df, [c for c in exclude if c in df.columns]).select(F.lit(n).alias("relacion"), "filas", "huella")
                for n, df in run.items()
            ]
        )

    return reconcile(prints(run_a), prints(run_b), ["relacion"], ["filas", "huella"])


def scoring_input_rules(df: DataFrame, numeric: Sequence[str], key: str = "tarjetas") -> Violations:
    """Q23: units that may not be scored, one row per unit and problem."""
    texts = ["unidad_id", key, "operador"]
    missing = _any([F.col(c).isNull() for c in [*texts, *numeric]])
    blank = _any([F.trim(F.col(c)) == "" for c in texts])
    infinite = _any([F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in numeric])
    wrong_key = _any([F.col("unidad_id") != fx.md5_key(F.col("operador"), F.col(key))])
    checks = {"nulo": missing, "vacio": blank, "no_finito": infinite, "clave": wrong_key}
    problems = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    per_row = df.select("unidad_id", F.explode(problems).alias("problema"))
    repeated = unique(df, ["unidad_id"]).select("unidad_id", F.lit("duplicado").alias("problema"))
    return per_row.unionByName(repeated)


def column_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per column, how many keys differ between two versions; ``__fila_ausente__`` counts lone keys."""
    left = a.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = b.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    joined = left.join(right, list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    counts = joined.agg(
        F.count_if(~both).alias("__fila_ausente__"),
        *[F.count_if(both & fx.differs(F.col(f"{c}_a"), F.col(f"{c}_b"))).alias(c) for c in cols],
    )
    names = counts.columns
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return counts.select(F.expr(f"stack({len(names)}, {pairs}) AS (columna, diferencias)"))


def leakage_audit(
    sources: Mapping[str, DataFrame],
    time_columns: Mapping[str, Sequence[str]],
    cut: str,
    build: Callable[[Mapping[str, DataFrame]], DataFrame],
    keys: Sequence[str],
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Q24: differences per column when every source is physically trimmed at the cut-off.

    ``build`` makes the features from the sources; any difference is information from the future.
    """
    trimmed = {
        name: fx.as_of(df, time_columns[name], cut) if name in time_columns else df
        for name, df in sources.items()
    }
    full, past = build(sources), build(trimmed)
    cols = [c for c in full.columns if c not in {*keys, *ignore}]
    return column_differences(full, past, keys, cols)


def invariance_audit(
    sources: Mapping[str, DataFrame],
    future: Mapping[str, DataFrame],
    build: Callable[[Mapping[str, DataFrame]], DataFrame],
    keys: Sequence[str],
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Q25: differences per column after appending later rows to the sources."""
    extended = {
        name: df.unionByName(future[name].select(*df.columns)) if name in future else df
        for name, df in sources.items()
    }
    before, after = build(sources), build(extended)
    cols = [c for c in before.columns if c not in {*keys, *ignore}]
    return column_differences(before, after, keys, cols)


def summary(assertions: Mapping[str, DataFrame]) -> DataFrame:
    """One row per assertion with its number of violating rows."""
    return union_all(
        [df.agg(F.lit(name).alias("prueba"), F.count(F.lit(1)).alias("violaciones")) for name, df in assertions.items()]
    )
