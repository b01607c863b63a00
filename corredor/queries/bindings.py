"""Transit sources derived from the driver's tables.

``events`` plays the boardings of the four operators and the card change log, ``customer`` and
``part`` the point catalogues. Every source is a projection of whole tables; defects (repeated
reads, missing stops, future dates, open trips) follow from column values. ``BINDING_SQL`` says
the same in SQL for the oracle.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corredor.functions import scalars as fx
from corredor.operators.cdc import type_cdc
from corredor.plans import gold, layers, pit, silver, views
from corredor.plans.silver import AM, MR, TM, TU
from corredor.session import work_dir

HORIZON = "2024-02-15 00:00:00"
CUTS = {"A": "2024-01-15", "B": "2024-01-22", "C": "2024-01-28"}
LABEL_DAYS = 3
KEY = "clave-de-prueba"
DETECTED = "2024-03-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def point_number() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def cents(col: str = "value") -> Column:
    return F.col(col).cast("string").cast("decimal(18,2)")


def _day(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 10)


def _clock(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 12, 8)


def _day_first(ts: Column) -> Column:
    return F.regexp_replace(_day(ts), r"(\d+)-(\d+)-(\d+)", "$3/$2/$1")


def _area(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name, _ in fx.AREAS]), index % 14 + 1)


def _padded(prefix: str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col("user_id").cast("string"), width, "0"))


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with its point number, amount and second."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.substring(F.col("ts").cast("string"), 1, 19).cast("timestamp_ntz").alias("t"),
        cents().alias("v"),
        point_number().alias("k"),
    )


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in the shared folder for as long as the session, as a build stores its relations."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Warehouse:
    """Lazily composed layers over one data folder; nothing runs until a result is read."""

    def __init__(self, spark: SparkSession, sf_dir: str, cut: str | None = None):
        self.spark, self.sf_dir, self.cut = spark, sf_dir, cut

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    # ---- staging -------------------------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        return typed_events(self.spark, self.sf_dir)

    @cached_property
    def tm_validations(self) -> DataFrame:
        src = self.events.filter(F.col("event_type").isin("click", "signup"))
        k, v = F.col("k"), F.col("v")
        reads = src.withColumn(
            "_read", F.explode(F.when(v > 150, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        )
        again = F.col("_read") == 1
        return reads.select(
            F.col("event_id").alias("validacion_id"),
            F.when(k == 50, "SIN-TARJETA").otherwise(_padded("TC-", 8)).alias("tarjeta"),
            F.concat(F.lit("TM-"), k).alias("estacion_id"),
            F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("L"), k % 7)).alias("linea"),
            F.col("t").cast("string").alias("fecha_hora"),
            F.when(v < 1, None).otherwise(v.cast("string")).alias("tarifa"),
            F.col("event_type").alias("tipo"),
            F.concat(F.lit("tm:"), F.col("event_id"), F.when(again, ":r").otherwise("")).alias("bronze_record_id"),
            F.when(again, "2024-02-01T00:05:00").otherwise("2024-02-01T00:00:00").alias("ingesta_timestamp"),
        )

    @cached_property
    def tu_transactions_raw(self) -> DataFrame:
        src = self.events.filter(F.col("event_type") == "view")
        k, v, t = F.col("k"), F.col("v"), F.col("t")
        day = (
            F.when(k == 77, "sin fecha")
            .when(v > 200, _day_first(t + F.expr("INTERVAL 400 DAYS")))
            .when(k % 2 == 0, _day_first(t))
            .otherwise(_day(t))
        )
        return src.select(
            day.alias("fecha"),
            _clock(t).alias("hora"),
            _padded("", 10).alias("num_tarjeta"),
            F.when(k == 13, "").when(k == 14, None).otherwise(F.concat(F.lit("P"), k)).alias("cod_parada"),
            F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("R"), k % 11)).alias("ruta"),
            (v * 100).cast("long").alias("monto_centavos"),
            F.lit(0).alias("cod_estado"),
            F.concat(F.lit("tu:"), F.col("event_id")).alias("bronze_record_id"),
            F.lit("2024-02-01T00:00:00").alias("ingesta_timestamp"),
        )

    @cached_property
    def mr_trips_raw(self) -> DataFrame:
        src = self.events.filter(F.col("event_type") == "purchase")
        k, v, t = F.col("k"), F.col("v"), F.col("t")
        seconds = F.floor(v * 20)
        closed = v >= 2
        return src.select(
            F.col("event_id").alias("trip_id"),
            _padded("MR", 7).alias("card"),
            k.cast("long").alias("entry_station"),
            t.cast("string").alias("entry_ts"),
            F.when(closed, ((k * 7 + 3) % 100).cast("long")).alias("exit_station"),
            F.when(closed, (t + F.make_dt_interval(secs=seconds)).cast("string")).alias("exit_ts"),
            v.alias("fare_gtq"),
            F.when(closed, seconds).alias("duration_s"),
            F.concat(F.lit("mr:"), F.col("event_id")).alias("bronze_record_id"),
            F.lit("2024-02-01T00:00:00").alias("ingesta_timestamp"),
        )

    @cached_property
    def am_boardings_raw(self) -> DataFrame:
        src = self.events.filter(F.col("event_type") == "error")
        k, v = F.col("k"), F.col("v")
        utc = F.col("t") + F.expr("INTERVAL 6 HOURS")
        return src.select(
            F.col("event_id").alias("boarding_id"),
            F.substring(F.md5(F.col("user_id").cast("string")), 1, 12).alias("user_hash"),
            F.concat(F.lit("A"), k).alias("station_code"),
            F.concat(F.lit("E"), k % 3).alias("axis"),
            F.concat(_day(utc), F.lit("T"), _clock(utc), F.lit("Z")).alias("timestamp_utc"),
            k.alias("cabin_number"),
            F.when(v < 1, None).otherwise(v.cast("string")).alias("fare"),
            F.concat(F.lit("am:"), F.col("event_id")).alias("bronze_record_id"),
            F.lit("2024-02-01T00:00:00").alias("ingesta_timestamp"),
        )

    @cached_property
    def tm_stations(self) -> DataFrame:
        n = F.col("c_nationkey")
        return self.table("customer").select(
            F.concat(F.lit("TM-"), F.col("c_custkey")).alias("estacion_id"),
            F.col("c_name").alias("nombre"),
            F.concat(F.lit("L"), F.col("c_custkey") % 7).alias("linea"),
            _area(n).alias("zona"),
            F.when(n == 3, "").otherwise(F.concat(F.lit("14."), n)).alias("lat"),
            F.when(n == 3, "").otherwise(F.concat(F.lit("-90."), n)).alias("lon"),
        )

    @cached_property
    def tu_stops(self) -> DataFrame:
        area = _area(F.col("c_nationkey"))
        spelled = F.when(area.startswith("Zona "), F.concat(F.lit("Z"), F.substring(area, 6, 9))).otherwise(F.upper(area))
        return self.table("customer").select(
            F.concat(F.lit("P"), F.col("c_custkey")).alias("cod_parada"),
            F.col("c_name").alias("descripcion"),
            F.concat(F.lit("R"), F.col("c_custkey") % 11).alias("ruta"),
            F.when(F.col("c_nationkey") != 24, spelled).alias("sector"),
        )

    @cached_property
    def mr_stations(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id_estacion"),
            F.col("p_name").alias("nombre_estacion"),
            F.lower(_area(F.col("p_size"))).alias("zona_nombre"),
            F.col("p_retailprice").alias("km"),
        )

    @cached_property
    def am_stations(self) -> DataFrame:
        area = _area(F.col("c_nationkey") + 3)
        spelled = F.when(area.startswith("Zona "), F.concat(F.lit("District "), F.substring(area, 6, 9))).otherwise(area)
        return self.table("customer").select(
            F.concat(F.lit("A"), F.col("c_custkey")).alias("station_code"),
            F.col("c_name").alias("station_name"),
            F.concat(F.lit("E"), F.col("c_custkey") % 3).alias("axis"),
            spelled.alias("district"),
        )

    @cached_property
    def cdc_raw(self) -> DataFrame:
        k, v = F.col("k"), F.col("v")
        op = (
            F.when(F.col("event_type") == "signup", "INSERT")
            .when((F.col("event_type") == "error") & (k < 5), "DELETE")
            .otherwise("UPDATE")
        )
        card = (
            F.when(k < 80, _padded("TC-", 8))
            .when(k < 90, _padded("", 10))
            .when(k < 98, _padded("MR", 7))
            .when(k == 98, "SIN-TARJETA")
            .otherwise(F.concat(F.lit("X-"), F.col("user_id")))
        )
        gone = F.col("op") == "DELETE"
        return self.events.withColumn("op", op).select(
            (F.col("event_id") + 1).cast("string").alias("seq"),
            F.concat(_day(F.col("t")), F.lit("T"), _clock(F.col("t"))).alias("commit_ts"),
            "op",
            card.alias("tarjeta"),
            F.when(gone | (v < 10), "").when(v < 40, "estudiante").when(v < 80, "general")
            .otherwise("tercera_edad").alias("perfil"),
            F.when(gone | (k % 4 == 0), "").otherwise(F.concat(F.lit("Zona "), k % 20 + 1)).alias("zona_residencia"),
            F.when(gone, "").otherwise("ACTIVA").alias("estado"),
        )

    @cached_property
    def cdc(self) -> DataFrame:
        return type_cdc(self.cdc_raw)

    @property
    def staging(self) -> dict[str, DataFrame]:
        """The staging relations by the names the layer build expects."""
        sources = (
            self.tm_validations, self.tu_transactions_raw, self.mr_trips_raw, self.am_boardings_raw,
            self.tm_stations, self.tu_stops, self.mr_stations, self.am_stations, self.cdc_raw,
        )
        return dict(zip(layers.STAGING, sources, strict=True))

    @property
    def settings(self) -> layers.Settings:
        return layers.Settings(
            key=KEY, detected_at=DETECTED, processed_on="2024-03-01", cuts=self.cuts, horizon=HORIZON, label_days=LABEL_DAYS
        )

    # ---- silver --------------------------------------------------------------------------
    @cached_property
    def silver(self) -> dict[str, DataFrame]:
        return {
            TM: silver.tm_boardings(self.tm_validations),
            TU: silver.tu_transactions(self.tu_transactions_raw, self.tu_stops, HORIZON, numbered=False),
            MR: silver.mr_trips(self.mr_trips_raw),
            AM: silver.am_boardings(self.am_boardings_raw, self.am_stations),
        }

    @cached_property
    def quarantine(self) -> DataFrame:
        return silver.quarantine(
            self.tm_validations, self.tu_transactions_raw, self.mr_trips_raw, DETECTED, HORIZON
        )

    @cached_property
    def points(self) -> DataFrame:
        return silver.point_catalog(self.tm_stations, self.tu_stops, self.mr_stations, self.am_stations)

    @cached_property
    def universe(self) -> DataFrame:
        return silver.zone_universe(self.points)

    @cached_property
    def bridge(self) -> DataFrame:
        return silver.identity_bridge(self.silver)

    @cached_property
    def history(self) -> DataFrame:
        return silver.card_history(self.cdc)

    @cached_property
    def uses(self) -> DataFrame:
        return silver.card_uses(self.silver, self.quarantine)

    @cached_property
    def user_features(self) -> DataFrame:
        return silver.user_features(self.silver, self.points)

    # ---- point in time -------------------------------------------------------------------
    @property
    def cuts(self):
        wanted = CUTS if self.cut is None else {self.cut: CUTS[self.cut]}
        return fx.cutoffs(wanted, include_unlabelled=True)

    @cached_property
    def population(self) -> DataFrame:
        return pit.card_population(self.uses, self.history, self.cuts, label_days=LABEL_DAYS)

    @cached_property
    def features(self) -> DataFrame:
        return pit.card_features(self.population, self.uses, self.cuts)

    @cached_property
    def cost(self) -> DataFrame:
        return pit.card_cost(self.population, self.uses, self.bridge, self.cuts, LABEL_DAYS)

    @cached_property
    def _shared(self) -> dict[str, DataFrame]:
        """What the point-in-time models share, written once: typed events, bus rows and uses.

        Bus rows are stored for their date text: a filter on the parsed date would make the text again for each reference.
        """
        base = Warehouse(self.spark, self.sf_dir)
        for name in ("events", "tu_transactions_raw", "uses"):
            vars(base)[name] = kept(getattr(base, name), name)
        return {name: vars(base)[name] for name in ("events", "tu_transactions_raw", "uses")}

    @cached_property
    def stored(self) -> Warehouse:
        """The same layers on typed events, bus rows and conformed events that are written once, for readers of several of them."""
        out = Warehouse(self.spark, self.sf_dir)
        for name in ("events", "tu_transactions_raw"):
            vars(out)[name] = kept(getattr(out, name), name)
        vars(out)["silver"] = {op: kept(df, "silver") for op, df in out.silver.items()}
        return out

    def at_cut(self, cut: str) -> Warehouse:
        """The same layers for one cut-off, its population and the relations below it written once."""
        out = Warehouse(self.spark, self.sf_dir, cut)
        vars(out).update(self._shared)
        vars(out)["population"] = kept(out.population, "population")
        return out

    # ---- gold ----------------------------------------------------------------------------
    @cached_property
    def modes(self) -> DataFrame:
        return gold.dim_mode(self.points)

    @cached_property
    def zones(self) -> DataFrame:
        return gold.dim_zone(self.universe)

    @cached_property
    def dim_points(self) -> DataFrame:
        return gold.dim_point(self.points)

    @cached_property
    def users(self) -> DataFrame:
        return gold.dim_user(self.bridge, KEY)

    @cached_property
    def boardings(self) -> DataFrame:
        return gold.fact_boardings(self.silver, self.points, KEY)

    @cached_property
    def trips(self) -> DataFrame:
        return gold.fact_trips(self.silver[MR], self.points, KEY)

    @cached_property
    def demand(self) -> DataFrame:
        return gold.demand_hour(self.boardings, self.trips, self.zones, self.modes)

    @cached_property
    def coverage(self) -> DataFrame:
        return gold.coverage(self.demand, self.zones)

    @cached_property
    def train_zones(self) -> DataFrame:
        return gold.train_zones(self.boardings, self.trips, self.dim_points, self.zones)

    @cached_property
    def user_events(self) -> DataFrame:
        return gold.user_events(self.boardings, self.trips, self.zones)

    @cached_property
    def transfers(self) -> DataFrame:
        return gold.transfers(self.user_events)

    @cached_property
    def view_transfers(self) -> DataFrame:
        return views.view_transfers(self.transfers)


@lru_cache(maxsize=8)
def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse(spark, sf_dir)
