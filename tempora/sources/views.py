"""Domain views of the star-schema test tables, and the same views as SQL for oracles.

events: one workout per event_type, one row a second in order of time; orders and lineitem: workouts and their zones;
events again: effective-dated body metrics per user and source. Every derived column is an exact function of the row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.operators.blocks import running

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its zone-less timestamps become instants of the session zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])


def _channels(events: DataFrame, workout: str, long: bool) -> DataFrame:
    """long: workouts are numbered in blocks of time, no task holds one; else one is a task's window."""
    # named before it is windowed, so that windows and joins by workout find the rows dealt as they need them
    events = events.withColumn("workout_id", F.col(workout).cast("string"))
    k, speed = F.get_json_object("props", "$.k").cast("double"), 2.0 + (F.col("event_id") % 7) * 0.5
    if long:
        rows = running(events.select("workout_id", "ts", "event_id", "value", k.alias("k")), "workout_id", "ts", {"_rn": F.lit(1), "_distance": speed}, ["event_id"])
        number, distance, k = F.col("_rn"), F.col("_distance"), F.col("k")
    else:
        own = Window.partitionBy("workout_id").orderBy("ts", "event_id")
        rows, number, distance = events, F.row_number().over(own), F.sum(speed).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "workout_id",
        (number - 1).cast("double").alias("elapsed_sec"),
        F.col("ts").alias("timestamp_utc"),
        "event_id",
        F.when(F.col("event_id") % 23 != 0, F.col("value")).alias("power_watts"),
        F.when(k % 19 != 0, 80 + k).alias("heart_rate_bpm"),
        (70 + F.col("event_id") % 31).cast("double").alias("cadence_rpm"),
        speed.alias("speed_mps"),
        distance.alias("distance_m"),
        (100 + (F.col("event_id") * 37 % 41) * 0.25).alias("elevation_m"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical record stream: workout_id, elapsed_sec, timestamp_utc, event_id and the channels."""
    return _channels(table(spark, sf_dir, "events"), "event_type", True)


def records_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shorter workouts, one per user, in the order of their events."""
    return _channels(table(spark, sf_dir, "events"), "user_id", False)


def workouts(spark: SparkSession, sf_dir: str, athlete: int | None = None) -> DataFrame:
    """Workout summaries: an order is a workout of its customer, its lines give seconds in zones. With an athlete only its
    own: lines of other orders go before they are aggregated."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if athlete is not None:
        o = o.where(F.col("o_custkey") == athlete)
        line = line.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    number = F.col("l_linenumber")
    zones = line.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("minutes"),
        *[F.sum(F.when(number == z, F.col("l_quantity") * 60).otherwise(0)).cast("long").alias(f"hr_z{z}_sec") for z in range(1, 6)],
        *[F.sum(F.when(number == z, F.col("l_quantity") * 30).otherwise(0)).cast("long").alias(f"pwr_z{z}_sec") for z in range(1, 8)],
    )
    joined = o.join(zones, o["o_orderkey"] == zones["l_orderkey"], "left")
    key = F.col("o_orderkey")
    start = F.timestamp_add("HOUR", (key % 24).cast("int"), F.col("o_orderdate"))
    return joined.select(
        key.alias("workout_id"),
        F.col("o_custkey").alias("athlete_id"),
        start.alias("start_time_utc"),
        F.col("o_orderpriority").alias("sport"),
        (F.coalesce("minutes", F.lit(0.0)) * 60).alias("duration_sec"),
        F.when(key % 11 != 0, (F.floor(F.col("o_totalprice") / 100) * 10).cast("double")).alias("distance_m"),
        F.when(key % 5 != 0, (key % 700).cast("double")).alias("elevation_gain_m"),
        F.when(key % 3 != 0, (key % 41) * 0.5 - 10).alias("decoupling_pct"),
        F.when(key % 13 != 0, (100 + key % 80).cast("double")).alias("hr_avg_bpm"),
        *[F.coalesce(f"hr_z{z}_sec", F.lit(0).cast("long")).alias(f"hr_z{z}_sec") for z in range(1, 6)],
        *[F.coalesce(f"pwr_z{z}_sec", F.lit(0).cast("long")).alias(f"pwr_z{z}_sec") for z in range(1, 8)],
        F.when(key % 4 != 0, (key % 150).cast("double")).alias("tss"),
        (key % 2 == 0).alias("has_power"),
        (key % 13 != 0).alias("has_hr"),
    )


def physiometrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective-dated sparse rows: athlete_id, effective_date, data_source, updated_at_utc, row_key and metrics."""
    e, k = table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("double")
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("athlete_id"),
        F.to_date("ts").alias("effective_date"),
        source.alias("data_source"),
        F.col("ts").alias("updated_at_utc"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("row_key"),
        F.when(F.col("event_id") % 3 == 0, 200 + k).alias("ftp_watts"),
        F.when(F.col("event_id") % 4 == 0, 150 + k % 30).alias("lthr_bpm"),
        F.when(F.col("event_id") % 2 == 0, 2.5 + k / 50).alias("hrv_ln_rmssd"),
        F.when(F.col("event_id") % 5 < 2, 60 + k / 4).alias("weight_kg"),
        F.when(F.col("event_id") % 7 == 0, 45 + k % 20).alias("resting_hr_bpm"),
    )


SOURCES = ["manual", "chatgpt", "garmin", "withings", "intervals"]
METRICS = ["ftp_watts", "lthr_bpm", "hrv_ln_rmssd", "weight_kg", "resting_hr_bpm"]


def _channels_sql(workout: str) -> str:
    return f"""
  SELECT {workout}::VARCHAR AS workout_id, (row_number() OVER own - 1)::DOUBLE AS elapsed_sec, ts AS timestamp_utc, event_id,
    CASE WHEN event_id % 23 <> 0 THEN value END AS power_watts,
    CASE WHEN (props->>'$.k')::BIGINT % 19 <> 0 THEN 80.0::DOUBLE + (props->>'$.k')::DOUBLE END AS heart_rate_bpm,
    (70 + event_id % 31)::DOUBLE AS cadence_rpm,
    2.0::DOUBLE + (event_id % 7) * 0.5::DOUBLE AS speed_mps,
    sum(2.0::DOUBLE + (event_id % 7) * 0.5::DOUBLE) OVER (PARTITION BY {workout} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS distance_m,
    100.0::DOUBLE + (event_id * 37 % 41) * 0.25::DOUBLE AS elevation_m
  FROM events WINDOW own AS (PARTITION BY {workout} ORDER BY ts, event_id)"""


RECORDS_SQL = f"records AS ({_channels_sql('event_type')})"
USER_RECORDS_SQL = f"records AS ({_channels_sql('user_id')})"
_HR = ", ".join(f"sum(CASE WHEN l_linenumber = {z} THEN l_quantity * 60 ELSE 0 END)::BIGINT AS hr_z{z}_sec" for z in range(1, 6))
_PWR = ", ".join(f"sum(CASE WHEN l_linenumber = {z} THEN l_quantity * 30 ELSE 0 END)::BIGINT AS pwr_z{z}_sec" for z in range(1, 8))
_ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in [f"hr_z{z}_sec" for z in range(1, 6)] + [f"pwr_z{z}_sec" for z in range(1, 8)])
WORKOUTS_SQL = f"""zones AS (SELECT l_orderkey, sum(l_quantity) AS minutes, {_HR}, {_PWR} FROM lineitem GROUP BY l_orderkey),
workouts AS (
  SELECT o_orderkey AS workout_id, o_custkey AS athlete_id, o_orderdate + to_hours(o_orderkey % 24) AS start_time_utc, o_orderpriority AS sport,
    coalesce(minutes, 0.0) * 60 AS duration_sec,
    CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 100) * 10 END AS distance_m,
    CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 700)::DOUBLE END AS elevation_gain_m,
    CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 41) * 0.5::DOUBLE - 10 END AS decoupling_pct,
    CASE WHEN o_orderkey % 13 <> 0 THEN (100 + o_orderkey % 80)::DOUBLE END AS hr_avg_bpm,
    {_ZERO},
    CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 150)::DOUBLE END AS tss,
    o_orderkey % 2 = 0 AS has_power, o_orderkey % 13 <> 0 AS has_hr
  FROM orders LEFT JOIN zones ON o_orderkey = l_orderkey)"""
_K = "(props->>'$.k')::DOUBLE"
PHYSIOMETRICS_SQL = f"""physiometrics AS (
  SELECT user_id AS athlete_id, ts::DATE AS effective_date, ({SOURCES})[event_id % 5 + 1] AS data_source, ts AS updated_at_utc,
    lpad(event_id::VARCHAR, 12, '0') AS row_key,
    CASE WHEN event_id % 3 = 0 THEN 200 + {_K} END AS ftp_watts,
    CASE WHEN event_id % 4 = 0 THEN 150 + (props->>'$.k')::BIGINT % 30::DOUBLE END AS lthr_bpm,
    CASE WHEN event_id % 2 = 0 THEN 2.5::DOUBLE + {_K} / 50 END AS hrv_ln_rmssd,
    CASE WHEN event_id % 5 < 2 THEN 60 + {_K} / 4 END AS weight_kg,
    CASE WHEN event_id % 7 = 0 THEN 45 + (props->>'$.k')::BIGINT % 20::DOUBLE END AS resting_hr_bpm
  FROM events)"""
