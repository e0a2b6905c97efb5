"""Composite answers: what a caller asks for in one go, out of the operators. Each is one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import text, zones
from tempora.operators import lookup, metrics, resolve, rollups
from tempora.operators.sequence import resample
from tempora.params import AthleteParams, resolve_ftp


def backfilled_device_model(workouts: DataFrame, metadata: DataFrame, products: DataFrame, key: str = "workout_id") -> DataFrame:
    """Workouts whose device_model is missing (null or blank) take that of their metadata (key, manufacturer, product,
    product_name): the product's name in `products` (manufacturer, product, name), else product_name as it stands.

    One row per workout, with `device_model` and `filled`; models that are there stay."""
    known = metadata.select(F.col(key).alias("_key"), "manufacturer", "product", F.col("product_name").alias("_said"))
    names = products.select(F.col("manufacturer").alias("_m"), F.col("product").alias("_p"), F.col("name").alias("_name"))
    own = workouts.join(known, F.col(key) == F.col("_key"), "left").join(names, (F.col("manufacturer") == F.col("_m")) & (F.col("product") == F.col("_p")), "left")
    there, found = F.when(F.trim("device_model") != "", F.col("device_model")), F.coalesce("_name", F.when(F.trim("_said") != "", F.col("_said")))
    out = own.withColumn("filled", there.isNull() & found.isNotNull()).withColumn("device_model", F.coalesce(there, found))
    return out.select(*workouts.columns, "filled")


def base_rows(workouts: DataFrame, session: DataFrame, key: str = "workout_id") -> DataFrame:
    """The base row of each workout: its own fields first, then those of its session, then what can be inferred.

    session has key, sport, sub_sport, workout_name, is_indoor, start_time_utc, duration_sec, moving_time_sec, distance_m,
    elevation_gain_m, calories_kcal; zero counts as unknown in durations, distances and calories."""
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    w, s = workouts.select(*[F.col(c).alias(f"w_{c}") for c in workouts.columns]), session.select(*[F.col(c).alias(f"s_{c}") for c in session.columns])
    sub = F.lower("s_sub_sport")
    guess = F.when(sub.rlike("cycling|bike"), "cycling").when(sub.contains("run"), "running").when(sub.contains("swim"), "swimming").otherwise("unknown")
    sport, start = F.coalesce(text.some(F.col("w_sport")), text.some(F.col("s_sport")), guess), F.coalesce("w_start_time_utc", "s_start_time_utc")
    named = F.concat(F.initcap(sport), F.coalesce(F.date_format(start, "' - 'MMM dd, yyyy"), F.lit(" Workout")))
    duration = F.coalesce(some("w_duration_sec"), some("s_duration_sec"), F.lit(0.0))
    indoor = F.coalesce(F.col("s_is_indoor"), text.inferred_indoor(F.coalesce("s_distance_m", F.lit(0.0)), F.col("s_elevation_gain_m")))
    return w.join(s, F.col(f"w_{key}") == F.col(f"s_{key}"), "left").select(
        F.col(f"w_{key}").alias(key), F.col("w_athlete_id").alias("athlete_id"), sport.alias("sport"), F.col("s_sub_sport").alias("sub_sport"), F.coalesce(text.some(F.col("s_workout_name")), named).alias("workout_name"), indoor.alias("is_indoor"),
        start.alias("start_time_utc"), duration.alias("duration_sec"), some("s_moving_time_sec").alias("moving_time_sec"), F.coalesce(some("s_distance_m"), F.col("w_distance_m")).alias("distance_m"), F.col("s_elevation_gain_m").alias("elevation_gain_m"),
        F.coalesce(some("s_calories_kcal"), text.estimated_calories(sport, duration)).cast("long").alias("calories_kcal"),
    )


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(int(value), high))


def planning_context(workouts: DataFrame, as_of: str, days: int) -> DataFrame:
    """Per athlete: totals and flags of the last `days` days (1 to 365), the listing newest first, and whole weeks."""
    days = clamp(days, 1, 365)
    end = F.lit(as_of).cast("timestamp")
    rows = workouts.where(F.col("start_time_utc").between(end - F.make_interval(days=F.lit(days)), end))
    summary = rollups.notable_flags(rollups.planning_summary(rows))
    # at most 200 of an athlete's workouts are listed; they are cut before the list is built
    w = rows.select("athlete_id", F.struct("start_time_utc", "workout_id", "sport", "duration_sec").alias("w"))
    newest = Window.partitionBy("athlete_id").orderBy(F.desc("w.start_time_utc"), F.desc("w.workout_id"))
    listed = w.withColumn("_rn", F.row_number().over(newest)).where("_rn <= 200").groupBy("athlete_id").agg(F.reverse(F.array_sort(F.collect_list("w"))).alias("workouts"))
    weeks = rollups.weekly(rows).groupBy("athlete_id").agg(F.array_sort(F.collect_list(F.struct("week_start", "workout_count", "total_duration_min"))).alias("weeks"))
    return summary.join(listed, "athlete_id").join(weeks, "athlete_id")


def workout_detail(workouts: DataFrame, stream: DataFrame, physiometrics: DataFrame, laps: DataFrame, params: AthleteParams) -> DataFrame:
    """One row per workout: its metrics under the baselines in effect, and its laps as a list. Workouts without records
    keep their row."""
    based = lookup.preferred_as_of(workouts, physiometrics, "athlete_id", "start_time_utc", ["manual", "chatgpt"], ["ftp_watts", "lthr_bpm"])
    shaped = metrics.with_channels(stream)
    power = metrics.channel_stats(shaped).join(metrics.normalized_power(shaped), "workout_id", "left")
    ftps = based.select("workout_id", resolve_ftp(F.col("ftp_watts"), params.ftp).alias("ftp"))  # once a workout, not a record
    loads = metrics.load(power.join(ftps, "workout_id"), F.col("ftp"))
    listed = laps.groupBy("workout_id").agg(F.array_sort(F.collect_list(F.struct("position", "minutes"))).alias("laps"))
    return based.join(loads, "workout_id", "left").join(listed, "workout_id", "left")


def with_metadata(workouts: DataFrame, metadata: DataFrame, columns: list[str]) -> DataFrame:
    """workouts with their metadata by ingestion_id, else workout_id; what isn't there stays null."""
    own = metadata.select(F.col("key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    key = F.coalesce(F.col("ingestion_id"), F.col("workout_id").cast("string"))
    out = workouts.join(own, key == F.col("_key"), "left")
    return out.select(*[c for c in workouts.columns if c not in columns], *[F.coalesce(c, f"_{c}").alias(c) if c in workouts.columns else F.col(f"_{c}").alias(c) for c in columns])


def with_records(workouts: DataFrame, stream: DataFrame) -> DataFrame:
    """Only workouts that have records."""
    return workouts.join(stream.select("workout_id").distinct(), "workout_id", "left_semi")


def durations(workouts: DataFrame, stream: DataFrame) -> DataFrame:
    """Duration, moving time and distance: as stated, else from the records."""
    seen = stream.groupBy("workout_id").agg(F.max("elapsed_sec").alias("_e"), (F.unix_timestamp(F.max("timestamp_utc")) - F.unix_timestamp(F.min("timestamp_utc"))).cast("double").alias("_t"), F.max("distance_m").alias("_d"))
    out = workouts.join(seen, "workout_id", "left").withColumn("duration_sec", F.coalesce("duration_sec", "_e", "_t"))
    return out.withColumn("moving_time_sec", F.coalesce("moving_time_sec", "duration_sec")).withColumn("distance_m", F.coalesce("distance_m", "_d")).drop("_e", "_t", "_d")


def first_start(events: DataFrame, by: str) -> DataFrame:
    """The earliest event of a kind that begins with start."""
    return events.groupBy(by).agg(F.min(F.when(F.col("kind").startswith("start"), F.col("at"))).alias("start_time_utc"))


def by_source(source: Column, readers: dict[str, Column], otherwise: Column) -> Column:
    """The expression of a row's source: which adapter reads it."""
    out = None
    for name, value in readers.items():
        out = F.when(F.lower(source) == name, value) if out is None else out.when(F.lower(source) == name, value)
    return out.otherwise(otherwise)


def backfilled(stream: DataFrame, raw: DataFrame, columns: list[str], tolerance: float = 1.0) -> DataFrame:
    """stream with null columns taken from the raw row nearest in time, where one is within the tolerance."""
    found = lookup.nearest(stream.select("workout_id", "elapsed_sec").distinct(), raw.withColumnRenamed("elapsed_sec", "_raw"), "workout_id", "elapsed_sec", "_raw", tolerance, columns)
    near = found.select("workout_id", "elapsed_sec", *[F.col(c).alias(f"_{c}") for c in columns])
    return stream.join(near.hint("merge"), ["workout_id", "elapsed_sec"], "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in stream.columns])


def daily_baseline(first: str, last: str, value: float, athletes: DataFrame) -> DataFrame:
    """One baseline row per athlete and day of a range."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("effective_date")
    return athletes.select("athlete_id", days).withColumn("lthr_bpm", F.lit(value))


def to_update(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """Rows whose column differs from what it should be, nulls included, with the new value."""
    return rows.withColumn("_new", value).where(~F.col(column).eqNullSafe(F.col("_new"))).withColumn(column, F.col("_new")).drop("_new")


def zones_to_update(workouts: DataFrame, home: Column) -> DataFrame:
    """Workouts (start_time_utc, offset_min, recorded, tz) whose stored tz is not what follows from the rest, with that: the
    recorded zone, else the one inferred from the offset at the start (the home zone if it has it), else the home zone."""
    inferred = zones.with_zone(workouts, F.col("start_time_utc"), F.col("offset_min"), home, "_inferred")
    zone = resolve.canonical_timezone(F.lit(False), home, F.col("recorded"), F.col("_inferred"))
    return to_update(inferred, "tz", zone).drop("_inferred")


def key_differences(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Keys that one of two environments' responses has and the other lacks."""
    a, b = (d.select(by, F.explode(F.json_object_keys("body")).alias("key")).distinct() for d in (left, right))
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def beats_by_second(stream: DataFrame) -> DataFrame:
    return resample(stream, "workout_id", "elapsed_sec", ["power_watts"], [], ["rr_intervals_sec"])
