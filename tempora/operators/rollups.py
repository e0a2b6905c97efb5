"""Summaries over workouts: weeks, zones, trends, planning, and listings."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of intensity over which a workout is hard, of aerobic work over which it is long (fixed values).
HARD_SEC, LONG_SEC = 300, 3600
SHORT_SEC, DECOUPLED_PCT = 600, 5.0
MOST_WEEKS = 52


def _power_sec(*zones: int) -> Column:
    """Seconds in these power zones; an unknown zone has none."""
    return reduce(add, [F.coalesce(f"pwr_z{z}_sec", F.lit(0)) for z in zones])


def low_aerobic_sec() -> Column:
    return _power_sec(1, 2)


def intensity_sec() -> Column:
    return _power_sec(4, 5, 6, 7)


def is_hard() -> Column:
    return intensity_sec() > HARD_SEC


def is_long() -> Column:
    return F.greatest("hr_z2_sec", "pwr_z2_sec") > LONG_SEC


def week_start(time: Column, tz: str | Column = "UTC") -> Column:
    """Monday of the local week, as a local wall-clock timestamp."""
    return F.date_trunc("week", F.from_utc_timestamp(time, tz))


def week_key(time: Column) -> Column:
    """ISO year and week, YYYY-WW."""
    return F.format_string("%d-%02d", F.extract(F.lit("YEAROFWEEK"), time).cast("int"), F.weekofyear(time))


def weekly(workouts: DataFrame, tz: str = "UTC") -> DataFrame:
    """Per athlete and week: counts, minutes (0 where no workout has any), and the optional sums of distance, elevation and
    decoupling, null where no workout has the measure."""
    minutes = lambda c, name: F.round(F.coalesce(F.sum(c), F.lit(0)) / 60, 2).alias(name)
    known = workouts.where("start_time_utc is not null").withColumn("week_start", week_start(F.col("start_time_utc"), tz))
    return known.groupBy("athlete_id", "week_start").agg(
        F.count("*").alias("workout_count"), minutes("duration_sec", "total_duration_min"),
        F.round(F.sum("distance_m") / 1000, 2).alias("total_distance_km"), F.round(F.sum("elevation_gain_m"), 2).alias("total_elevation_m"),
        minutes("hr_z2_sec", "hr_z2_min"), minutes("pwr_z2_sec", "pwr_z2_min"), minutes(low_aerobic_sec(), "low_aerobic_min"), minutes(intensity_sec(), "intensity_min"),
        F.round(F.avg("decoupling_pct"), 2).alias("avg_decoupling_pct"), F.count_if(is_hard()).alias("hard_days"), F.count_if(is_long()).alias("long_days"),
    )


def parsed_starts(rows: DataFrame, text: str = "start_time_utc") -> DataFrame:
    """Rows whose start is ISO text: it becomes a timestamp, and `start_status` says ok, missing or invalid (null then)."""
    raw = F.trim(F.col(text).cast("string"))
    start = F.try_to_timestamp(F.regexp_replace(raw, "[Zz]$", "+00:00"))
    status = F.when(F.coalesce(raw, F.lit("")) == "", "missing").when(start.isNull(), "invalid").otherwise("ok")
    return rows.withColumn("start_status", status).withColumn(text, start)


def skipped_starts(parsed: DataFrame) -> DataFrame:
    """Per athlete how many workouts a rollup leaves out for want of a start, and how many it counts."""
    count = lambda s: F.count_if(F.col("start_status") == s)
    return parsed.groupBy("athlete_id").agg(count("ok").alias("with_start"), count("missing").alias("missing_start"), count("invalid").alias("invalid_start"))


def by_id(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, one at most: the filter goes to the scan, which stops at the first."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def local_week_bounds(now: Column, tz: str, back: int = 1) -> tuple[Column, Column]:
    """First and last second of the local week `back` weeks ago, as instants."""
    monday = F.date_trunc("week", F.from_utc_timestamp(now, tz)) - F.make_interval(weeks=F.lit(back))
    sunday = monday + F.make_interval(days=F.lit(7)) - F.make_interval(secs=F.lit(1))
    return F.to_utc_timestamp(monday, tz), F.to_utc_timestamp(sunday, tz)


def week_slots(rollups: DataFrame, weeks: int) -> DataFrame:
    """The newest `weeks` (1 to 52) rollups of each athlete in slots 1.. (weeks_ago), empty slots marked skipped."""
    weeks = max(1, min(int(weeks), MOST_WEEKS))
    newest = Window.partitionBy("athlete_id").orderBy(F.desc("week_start"))
    placed = rollups.withColumn("weeks_ago", F.row_number().over(newest)).where(F.col("weeks_ago") <= weeks)
    slots = rollups.select("athlete_id").distinct().select("athlete_id", F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("weeks_ago"))
    out = slots.join(placed, ["athlete_id", "weeks_ago"], "left")
    return out.withColumn("status", F.when(F.col("workout_count").isNull(), "skipped").otherwise("ok"))


def zone_distribution(workouts: DataFrame) -> DataFrame:
    """Per athlete and zone minutes and share; a workout's zone counts heart rate, or power where it has no such seconds."""
    seconds = [F.when(F.col(f"hr_z{z}_sec") > 0, F.col(f"hr_z{z}_sec")).otherwise(F.coalesce(f"pwr_z{z}_sec", F.lit(0))) for z in range(1, 6)]
    sums = workouts.groupBy("athlete_id").agg(*[F.sum(s).alias(f"_z{z}") for z, s in enumerate(seconds, 1)])
    total = sum((F.col(f"_z{z}") for z in range(2, 6)), F.col("_z1"))
    points = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.col(f"_z{z}").alias("s")) for z in range(1, 6)]))
    rows = sums.withColumn("_total", total).select("athlete_id", "_total", points.alias("p"))
    share = F.when(F.col("_total") > 0, F.col("p.s") / F.col("_total") * 100).otherwise(0.0)
    return rows.select("athlete_id", "p.zone", F.round(F.col("p.s") / 60, 1).alias("minutes"), F.round(share, 1).alias("pct"))


def efficiency_trend(workouts: DataFrame) -> DataFrame:
    known = workouts.where("decoupling_pct is not null")
    return known.groupBy("athlete_id").agg(F.count("*").alias("samples"), F.round(F.avg("decoupling_pct"), 2).alias("avg_decoupling_pct"))


def planning_summary(workouts: DataFrame) -> DataFrame:
    """Per athlete: totals, last hard and long workouts, and counts behind the notable flags."""
    return workouts.groupBy("athlete_id").agg(
        F.count("*").alias("workout_count"), F.round(F.sum(F.greatest("hr_z2_sec", "pwr_z2_sec")) / 60, 1).alias("z2_min"), F.round(F.sum(intensity_sec()) / 60, 1).alias("intensity_min"),
        F.max(F.when(is_hard(), F.col("start_time_utc"))).alias("last_hard_day"), F.max(F.when(is_long(), F.col("start_time_utc"))).alias("last_long_day"),
        F.count_if(F.col("hr_avg_bpm").isNull()).alias("missing_hr"), F.count_if(F.col("decoupling_pct") > DECOUPLED_PCT).alias("decoupled"),
        F.count_if((F.col("duration_sec") > 0) & (F.col("duration_sec") < SHORT_SEC)).alias("short"),
    )


def notable_flags(summary: DataFrame) -> DataFrame:
    """The counts as sentences, only those that are not zero."""
    said = {"missing_hr": "%d workout(s) without heart rate", "decoupled": "%d workout(s) with decoupling above 5%%", "short": "%d short workout(s)"}
    texts = F.array(*[F.when(F.col(c) > 0, F.format_string(t, F.col(c))) for c, t in said.items()])
    return summary.withColumn("notable_flags", F.array_compact(texts))


def summary_rows(workouts: DataFrame) -> DataFrame:
    """The light summary: zone seconds with nulls as zero, low aerobic and intensity seconds."""
    zones = [f"hr_z{z}_sec" for z in range(1, 6)] + [f"pwr_z{z}_sec" for z in range(1, 8)]
    filled = workouts.withColumns({z: F.coalesce(z, F.lit(0)) for z in zones})
    return filled.select("workout_id", "athlete_id", "start_time_utc", "sport", "duration_sec", "distance_m", "hr_avg_bpm", "decoupling_pct", *zones, low_aerobic_sec().alias("low_aerobic_sec"), intensity_sec().alias("intensity_sec"))


def gated(workouts: DataFrame) -> DataFrame:
    """The listing row: heart-rate columns only with heart rate, power columns only with power."""
    heart, power = ["hr_avg_bpm", *[f"hr_z{z}_sec" for z in range(1, 6)]], [f"pwr_z{z}_sec" for z in range(1, 8)]
    return workouts.select("workout_id", "athlete_id", "start_time_utc", "sport", "duration_sec", *[F.when(F.col("has_hr"), F.col(c)).alias(c) for c in heart], *[F.when(F.col("has_power"), F.col(c)).alias(c) for c in power])


def filled_from(rows: DataFrame, computed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows whose null columns take the computed value, none that is there is replaced."""
    other = computed.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(other, F.col(key) == F.col("_key"), "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def listing(workouts: DataFrame, since: str, until: str, sport: str | None, limit: int) -> DataFrame:
    """The newest workouts of a window, of a sport if given: a top-n over pushed-down filters."""
    rows = workouts.where(F.col("start_time_utc").between(lower_bound(since), upper_bound(until)))
    rows = rows.where(F.col("sport") == sport) if sport else rows
    return rows.orderBy(F.desc("start_time_utc"), "workout_id").limit(max(1, min(limit, 200)))


def lower_bound(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def upper_bound(text: str) -> Column:
    """A date alone means its last microsecond."""
    day = len(text) == 10
    return F.lit(f"{text} 23:59:59.999999" if day else text).cast("timestamp")


def athletes(workouts: DataFrame, partition_key: str | None = None) -> DataFrame:
    """Distinct athletes, in order; the key's first part where the id is null."""
    who = F.col("athlete_id").cast("string")
    who = F.coalesce(who, F.split(partition_key, r"\|")[0]) if partition_key else who
    return workouts.select(who.alias("athlete_id")).where("athlete_id is not null").distinct().orderBy("athlete_id")


def overall_status(rows: DataFrame, by: str, status: str) -> DataFrame:
    """success, partial, failed or skipped out of the parts' statuses."""
    ok, bad, n = F.count_if(F.col(status) == "success"), F.count_if(F.col(status) == "failed"), F.count("*")
    verdict = F.when(ok == n, "success").when(bad == n, "failed").when(ok > 0, "partial").when(bad > 0, "partial").otherwise("skipped")
    return rows.groupBy(by).agg(ok.alias("succeeded"), bad.alias("failed"), verdict.alias("overall_status"))
