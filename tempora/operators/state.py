"""Training state: daily load, rolling sums over a date spine, fatigue and readiness."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.lookup import metrics_as_of

#: Days that a sum looks back, the day itself not counted; the divisors are the nominal 7 and 28.
SHORT, LONG = 7, 28
#: Days of a history at most (fixed value).
MOST_DAYS = 90


def workout_tss(table_value: Column, computed: Column) -> Column:
    return F.coalesce(table_value, computed)


def daily_tss(workouts: DataFrame, computed: DataFrame | None = None) -> DataFrame:
    """Per athlete and day the workouts' load; where the table has none, that of `computed` (workout_id, tss) if given."""
    rows = workouts
    if computed is not None:
        other = computed.select(F.col("workout_id").alias("_id"), F.col("tss").alias("_tss"))
        rows = rows.join(other, F.col("workout_id") == F.col("_id"), "left").withColumn("tss", workout_tss(F.col("tss"), F.col("_tss")))
    known = rows.where("tss is not null and start_time_utc is not null")
    return known.groupBy("athlete_id", F.to_date("start_time_utc").alias("day")).agg(F.sum("tss").alias("tss"))


def rolling_at(workouts: DataFrame, day: str, computed: DataFrame | None = None) -> DataFrame:
    """Both sums for one date: workouts from 7 (28) days before it to the day itself."""
    d = F.lit(day).cast("date")
    daily = daily_tss(workouts, computed).where(F.col("day").between(F.date_sub(d, LONG), d))
    total = lambda n: F.coalesce(F.sum(F.when(F.col("day") >= F.date_sub(d, n), F.col("tss"))), F.lit(0.0))
    return daily.groupBy("athlete_id").agg(total(SHORT).alias("tss_7d"), total(LONG).alias("tss_28d"))


def rolling(workouts: DataFrame, first: str, last: str, computed: DataFrame | None = None) -> DataFrame:
    """Both sums for each day of a range and each athlete with workouts in reach, from 28 days before it.

    The days that an athlete has are gathered in one row, no longer than the calendar, and the range is spread out of it
    where it is read: no spine is joined, sorted or shuffled."""
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    daily = daily_tss(workouts, computed).where(F.col("day").between(F.date_sub(lo, LONG), hi))
    own = F.when(F.col("athlete_id").isNotNull(), F.struct("day", F.col("tss").cast("double").alias("tss")))  # nobody's days are nobody's load
    spread = daily.groupBy("athlete_id").agg(F.array_sort(F.collect_list(own)).alias("_days")).select("athlete_id", "_days", F.explode(F.sequence(lo, hi)).alias("day"))
    reached = lambda n: F.filter("_days", lambda x: x["day"].between(F.date_sub(F.col("day"), n), F.col("day")))
    total = lambda n: F.aggregate(reached(n), F.lit(0.0), lambda s, x: s + x["tss"])
    return spread.select("athlete_id", "day", total(0).alias("tss"), total(SHORT).alias("tss_7d"), total(LONG).alias("tss_28d"))


def load_components(rows: DataFrame) -> DataFrame:
    """Chronic and acute stress a day, and fatigue as their ratio (null without long-term stress)."""
    out = rows.withColumn("cts_7d", F.col("tss_7d") / SHORT).withColumn("cts_28d", F.col("tss_28d") / LONG).withColumn("ats", F.col("tss_7d") / SHORT)
    return out.withColumn("fatigue", F.when(F.col("cts_28d") != 0, F.col("cts_7d") / F.col("cts_28d")))


def readiness(hrv: Column, fatigue: Column) -> Column:
    """Mean of two scores from 0 to 100, of heart-rate variability and of freshness; null if either is unknown."""
    score = lambda x: F.least(F.greatest(x * 100, F.lit(0.0)), F.lit(100.0))
    both = (score((hrv - 2.5) / 2.0) + score((2.0 - fatigue) / 1.5)) / 2
    return F.when(hrv.isNotNull() & (fatigue > 0), both)


def training_state(workouts: DataFrame, physiometrics: DataFrame, first: str, last: str, computed: DataFrame | None = None) -> DataFrame:
    """Per athlete and day: load, the newest known body metrics of that day, and readiness. `computed` as in daily_tss."""
    metrics = ["hrv_ln_rmssd", "resting_hr_bpm", "weight_kg"]
    found = load_components(metrics_as_of(rolling(workouts, first, last, computed), physiometrics, "athlete_id", "day", metrics))
    known = found.select(*[c for c in found.columns if c not in metrics], *metrics)
    return known.withColumn("readiness", F.round(readiness(F.col("hrv_ln_rmssd"), F.col("fatigue")), 2))


def history(workouts: DataFrame, physiometrics: DataFrame, until: str, days: int, computed: DataFrame | None = None) -> DataFrame:
    """The training state of the last `days` days (1 to MOST_DAYS) up to a date."""
    last = date.fromisoformat(until)
    first = last - timedelta(days=max(1, min(int(days), MOST_DAYS)) - 1)
    return training_state(workouts, physiometrics, first.isoformat(), last.isoformat(), computed)
