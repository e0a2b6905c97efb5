"""Derived tables kept up to date by what changed: weekly rollups and rolling loads under late and corrected workouts.

Workouts arrive in any order, are corrected by a higher version and withdrawn by `deleted`. Their week is part of their
identity, as an effective date is: a workout moved in time is a withdrawal and a new row. A batch stores its rows by
month (of the week's Monday), marks the (athlete, week) and the 29 days that each of its rows counts in, reads the stored
months in reach of the marks and no others, and writes the marked results only. Tables are read as the newest row of each key, so that a batch
that runs again replaces its own folders and nothing that is stored is rewritten."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tempora.operators import rollups
from tempora.operators.state import LONG, SHORT
from tempora.sources.ledger import latest

WEEK = ["athlete_id", "week_start"]
DAY = ["athlete_id", "day"]


def week_of(time: Column) -> Column:
    """Monday (UTC) of a time as a date."""
    return F.to_date(rollups.week_start(time))


def loads(daily: DataFrame) -> DataFrame:
    """Per athlete and day in reach of a load (athlete_id, day, tss): tss of the day, of 7 days before it and of 28, the
    day itself counted as well. Each day's load goes to the days that it counts in; sums are aggregated before the shuffle."""
    spread = daily.select("athlete_id", F.col("day").alias("_of"), "tss", F.explode(F.sequence("day", F.date_add("day", LONG))).alias("day"))
    near = F.datediff("day", "_of")
    total = lambda most: F.coalesce(F.sum(F.when(near <= most, F.col("tss"))), F.lit(0.0))
    return spread.groupBy("athlete_id", "day").agg(total(0).alias("tss"), total(SHORT).alias("tss_7d"), F.sum("tss").alias("tss_28d"))


def daily_loads(workouts: DataFrame) -> DataFrame:
    return workouts.where("tss is not null").groupBy("athlete_id", F.to_date("start_time_utc").alias("day")).agg(F.sum("tss").alias("tss"))


class Upkeep:
    """The tables below `path`: base (workouts by batch and week), weekly and loads (results by batch)."""

    def __init__(self, path: str):
        self.path = path

    def _base(self, spark: SparkSession, weeks: list, schema) -> DataFrame:
        """The newest version of each workout in these weeks, withdrawn ones left out; other months are not read."""
        stored = spark.read.schema(schema).parquet(f"{self.path}/base")
        stored = stored.where(F.col("month").isin(sorted({f"{w:%Y-%m}" for w in weeks})) & F.col("week").isin(weeks)).drop("month")
        return latest(stored, ["workout_id", "week"], [F.col("version"), F.col("batch")]).where("not deleted")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take one batch: workout_id, athlete_id, start_time_utc, version, deleted and what rollups need."""
        spark = batch.sparkSession
        rows = batch.where("workout_id is not null and start_time_utc is not null").withColumn("week", week_of(F.col("start_time_utc")))
        rows = rows.withColumn("month", F.date_format("week", "yyyy-MM"))
        base = f"{self.path}/base/batch={number}"
        newest = latest(rows, ["workout_id", "week"], [F.col("version")])
        newest.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(base)  # few files a month, a hot one in several
        schema = rows.select("*", F.lit(0).cast("long").alias("batch")).schema
        new = spark.read.schema(rows.schema).parquet(base).drop("month")
        # athletes, weeks and days grow with the tables, and a size by files knows nothing of days to come: they meet by sorted merges
        weeks = [r.week for r in new.select("week").distinct().collect()]  # a row a calendar week
        marked_weeks = new.select("athlete_id", F.col("week").cast("timestamp").alias("week_start")).distinct()
        rollup = rollups.weekly(self._base(spark, weeks, schema))
        self._write(marked_weeks.join(rollup.hint("merge"), WEEK, "left"), "weekly", number)
        reach = sorted({w + timedelta(days=7 * k) for w in weeks for k in range(-(LONG // 7) - 1, LONG // 7 + 2)})
        marked_days = new.select("athlete_id", F.explode(F.sequence(F.to_date("start_time_utc"), F.date_add(F.to_date("start_time_utc"), LONG))).alias("day")).distinct()
        near = self._base(spark, reach, schema).join(new.select("athlete_id").distinct().hint("merge"), "athlete_id", "left_semi")
        self._write(marked_days.join(loads(daily_loads(near)).hint("merge"), DAY, "left"), "loads", number)

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def weekly(self, spark: SparkSession) -> DataFrame:
        """The rollups as they are now; weeks that lost all their workouts are gone."""
        return latest(spark.read.parquet(f"{self.path}/weekly"), WEEK, [F.col("batch")]).where("workout_count > 0").drop("batch")

    def loads(self, spark: SparkSession) -> DataFrame:
        """The loads as they are now, of all days in reach of one."""
        return latest(spark.read.parquet(f"{self.path}/loads"), DAY, [F.col("batch")]).where("tss_28d is not null").drop("batch")


def keep_up(stream: DataFrame, path: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start a run that takes the batches that have landed and ends; `after` is told each batch's number."""
    tables = Upkeep(path)

    def write(batch: DataFrame, number: int) -> None:
        tables.apply(batch, number)
        if after:
            after(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
