"""One value per metric out of several sources: by precedence, by recency, per day or as a current snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.lookup import long_metrics

ROW_KEYS = ["data_source", "effective_date", "updated_at_utc", "row_key"]
#: Rank of a source that no precedence names.
UNRANKED = 1 << 20


def rank_of(source: Column, order: list[str]) -> Column:
    """Place of a source in the order, from 0; sources outside come last."""
    rank = F.lit(UNRANKED)
    for place, name in reversed(list(enumerate(order))):
        rank = F.when(source == name, place).otherwise(rank)
    return rank


def by_precedence(rows: DataFrame, by: list[str], metrics: list[str], order: dict[str, list[str]], default: list[str]) -> DataFrame:
    """Per group and metric the value of the first source of its order that has one, from that source's newest row.

    Sources that the order doesn't name don't count. Gives by, metric, value, data_source, effective_date."""
    long = long_metrics(rows, [*by, *ROW_KEYS], metrics)
    rank = reduce(lambda acc, m: acc.when(F.col("metric") == m, rank_of(F.col("data_source"), order[m])), order, F.when(F.lit(False), 0)).otherwise(rank_of(F.col("data_source"), default))
    ranked = long.withColumn("_rank", rank).where(F.col("_rank") < UNRANKED)
    # the least rank and, within it, the newest row: the greatest of (-rank, date, update, key)
    best = F.max_by(F.struct("value", "data_source", "effective_date"), F.struct(-F.col("_rank"), "effective_date", "updated_at_utc", "row_key"))
    return ranked.groupBy(*by, "metric").agg(best.alias("_b")).select(*by, "metric", "_b.value", "_b.data_source", "_b.effective_date")


def by_recency(rows: DataFrame, by: list[str], metrics: list[str], order: list[str]) -> DataFrame:
    """Per group and metric the newest value; of equally new ones that of the source first in order, then by row key."""
    long = long_metrics(rows, [*by, *ROW_KEYS], metrics)
    key = F.struct("effective_date", "updated_at_utc", -rank_of(F.col("data_source"), order), "row_key")
    best = F.max_by(F.struct("value", "data_source", "effective_date"), key)
    return long.groupBy(*by, "metric").agg(best.alias("_b")).select(*by, "metric", "_b.value", "_b.data_source", "_b.effective_date")


def wide(resolved: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return resolved.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def first_alias(columns: list[str], aliases: list[str]) -> Column:
    """The first non-null of a metric's legacy columns, those that exist."""
    present = [F.col(c).cast("double") for c in aliases if c in columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def sources_of(single: Column, csv: Column) -> Column:
    """Distinct lower-case sources of a scalar and a comma-separated column, sorted."""
    parts = F.concat(F.array(single), F.split(F.coalesce(csv, F.lit("")), ","))
    clean = F.filter(F.transform(parts, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(clean))


def consolidate_days(rows: DataFrame, metrics: list[str], order: dict[str, list[str]], default: list[str], plain: list[str] | None = None) -> DataFrame:
    """One row per athlete and day: metrics by precedence, `plain` ones as the first value in order of update, and the
    sources that gave something, sorted, as text."""
    by = ["athlete_id", "effective_date"]
    day = rows.withColumn("_day", F.col("effective_date"))
    resolved = by_precedence(day, ["athlete_id", "_day"], metrics, order, default)
    out = resolved.groupBy("athlete_id", "_day").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    contributing = long_metrics(rows, [*by, "data_source"], metrics + (plain or []))
    sources = contributing.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("data_source")), ",").alias("data_sources"))
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("updated_at_utc", "row_key"))).alias(c) for c in plain or []]
    joined = sources.join(out.withColumnRenamed("_day", "effective_date"), by, "left")
    return joined.join(rows.groupBy(*by).agg(*firsts), by, "left") if firsts else joined


def current(rows: DataFrame, by: str, metrics: list[str], order: list[str]) -> DataFrame:
    """Newest value per metric, the date of each source's newest row as a map, and the newest date."""
    values = wide(by_recency(rows, [by], metrics, order), [by], metrics)
    dates = rows.groupBy(by, "data_source").agg(F.max("effective_date").alias("d"))
    maps = dates.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("data_source", "d")))).alias("source_dates"), F.max("d").alias("effective_date"))
    return maps.join(values, by, "left")


def history(rows: DataFrame, by: str, first: str, last: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Rows of the date range, newest first within an athlete, with metrics under their present names."""
    own = rows.where(F.col("effective_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return own.select(by, "effective_date", "data_source", "row_key", *[first_alias(rows.columns, a).alias(m) for m, a in aliases.items()])


def timezone(explicit: Column, preference: Column, physiometric: Column, configured: Column) -> Column:
    """An athlete's zone: as asked for, as preferred, as recorded, as configured; empty text is no answer."""
    some = [F.when(F.trim(c) != "", F.trim(c)) for c in (explicit, preference, physiometric, configured)]
    return F.coalesce(*some, F.lit("UTC"))


def canonical_timezone(is_virtual: Column, home: Column, recorded: Column, inferred: Column, default: str = "UTC") -> Column:
    """A workout's zone: the home zone for virtual rides, else the recorded, the inferred and the home one."""
    return F.coalesce(F.when(is_virtual, home), recorded, inferred, home, F.lit(default))
