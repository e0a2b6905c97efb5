"""Joins in time: as-of lookups, nearest rows, near-duplicate intervals, and lookups with fallbacks.

An as-of join is a union of both sides, ordered by time within a key and a block of time, that carries the last right
row forward, into later blocks as well (`blocks.carried`): one shuffle and one sort of rows, whatever the number of right
rows a left row could match, and no key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.blocks import carried


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, ties: list[str], columns: list[str], fallback: bool = False, day_end: bool = False) -> DataFrame:
    """left with the columns of the right row of the same key at or before left_time (the latest; ties by `ties`).

    With fallback a left row without an earlier right row gets the latest of all, even a later one. day_end: right_time
    is a date that holds for the whole day of left_time. Null times of either side match nothing; no left row is lost."""
    found = carried(left, right, by, left_time, right_time, ties, {"_found": F.struct(*columns)}, ["_found"] if fallback else [], day_end)
    return found.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def preferred_as_of(workouts: DataFrame, rows: DataFrame, by: str, time: str, sources: list[str], columns: list[str]) -> DataFrame:
    """The configuration in effect on a workout's day: rows of the given sources first, else any; else the latest of all.

    rows: effective_date, updated_at_utc, row_key, data_source; ties go to the later update, then the greater row key."""
    row = F.struct("effective_date", *columns)
    values = {"_own": F.when(F.col("data_source").isin(sources), row), "_any": row}
    found = carried(workouts, rows, by, time, "effective_date", ["updated_at_utc", "row_key"], values, ["_any"], day_end=True)
    chosen = F.coalesce("_own", "_any")
    return found.select("_left.*", chosen["effective_date"].alias("effective_date"), *[chosen[c].alias(c) for c in columns])


def long_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide sparse rows as (keys, metric, value), one per value that is there."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return rows.select(*keys, pairs.alias("_p")).select(*keys, "_p.metric", "_p.value").where("value is not null")


def metrics_as_of(days: DataFrame, rows: DataFrame, by: str, day: str, metrics: list[str]) -> DataFrame:
    """days with each metric's latest value at or before the day, whatever row it comes from."""
    found = carried(days, rows, by, day, "effective_date", ["updated_at_utc", "row_key"], {m: F.col(m).cast("double") for m in metrics})
    return found.select("_left.*", *metrics)


def nearest(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, tolerance: float, columns: list[str]) -> DataFrame:
    """left with the columns of the right row nearest in time within `tolerance` seconds (the earlier of two equally near).

    Times are seconds. Both sides meet in buckets of twice the tolerance, so a left row looks into two of them. Both may be streams
    that take little room in files: they meet by sorted merges, none is broadcast."""
    span = 2 * tolerance
    l = left.withColumn("_id", F.struct(by, left_time)).withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor((F.col(left_time) - tolerance) / span), F.floor((F.col(left_time) + tolerance) / span)))))  # noqa: E741
    r = right.select(F.col(by).alias("_rby"), F.col(right_time).alias("_rt"), F.floor(F.col(right_time) / span).alias("_rb"), F.struct(*columns).alias("_right"))
    near = F.abs(F.col("_rt") - F.col(left_time))
    met = l.hint("merge").join(r.hint("merge"), (F.col(by) == F.col("_rby")) & (F.col("_bucket") == F.col("_rb")) & (near <= tolerance))
    best = met.groupBy("_id").agg(F.min_by("_right", F.struct(near, "_rt")).alias("_best"))
    out = left.withColumn("_id", F.struct(by, left_time)).join(best.hint("merge"), "_id", "left")
    return out.select(*left.columns, *[F.col(f"_best.{c}").alias(c) for c in columns])


def near_duplicate_pairs(rows: DataFrame, by: str, time: str, key: str, duration: str, seconds: int = 600, slack: float = 180.0) -> DataFrame:
    """Pairs (key_a < key_b) of a group that start within `seconds` and last alike within `slack` (or unknown).

    Rows meet on an equality of cells, `seconds` wide and `slack` long: a row looks into its own and the next cell of time
    and into three of duration. So most rows that meet are pairs, however many start together; a row of unknown duration
    is alike to all that start with it and meets them by time alone."""
    t = F.unix_timestamp(time)
    own = rows.select(F.col(by).alias("_by"), F.col(key).alias("_key"), t.alias("_t"), F.col(duration).alias("_d"), F.floor(t / seconds).alias("_cell"))
    own = own.withColumn("_span", F.floor(F.col("_d") / slack) if slack else F.col("_d"))
    a = own.select("_by", F.col("_key").alias("_ka"), F.col("_t").alias("_ta"), F.col("_d").alias("_da"), "_span", F.explode(F.array(F.col("_cell"), F.col("_cell") + 1)).alias("_cell"))
    b = own.select("_by", F.col("_key").alias("_kb"), F.col("_t").alias("_tb"), F.col("_d").alias("_db"), "_span", "_cell")
    known_a, known_b = a.where("_da is not null"), b.where("_db is not null")
    spans = F.explode(F.array(*[F.col("_span") + k for k in (-1, 0, 1)])) if slack else F.col("_span")
    met = known_a.withColumn("_span", spans).join(known_b, ["_by", "_cell", "_span"])
    met = met.unionByName(a.where("_da is null").drop("_span").join(b.drop("_span"), ["_by", "_cell"]), allowMissingColumns=True)
    met = met.unionByName(known_a.drop("_span").join(b.where("_db is null").drop("_span"), ["_by", "_cell"]), allowMissingColumns=True)
    later = (F.col("_tb") > F.col("_ta")) | ((F.col("_tb") == F.col("_ta")) & (F.col("_kb") > F.col("_ka")))
    alike = F.coalesce(F.abs(F.col("_da") - F.col("_db")) <= slack, F.lit(True))
    found = met.where(later & (F.col("_tb") - F.col("_ta") <= seconds) & alike)
    return found.select(F.col("_by").alias(by), F.least("_ka", "_kb").alias("key_a"), F.greatest("_ka", "_kb").alias("key_b")).distinct()


def missing_days(expected: DataFrame, present: DataFrame, by: str, day: str) -> DataFrame:
    """expected (by, first_day, last_day) spread to days, without those that present (by, day) has."""
    spine = expected.select(by, F.explode(F.sequence("first_day", "last_day")).alias(day))
    return spine.join(present.select(by, day).distinct(), [by, day], "left_anti")


def not_stored(days: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """days (keys: athlete, day, perhaps source) without those that are stored already."""
    return days.join(stored.select(*keys).distinct(), keys, "left_anti")


def unprocessed(items: DataFrame, ledger: DataFrame, key: str, done: list[str]) -> DataFrame:
    """items whose key the ledger doesn't have in a status of `done`."""
    return items.join(ledger.where(F.col("status").isin(done)).select(key).distinct(), key, "left_anti")


def changed(items: DataFrame, ledger: DataFrame, key: str, tags: list[str]) -> DataFrame:
    """items with `unchanged`: whether the first tag that both sides know is equal; no such tag: changed."""
    known = ledger.select(F.col(key), *[F.col(t).alias(f"_{t}") for t in tags])
    same = F.coalesce(*[F.col(t) == F.col(f"_{t}") for t in tags], F.lit(False))
    return items.join(known, key, "left").withColumn("unchanged", same).select(*items.columns, "unchanged")


def code_names(rows: DataFrame, codes: DataFrame, code: str, key: str, name: str, out: str) -> DataFrame:
    """rows with the name of a code; unknown codes keep themselves as text. The code table is a dimension; Spark
    broadcasts it when its size allows."""
    dim = codes.select(F.col(key).alias("_code"), F.col(name).alias("_name"))
    return rows.join(dim, F.col(code) == F.col("_code"), "left").withColumn(out, F.coalesce("_name", F.col(code).cast("string"))).drop("_code", "_name")


def typed_by(rows: DataFrame, types: DataFrame, sport: str, sub: str, default: str = "Other") -> DataFrame:
    """rows with activity_type: by sport and sub-sport, else by sport alone (types with a null sub-sport), else default."""
    exact = types.where("sub_sport is not null").select(F.col("sport").alias("_s"), F.col("sub_sport").alias("_u"), F.col("activity_type").alias("_exact"))
    plain = types.where("sub_sport is null").select(F.col("sport").alias("_p"), F.col("activity_type").alias("_plain"))
    out = rows.join(exact, (F.col(sport) == F.col("_s")) & (F.col(sub) == F.col("_u")), "left").join(plain, F.col(sport) == F.col("_p"), "left")
    return out.withColumn("activity_type", F.coalesce("_exact", "_plain", F.lit(default))).drop("_s", "_u", "_exact", "_p", "_plain")


def only_effective(payload: Column, payload_date: Column, day: Column) -> Column:
    """A baseline payload, unless it is dated after the day."""
    return F.when(payload_date.isNull() | (payload_date <= day), payload)


def lap(laps: DataFrame, by: str, index: int) -> DataFrame:
    """The lap of each workout with that message_index, else the one at that position (from 0)."""
    at = Window.partitionBy(by).orderBy("position")
    placed = laps.withColumn("_pos", F.row_number().over(at) - 1).where((F.col("message_index") == index) | (F.col("_pos") == index))
    rank = Window.partitionBy(by).orderBy(F.when(F.col("message_index") == index, 0).otherwise(1), "position")
    return placed.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r", "_pos")


def beats_to_seconds(beats: DataFrame, records: DataFrame, by: str, time: str) -> DataFrame:
    """records with rr_intervals_sec: the beats (message, position, rr, start_sec) that end in each second, in order.

    A message's beats follow one another from its start; the time of a beat is the running sum of its intervals."""
    w = Window.partitionBy(by, "message").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    timed = beats.withColumn("_at", F.col("start_sec") + F.sum("rr").over(w))
    per_second = timed.groupBy(by, F.floor("_at").alias("_second")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "message", "position", "rr"))), lambda x: x["rr"]).alias("_rr"))
    keyed = records.withColumn("_second", F.floor(time))
    return keyed.join(per_second, [by, "_second"], "left").select(*records.columns, F.coalesce("_rr", F.array().cast("array<double>")).alias("rr_intervals_sec"))
