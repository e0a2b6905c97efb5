"""Data-quality queries: contracts, anomalies, mismatches, payload profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.blocks import counted_out

# Fixed limits: metres, km/h, and ratios of two distances that agree.
FAR_M, FAST_KMH, SLOW_KMH, SLOW_FROM_M = 300_000, 90, 2, 5000
RATIO = (0.95, 1.05)
#: Fixed ranges of body metrics; a payload with a value outside is set aside whole.
RANGES = {"ftp": (150, 400), "vo2max_cycling": (30, 100), "vo2max_running": (20, 100), "training_effect_aerobic": (0, 5), "training_effect_anaerobic": (0, 5), "atp_probability": (0, 100), "lactate_threshold_hr_bpm": (80, 220), "lactate_threshold_hr_cycling_bpm": (80, 220)}


def speed_kmh(distance: Column, duration: Column) -> Column:
    return F.when(duration != 0, distance / 1000 / (duration / 3600))


def distance_anomalies(distance: Column, duration: Column) -> Column:
    """The labels that a workout's distance and speed earn, as an array."""
    speed = speed_kmh(distance, duration)
    labels = F.array(
        F.when(distance < 0, "negative_distance"),
        F.when(distance > FAR_M, "distance_over_300km"),
        F.when(speed > FAST_KMH, "speed_over_90kmh"),
        F.when((speed < SLOW_KMH) & (distance > SLOW_FROM_M), "speed_under_2kmh_with_distance"),
    )
    return F.when(distance.isNull(), F.array(F.lit("missing_distance"))).otherwise(F.array_compact(labels))


def anomaly_buckets(workouts: DataFrame) -> DataFrame:
    labelled = workouts.select("workout_id", F.explode(distance_anomalies(F.col("distance_m"), F.col("duration_sec"))).alias("anomaly"))
    return labelled.groupBy("anomaly").agg(F.count("*").alias("workouts"), F.min("workout_id").alias("first_workout_id"))


def within(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> Column:
    """Whether all values of a row that are there are in range; a row is kept or set aside by this one condition."""
    tests = [F.col(c).isNull() | F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items() if c in rows.columns]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_value_in(columns: list[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def mismatches(rows: DataFrame, key: str, value: str, candidates: list[str]) -> DataFrame:
    """Candidate columns whose ratio to value is outside RATIO: key, source, candidate, ratio."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).cast("double").alias("candidate")) for c in candidates]))
    long = rows.select(key, F.col(value).alias("_v"), pairs.alias("p")).select(key, "p.source", "p.candidate", F.when(F.col("_v") != 0, F.col("p.candidate") / F.col("_v")).alias("ratio"))
    return long.where(F.col("ratio").isNotNull() & ~F.col("ratio").between(*RATIO))


def compare_totals(persisted: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Full outer comparison of two tables of totals: both values and missing_persisted, missing_expected, match or differs."""
    a, b = persisted.select(*keys, F.col(value).alias("persisted")), expected.select(*keys, F.col(value).alias("expected"))
    status = F.when(F.col("persisted").isNull(), "missing_persisted").when(F.col("expected").isNull(), "missing_expected").when(F.abs(F.col("persisted") - F.col("expected")) <= tolerance, "match").otherwise("differs")
    return a.join(b, keys, "full_outer").withColumn("status", status)


def contract_violations(messages: DataFrame, by: str, slack: float = 2.0) -> DataFrame:
    """Files that break the message contract, with what they break, as an array; message rows have
    name, kind, position (of any type that sorts), timestamp, total_elapsed_time, total_timer_time and num_sessions.

    Records of one position are in order of time. Messages are dealt once, by file, and sorted once; a task has its share
    of them, however many there are. What only other messages have takes no room in a record."""
    own = F.when(F.col("name") != "record", F.struct("kind", "total_elapsed_time", "total_timer_time", "num_sessions")).alias("_own")
    w = Window.partitionBy(by, "name").orderBy("position", "timestamp")
    dealt = counted_out(messages.select(by, "name", "position", "timestamp", own), by)
    back = (F.col("name") == "record") & (F.col("timestamp") < F.lag("timestamp").over(w))
    m = dealt.select(by, "name", "position", "timestamp", "_own.*", back.alias("_back"))
    of = lambda name: F.col("name") == name
    session_time = F.sum(F.when(of("session"), F.col("total_timer_time")))
    facts = m.groupBy(by).agg(
        F.count_if(of("file_id")).alias("file_ids"), F.count_if(of("file_id") & (F.lower("kind") == "activity")).alias("activities"),
        F.count_if(of("session")).alias("sessions"), F.count_if(of("record")).alias("records"),
        F.count_if(of("session") & (F.col("timestamp").isNull() | F.col("total_elapsed_time").isNull() | (F.col("total_elapsed_time") < 0) | F.col("total_timer_time").isNull())).alias("bad_sessions"),
        F.count_if(of("record") & F.col("timestamp").isNull()).alias("undated"), F.count_if("_back").alias("backward"),
        F.min_by(F.col("num_sessions"), F.when(of("activity"), F.col("position"))).alias("stated"), F.min_by(F.col("total_timer_time"), F.when(of("activity"), F.col("position"))).alias("timer"), session_time.alias("timed"),
    )
    broken = F.array_compact(F.array(
        F.when(F.col("file_ids") != 1, "one_file_id"), F.when((F.col("file_ids") == 1) & (F.col("activities") == 0), "file_type"), F.when(F.col("sessions") == 0, "session_missing"),
        F.when(F.col("records") == 0, "record_missing"), F.when(F.col("bad_sessions") > 0, "session_fields"), F.when(F.col("undated") > 0, "record_timestamp"),
        F.when(F.col("backward") > 0, "record_order"), F.when(F.col("stated") != F.col("sessions"), "session_count"), F.when(F.abs(F.col("timer") - F.col("timed")) > slack, "timer_total"),
    ))
    return facts.select(by, broken.alias("violations")).where(F.size("violations") > 0)


def field_summary(fields: DataFrame, keys: list[str], samples: int = 3) -> DataFrame:
    """Per key the number of fields, their units (sorted) and the first values by position. A bounded top-n per key:
    values are numbered within the part of a key that one task has read, so no task holds a key and no list all values."""
    own = fields.withColumn("_part", F.spark_partition_id())
    order = Window.partitionBy(*keys, "_part").orderBy("position")
    kept = F.collect_list(F.when(F.col("_rn") <= samples, F.struct("position", "value")))
    parts = own.withColumn("_rn", F.row_number().over(order)).groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.collect_set("units").alias("_units"), kept.alias("_first"))
    first = F.slice(F.array_sort(F.flatten(F.collect_list("_first"))), 1, samples)
    return parts.groupBy(*keys).agg(F.sum("_n").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_units")))).alias("units"), F.transform(first, lambda x: x["value"]).alias("samples"))


def key_presence(payloads: DataFrame, kind: str, payload: str) -> DataFrame:
    """kind, key, ratio, kinds: the share of a kind's payloads (JSON text) that have a key, where any has it; and how
    many kinds there are."""
    sizes = payloads.groupBy(kind).agg(F.count("*").alias("_n"))
    own = payloads.select(kind, F.explode(F.array_distinct(F.json_object_keys(payload))).alias("key"))
    found = own.groupBy(kind, "key").agg(F.count("*").alias("_has"))
    return found.join(sizes, kind).select(kind, "key", (F.col("_has") / F.col("_n")).alias("ratio"), F.lit(sizes.count()).alias("kinds"))


def discriminating_keys(presence: DataFrame, top: int = 20) -> DataFrame:
    """The keys whose presence differs most between kinds, as a report of `top` rows: key, ratio_variance.

    A kind without the key counts as 0: it adds nothing to the sums, so kinds and keys are never paired off."""
    r, n = F.col("ratio"), F.first("kinds")
    least = F.when(F.count("*") < n, 0.0).otherwise(F.min(r))
    variance = F.when(n > 1, (F.sum(r * r) - F.sum(r) * F.sum(r) / n) / (n - 1))
    by_key = presence.groupBy("key").agg(F.round(variance, 6).alias("ratio_variance"), (least != F.max(r)).alias("_differs"))
    return by_key.where("_differs").select("key", "ratio_variance").orderBy(F.desc("ratio_variance"), "key").limit(top)


def unique_keys(presence: DataFrame, kind: str) -> DataFrame:
    """Keys that only one kind has."""
    return presence.groupBy("key").agg(F.count("*").alias("_n"), F.min(kind).alias(kind)).where("_n = 1").select("key", kind)


def environment(gps: Column, indoor: Column, sub_sport: Column, name: Column) -> Column:
    """Evidence of where a workout took place, with a confidence."""
    virtual = F.array_compact(F.array(F.when(F.lower(sub_sport).contains("virtual"), "session.sub_sport=virtual"), F.when(F.lower(name).rlike("zwift|virtual|trainerroad|peloton"), "session.session_name=virtual_keyword")))
    inside = F.array_compact(F.array(F.when(indoor, "session.indoor=true"), F.when(F.lower(sub_sport).contains("indoor"), "session.sub_sport=indoor")))
    outside = F.array_compact(F.array(F.when(gps, "record.position_lat/long=present"), F.when(~indoor, "session.indoor=false")))
    some = lambda a: F.size(a) > 0
    confidence = F.when(some(virtual), "high").when(some(inside) != some(outside), "medium").otherwise("low")
    return F.struct(virtual.alias("virtual"), inside.alias("indoor"), outside.alias("outdoor"), confidence.alias("confidence"))


#: What a caller may ask for.
STATUSES = ("active", "resolved", "archived", "all")


def visible(items: DataFrame, status: str | None = None) -> DataFrame:
    """Items of a status; all but archived by default (none or an empty one asked for), everything for `all`.

    Any other status is a ValueError."""
    if not status:
        return items.where(F.coalesce("status", F.lit("active")) != "archived")
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    return items if status == "all" else items.where(F.col("status") == status)


def owned(rows: DataFrame, athlete: object, by: str = "athlete_id") -> DataFrame:
    """Rows of the athlete who asks; rows without an owner are nobody's."""
    return rows.where(F.col(by) == F.lit(athlete))


def from_watches(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose device is a watch by its name."""
    return rows.where(F.lower(F.coalesce(name, F.lit(""))).contains("watch"))


def by_priority(items: DataFrame, limit: int) -> DataFrame:
    """The first items by priority (high, normal, low; unknown is normal), then age."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "low", 2).otherwise(1)
    return items.orderBy(rank, "created_at", "item_id").limit(limit)


def instruction_text(items: DataFrame, by: str, most: int = 3) -> DataFrame:
    """Per athlete: goal and phase, then up to `most` preferences and observations, newest first, joined by ' | '."""
    order = Window.partitionBy(by, "kind").orderBy(F.desc("created_at"), "item_id")
    kinds = F.when(F.col("kind") == "goal", 0).when(F.col("kind") == "phase", 1).when(F.col("kind") == "preference", 2).when(F.col("kind") == "observation", 3)
    first = items.withColumn("_k", kinds).withColumn("_rn", F.row_number().over(order)).where(F.col("_k").isNotNull() & (F.col("_rn") <= F.when(F.col("_k") < 2, 1).otherwise(most)))
    return first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_rn", "content"))), lambda x: x["content"]), " | ").alias("instructions"))
