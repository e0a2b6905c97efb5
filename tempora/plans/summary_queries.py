"""Queries over workout summaries and body metrics: rollups, listings, planning, lookups, resolution, training state."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import lookup, resolve, rollups, state
from tempora.sources.views import METRICS, PHYSIOMETRICS_SQL, SOURCES, WORKOUTS_SQL, physiometrics, table, workouts

ZONE = "America/New_York"
ORDER = {"ftp_watts": ["garmin", "manual"], "lthr_bpm": ["manual", "chatgpt", "garmin"], "weight_kg": ["withings", "intervals"]}
RECENT = ["manual", "chatgpt", "garmin", "withings", "intervals"]
FIRST, LAST = "1998-03-01", "1998-03-31"

Q: dict = {}
SQL: dict = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_INTENSITY = "(pwr_z4_sec + pwr_z5_sec + pwr_z6_sec + pwr_z7_sec)"
_HARD, _LONG = f"{_INTENSITY} > 300", "greatest(hr_z2_sec, pwr_z2_sec) > 3600"
_WEEK_COLUMNS = f"""count(*) AS workout_count, round(sum(duration_sec) / 60, 2) AS total_duration_min, round(sum(distance_m) / 1000, 2) AS total_distance_km,
  round(sum(elevation_gain_m), 2) AS total_elevation_m, round(coalesce(sum(hr_z2_sec), 0) / 60, 2) AS hr_z2_min, round(coalesce(sum(pwr_z2_sec), 0) / 60, 2) AS pwr_z2_min,
  round(coalesce(sum(pwr_z1_sec + pwr_z2_sec), 0) / 60, 2) AS low_aerobic_min, round(sum({_INTENSITY}) / 60, 2) AS intensity_min, round(avg(decoupling_pct), 2) AS avg_decoupling_pct,
  count(*) FILTER ({_HARD}) AS hard_days, count(*) FILTER ({_LONG}) AS long_days"""
_WEEKLY = f"weekly AS (SELECT athlete_id, date_trunc('week', start_time_utc)::TIMESTAMP AS week_start, {_WEEK_COLUMNS} FROM workouts GROUP BY ALL)"


@query(f"WITH {WORKOUTS_SQL}, {_WEEKLY} SELECT * FROM weekly")
def a9_weekly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.weekly(workouts(spark, sf_dir))


@query(f"WITH {WORKOUTS_SQL} SELECT athlete_id, date_trunc('week', start_time_utc AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}')::TIMESTAMP AS week_start, {_WEEK_COLUMNS} FROM workouts GROUP BY ALL")
def a10_local_weekly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.weekly(workouts(spark, sf_dir), ZONE)


@query(f"""WITH {WORKOUTS_SQL}, {_WEEKLY}, r AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY week_start DESC)::INTEGER AS weeks_ago FROM weekly),
s AS (SELECT athlete_id, unnest(range(1, 5))::INTEGER AS weeks_ago FROM (SELECT DISTINCT athlete_id FROM weekly))
SELECT s.athlete_id, s.weeks_ago, week_start, workout_count, total_duration_min, CASE WHEN workout_count IS NULL THEN 'skipped' ELSE 'ok' END AS status
FROM s LEFT JOIN r ON s.athlete_id = r.athlete_id AND s.weeks_ago = r.weeks_ago""")
def w11_week_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = rollups.week_slots(rollups.weekly(workouts(spark, sf_dir)), 4)
    return slots.select("athlete_id", "weeks_ago", "week_start", "workout_count", "total_duration_min", "status")


@query(f"""WITH {WORKOUTS_SQL}, z AS (SELECT athlete_id, {', '.join(f'sum(CASE WHEN hr_z{z}_sec > 0 THEN hr_z{z}_sec ELSE pwr_z{z}_sec END) AS z{z}' for z in range(1, 6))} FROM workouts GROUP BY athlete_id),
l AS (SELECT athlete_id, z1 + z2 + z3 + z4 + z5 AS total, unnest([{', '.join(f"{{'zone': {z}, 's': z{z}}}" for z in range(1, 6))}]) AS p FROM z)
SELECT athlete_id, p.zone AS zone, round(p.s / 60, 1) AS minutes, round(CASE WHEN total > 0 THEN p.s / total * 100 ELSE 0 END, 1) AS pct FROM l""")
def a11_zone_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.zone_distribution(workouts(spark, sf_dir))


@query(f"WITH {WORKOUTS_SQL} SELECT athlete_id, count(*) AS samples, round(avg(decoupling_pct), 2) AS avg_decoupling_pct FROM workouts WHERE decoupling_pct IS NOT NULL GROUP BY athlete_id")
def a12_efficiency_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.efficiency_trend(workouts(spark, sf_dir))


_PLANNING = f"""SELECT athlete_id, count(*) AS workout_count, round(sum(greatest(hr_z2_sec, pwr_z2_sec)) / 60, 1) AS z2_min, round(sum({_INTENSITY}) / 60, 1) AS intensity_min,
  max(start_time_utc) FILTER ({_HARD}) AS last_hard_day, max(start_time_utc) FILTER ({_LONG}) AS last_long_day, count(*) FILTER (hr_avg_bpm IS NULL) AS missing_hr,
  count(*) FILTER (decoupling_pct > 5) AS decoupled, count(*) FILTER (duration_sec > 0 AND duration_sec < 600) AS short FROM workouts GROUP BY athlete_id"""


@query(f"WITH {WORKOUTS_SQL} {_PLANNING}")
def a13_planning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.planning_summary(workouts(spark, sf_dir))


@query(f"""WITH {WORKOUTS_SQL}, p AS ({_PLANNING}) SELECT athlete_id, array_to_string(list_filter([
  CASE WHEN missing_hr > 0 THEN missing_hr || ' workout(s) without heart rate' END, CASE WHEN decoupled > 0 THEN decoupled || ' workout(s) with decoupling above 5%' END,
  CASE WHEN short > 0 THEN short || ' short workout(s)' END], lambda x: x IS NOT NULL), '; ') AS notable FROM p""")
def a14_notable_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = rollups.notable_flags(rollups.planning_summary(workouts(spark, sf_dir)))
    return flagged.select("athlete_id", F.array_join("notable_flags", "; ").alias("notable"))


_LIGHT = ", ".join(["workout_id", "athlete_id", "start_time_utc", "sport", "duration_sec", "distance_m", "hr_avg_bpm", "decoupling_pct"] + [f"hr_z{z}_sec" for z in range(1, 6)] + [f"pwr_z{z}_sec" for z in range(1, 8)])


@query(f"WITH {WORKOUTS_SQL} SELECT {_LIGHT}, pwr_z1_sec + pwr_z2_sec AS low_aerobic_sec, {_INTENSITY} AS intensity_sec FROM workouts")
def p2_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.summary_rows(workouts(spark, sf_dir))


_GATED = ", ".join([f"CASE WHEN has_hr THEN {c} END AS {c}" for c in ["hr_avg_bpm"] + [f"hr_z{z}_sec" for z in range(1, 6)]] + [f"CASE WHEN has_power THEN {c} END AS {c}" for c in [f"pwr_z{z}_sec" for z in range(1, 8)]])


@query(f"WITH {WORKOUTS_SQL} SELECT workout_id, athlete_id, start_time_utc, sport, duration_sec, {_GATED} FROM workouts")
def p3_gated_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.gated(workouts(spark, sf_dir))


@query(f"WITH {WORKOUTS_SQL} SELECT workout_id, athlete_id, coalesce(distance_m, duration_sec * 2) AS distance_m, coalesce(hr_avg_bpm, 120) AS hr_avg_bpm FROM workouts")
def p4_fill_from_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workouts(spark, sf_dir)
    computed = w.select("workout_id", (F.col("duration_sec") * 2).alias("distance_m"), F.lit(120.0).alias("hr_avg_bpm"))
    return rollups.filled_from(w.select("workout_id", "athlete_id", "distance_m", "hr_avg_bpm"), computed, "workout_id", ["distance_m", "hr_avg_bpm"])


@query(f"WITH {WORKOUTS_SQL} SELECT workout_id, athlete_id, start_time_utc, sport FROM workouts WHERE start_time_utc BETWEEN '1998-01-01' AND '1998-03-31 23:59:59.999999' AND sport = '1-URGENT' ORDER BY start_time_utc DESC, workout_id LIMIT 50")
def o1_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.listing(workouts(spark, sf_dir), "1998-01-01", "1998-03-31", "1-URGENT", 50).select("workout_id", "athlete_id", "start_time_utc", "sport")


@query("""SELECT o_custkey AS athlete_id, count(*) FILTER (o_orderkey % 7 > 2) AS with_start, count(*) FILTER (o_orderkey % 7 IN (0, 1)) AS missing_start, count(*) FILTER (o_orderkey % 7 = 2) AS invalid_start
FROM orders GROUP BY o_custkey""")
def p11_start_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts as text: without any, empty, malformed and with or without a zone."""
    k, good = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 7 == 0, None).when(k % 7 == 1, " ").when(k % 7 == 2, "2024-13-45Tmorning").when(k % 7 == 3, F.concat(good, F.lit("Z"))).when(k % 7 == 4, F.concat(good, F.lit("+02:00"))).otherwise(good)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("athlete_id"), text.alias("start_time_utc"))
    return rollups.skipped_starts(rollups.parsed_starts(rows))


@query(f"WITH {WORKOUTS_SQL} SELECT workout_id, athlete_id, sport FROM workouts WHERE workout_id = 7")
def o5_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.by_id(workouts(spark, sf_dir), "workout_id", 7).select("workout_id", "athlete_id", "sport")


@query(f"WITH {WORKOUTS_SQL} SELECT DISTINCT athlete_id::VARCHAR AS athlete_id FROM workouts WHERE athlete_id IS NOT NULL")
def a18_athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.athletes(workouts(spark, sf_dir))


@query("""SELECT o_custkey AS athlete_id, count(*) FILTER (o_orderstatus = 'O') AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS failed,
  CASE WHEN succeeded = count(*) THEN 'success' WHEN failed = count(*) THEN 'failed' WHEN succeeded > 0 THEN 'partial' WHEN failed > 0 THEN 'partial' ELSE 'skipped' END AS overall_status
FROM orders GROUP BY o_custkey""")
def a26_overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failed").otherwise("skipped")
    parts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("athlete_id"), status.alias("status"))
    return rollups.overall_status(parts, "athlete_id", "status")


@query(f"""WITH {PHYSIOMETRICS_SQL}, w AS (SELECT event_id AS workout_id, user_id AS athlete_id, ts AS start_time_utc FROM events),
c AS (SELECT w.*, p.effective_date, p.updated_at_utc, p.row_key, p.ftp_watts, p.lthr_bpm, p.data_source IN ('manual', 'chatgpt') AS own, p.effective_date <= w.start_time_utc::DATE AS before FROM w LEFT JOIN physiometrics p ON w.athlete_id = p.athlete_id),
r AS (SELECT *, row_number() OVER (PARTITION BY workout_id ORDER BY (own AND before) DESC, before DESC, effective_date DESC, updated_at_utc DESC, row_key DESC) AS rn FROM c)
SELECT workout_id, athlete_id, start_time_utc, effective_date, ftp_watts, lthr_bpm FROM r WHERE rn = 1""")
def j1_baselines_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").select(F.col("event_id").alias("workout_id"), F.col("user_id").alias("athlete_id"), F.col("ts").alias("start_time_utc"))
    return lookup.preferred_as_of(w, physiometrics(spark, sf_dir), "athlete_id", "start_time_utc", ["manual", "chatgpt"], ["ftp_watts", "lthr_bpm"])


@query(f"""WITH {PHYSIOMETRICS_SQL}, w AS (SELECT event_id AS workout_id, user_id AS athlete_id, ts AS start_time_utc FROM events),
p AS (SELECT athlete_id, updated_at_utc, weight_kg FROM physiometrics WHERE weight_kg IS NOT NULL)
SELECT workout_id, w.athlete_id, start_time_utc, weight_kg FROM w ASOF LEFT JOIN p ON w.athlete_id = p.athlete_id AND w.start_time_utc >= p.updated_at_utc""")
def j2_snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").select(F.col("event_id").alias("workout_id"), F.col("user_id").alias("athlete_id"), F.col("ts").alias("start_time_utc"))
    return lookup.as_of(w, physiometrics(spark, sf_dir).where("weight_kg is not null"), "athlete_id", "start_time_utc", "updated_at_utc", ["row_key"], ["weight_kg"])


_RUNNING = ", ".join(f"last_value({m} IGNORE NULLS) OVER w AS {m}" for m in METRICS)


@query(f"""WITH {PHYSIOMETRICS_SQL}, l AS (SELECT athlete_id, effective_date AS day, row_number() OVER (PARTITION BY athlete_id, effective_date ORDER BY updated_at_utc DESC, row_key DESC) AS rn, {_RUNNING}
FROM physiometrics WINDOW w AS (PARTITION BY athlete_id ORDER BY effective_date, updated_at_utc, row_key ROWS UNBOUNDED PRECEDING)) SELECT * EXCLUDE rn FROM l WHERE rn = 1""")
def j3_metrics_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = physiometrics(spark, sf_dir)
    days = p.select("athlete_id", F.col("effective_date").alias("day")).distinct()
    return lookup.metrics_as_of(days, p, "athlete_id", "day", METRICS)


@query(f"""WITH {PHYSIOMETRICS_SQL}, b AS (SELECT athlete_id, arg_max(lthr_bpm, (effective_date, updated_at_utc, row_key)) AS best FROM physiometrics WHERE lthr_bpm IS NOT NULL GROUP BY athlete_id)
SELECT p.athlete_id, row_key, coalesce(best, lthr_bpm) AS lthr_bpm FROM physiometrics p LEFT JOIN b ON p.athlete_id = b.athlete_id""")
def j4_baseline_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = physiometrics(spark, sf_dir)
    best = resolve.by_recency(p, ["athlete_id"], ["lthr_bpm"], RECENT).select("athlete_id", F.col("value").alias("best"))
    return p.join(best, "athlete_id", "left").select("athlete_id", "row_key", F.coalesce("best", "lthr_bpm").alias("lthr_bpm"))


@query("""WITH l AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS t FROM events WHERE event_id % 2 = 0), r AS (SELECT event_type, epoch_us(ts) / 1e6 AS rt, value FROM events WHERE event_id % 2 = 1),
c AS (SELECT event_id, l.event_type, t, arg_min(value, (abs(rt - t), rt)) AS value FROM l LEFT JOIN r ON l.event_type = r.event_type AND abs(rt - t) <= 60 GROUP BY ALL)
SELECT event_id, event_type, value FROM c""")
def j7_nearest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros("ts") / 1e6)
    left, right = e.where("event_id % 2 = 0").select("event_id", "event_type", "t"), e.where("event_id % 2 = 1").select("event_type", F.col("t").alias("rt"), "value")
    return lookup.nearest(left, right, "event_type", "t", "rt", 60.0, ["value"]).select("event_id", "event_type", "value")


@query("""SELECT a.user_id, least(a.event_id, b.event_id) AS key_a, greatest(a.event_id, b.event_id) AS key_b FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) <= 600 AND coalesce(abs(a.value - b.value) <= 10, true)""")
def j8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.near_duplicate_pairs(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 600, 10.0)


@query("""WITH e AS (SELECT user_id AS athlete_id, min(ts)::DATE AS a, max(ts)::DATE AS b FROM events GROUP BY user_id), s AS (SELECT athlete_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM e)
SELECT athlete_id, day FROM s ANTI JOIN (SELECT user_id AS athlete_id, ts::DATE AS day FROM events) USING (athlete_id, day)""")
def j9_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = table(spark, sf_dir, "events").select(F.col("user_id").alias("athlete_id"), F.to_date("ts").alias("day"))
    expected = present.groupBy("athlete_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return lookup.missing_days(expected, present, "athlete_id", "day")


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_linestatus = 'F') USING (o_orderkey)")
def j10_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "ingested").otherwise("fetched").alias("status"))
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookup.unprocessed(items, ledger, "o_orderkey", ["ingested", "skipped", "skipped_duplicate", "filtered"])


@query("""WITH i AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS ctag, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS sha, o_orderkey % 11 AS etag FROM orders),
l AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 10 END AS ctag, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 14 END AS sha, o_orderkey % 22 AS etag FROM orders WHERE o_orderkey % 5 <> 1)
SELECT i.item, coalesce(i.ctag = l.ctag, i.sha = l.sha, i.etag = l.etag, false) AS unchanged FROM i LEFT JOIN l ON i.item = l.item""")
def j13_change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    items = o.select(k.alias("item"), F.when(k % 2 == 0, k % 5).alias("ctag"), F.when(k % 3 == 0, k % 7).alias("sha"), (k % 11).alias("etag"))
    ledger = o.where(k % 5 != 1).select(k.alias("item"), F.when(k % 4 == 0, k % 10).alias("ctag"), F.when(k % 3 == 0, k % 14).alias("sha"), (k % 22).alias("etag"))
    return lookup.changed(items, ledger, "item", ["ctag", "sha", "etag"]).select("item", "unchanged")


@query("""WITH l AS (SELECT l_orderkey AS workout_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position, l_linenumber - 1 AS message_index, l_quantity AS minutes FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY workout_id ORDER BY position) - 1 AS pos FROM l WHERE true),
r AS (SELECT *, row_number() OVER (PARTITION BY workout_id ORDER BY message_index <> 2, position) AS rn FROM p WHERE message_index = 2 OR pos = 2)
SELECT workout_id, message_index, minutes FROM r WHERE rn = 1""")
def j14_lap_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    laps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("workout_id"), F.row_number().over(order).alias("position"), (F.col("l_linenumber") - 1).alias("message_index"), F.col("l_quantity").alias("minutes"))
    return lookup.lap(laps, "workout_id", 2).select("workout_id", "message_index", "minutes")


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def j17_code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return lookup.code_names(table(spark, sf_dir, "customer"), codes, "c_nationkey", "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'Race' WHEN o_orderpriority = '1-URGENT' THEN 'Run' WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'Trail Run'
  WHEN o_orderpriority = '5-LOW' THEN 'Walk' ELSE 'Other' END AS activity_type FROM orders""")
def j18_activity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([("1-URGENT", "O", "Race"), ("1-URGENT", None, "Run"), ("2-HIGH", "F", "Trail Run"), ("5-LOW", None, "Walk")], "sport string, sub_sport string, activity_type string")
    return lookup.typed_by(table(spark, sf_dir, "orders"), types, "o_orderpriority", "o_orderstatus").select("o_orderkey", "activity_type")


_UNPIVOT = " UNION ALL ".join(f"SELECT athlete_id, '{m}' AS metric, {m} AS value, data_source, effective_date, updated_at_utc, row_key FROM physiometrics WHERE {m} IS NOT NULL" for m in METRICS)
_RANK = "CASE metric " + " ".join(f"WHEN '{m}' THEN list_position({o}, data_source)" for m, o in ORDER.items()) + f" ELSE list_position({RECENT}, data_source) END"


@query(f"""WITH {PHYSIOMETRICS_SQL}, l AS ({_UNPIVOT}), r AS (SELECT *, {_RANK} AS rank FROM l),
b AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, metric ORDER BY rank, effective_date DESC, updated_at_utc DESC, row_key DESC) AS rn FROM r WHERE rank > 0)
SELECT athlete_id, metric, value, data_source, effective_date FROM b WHERE rn = 1""")
def r1_by_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.by_precedence(physiometrics(spark, sf_dir), ["athlete_id"], METRICS, ORDER, RECENT)


_RECENT_SQL = f"""l AS ({_UNPIVOT}),
b AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, metric ORDER BY effective_date DESC, updated_at_utc DESC, coalesce(list_position({RECENT}, data_source), 99), row_key DESC) AS rn FROM l)"""


@query(f"WITH {PHYSIOMETRICS_SQL}, {_RECENT_SQL} SELECT athlete_id, metric, value, data_source, effective_date FROM b WHERE rn = 1")
def r2_by_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.by_recency(physiometrics(spark, sf_dir), ["athlete_id"], METRICS, RECENT)


@query(f"""WITH {PHYSIOMETRICS_SQL}, l AS ({_UNPIVOT}), r AS (SELECT *, {_RANK} AS rank FROM l),
b AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, effective_date, metric ORDER BY rank, updated_at_utc DESC, row_key DESC) AS rn FROM r WHERE rank > 0),
v AS (SELECT athlete_id, effective_date, {', '.join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in ORDER)} FROM b WHERE rn = 1 GROUP BY ALL),
s AS (SELECT athlete_id, effective_date, array_to_string(list_sort(list(DISTINCT data_source)), ',') AS data_sources FROM l WHERE metric IN ('ftp_watts', 'lthr_bpm', 'weight_kg', 'hrv_ln_rmssd') GROUP BY ALL),
f AS (SELECT athlete_id, effective_date, arg_min(hrv_ln_rmssd, (updated_at_utc, row_key)) FILTER (hrv_ln_rmssd IS NOT NULL) AS hrv_ln_rmssd FROM physiometrics GROUP BY ALL)
SELECT s.athlete_id, s.effective_date, data_sources, ftp_watts, lthr_bpm, weight_kg, hrv_ln_rmssd FROM s LEFT JOIN v USING (athlete_id, effective_date) LEFT JOIN f USING (athlete_id, effective_date)""")
def r4_consolidated_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.consolidate_days(physiometrics(spark, sf_dir), list(ORDER), ORDER, RECENT, ["hrv_ln_rmssd"])


@query(f"""WITH {PHYSIOMETRICS_SQL}, {_RECENT_SQL}, v AS (SELECT athlete_id, {', '.join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in METRICS)} FROM b WHERE rn = 1 GROUP BY athlete_id)
SELECT p.athlete_id, max(p.effective_date) AS effective_date, max(p.effective_date) FILTER (p.data_source = 'garmin') AS garmin_date, {', '.join(f'any_value({m}) AS {m}' for m in METRICS)}
FROM (SELECT athlete_id, effective_date, data_source FROM physiometrics) p LEFT JOIN v USING (athlete_id) GROUP BY p.athlete_id""")
def r6_current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = resolve.current(physiometrics(spark, sf_dir), "athlete_id", METRICS, RECENT)
    return now.select("athlete_id", "effective_date", F.try_element_at("source_dates", F.lit("garmin")).alias("garmin_date"), *METRICS)


@query(f"WITH {PHYSIOMETRICS_SQL} SELECT athlete_id, effective_date, data_source, row_key, coalesce(ftp_watts, lthr_bpm) AS threshold, weight_kg AS weight FROM physiometrics WHERE effective_date BETWEEN '2024-01-05' AND '2024-01-20'")
def r7_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = {"threshold": ["power_ftp", "ftp_watts", "lthr_bpm"], "weight": ["weight_kg"]}
    return resolve.history(physiometrics(spark, sf_dir), "athlete_id", "2024-01-05", "2024-01-20", aliases)


@query(f"WITH {WORKOUTS_SQL} SELECT athlete_id, start_time_utc::DATE AS day, sum(tss) AS tss FROM workouts WHERE tss IS NOT NULL GROUP BY ALL")
def a16_daily_tss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.daily_tss(workouts(spark, sf_dir))


@query(f"WITH {WORKOUTS_SQL} SELECT athlete_id, start_time_utc::DATE AS day, sum(coalesce(tss, CASE WHEN workout_id % 8 = 0 THEN 50 END)) AS tss FROM workouts WHERE tss IS NOT NULL OR workout_id % 8 = 0 GROUP BY ALL")
def r12_computed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workout without a load in the table takes its computed one, if it has one."""
    w = workouts(spark, sf_dir)
    return state.daily_tss(w, w.where("workout_id % 8 = 0").select("workout_id", F.lit(50.0).alias("tss")))


@query(f"""WITH {WORKOUTS_SQL} SELECT athlete_id, coalesce(sum(tss) FILTER (start_time_utc::DATE >= DATE '{LAST}' - 7), 0.0) AS tss_7d, sum(tss) AS tss_28d FROM workouts
WHERE tss IS NOT NULL AND start_time_utc::DATE BETWEEN DATE '{LAST}' - 28 AND DATE '{LAST}' GROUP BY athlete_id""")
def a17_rolling_tss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.rolling_at(workouts(spark, sf_dir), LAST)


_ROLLING = f"""daily AS (SELECT athlete_id, start_time_utc::DATE AS day, sum(tss) AS tss FROM workouts WHERE tss IS NOT NULL AND start_time_utc::DATE BETWEEN DATE '{FIRST}' - 28 AND DATE '{LAST}' GROUP BY ALL),
spine AS (SELECT athlete_id, unnest(generate_series(DATE '{FIRST}' - 28, DATE '{LAST}', INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT athlete_id FROM daily)),
x AS (SELECT spine.athlete_id, spine.day, coalesce(tss, 0.0) AS tss FROM spine LEFT JOIN daily USING (athlete_id, day)),
rolled AS (SELECT *, sum(tss) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS tss_7d, sum(tss) OVER (w ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) AS tss_28d FROM x WINDOW w AS (PARTITION BY athlete_id ORDER BY day)),
loads AS (SELECT *, tss_7d / 7 AS cts_7d, tss_28d / 28 AS cts_28d, tss_7d / 7 AS ats, CASE WHEN tss_28d <> 0 THEN (tss_7d / 7) / (tss_28d / 28) END AS fatigue FROM rolled WHERE day >= DATE '{FIRST}')"""


@query(f"WITH {WORKOUTS_SQL}, {_ROLLING} SELECT athlete_id, day, tss, tss_7d, tss_28d, round(cts_7d, 6) AS cts_7d, round(cts_28d, 6) AS cts_28d, round(fatigue, 6) AS fatigue FROM loads")
def w9_rolling_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = state.load_components(state.rolling(workouts(spark, sf_dir), FIRST, LAST))
    return loads.select("athlete_id", "day", "tss", "tss_7d", "tss_28d", *[F.round(c, 6).alias(c) for c in ("cts_7d", "cts_28d", "fatigue")])


#: Body metrics dated into the range of the workouts, so that states have some.
_SHIFTED = f"shifted AS (SELECT * REPLACE ((DATE '{FIRST}' + (effective_date - DATE '2024-01-01')::INTEGER) AS effective_date) FROM physiometrics)"


_STATE_SQL = f"""WITH {WORKOUTS_SQL}, {PHYSIOMETRICS_SQL}, {_SHIFTED}, {_ROLLING},
s AS (SELECT athlete_id, day, round(fatigue, 6) AS fatigue, fatigue AS f, (SELECT arg_max(hrv_ln_rmssd, (effective_date, updated_at_utc, row_key)) FROM shifted p WHERE p.athlete_id = loads.athlete_id AND p.effective_date <= loads.day AND hrv_ln_rmssd IS NOT NULL) AS hrv_ln_rmssd FROM loads)
SELECT athlete_id, day, fatigue, hrv_ln_rmssd, round(CASE WHEN hrv_ln_rmssd IS NOT NULL AND f > 0 THEN (least(greatest((hrv_ln_rmssd - 2.5) / 2 * 100, 0), 100) + least(greatest((2 - f) / 1.5 * 100, 0), 100)) / 2 END, 2) AS readiness FROM s"""


#: The first of the ninety days that end with LAST.
_CLAMPED = (date.fromisoformat(LAST) - timedelta(days=89)).isoformat()


def _training_state(w: DataFrame, p: DataFrame) -> DataFrame:
    shift = F.date_add(F.lit(FIRST).cast("date"), F.datediff("effective_date", F.lit("2024-01-01").cast("date")))
    return state.training_state(w, p.withColumn("effective_date", shift), FIRST, LAST).select("athlete_id", "day", F.round("fatigue", 6).alias("fatigue"), "hrv_ln_rmssd", "readiness")


@query(_STATE_SQL)
def r11_training_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training_state(workouts(spark, sf_dir), physiometrics(spark, sf_dir))


@query(f"SELECT * FROM ({_STATE_SQL}) WHERE athlete_id = 10")
def r11_state_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history that one athlete asks for."""
    return _training_state(workouts(spark, sf_dir, 10), physiometrics(spark, sf_dir).where("athlete_id = 10"))


@query(f"SELECT athlete_id, day, fatigue, readiness FROM ({_STATE_SQL.replace(FIRST, _CLAMPED)})")
def p22_state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of a thousand days asked for: ninety are given."""
    shift = F.date_add(F.lit(_CLAMPED).cast("date"), F.datediff("effective_date", F.lit("2024-01-01").cast("date")))
    p = physiometrics(spark, sf_dir).withColumn("effective_date", shift)
    return state.history(workouts(spark, sf_dir), p, LAST, 1000).select("athlete_id", "day", F.round("fatigue", 6).alias("fatigue"), "readiness")


@query(f"""WITH {WORKOUTS_SQL}, n AS (SELECT athlete_id, max(start_time_utc) AS now_utc FROM workouts GROUP BY athlete_id),
m AS (SELECT *, date_trunc('week', now_utc AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}')::TIMESTAMP - INTERVAL 7 DAY AS monday FROM n)
SELECT athlete_id, (monday AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS week_from, ((monday + INTERVAL 7 DAY - INTERVAL 1 SECOND) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS week_to FROM m""")
def w14_local_week_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = workouts(spark, sf_dir).groupBy("athlete_id").agg(F.max("start_time_utc").alias("now_utc"))
    first, last = rollups.local_week_bounds(F.col("now_utc"), ZONE)
    return now.select("athlete_id", first.alias("week_from"), last.alias("week_to"))


@query(f"""WITH {PHYSIOMETRICS_SQL} SELECT row_key, array_to_string(list_sort(list_distinct(list_filter(list_transform([data_source] || string_split({SOURCES[0]!r} || ', ' || upper(data_source), ','), lambda x: lower(trim(x))), lambda x: x <> ''))), ',') AS sources FROM physiometrics""")
def u4_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv = F.concat(F.lit(f"{SOURCES[0]}, "), F.upper("data_source"))
    return physiometrics(spark, sf_dir).select("row_key", F.array_join(resolve.sources_of(F.col("data_source"), csv), ",").alias("sources"))
