"""Queries of scalar functions, data quality, keyed tables and streams over the test tables, with SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions import dates, numbers, payloads, text
from tempora.operators import lookup, quality, selection, sequence
from tempora.sources import device, files, ledger
from tempora.sources.views import WORKOUTS_SQL, table, workouts
from tempora.streaming import items, landing, listing, upkeep

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


_shared = files.shared


# --- dates -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, date_trunc('week', ts)::TIMESTAMP AS week_start, isoyear(ts) || '-' || lpad(week(ts)::VARCHAR, 2, '0') AS week_key FROM events")
def f2_week_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.operators.rollups import week_key

    return table(spark, sf_dir, "events").select("event_id", F.date_trunc("week", "ts").alias("week_start"), week_key(F.col("ts")).alias("week_key"))


@query("SELECT event_id, epoch(CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '0001-01-01' ELSE date_trunc('second', ts) END)::BIGINT AS at_sec FROM events")
def f1_iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(dates.iso_or_earliest(raw)).alias("at_sec"))


@query("""WITH m AS (SELECT event_id, (event_id * 15) % 1680 - 840 AS m FROM events),
t AS (SELECT event_id, m, 'UTC' || CASE WHEN m >= 0 THEN '+' ELSE '-' END || lpad((abs(m) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(m) % 60)::VARCHAR, 2, '0') AS label FROM m)
SELECT event_id, label, m::INTEGER AS minutes FROM t""")
def f4_offset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = dates.offset_text(F.col("event_id") * 15 % 1680 - 840)
    return table(spark, sf_dir, "events").select("event_id", label.alias("label"), dates.offset_minutes(label).alias("minutes"))


@query("""WITH m AS (SELECT event_id, (event_id % 1800 - 900)::DOUBLE + (event_id % 5) / 10 AS raw FROM events), r AS (SELECT *, round_even(raw / 15, 0) * 15 AS q FROM m)
SELECT event_id, CASE WHEN abs(raw - q) <= 3 AND abs(q) <= 840 THEN q::INTEGER END AS offset_min FROM r""")
def f5_inferred_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seconds = ((F.col("event_id") % 1800 - 900) * 60 + F.col("event_id") % 5 * 6).cast("int")
    return e.select("event_id", dates.inferred_offset(F.timestamp_add("SECOND", seconds, F.col("ts")), F.col("ts")).alias("offset_min"))


@query("SELECT event_id, CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'Afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS daypart FROM events")
def f7_dayparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.daypart(F.col("ts")).alias("daypart"))


@query("SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [o_orderdate::DATE] ELSE generate_series(o_orderdate::DATE - (o_orderkey % 4)::INTEGER, o_orderdate::DATE - 1, INTERVAL 1 DAY)::DATE[] END) AS day FROM orders")
def f8_sync_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dates.sync_window(F.to_date("o_orderdate"), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(days).alias("day"))


@query("SELECT o_custkey, unnest(list_transform(generate_series(date_trunc('month', min(o_orderdate))::TIMESTAMP, date_trunc('month', max(o_orderdate))::TIMESTAMP, INTERVAL 1 MONTH), lambda d: strftime(d, '%Y-%m'))) AS month FROM orders GROUP BY o_custkey")
def s2_month_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return ends.select("o_custkey", F.explode(dates.month_keys(F.col("a"), F.col("b"))).alias("month"))


# --- text ------------------------------------------------------------------------------------------------------------

_NAME_SQL = "['Zwift Race', 'Morning Ride', 'indoor-cycling hour', 'Trail Run', '', 'Peloton', 'outdoor walking', 'Yoga'][event_id % 8 + 1]"
_NAMES = ["Zwift Race", "Morning Ride", "indoor-cycling hour", "Trail Run", "", "Peloton", "outdoor walking", "Yoga"]


def _pick(values: list, by: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


@query(f"""WITH n AS (SELECT event_id, {_NAME_SQL} AS name FROM events)
SELECT event_id, CASE WHEN name <> '' THEN regexp_matches(lower(name), 'zwift|peloton|indoor|trainer|stationary') END AS indoor,
  CASE WHEN contains(lower(replace(name, '-', ' ')), 'indoor cycling') THEN 'Indoor Cycle' WHEN contains(lower(name), 'outdoor walking') THEN 'Outdoor Walk' WHEN contains(lower(name), 'trail run') THEN 'Trail Run' WHEN contains(lower(name), 'yoga') THEN 'Yoga' END AS activity FROM n""")
def f10_indoor_and_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _pick(_NAMES, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", text.is_indoor(name).alias("indoor"), text.activity_from_name(name).alias("activity"))


@query(f"""WITH n AS (SELECT event_id, ts, nullif({_NAME_SQL}, '') AS name, CASE WHEN event_id % 3 = 0 THEN 'Other' ELSE 'Outdoor Run' END AS act, CASE WHEN event_id % 5 = 0 THEN 'tempo' END AS src FROM events)
SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN name END, src, CASE WHEN act <> 'Other' THEN CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'Afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END || ' ' || act END,
  'running-road-' || strftime(ts, '%Y-%m-%d %H:%M')) AS workout_name FROM n""")
def f9_workout_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    message, source = F.when(k % 7 == 0, _pick(_NAMES, k)), F.when(k % 5 == 0, "tempo")
    activity = F.when(k % 3 == 0, "Other").otherwise("Outdoor Run")
    name = text.workout_name(message, source, F.lit(None).cast("string"), F.col("ts"), activity, F.lit("running"), F.lit("road"))
    return table(spark, sf_dir, "events").select("event_id", name.alias("workout_name"))


_PARTS = ["Functional-Strength-Training-Watch7,1", "Indoor Cycling-My Watch", "indoor-cycle-iPhone", "Nothing-Watch", "Trail Run-Ultra-2", "Yoga-"]


@query(f"""WITH n AS (SELECT event_id, ts, event_id % 6 AS k, {_PARTS}[event_id % 6 + 1] AS part FROM events)
SELECT event_id, CASE WHEN k IN (0, 1, 2, 4) THEN strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN k IN (0, 1, 2, 4) THEN strftime(ts, '%H%M%S') END AS time,
  ['Functional Strength Training', 'Indoor Cycle', 'Indoor Cycle', NULL, 'Trail Run', NULL][k + 1] AS activity, ['Watch7,1', 'My Watch', 'iPhone', NULL, 'Ultra-2', NULL][k + 1] AS device FROM n""")
def f11_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.date_format("ts", "yyyy-MM-dd-HHmmss"), F.lit("-"), _pick(_PARTS, F.col("event_id")), F.when(F.col("event_id") % 2 == 0, ".fit").otherwise(".fit.gz"))
    return table(spark, sf_dir, "events").withColumn("p", text.file_parts(name)).select("event_id", "p.date", "p.time", "p.activity", "p.device")


_DEVICES = [("iPhone", "x"), ("Watch 7,12", "Watch7,12"), ("Edge", "iPhone17,1"), ("Edge", "1050"), ("my iphone watch", "y")]


@query("SELECT event_id, ['healthkit_synced', 'apple_watch', 'healthkit_synced', 'unknown', 'healthkit_synced'][event_id % 5 + 1] AS device_source FROM events")
def f12_device_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", text.device_source(_pick([d[0] for d in _DEVICES], k), _pick([d[1] for d in _DEVICES], k)).alias("device_source"))


@query("SELECT p_partkey, translate(p_name || '/#?', '/\\#?', '____') AS safe, rtrim(translate(to_base64(encode(p_name)), '+/', '-_'), '=') AS row_key, '''' || replace(p_name || '''s', '''', '''''') || '''' AS quoted FROM part")
def f14_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_key(F.concat(name, F.lit("/#?"))).alias("safe"), text.base64url(name).alias("row_key"), text.quoted(F.concat(name, F.lit("'s"))).alias("quoted"))


@query(f"""WITH {WORKOUTS_SQL} SELECT workout_id, CASE WHEN workout_id % 3 = 0 THEN 'cycling' WHEN workout_id % 3 = 1 THEN 'running' ELSE 'generic' END AS sport,
  trunc(duration_sec / 60 * CASE WHEN workout_id % 3 = 1 THEN 15 ELSE 10 END)::INTEGER AS calories FROM workouts""")
def f15_sport_and_calories(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = _pick(["indoor_cycling", "treadmill", "other"], F.col("workout_id"))
    rows = workouts(spark, sf_dir).withColumn("s", text.sport_from_sub(F.lit("generic"), sub))
    return rows.select("workout_id", F.col("s").alias("sport"), text.estimated_calories(F.col("s"), F.col("duration_sec")).alias("calories"))


@query("SELECT o_orderkey, sha1(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '#' || lower(trim(o_orderpriority))) AS workout_id, sha256(o_orderpriority) AS content_id FROM orders")
def f16_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.workout_id(start, F.col("o_orderpriority")).alias("workout_id"), files.content_id(F.col("o_orderpriority")).alias("content_id"))


# --- numbers ---------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS number, round(CASE WHEN event_id % 2 = 0 THEN value / 3.6::DOUBLE ELSE value END, 6) AS mps,
  CASE WHEN event_id % 3 = 0 THEN value * 1000 ELSE value END AS metres, (event_id & 127) AS balance, round(value * 10.0::DOUBLE ** (event_id % 5 - 3), 9) AS scaled,
  round(CASE WHEN event_id % 5 < 3 THEN value / 10.0::DOUBLE ** (3 - event_id % 5) ELSE value END, 9) AS down_scaled FROM events""")
def f17_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    raw = F.when(k % 4 == 0, "n/a").otherwise(v.cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", numbers.number(raw).alias("number"), F.round(numbers.speed_mps(v, F.when(k % 2 == 0, "km/h").otherwise("m/s")), 6).alias("mps"),
        numbers.metres(v, F.when(k % 3 == 0, "km").otherwise("m")).alias("metres"), numbers.balance(k).alias("balance"),
        F.round(numbers.scaled(v, k % 5 - 3), 9).alias("scaled"), F.round(numbers.scaled(v, k % 5 - 3, True), 9).alias("down_scaled"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN round_even(value, 0) ELSE round_even(event_id % 7 * 60.0::DOUBLE / 4, 0) END::INTEGER AS minutes,
  coalesce(CASE WHEN event_id % 4 <> 0 THEN (150 + event_id % 20)::DOUBLE END, floor((180 + event_id % 10) * 0.85::DOUBLE)) AS lthr FROM events""")
def f21_minutes_and_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", numbers.minutes(F.when(k % 3 != 0, F.col("value")), k % 7 / 4).alias("minutes"), numbers.threshold_hr(F.when(k % 4 != 0, 150 + k % 20), 180 + k % 10).alias("lthr"))


@query(f"""WITH {WORKOUTS_SQL}, s AS (SELECT workout_id, nullif(hr_z1_sec, 0) AS a, nullif(hr_z2_sec, 0) AS b, nullif(hr_z3_sec, 0) AS c FROM workouts), t AS (SELECT *, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))::DOUBLE AS t FROM s)
SELECT workout_id, round(CASE WHEN t > 0 THEN coalesce(a, 0) / t * 100 END, 4) AS low_pct, round(CASE WHEN t > 0 THEN coalesce(b, 0) / t * 100 END, 4) AS high_pct, round(CASE WHEN t > 0 THEN coalesce(c, 0) / t * 100 END, 4) AS anaerobic_pct FROM t""")
def a27_load_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    rows = workouts(spark, sf_dir).withColumn("f", numbers.load_focus(some("hr_z1_sec"), some("hr_z2_sec"), some("hr_z3_sec")))
    return rows.select("workout_id", *[F.round(f"f.{c}", 4).alias(c) for c in ("low_pct", "high_pct", "anaerobic_pct")])


# --- payloads --------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (props->>'$.k')::DOUBLE WHEN event_id % 3 = 1 THEN value END AS lthr_bpm, CASE WHEN event_id % 3 = 0 THEN 'lactate_threshold_endpoint' WHEN event_id % 3 = 1 THEN 'wellness_endpoint' END AS provenance FROM events""")
def f25_threshold_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    first = F.when(k % 3 == 0, F.format_string('{"speed_and_heart_rate": {"heartRate": %s}}', F.get_json_object("props", "$.k")))
    last = F.when(k % 3 == 1, F.format_string('{"heartRateMetrics": {"lactateThresholdHeartRate": %s}}', F.col("value").cast("string")))
    empty = payloads.parsed(F.lit("{}"))
    found = payloads.threshold_hr({"lactate_threshold": payloads.parsed(first), "training_status": empty, "recovery_metrics": empty, "wellness": payloads.parsed(last)})
    return table(spark, sf_dir, "events").withColumn("f", found).select("event_id", "f.lthr_bpm", "f.provenance")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 100)::DOUBLE WHEN 1 THEN (event_id % 50)::DOUBLE ELSE (event_id % 20)::DOUBLE END AS readiness FROM events")
def f26_readiness_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    entry = lambda value, context: payloads.parsed(F.format_string(f'{{"inputContext": "{context}", "score": %d}}', value))
    morning = F.when(k % 3 == 0, payloads.parsed(F.format_string('{"readiness": {"score": %d}}', k % 100)))
    entries = F.when(k % 3 == 1, F.array(entry(k % 9, "OTHER"), entry(k % 50, "AFTER_WAKEUP_RESET"))).otherwise(F.array(entry(k % 20, "OTHER")))
    return table(spark, sf_dir, "events").select("event_id", payloads.readiness(morning, entries).alias("readiness"))


@query("""SELECT event_id, (props->>'$.k')::DOUBLE AS k, CASE WHEN event_id % 2 = 0 THEN 'activityId,typeKey' ELSE 'activityId' END AS missing FROM events""")
def f27_payload_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.regexp_replace("props", r"\}$", ', "typeKey": "run"}'))
    v = payloads.parsed(raw)
    return table(spark, sf_dir, "events").select("event_id", payloads.first_path(v, ["$.missing.k", "$.k"]).alias("k"), F.array_join(payloads.missing_fields(v, ["activityId", "typeKey", "k"]), ",").alias("missing"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS total_timer_time, l_extendedprice AS total_distance, l_tax AS tax FROM lineitem")
def f28_lap_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).alias("value"), F.lit("u").alias("units"))
    fields = F.array(field("total_timer_time", "l_quantity"), field("total_distance", "l_extendedprice"), field("tax", "l_tax"))
    rows = table(spark, sf_dir, "lineitem").withColumn("p", payloads.promoted(fields, ["total_timer_time", "total_distance"]))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.total_timer_time", "p.total_distance", F.try_element_at("p.extra_fields", F.lit("tax")).alias("tax"))


@query("""SELECT l_orderkey AS measure_group, last(l_quantity ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) FILTER (l_linenumber = 1) AS weight_kg,
  last(l_quantity ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) FILTER (l_linenumber = 6) AS body_fat_pct FROM lineitem GROUP BY l_orderkey""")
def f31_measure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("measure_group")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_linenumber", "l_quantity"))).alias("m"))
    found = payloads.measures(F.col("m.l_linenumber"), {1: "weight_kg", 6: "body_fat_pct"}, F.col("m.l_quantity"))
    return lists.select("measure_group", found.alias("f")).select("measure_group", "f.weight_kg", "f.body_fat_pct")


@query("SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ',\"status\":\"' || o_orderstatus || '\"' ELSE '' END || '}' AS body FROM orders")
def k8_response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")))
    return rows.select("o_orderkey", payloads.response(["o_orderkey", "status"]).alias("body"))


# --- data quality ----------------------------------------------------------------------------------------------------

_SPEED = "distance_m / 1000 / (nullif(duration_sec, 0) / 3600)"


@query(f"""WITH {WORKOUTS_SQL}, l AS (SELECT workout_id, unnest(CASE WHEN distance_m IS NULL THEN ['missing_distance'] ELSE list_filter([CASE WHEN distance_m < 0 THEN 'negative_distance' END, CASE WHEN distance_m > 300000 THEN 'distance_over_300km' END,
  CASE WHEN {_SPEED} > 90 THEN 'speed_over_90kmh' END, CASE WHEN {_SPEED} < 2 AND distance_m > 5000 THEN 'speed_under_2kmh_with_distance' END], lambda x: x IS NOT NULL) END) AS anomaly FROM workouts)
SELECT anomaly, count(*) AS workouts, min(workout_id) AS first_workout_id FROM l GROUP BY anomaly""")
def p21_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.anomaly_buckets(workouts(spark, sf_dir))


@query(f"WITH {WORKOUTS_SQL} SELECT workout_id, (hr_avg_bpm IS NULL OR hr_avg_bpm BETWEEN 105 AND 170) AND (tss IS NULL OR tss BETWEEN 0 AND 120) AS valid, coalesce(distance_m, elevation_gain_m) IS NOT NULL AS has_metric FROM workouts")
def p15_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workouts(spark, sf_dir)
    return w.select("workout_id", quality.within(w, {"hr_avg_bpm": (105, 170), "tss": (0, 120)}).alias("valid"), quality.any_value_in(["distance_m", "elevation_gain_m"]).alias("has_metric"))


@query("""WITH c AS (SELECT o_orderkey, unnest([{'s': 'session', 'v': o_totalprice * (0.9 + (o_orderkey % 20)::DOUBLE / 100)}, {'s': 'records', 'v': o_totalprice * (1 + (o_orderkey % 8)::DOUBLE / 100)}]) AS p, o_totalprice AS v FROM orders)
SELECT o_orderkey, p.s AS source, round(p.v / v, 6) AS ratio FROM c WHERE p.v / v NOT BETWEEN 0.95 AND 1.05""")
def j15_distance_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (v * (0.9 + (k % 20).cast("double") / 100)).alias("session"), (v * (1 + (k % 8).cast("double") / 100)).alias("records"))
    return quality.mismatches(o, "o_orderkey", "o_totalprice", ["session", "records"]).select("o_orderkey", "source", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {WORKOUTS_SQL}, w AS (SELECT athlete_id, date_trunc('week', start_time_utc)::TIMESTAMP AS week_start, round(sum(distance_m) / 1000, 2) AS km, min(workout_id) AS m FROM workouts GROUP BY ALL),
p AS (SELECT athlete_id, week_start, km + CASE WHEN m % 5 = 0 THEN 1 ELSE 0 END AS persisted FROM w WHERE m % 7 <> 0), x AS (SELECT athlete_id, week_start, km AS expected FROM w WHERE m % 6 <> 0)
SELECT athlete_id, week_start, round(persisted, 2) AS persisted, round(expected, 2) AS expected, CASE WHEN persisted IS NULL THEN 'missing_persisted' WHEN expected IS NULL THEN 'missing_expected' WHEN abs(persisted - expected) <= 0.01 THEN 'match' ELSE 'differs' END AS status
FROM p FULL JOIN x USING (athlete_id, week_start)""")
def j16_weekly_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.operators.rollups import week_start

    w = workouts(spark, sf_dir).groupBy("athlete_id", week_start(F.col("start_time_utc")).alias("week_start")).agg(F.round(F.sum("distance_m") / 1000, 2).alias("km"), F.min("workout_id").alias("m"))
    persisted = w.where("m % 7 <> 0").withColumn("km", F.col("km") + F.when(F.col("m") % 5 == 0, 1).otherwise(0))
    out = quality.compare_totals(persisted, w.where("m % 6 <> 0"), ["athlete_id", "week_start"], "km", 0.01)
    return out.select("athlete_id", "week_start", F.round("persisted", 2).alias("persisted"), F.round("expected", 2).alias("expected"), "status")


@query(f"WITH {WORKOUTS_SQL} SELECT sport, count(*) AS non_null, min(distance_m) AS least, median(distance_m) AS median, max(distance_m) AS greatest FROM workouts WHERE distance_m IS NOT NULL GROUP BY sport")
def a31_distance_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.spread(workouts(spark, sf_dir), "sport", "distance_m")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, count(gap) + 1 AS rows, round(median(gap), 3) AS median_interval_sec, round(min(gap), 3) AS min_interval_sec, round(max(gap), 3) AS max_interval_sec FROM g WHERE gap IS NOT NULL GROUP BY user_id HAVING bool_or(abs(gap - 1) > 0.01)""")
def t3_irregular_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strict mode reports of each group that is not at one row a second."""
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return sequence.irregular(e, "user_id", "t")


@query("""SELECT 'all' AS "all", count(*) AS non_null, min(l_extendedprice) AS least, median(l_extendedprice) AS median, max(l_extendedprice) AS greatest FROM lineitem""")
def a31_spread_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group that holds every row."""
    return selection.spread(table(spark, sf_dir, "lineitem").withColumn("all", F.lit("all")), "all", "l_extendedprice")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as device files: a file_id, a session and the lines as records, whose position is what they are sorted by; the
    date, last of it, is their time."""
    k, o, line = F.col("o_orderkey"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    order = ["l_partkey", "l_suppkey", "l_extendedprice"]
    first = F.struct(*[F.lit(None).cast(line.schema[c].dataType).alias(c) for c in order]).alias("position")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("total_elapsed_time", "double"), ("total_timer_time", "double"), ("num_sessions", "int"))]
    one = o.select(k.alias("file"), F.lit("file_id").alias("name"), F.when(k % 9 == 0, "course").otherwise("activity").alias("kind"), first, F.col("o_orderdate").alias("timestamp"), *nothing)
    session = o.where("o_orderkey % 10 <> 3").select(k.alias("file"), F.lit("session").alias("name"), F.lit(None).cast("string").alias("kind"), first, F.col("o_orderdate").alias("timestamp"), F.lit(60.0).alias("total_elapsed_time"), F.lit(50.0).alias("total_timer_time"), F.lit(None).cast("int").alias("num_sessions"))
    activity = o.select(k.alias("file"), F.lit("activity").alias("name"), F.lit(None).cast("string").alias("kind"), first, F.col("o_orderdate").alias("timestamp"), F.lit(None).cast("double").alias("total_elapsed_time"), (50.0 + (k % 5)).alias("total_timer_time"), F.lit(1).alias("num_sessions"))
    record = line.select(F.col("l_orderkey").alias("file"), F.lit("record").alias("name"), F.lit(None).cast("string").alias("kind"), F.struct(*order).alias("position"), F.col("l_shipdate").alias("timestamp"), *nothing)
    return one.unionByName(session).unionByName(activity).unionByName(record)


@query("""WITH r AS (SELECT l_orderkey AS file, l_shipdate AS t, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS b FROM lineitem),
b AS (SELECT file, count(*) FILTER (t < b) AS back FROM r GROUP BY file),
v AS (SELECT o_orderkey AS file, list_filter([CASE WHEN o_orderkey % 9 = 0 THEN 'file_type' END, CASE WHEN o_orderkey % 10 = 3 THEN 'session_missing' END, CASE WHEN b.file IS NULL THEN 'record_missing' END,
  CASE WHEN back > 0 THEN 'record_order' END, CASE WHEN o_orderkey % 10 = 3 THEN 'session_count' END, CASE WHEN o_orderkey % 10 <> 3 AND o_orderkey % 5 > 2 THEN 'timer_total' END], lambda x: x IS NOT NULL) AS v FROM orders LEFT JOIN b ON o_orderkey = b.file)
SELECT file, array_to_string(v, ',') AS violations FROM v WHERE len(v) > 0""")
def p20_file_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract_violations(_messages(spark, sf_dir), "file").select("file", F.array_join("violations", ",").alias("violations"))


@query("""WITH f AS (SELECT l_returnflag AS message, l_linestatus AS field, l_shipdate AS u, l_quantity, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position, ['W', 'bpm', 'm'][l_linenumber % 3 + 1] AS units FROM lineitem)
SELECT message, field, count(*) AS count, array_to_string(list_sort(list(DISTINCT units)), ',') AS units, array_to_string(list(l_quantity::INTEGER ORDER BY position) FILTER (position <= 3), ',') AS samples FROM f GROUP BY ALL""")
def a19_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("message"), F.col("l_linestatus").alias("field"), position.alias("position"), _pick(["W", "bpm", "m"], F.col("l_linenumber")).alias("units"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    out = quality.field_summary(fields, ["message", "field"])
    return out.select("message", "field", "count", F.array_join("units", ",").alias("units"), F.array_join("samples", ",").alias("samples"))


@query("""WITH e AS (SELECT user_id, 'dev_' || CASE WHEN user_id % 2 = 0 THEN 'strain' ELSE 'torque' END AS field, CASE WHEN user_id % 3 = 0 THEN 'kN' ELSE 'Nm' END AS units, event_id % 1000 AS raw,
  row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id % 1000) AS position FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY user_id, position) AS rn FROM e)
SELECT 'record' AS message, field, count(*) AS count, array_to_string(list_sort(list(DISTINCT units)), ',') AS units, array_to_string(list(round(raw / 10 - 2, 3)::VARCHAR ORDER BY rn) FILTER (rn <= 3), ',') AS samples FROM r GROUP BY field""")
def a19_developer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a device file with a field of its own, described in the file: name, units, scale by user."""
    bytes_ = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    user, raw = F.col("user_id"), F.col("event_id") % 1000
    record = F.concat(F.lit("00"), bytes_(F.unix_seconds(F.col("ts").cast("timestamp")) - device.EPOCH, 4), bytes_(raw, 2))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(record)), "").alias("data"))
    # big-endian: message 206 with index, number, base type, name, units, scale and offset; then message 20 with a time and the field
    described = F.concat(F.lit("41000100CE07" + "000102" + "010102" + "020102" + "030807" + "080407" + "060102" + "070101" + "01" + "00" + "05" + "84"), F.when(user % 2 == 0, F.lit("73747261696E0000")).otherwise(F.lit("746F727175650000")), F.when(user % 3 == 0, F.lit("6B4E0000")).otherwise(F.lit("4E6D0000")), F.lit("0A02"))
    body = F.concat(described, F.lit("6000010014" + "01" + "FD0486" + "01" + "050200"), "data")
    size = bytes_(F.length(body) / 2, 4)
    content = F.unhex(F.concat(F.lit("0E103408"), *[F.substring(size, k, 2) for k in (7, 5, 3, 1)], F.lit("2E4649540000"), body, F.lit("0000")))
    fields = device.developer_fields(device.decode(rows.select(F.col("user_id").cast("string").alias("path"), content.alias("content"))))
    placed = fields.withColumn("position", F.struct(F.col("path").cast("long").alias("file"), "position")).withColumn("value", F.round(F.col("value").cast("double"), 3).cast("string"))
    out = quality.field_summary(placed, ["message", "field"])
    return out.select("message", "field", "count", F.array_join("units", ",").alias("units"), F.array_join("samples", ",").alias("samples"))


@query("SELECT event_type AS name, count(*) AS messages FROM events GROUP BY event_type")
def a20_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("messages"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'high' WHEN (o_orderkey % 3 = 1) <> (o_orderkey % 2 = 0) THEN 'medium' ELSE 'low' END AS confidence FROM orders")
def f32_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    sub = F.when(F.col("o_orderstatus") == "P", "virtual_activity").otherwise("road")
    found = quality.environment(k % 2 == 0, F.when(k % 3 == 1, F.lit(True)), sub, F.lit("ride"))
    return table(spark, sf_dir, "orders").select("o_orderkey", found["confidence"].alias("confidence"))


@query("""WITH i AS (SELECT o_orderkey AS item_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'archived' END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS priority FROM orders)
SELECT item_id, priority FROM i WHERE coalesce(status, 'active') <> 'archived' ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, created_at, item_id LIMIT 20""")
def o3_priority_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("created_at"), F.when(s == "O", "active").when(s == "F", "archived").alias("status"), F.when(p == "1-URGENT", "high").when(p == "5-LOW", "low").otherwise(p).alias("priority"))
    return quality.by_priority(quality.visible(items), 20).select("item_id", "priority")


@query("""WITH i AS (SELECT o_custkey AS athlete_id, ['goal', 'phase', 'preference', 'observation', 'other'][o_orderkey % 5 + 1] AS kind, o_orderkey % 5 AS k, o_orderdate AS created_at, o_orderkey AS item_id, 'note ' || o_orderkey AS content FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, kind ORDER BY created_at DESC, item_id) AS rn FROM i)
SELECT athlete_id, string_agg(content, ' | ' ORDER BY k, rn) AS instructions FROM r WHERE k < 4 AND rn <= CASE WHEN k < 2 THEN 1 ELSE 3 END GROUP BY athlete_id""")
def r15_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("athlete_id"), _pick(["goal", "phase", "preference", "observation", "other"], F.col("o_orderkey")).alias("kind"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("item_id"), F.concat(F.lit("note "), F.col("o_orderkey").cast("string")).alias("content"))
    return quality.instruction_text(items, "athlete_id")


_PAYLOAD = """p AS (SELECT event_type AS kind, CASE WHEN event_id % 3 = 0 THEN ['id', 'k', 'only_' || event_type] WHEN event_id % 3 = 1 THEN ['id', 'k'] ELSE ['id'] END AS keys FROM events),
o AS (SELECT kind, unnest(keys) AS key FROM p), n AS (SELECT kind, count(*) AS n FROM p GROUP BY kind), h AS (SELECT kind, key, count(*) AS h FROM o GROUP BY ALL),
g AS (SELECT n.kind, k.key, coalesce(h, 0) / n AS ratio FROM n CROSS JOIN (SELECT DISTINCT key FROM o) k LEFT JOIN h ON h.kind = n.kind AND h.key = k.key)"""


def _key_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    body = F.when(k % 3 == 0, F.format_string('{"id": 1, "k": 2, "only_%s": 3}', kind)).when(k % 3 == 1, '{"id": 1, "k": 2}').otherwise('{"id": 1}')
    return table(spark, sf_dir, "events").select(kind.alias("kind"), body.alias("payload"))


@query(f"WITH {_PAYLOAD}, v AS (SELECT key, round(var_samp(ratio), 6) AS ratio_variance FROM g GROUP BY key HAVING min(ratio) <> max(ratio)) SELECT * FROM v ORDER BY ratio_variance DESC, key LIMIT 20")
def x6_discriminating_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.discriminating_keys(quality.key_presence(_key_payloads(spark, sf_dir), "kind", "payload"))


@query(f"WITH {_PAYLOAD} SELECT key, min(kind) AS kind FROM g WHERE ratio > 0 GROUP BY key HAVING count(*) = 1")
def x6_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unique_keys(quality.key_presence(_key_payloads(spark, sf_dir), "kind", "payload"), "kind")


# --- keyed tables ----------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM u WHERE rn = 1""")
def k3_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return ledger.upsert(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 = 1"), ["o_custkey"], "o_orderkey")


@query("""WITH a AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, c_name, round(coalesce(b.c_acctbal, a.c_acctbal), 2) AS c_acctbal, c_mktsegment FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def k4_merge_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment")
    return ledger.merge(old, new, ["c_custkey"]).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


@query("SELECT user_id, max_by(event_id, ts) AS event_id, 321.0::DOUBLE AS value FROM events GROUP BY user_id")
def k5_change_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return ledger.change_metric(e, ["user_id"], ["ts", "event_id"], "value", F.lit(321.0)).select("user_id", "event_id", "value")


@query("SELECT event_id, CASE WHEN event_id % 4 > 1 THEN value END AS value FROM events")
def k6_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 4 == 0, float("nan")).when(F.col("event_id") % 4 == 1, float("inf")).otherwise(F.col("value"))
    return ledger.sanitized(table(spark, sf_dir, "events").select("event_id", odd.alias("value"), F.array("value").alias("nested")))


@query("SELECT o_custkey, arg_max(o_totalprice, (o_orderkey % 2, o_orderkey)) AS o_totalprice FROM orders WHERE o_orderkey % 2 = 1 OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) GROUP BY o_custkey")
def u2_later_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    first, second = (ledger.latest(o.where(f"o_orderkey % 2 = {k}"), ["o_custkey"], [F.col("o_orderkey")]) for k in (0, 1))
    return ledger.later_source_wins([first, second], ["o_custkey"]).select("o_custkey", "o_totalprice")


@query("SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def u5_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query(f"WITH {WORKOUTS_SQL} SELECT workout_id, distance_m, decoupling_pct FROM workouts WHERE distance_m IS NOT NULL AND hr_avg_bpm IS NOT NULL")
def p12_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.complete(workouts(spark, sf_dir), ["distance_m", "hr_avg_bpm"], ["workout_id", "distance_m", "decoupling_pct"])


@query("SELECT user_id, max(event_id) AS latest FROM events GROUP BY user_id")
def a24_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("event_id").cast("string").try_cast("long")).alias("latest"))


@query("SELECT DISTINCT user_id, ts::DATE AS day FROM events")
def a25_day_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN ts >= '2024-01-15' ELSE true END AS kept FROM events")
def p17_file_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    name = F.when(k == 0, "2024-02-01-ride.fit").when(k == 1, "2023-12-31-ride.fit").otherwise("ride.fit")
    kept = files.in_lookback(name, F.when(k == 2, F.col("ts")), F.lit("2024-01-15").cast("date"))
    return table(spark, sf_dir, "events").select("event_id", kept.alias("kept"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderdate <= '1998-01-01' THEN o_totalprice END AS baseline FROM orders")
def j19_effective_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", lookup.only_effective(F.col("o_totalprice"), dated, F.lit("1998-01-01").cast("date")).alias("baseline"))


_BEATS = """b AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS position, 0.5::DOUBLE + l_quantity / 100 AS rr, sum(0.5::DOUBLE + l_quantity / 100) OVER (w ROWS UNBOUNDED PRECEDING) AS done FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)),
r AS (SELECT o_orderkey, unnest(range(0, 6))::DOUBLE AS elapsed_sec FROM orders)"""


@query(f"WITH {_BEATS} SELECT r.o_orderkey AS workout_id, elapsed_sec, count(rr) AS beats, round(coalesce(sum(rr), 0), 4) AS total FROM r LEFT JOIN b ON l_orderkey = o_orderkey AND floor(done) = elapsed_sec GROUP BY ALL")
def j12_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    beats = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("workout_id"), F.lit(1).alias("message"), F.row_number().over(order).alias("position"), (0.5 + F.col("l_quantity") / 100).alias("rr"), F.lit(0.0).alias("start_sec"))
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("workout_id"), F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<double>")).alias("elapsed_sec"))
    out = lookup.beats_to_seconds(beats, records, "workout_id", "elapsed_sec")
    return out.select("workout_id", "elapsed_sec", F.size("rr_intervals_sec").cast("long").alias("beats"), F.round(F.aggregate("rr_intervals_sec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# --- files and streams -----------------------------------------------------------------------------------------------


@query("SELECT event_type AS workout_id, event_id, value AS power_watts FROM events WHERE ts BETWEEN '2024-01-10' AND '2024-01-20'")
def k1_partitioned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by month, read back for a range: one partition is scanned."""
    e = table(spark, sf_dir, "events").select(F.lit("a").alias("athlete_id"), F.col("event_type").alias("workout_id"), F.col("ts").alias("timestamp_utc"), F.col("event_id").cast("double").alias("elapsed_sec"), F.col("value").alias("power_watts"))
    path = _shared(spark, "records")
    files.write_records(e, path)
    back = files.read_records(spark, path, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return back.select("workout_id", F.col("elapsed_sec").cast("long").alias("event_id"), "power_watts")


@query("SELECT event_id, user_id, value FROM events")
def k2_gzip_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark, "payloads")
    files.write_payloads(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), path)
    return files.read_payloads(spark, path, "event_id long, user_id long, value double").where("_corrupt is null").drop("_corrupt")


@query("""WITH u AS (SELECT user_id, min(floor(epoch(ts))) AS first FROM events WHERE user_id % 10 <> 7 GROUP BY user_id)
SELECT e.user_id, event_id, floor(epoch(ts)) - first AS elapsed_sec, floor(value)::DOUBLE AS power_watts, ((event_id * 37) % 200)::DOUBLE AS heart_rate_bpm FROM events e JOIN u ON e.user_id = u.user_id""")
def s9_device_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a device file of the binary format, checked and decoded to records; each tenth file is cut off."""
    bytes_ = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    seconds, power, heart = F.unix_seconds(F.col("ts").cast("timestamp")) - device.EPOCH, F.floor("value"), (F.col("event_id") * 37) % 200
    record = F.concat(F.lit("00"), bytes_(seconds, 4), bytes_(power, 2), bytes_(heart, 1), bytes_(F.col("event_id"), 4))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(record)), "").alias("data"))
    # a definition in big-endian order: message 20 with a time, power, heart rate and a field of its own
    body = F.concat(F.lit("4000010014" + "04" + "FD0486" + "070284" + "030102" + "C80486"), "data")
    size = bytes_(F.length(body) / 2, 4)
    little = F.concat(*[F.substring(size, k, 2) for k in (7, 5, 3, 1)])
    content = F.unhex(F.concat(F.lit("0E103408"), little, F.lit("2E4649540000"), F.when(F.col("user_id") % 10 == 7, F.lit("")).otherwise(body), F.lit("0000")))
    decoded = device.decode(files.unpacked(rows.select(F.col("user_id").cast("string").alias("path"), content.alias("content"))))
    kept = decoded.where("field = 'field_200'").select(F.col("path").alias("_path"), "position", F.col("value").cast("long").alias("event_id"))
    return device.records(decoded).join(kept, (F.col("workout_id") == F.col("_path")) & (F.col("message_position") == F.col("position"))).select(F.col("workout_id").cast("long").alias("user_id"), "event_id", "elapsed_sec", "power_watts", "heart_rate_bpm")


_EXPORTED = ("nation", "region", "customer", "supplier", "orders", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in _EXPORTED))
def k7_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = files.export({t: table(spark, sf_dir, t) for t in _EXPORTED}, _shared(spark, "export"))
    return report.select("table", "rows")


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Events as payload files in a landing zone, each user's delivered more than once."""
    path = _shared(spark, "landing")
    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "event_id", "value")
    e.repartition(4, "event_id").write.json(path)
    return path


_LANDED = "user_id long, ts timestamp, event_id long, value double"


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def t8_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files, two at a time, upserted by user: the newest event of each stays."""
    source, target = _landed(spark, sf_dir), _shared(spark, "state")
    stream = landing.landing_stream(spark, source, _LANDED, 2)
    landing.ingest(stream, f"{target}/table", f"{target}/checkpoint", ["user_id"], "event_id").awaitTermination()
    return landing.current_table(spark, f"{target}/table", ["user_id"], "event_id", stream.schema).select("user_id", "event_id", "value")


def _streamed(spark: SparkSession, made: DataFrame, mode: str = "append") -> DataFrame:
    target = _shared(spark, "stream")
    query_ = made.writeStream.outputMode(mode).format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{target}/out")


@query("SELECT DISTINCT user_id, event_id // 10 AS delivery FROM events")
def t9_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries by user and number, once each; all files of the landing zone are one micro-batch."""
    stream = landing.landing_stream(spark, _landed(spark, sf_dir), _LANDED).withColumn("delivery", F.floor(F.col("event_id") / 10))
    return _streamed(spark, landing.once_per_key(stream, ["user_id", "delivery"], "ts", "90 days")).select("user_id", "delivery")


@query("""WITH e AS (SELECT user_id, value, date_trunc('day', ts)::TIMESTAMP - to_days(unnest(range(0, 7))::INTEGER) AS window_from FROM events)
SELECT user_id, window_from, window_from + INTERVAL 7 DAY AS window_to, count(*) AS events, round(sum(value), 4) AS total FROM e
WHERE window_from + INTERVAL 7 DAY <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 1 DAY FROM events) GROUP BY ALL""")
def t6_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding seven-day sums; the windows that the watermark has closed are final."""
    stream = landing.landing_stream(spark, _landed(spark, sf_dir), _LANDED)
    windows = _streamed(spark, landing.windowed_load(stream, "ts", "user_id", "value", "7 days", "1 day", "1 day"))
    return windows.withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS session_from, max(ts) + INTERVAL 6 HOUR AS session_to, count(*) AS events FROM s GROUP BY user_id, s""")
def t7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the session operator that the stream uses."""
    return landing.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours", "1 day")


#: An item's deliveries: some bad, some without payload; a good payload says the same each time.
_DELIVERIES = """CASE WHEN event_id % 7 < 3 THEN NULL WHEN event_id % 5 < 3 AND event_id % 12 < 9 THEN CASE WHEN event_id % 2 = 0 THEN 'no JSON' ELSE '{"value":null}' END
  ELSE '{"value":' || ((event_id // 3) % 1000) || '}' END"""


@query(f"""WITH d AS (SELECT 'item' || (event_id // 3) AS item, ts, {_DELIVERIES} AS payload, {_DELIVERIES} LIKE '{{"value":_%' AND {_DELIVERIES} NOT LIKE '%null%' AS good FROM events),
s AS (SELECT item, coalesce(bool_or(good), false) AS good, count(*) FILTER (payload IS NOT NULL) AS bad, max(payload) FILTER (good) AS payload, max(ts) AS last FROM d GROUP BY item)
SELECT item, CASE WHEN good THEN 'processed' WHEN bad > 0 THEN 'failed' WHEN epoch_ms(last) + 864000000 <= (SELECT max(epoch_ms(ts)) - 86400000 FROM events) THEN 'failed' ELSE 'fetched' END AS status, payload FROM s""")
def t8_item_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of items, some repeated, in three lots one after another through the state machine: each item's last state."""
    path = _shared(spark, "items")
    k = F.col("event_id")
    bad = F.when(k % 2 == 0, "no JSON").otherwise('{"value":null}')
    payload = F.when(k % 7 < 3, F.lit(None)).when((k % 5 < 3) & (k % 12 < 9), bad).otherwise(F.concat(F.lit('{"value":'), F.floor(k / 3) % 1000, F.lit("}")))
    sent = table(spark, sf_dir, "events").select(F.concat(F.lit("item"), F.floor(k / 3)).alias("item"), payload.alias("payload"), F.col("ts").alias("at"))
    lo, hi = sent.agg(F.min("at"), F.max("at")).first()
    third = F.least(F.lit(2), F.floor((F.unix_seconds("at") - F.lit(int(lo.timestamp()))) * 3 / F.lit(int((hi - lo).total_seconds()) + 1)))
    session = items.session_with_timers(spark)
    for k_ in range(3):  # a run takes the files of its third as one batch; timers without news are the last run's
        sent.where(third == k_).write.mode("append").parquet(f"{path}/in")
        session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", k_ == 2)
        stream = session.readStream.schema(sent.schema).parquet(f"{path}/in")
        moves = items.item_states(stream, items.required("value"), "1 day", timedelta(days=10), timedelta(days=3650))
        items.ingest_items(moves, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    found = items.current_states(spark, f"{path}/out")
    return found.select("item", "status", F.when(F.col("status") == "processed", F.col("payload")).alias("payload"))


@query("""WITH r AS (SELECT user_id, event_id, value, event_id % 13 = 0 AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id::VARCHAR AS item, event_id::VARCHAR AS tag FROM r WHERE NOT deleted""")
def s11_delta_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's listing in four generations: the first by its full listing, then two that expired (a re-list), then a change."""
    folder, target = _shared(spark, "listing"), _shared(spark, "listed")
    e = table(spark, sf_dir, "events")
    most = e.agg(F.max("event_id")).first()[0] + 1
    e = e.withColumn("generation", F.floor(F.col("event_id") * 4 / most))
    item = [F.col("user_id").cast("string").alias("item"), F.col("event_id").cast("string").alias("tag"), (F.col("event_id") % 13 == 0).alias("deleted")]

    def run(generation: int, full: bool) -> None:
        seen = e.where(F.col("generation") <= generation if full else F.col("generation") == generation)
        rows = ledger.latest(seen.select("user_id", "event_id"), ["user_id"], [F.col("event_id")]).select(*item)
        rows.where("not deleted" if full else "true").write.json(f"{folder}/{'full' if full else 'changes'}/generation={generation}")
        listing.follow(listing.listing_stream(spark, folder), f"{target}/state", f"{target}/checkpoint").awaitTermination()

    for generation, full in ((0, True), (2, True), (3, False)):
        run(generation, full)
    return listing.current_items(spark, f"{target}/state").select("item", "tag")


#: Workouts in three deliveries out of order: each tenth is corrected later, each seventeenth withdrawn.
_KEPT_UP = "w AS (SELECT * FROM workouts WHERE workout_id % 17 <> 0)"


def _kept_up(spark: SparkSession, sf_dir: str) -> upkeep.Upkeep:
    path = _shared(spark, "upkeep")
    k, w = F.col("workout_id"), workouts(spark, sf_dir)
    final = w.withColumn("version", F.lit(2)).withColumn("deleted", k % 17 == 0)
    early = w.where((k % 10 == 0) | (k % 17 == 0)).withColumn("version", F.lit(1)).withColumn("deleted", F.lit(False)).withColumn("tss", F.coalesce("tss", F.lit(5.0)) + 100).withColumn("duration_sec", F.lit(60.0))
    sent = (early, final.where((k % 3 == 1) | (k % 17 == 0)), final.where((k % 3 != 1) & (k % 17 != 0)))
    for part in sent:  # a run takes the files of its part as one batch
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(final.schema).parquet(f"{path}/in")
        upkeep.keep_up(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return upkeep.Upkeep(f"{path}/out")


@query(f"""WITH {WORKOUTS_SQL}, {_KEPT_UP} SELECT athlete_id, date_trunc('week', start_time_utc)::TIMESTAMP AS week_start, count(*) AS workout_count, round(sum(duration_sec) / 60, 2) AS total_duration_min FROM w GROUP BY ALL""")
def t11_weekly_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly rollups after three out-of-order batches, of which each recomputed only the weeks it touched."""
    return _kept_up(spark, sf_dir).weekly(spark).select("athlete_id", "week_start", "workout_count", "total_duration_min")


@query(f"""WITH {WORKOUTS_SQL}, {_KEPT_UP}, d AS (SELECT athlete_id, start_time_utc::DATE AS of_, sum(tss) AS tss FROM w WHERE tss IS NOT NULL GROUP BY ALL),
x AS (SELECT athlete_id, of_, tss, of_ + unnest(range(0, 29))::INTEGER AS day FROM d)
SELECT athlete_id, day, coalesce(sum(tss) FILTER (day = of_), 0.0) AS tss, coalesce(sum(tss) FILTER (day - of_ <= 7), 0.0) AS tss_7d, sum(tss) AS tss_28d FROM x GROUP BY ALL""")
def t11_load_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling loads after the same batches: a row marks its day and the 28 after it."""
    return _kept_up(spark, sf_dir).loads(spark).select("athlete_id", "day", "tss", "tss_7d", "tss_28d")
