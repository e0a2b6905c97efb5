"""Queries of composite answers, lookups of metadata, zones and maintenance jobs over the test tables, with SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions import dates, numbers, zones
from tempora.operators import lookup, metrics, quality, resolve, rollups
from tempora.params import AthleteParams, params_from, resolve_ftp
from tempora.plans import composites
from tempora.sources import clustered, files, ledger, rewrite
from tempora.sources.views import PHYSIOMETRICS_SQL, RECORDS_SQL, USER_RECORDS_SQL, WORKOUTS_SQL, physiometrics, records, records_by_user, table, workouts

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


def _planning_sql(rows: str) -> str:
    return f"""WITH {WORKOUTS_SQL}, w AS (SELECT * FROM workouts WHERE {rows} AND start_time_utc BETWEEN TIMESTAMP '1998-06-30' - INTERVAL 90 DAY AND TIMESTAMP '1998-06-30'),
s AS (SELECT athlete_id, count(*) AS workout_count, round(sum({_INTENSITY}) / 60, 1) AS intensity_min, count(DISTINCT date_trunc('week', start_time_utc)) AS n_weeks, arg_max(workout_id, (start_time_utc, workout_id)) AS newest FROM w GROUP BY athlete_id)
SELECT athlete_id, workout_count, intensity_min, workout_count AS n_listed, n_weeks, newest FROM s"""


def _planning(rows: DataFrame) -> DataFrame:
    out = composites.planning_context(rows, "1998-06-30", 90)
    return out.select("athlete_id", "workout_count", "intensity_min", F.size("workouts").cast("long").alias("n_listed"), F.size("weeks").cast("long").alias("n_weeks"), F.col("workouts")[0]["workout_id"].alias("newest"))


@query(_planning_sql("true"))
def r13_planning_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planning(workouts(spark, sf_dir))


@query(_planning_sql("athlete_id = 10"))
def r13_planning_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that one athlete asks for."""
    return _planning(workouts(spark, sf_dir, 10))


@query(f"""WITH {RECORDS_SQL}, {PHYSIOMETRICS_SQL}, w AS (SELECT event_type AS workout_id, min(user_id) AS athlete_id, min(ts) AS start_time_utc FROM events GROUP BY event_type),
c AS (SELECT w.workout_id, ftp_watts, row_number() OVER (PARTITION BY w.workout_id ORDER BY (p.data_source IN ('manual', 'chatgpt') AND p.effective_date <= w.start_time_utc::DATE) DESC, p.effective_date <= w.start_time_utc::DATE DESC, effective_date DESC, updated_at_utc DESC, row_key DESC) AS rn FROM w LEFT JOIN physiometrics p ON w.athlete_id = p.athlete_id),
f AS (SELECT workout_id, coalesce(CASE WHEN ftp_watts > 0 THEN ftp_watts END, 30.0) AS ftp FROM c WHERE rn = 1),
p AS (SELECT workout_id, elapsed_sec, power_watts FROM records WHERE power_watts IS NOT NULL),
s AS (SELECT workout_id, CASE WHEN count(*) OVER t = 30 THEN avg(power_watts) OVER t END AS s FROM p WINDOW t AS (PARTITION BY workout_id ORDER BY elapsed_sec ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
n AS (SELECT workout_id, round(pow(avg(pow(s, 4)), 0.25), 1) AS normalized_power FROM s GROUP BY workout_id), d AS (SELECT workout_id, max(elapsed_sec) AS d FROM records GROUP BY workout_id),
i AS (SELECT *, round(normalized_power / ftp, 3) AS intensity_factor FROM n JOIN f USING (workout_id) JOIN d USING (workout_id))
SELECT workout_id, ftp, normalized_power, intensity_factor, round(d / 3600 * intensity_factor * intensity_factor * 100, 1) AS tss, 3::BIGINT AS n_laps FROM i""")
def r14_workout_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("workout_id")).agg(F.min("user_id").alias("athlete_id"), F.min("ts").alias("start_time_utc"))
    laps = w.select("workout_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("position")).withColumn("minutes", F.lit(5.0))
    out = composites.workout_detail(w, records(spark, sf_dir), physiometrics(spark, sf_dir), laps, AthleteParams(ftp=30.0))
    return out.select("workout_id", "ftp", "normalized_power", "intensity_factor", "tss", F.size("laps").cast("long").alias("n_laps"))


@query("""WITH m AS (SELECT 'i' || o_orderkey AS key, o_totalprice AS ftp FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey::VARCHAR, -1 FROM orders WHERE o_orderkey % 3 = 1)
SELECT o_orderkey AS workout_id, coalesce(CASE WHEN o_orderkey % 10 = 0 THEN 5.0 END, m.ftp) AS ftp FROM orders LEFT JOIN m ON coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'i' || o_orderkey END, o_orderkey::VARCHAR) = m.key""")
def j5_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    rows = o.select(k.alias("workout_id"), F.when(k % 2 == 0, F.concat(F.lit("i"), k.cast("string"))).alias("ingestion_id"), F.when(k % 10 == 0, 5.0).alias("ftp"))
    known = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("i"), k.cast("string")).alias("key"), F.col("o_totalprice").alias("ftp")).union(o.where("o_orderkey % 3 = 1").select(k.cast("string").alias("key"), F.lit(-1.0).alias("ftp")))
    return composites.with_metadata(rows, known, ["ftp"]).select("workout_id", "ftp")


@query("SELECT o_orderkey AS workout_id, o_custkey AS athlete_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def j6_with_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("workout_id"), F.col("o_custkey").alias("athlete_id"))
    return composites.with_records(o, table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("workout_id")))


@query(f"""WITH {RECORDS_SQL}, w AS (SELECT DISTINCT event_type AS workout_id, CASE WHEN length(event_type) > 5 THEN 1000.0 END AS duration_sec, CASE WHEN length(event_type) % 2 = 0 THEN 7.0 END AS distance_m FROM events)
SELECT w.workout_id, coalesce(any_value(w.duration_sec), max(elapsed_sec)) AS duration_sec, coalesce(any_value(w.duration_sec), max(elapsed_sec)) AS moving_time_sec, coalesce(any_value(w.distance_m), max(r.distance_m)) AS distance_m FROM w LEFT JOIN records r ON w.workout_id = r.workout_id GROUP BY w.workout_id""")
def a3_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("workout_id")
    w = table(spark, sf_dir, "events").select(F.col("event_type").alias("workout_id")).distinct().select(kind, F.when(F.length(kind) > 5, 1000.0).alias("duration_sec"), F.lit(None).cast("double").alias("moving_time_sec"), F.when(F.length(kind) % 2 == 0, 7.0).alias("distance_m"))
    return composites.durations(w, records(spark, sf_dir)).select("workout_id", "duration_sec", "moving_time_sec", "distance_m")


@query("SELECT user_id, min(ts) FILTER (event_type LIKE 's%') AS start_time_utc FROM events GROUP BY user_id")
def a29_first_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").startswith("s"), F.concat(F.lit("start_"), F.col("event_type"))).otherwise("stop")
    return composites.first_start(table(spark, sf_dir, "events").select("user_id", kind.alias("kind"), F.col("ts").alias("at")), "user_id")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN (props->>'$.k')::DOUBLE ELSE -1 END AS reading FROM events")
def s14_source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(F.lit("Garmin"), F.lit("intervals"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    reading = composites.by_source(source, {"garmin": F.col("value"), "intervals": F.get_json_object("props", "$.k").cast("double")}, F.lit(-1.0))
    return table(spark, sf_dir, "events").select("event_id", reading.alias("reading"))


@query("SELECT event_id, ts, user_id, value FROM events WHERE ts BETWEEN '2024-01-10' AND '2024-01-12' AND user_id = 7")
def s1_pushed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts BETWEEN timestamp_ntz'2024-01-10 00:00:00' AND timestamp_ntz'2024-01-12 00:00:00' AND user_id = 7")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")


@query(f"WITH {WORKOUTS_SQL} SELECT athlete_id, date_trunc('week', start_time_utc)::TIMESTAMP AS week_start, count(*) AS workout_count, round(sum(duration_sec) / 60, 2) AS total_duration_min FROM workouts WHERE athlete_id = 10 GROUP BY ALL")
def s13_clustered_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One athlete's weeks out of clustered summaries, of which a few row groups are read."""
    path = files.shared(spark, "clustered")
    clustered.write_clustered(workouts(spark, sf_dir), path, "athlete_id", ["start_time_utc", "workout_id"], 4)
    return rollups.weekly(clustered.of_one(spark, path, "athlete_id", 10)).select("athlete_id", "week_start", "workout_count", "total_duration_min")


@query(f"WITH {WORKOUTS_SQL}, w AS (SELECT athlete_id, count(*) AS n FROM workouts GROUP BY athlete_id) SELECT workout_id, athlete_id, c_nationkey, n FROM workouts JOIN customer ON athlete_id = c_custkey JOIN w USING (athlete_id)")
def s13_bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and athletes in equal buckets: joined and counted by athlete without a shuffle."""
    own = workouts(spark, sf_dir).select("workout_id", "athlete_id")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("athlete_id"), "c_nationkey")
    tables = {}
    for name, rows, order in (("workouts", own, ["workout_id"]), ("athletes", people, [])):
        path = files.shared(spark, f"bucketed-{name}")
        tables[name] = clustered.write_bucketed(rows, path.rpartition("/")[2].replace("-", "_"), path, "athlete_id", 8, order)
    return clustered.with_counts(tables["workouts"], tables["athletes"], "athlete_id").select("workout_id", "athlete_id", "c_nationkey", "n")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 300 > 0 THEN o_orderkey % 300 END, CASE WHEN o_orderkey % 3 = 0 THEN 210 END, 250)::DOUBLE AS ftp FROM orders")
def m5_ftp_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ftp = resolve_ftp(F.when(k % 4 == 1, k % 300).otherwise(F.lit(0)), F.when(k % 3 == 0, 210))
    return table(spark, sf_dir, "orders").select("o_orderkey", ftp.alias("ftp"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 155.0 ELSE 165.0 END ELSE 190.0 END::DOUBLE AS reference, CASE WHEN o_orderkey % 2 = 0 THEN 'coggan' ELSE 'karvonen' END AS model FROM orders")
def m24_hr_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    basis = F.when(k % 2 == 0, "LTHR").otherwise("HRR")
    params = AthleteParams(hr_max=190.0, lthr=165.0, cycling_lthr=155.0, basis=basis)
    sport = F.when(k % 3 == 0, "Gravel Ride").otherwise("Running")
    return table(spark, sf_dir, "orders").select("o_orderkey", metrics.hr_reference(params, sport).alias("reference"), metrics.zone_model(basis).alias("model"))


@query(f"WITH {WORKOUTS_SQL}, w AS (SELECT athlete_id, date_trunc('week', start_time_utc)::TIMESTAMP AS week_start, count(*) AS workout_count FROM workouts GROUP BY ALL) SELECT * FROM w ORDER BY week_start DESC, athlete_id LIMIT 100")
def o2_newest_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.weekly(workouts(spark, sf_dir)).select("athlete_id", "week_start", "workout_count").orderBy(F.desc("week_start"), "athlete_id").limit(100)


@query(f"WITH {PHYSIOMETRICS_SQL} SELECT athlete_id, effective_date, updated_at_utc, row_key FROM physiometrics WHERE data_source IN ('manual', 'chatgpt') AND athlete_id = 3 ORDER BY effective_date DESC, updated_at_utc DESC, row_key DESC LIMIT 25")
def o4_config_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = physiometrics(spark, sf_dir).where("data_source in ('manual', 'chatgpt') and athlete_id = 3")
    return own.orderBy(F.desc("effective_date"), F.desc("updated_at_utc"), F.desc("row_key")).limit(25).select("athlete_id", "effective_date", "updated_at_utc", "row_key")


@query(f"WITH {PHYSIOMETRICS_SQL}, r AS (SELECT athlete_id, data_source, row_key, row_number() OVER (PARTITION BY athlete_id, data_source ORDER BY effective_date DESC, updated_at_utc DESC, row_key DESC)::INTEGER AS nth FROM physiometrics) SELECT * FROM r")
def w10_newest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("athlete_id", "data_source").orderBy(F.desc("effective_date"), F.desc("updated_at_utc"), F.desc("row_key"))
    return physiometrics(spark, sf_dir).select("athlete_id", "data_source", "row_key", F.row_number().over(newest).alias("nth"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'view'")
def u1_partitions_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return e.where("event_type = 'click'").unionByName(e.where("event_type = 'view'")).drop("event_type")


@query("SELECT DISTINCT o_orderdate::DATE AS day FROM orders EXCEPT SELECT l_shipdate::DATE FROM lineitem WHERE l_quantity > 45")
def u3_day_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return days.subtract(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.to_date("l_shipdate").alias("day")))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'Asia/Tokyo' END, CASE WHEN c_custkey % 3 = 0 THEN 'Europe/Paris' END, CASE WHEN c_custkey % 2 = 0 THEN 'UTC' END, 'America/Denver') AS home,
  coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'America/Denver' END, CASE WHEN c_custkey % 3 = 0 THEN 'UTC+02:00' END, 'America/Denver') AS canonical FROM customer""")
def r8_timezones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    home = resolve.timezone(F.when(k % 5 == 0, "Asia/Tokyo"), F.when(k % 3 == 0, " Europe/Paris ").otherwise(" "), F.when(k % 2 == 0, "UTC"), F.lit("America/Denver"))
    canonical = resolve.canonical_timezone(k % 4 == 0, F.lit("America/Denver"), F.lit(None).cast("string"), F.when(k % 3 == 0, dates.offset_text(F.lit(120))))
    return table(spark, sf_dir, "customer").select("c_custkey", home.alias("home"), canonical.alias("canonical"))


#: The order of preference among cities, stated once more for the SQL.
_CITIES = [
    "America/New_York", "America/Toronto", "America/Montreal", "America/Chicago", "America/Mexico_City", "America/Winnipeg", "America/Denver", "America/Edmonton",
    "America/Los_Angeles", "America/Vancouver", "America/Anchorage", "Pacific/Honolulu", "Europe/London", "Europe/Paris", "Europe/Berlin", "Europe/Madrid",
    "Europe/Rome", "Europe/Amsterdam", "Asia/Tokyo", "Asia/Shanghai", "Asia/Hong_Kong", "Asia/Singapore", "Asia/Dubai", "Asia/Seoul", "Asia/Taipei",
    "Australia/Sydney", "Australia/Melbourne", "Pacific/Auckland", "America/Sao_Paulo", "America/Buenos_Aires", "America/Santiago", "Africa/Cairo", "Africa/Johannesburg",
]
_MINUTES = "date_diff('minute', {0}, {0} AT TIME ZONE 'UTC' AT TIME ZONE name)"


@query(f"""WITH e AS (SELECT event_id, ts + to_days((event_id % 300)::INTEGER) AS ts, [0, 60, 120, 330, -300, -240, -420, 15][event_id % 8 + 1] AS offset_min FROM events),
z AS (SELECT name, {_MINUTES.format("TIMESTAMP '2024-01-15 12:00:00'")} <> {_MINUTES.format("TIMESTAMP '2024-07-15 12:00:00'")} AS summer, coalesce(list_position({_CITIES}, name), 99) AS city, length(name) - length(replace(name, '/', '')) AS depth
  FROM pg_timezone_names() WHERE name LIKE '%/%' AND name NOT LIKE 'Etc/%' AND name NOT LIKE 'SystemV/%'),
t AS (SELECT DISTINCT ts, offset_min FROM e),
f AS (SELECT ts, offset_min, name, row_number() OVER (PARTITION BY ts, offset_min ORDER BY name <> 'America/Denver', NOT summer, city, depth, name) AS rn FROM t, z WHERE {_MINUTES.format('ts')} = offset_min)
SELECT event_id, name AS zone FROM e LEFT JOIN f ON e.ts = f.ts AND e.offset_min = f.offset_min AND rn = 1""")
def f6_zone_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_add("DAY", (F.col("event_id") % 300).cast("int"), F.col("ts"))
    offset = F.element_at(F.array(*[F.lit(m) for m in (0, 60, 120, 330, -300, -240, -420, 15)]), (F.col("event_id") % 8 + 1).cast("int"))
    return zones.with_zone(table(spark, sf_dir, "events"), at, offset, F.lit("America/Denver")).select("event_id", "zone")


@query(f"WITH {WORKOUTS_SQL} SELECT workout_id, round(distance_m / 1000 / (duration_sec / 3600), 9) AS kmh FROM workouts WHERE duration_sec > 0")
def f23_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.operators.quality import speed_kmh

    return workouts(spark, sf_dir).where("duration_sec > 0").select("workout_id", F.round(speed_kmh(F.col("distance_m"), F.col("duration_sec")), 9).alias("kmh"))


@query(f"""WITH {RECORDS_SQL}, s AS (SELECT workout_id, elapsed_sec, CASE WHEN event_id % 5 <> 0 THEN elevation_m END AS elevation_m FROM records), r AS (SELECT workout_id, elapsed_sec + 0.5::DOUBLE AS t, elevation_m FROM records WHERE event_id % 2 = 0),
c AS (SELECT s.workout_id, s.elapsed_sec, arg_min(r.elevation_m, (abs(t - s.elapsed_sec), t)) AS near FROM s JOIN r ON s.workout_id = r.workout_id AND abs(t - s.elapsed_sec) <= 1 GROUP BY ALL)
SELECT s.workout_id, s.elapsed_sec, coalesce(s.elevation_m, near) AS elevation_m FROM s LEFT JOIN c ON s.workout_id = c.workout_id AND s.elapsed_sec = c.elapsed_sec""")
def x1_elevation_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    holes = r.select("workout_id", "elapsed_sec", F.when(F.col("event_id") % 5 != 0, F.col("elevation_m")).alias("elevation_m"))
    raw = r.where("event_id % 2 = 0").select("workout_id", (F.col("elapsed_sec") + 0.5).alias("elapsed_sec"), "elevation_m")
    return composites.backfilled(holes, raw, ["elevation_m"], 1.0)


@query(f"""WITH {USER_RECORDS_SQL}, s AS (SELECT workout_id, CASE WHEN event_id % 5 <> 0 THEN elevation_m END AS had, elevation_m, event_id % 3 = 0 AND workout_id::BIGINT % 4 <> 1 AS raw FROM records)
SELECT workout_id, count(had) AS before, count(coalesce(had, CASE WHEN raw THEN elevation_m END)) AS after, count(had) < count(coalesce(had, CASE WHEN raw THEN elevation_m END)) AS improved, count(coalesce(had, CASE WHEN raw THEN elevation_m END)) AS stored, 0::BIGINT AS again
FROM s GROUP BY workout_id HAVING count(had) < count(*)""")
def x1_conditional_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records with holes, filled where raw ones are near: improved workouts are rewritten, and a second run finds
    none to improve."""
    path, r = files.shared(spark, "records"), records_by_user(spark, sf_dir)
    month = F.date_format("timestamp_utc", "yyyy-MM").alias("month")
    holes = r.select("workout_id", "elapsed_sec", F.when(F.col("event_id") % 5 != 0, F.col("elevation_m")).alias("elevation_m"), month)
    holes.write.partitionBy("month").parquet(path)
    raw = r.where((F.col("event_id") % 3 == 0) & (F.col("workout_id").cast("long") % 4 != 1)).select("workout_id", (F.col("elapsed_sec") + 0.25).alias("elapsed_sec"), "elevation_m")
    fill = lambda rows: composites.backfilled(rows, raw, ["elevation_m"], 0.5)
    first, second = (rewrite.rewrite_improved(spark, path, fill, ["elevation_m"]) for _ in range(2))
    per = first.groupBy("workout_id").agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.bool_or("improved").alias("improved"))
    stored = spark.read.parquet(path).groupBy(F.col("workout_id").cast("string").alias("workout_id")).agg(F.count("elevation_m").alias("stored"))
    return per.join(stored.hint("merge"), "workout_id").withColumn("again", F.lit(second.where("improved").count()).cast("long"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Europe/Paris' ELSE 'UTC' END AS tz FROM customer WHERE CASE WHEN c_custkey % 2 = 0 THEN 'UTC' END IS DISTINCT FROM CASE WHEN c_custkey % 3 = 0 THEN 'Europe/Paris' ELSE 'UTC' END")
def x2_timezone_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "UTC").alias("tz"))
    return composites.to_update(rows, "tz", F.when(F.col("c_custkey") % 3 == 0, "Europe/Paris").otherwise("UTC"))


@query(f"""WITH e AS (SELECT o_orderkey AS workout_id, o_orderdate + to_hours(o_orderkey % 24) AS ts, [60, 120, -300, -240, -420, -360][o_orderkey % 6 + 1] AS offset_min,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Asia/Tokyo' END AS recorded, CASE WHEN o_orderkey % 7 = 0 THEN 'Europe/Paris' WHEN o_orderkey % 4 = 0 THEN 'America/Denver' END AS tz FROM orders),
z AS (SELECT name, coalesce(list_position({_CITIES}, name), 99) AS city, length(name) - length(replace(name, '/', '')) AS depth FROM pg_timezone_names() WHERE name LIKE '%/%' AND name NOT LIKE 'Etc/%' AND name NOT LIKE 'SystemV/%'),
y AS (SELECT name, city, depth, year, {_MINUTES.format("make_timestamp(year, 1, 15, 12, 0, 0)")} <> {_MINUTES.format("make_timestamp(year, 7, 15, 12, 0, 0)")} AS summer FROM z, (SELECT DISTINCT year(ts) AS year FROM e)),
t AS (SELECT DISTINCT ts, offset_min FROM e),
f AS (SELECT ts, offset_min, name, row_number() OVER (PARTITION BY ts, offset_min ORDER BY name <> 'America/Denver', NOT summer, city, depth, name) AS rn FROM t JOIN y ON year(ts) = year AND {_MINUTES.format('ts')} = offset_min),
n AS (SELECT workout_id, tz, coalesce(recorded, name, 'America/Denver') AS new_tz FROM e LEFT JOIN f ON e.ts = f.ts AND e.offset_min = f.offset_min AND rn = 1)
SELECT workout_id, new_tz AS tz FROM n WHERE tz IS DISTINCT FROM new_tz""")
def x2_inferred_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every workout's zone from its recorded one or its offset at the start; those whose stored zone is another."""
    k = F.col("o_orderkey")
    at = F.timestamp_add("HOUR", (k % 24).cast("int"), F.col("o_orderdate"))
    offset = F.element_at(F.array(*[F.lit(m) for m in (60, 120, -300, -240, -420, -360)]), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("workout_id"), at.alias("start_time_utc"), offset.alias("offset_min"), F.when(k % 9 == 0, "Asia/Tokyo").alias("recorded"),
        F.when(k % 7 == 0, "Europe/Paris").when(k % 4 == 0, "America/Denver").alias("tz"),
    )
    return composites.zones_to_update(rows, F.lit("America/Denver")).select("workout_id", "tz")


@query("SELECT o_orderkey AS workout_id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END) AS enrichment FROM orders")
def x3_enrichment_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    rows = o.select(k.alias("workout_id"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("enrichment"))
    index = o.where("o_orderkey % 3 = 0").select(k.alias("workout_id"), F.col("o_orderpriority").alias("enrichment"))
    return rollups.filled_from(rows, index, "workout_id", ["enrichment"])


@query("SELECT c_custkey AS athlete_id, unnest(generate_series(DATE '2026-01-01', DATE '2026-01-03', INTERVAL 1 DAY))::DATE AS effective_date, 161.0::DOUBLE AS lthr_bpm FROM customer")
def x4_daily_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composites.daily_baseline("2026-01-01", "2026-01-03", 161.0, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("athlete_id")))


@query("SELECT s_suppkey, n_name AS listed, s_nationkey % 7 AS file_code FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey <> s_nationkey % 7")
def x7_code_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).where("s_nationkey <> s_nationkey % 7").select("s_suppkey", F.col("n_name").alias("listed"), (F.col("s_nationkey") % 7).alias("file_code"))


@query("SELECT event_type AS endpoint, 'extra' AS key, 'right' AS only_in FROM events GROUP BY event_type HAVING bool_or(event_id % 9 = 0)")
def x9_response_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.select(F.col("event_type").alias("endpoint"), F.lit('{"a": 1, "b": 2}').alias("body"))
    right = e.select(F.col("event_type").alias("endpoint"), F.when(F.col("event_id") % 9 == 0, '{"a": 1, "b": 2, "extra": 3}').otherwise('{"a": 1, "b": 2}').alias("body"))
    return composites.key_differences(left, right, "endpoint")


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT workout_id, floor(elapsed_sec / 3)::DOUBLE AS s, avg(power_watts) AS p, count(heart_rate_bpm) AS n, round(sum(60 / heart_rate_bpm), 6) AS total FROM records GROUP BY ALL)
SELECT workout_id, s AS elapsed_sec, round(p, 6) AS power_watts, n AS beats, coalesce(total, 0) AS total FROM r""")
def f29_beats_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("elapsed_sec", F.col("elapsed_sec") / 3)
    beats = r.withColumn("rr_intervals_sec", F.array_compact(F.array(60 / F.col("heart_rate_bpm"))))
    out = composites.beats_by_second(beats)
    return out.select("workout_id", "elapsed_sec", F.round("power_watts", 6).alias("power_watts"), F.size("rr_intervals_sec").cast("long").alias("beats"), F.round(F.aggregate("rr_intervals_sec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 260) AND s_name ILIKE '%supplier%'")
def p18_allow_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where(F.col("s_nationkey").isin(1, 260) & F.lower("s_name").contains("supplier")).select("s_suppkey")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 6 = 0 THEN 'top' END, CASE WHEN event_id % 3 = 0 THEN 'zone' END, 'entity') AS sport FROM events")
def p5_promoted_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k % 6 == 0, "top").alias("sport"), F.struct(F.when(k % 3 == 0, "zone").alias("sport")).alias("identity"), F.lit("entity").alias("entity_sport"))
    return rows.select("event_id", F.coalesce("sport", "identity.sport", "entity_sport").alias("sport"))


@query("SELECT event_id, value AS a, NULL::DOUBLE AS absent FROM events")
def p1_named_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.sources.ledger import complete

    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("a"))
    return complete(rows, ["event_id"], ["event_id", "a", "absent"]).withColumn("absent", numbers.number(F.col("absent").cast("string")))


@query(f"""WITH {WORKOUTS_SQL}, w AS (SELECT workout_id AS k, athlete_id, start_time_utc, CASE WHEN workout_id % 3 = 0 THEN 'running' END AS sport, CASE WHEN workout_id % 4 <> 0 THEN duration_sec END AS duration_sec, distance_m FROM workouts),
s AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'Indoor_Cycling' WHEN k % 11 = 1 THEN 'lap_swimming' END AS sub_sport, CASE WHEN k % 7 = 0 THEN ' Morning ' END AS workout_name, CASE k % 6 WHEN 0 THEN true WHEN 1 THEN false END AS is_indoor,
  (k % 2) * 500.0::DOUBLE AS distance_m, (k % 9)::DOUBLE AS elevation_gain_m, CASE WHEN k % 8 = 0 THEN 300 ELSE 0 END AS calories_kcal FROM w WHERE k % 5 <> 0),
j AS (SELECT w.*, s.* EXCLUDE (k, distance_m), s.distance_m AS d, coalesce(w.sport, CASE WHEN lower(sub_sport) LIKE '%cycling%' THEN 'cycling' WHEN lower(sub_sport) LIKE '%swim%' THEN 'swimming' ELSE 'unknown' END) AS sp, coalesce(nullif(w.duration_sec, 0), 0) AS du FROM w LEFT JOIN s ON w.k = s.k)
SELECT k AS workout_id, sp AS sport, sub_sport, coalesce(trim(workout_name), upper(sp[1]) || sp[2:] || ' - ' || strftime(start_time_utc, '%b %d, %Y')) AS workout_name, coalesce(is_indoor, coalesce(d, 0) > 100 AND coalesce(elevation_gain_m, 0) < 5) AS is_indoor,
  start_time_utc, du AS duration_sec, coalesce(nullif(d, 0), distance_m) AS distance_m, elevation_gain_m, coalesce(nullif(calories_kcal, 0), trunc(du / 60 * CASE WHEN sp = 'running' THEN 15 ELSE 10 END))::BIGINT AS calories_kcal FROM j""")
def p6_base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, null = F.col("workout_id"), F.lit(None)
    w = workouts(spark, sf_dir).select("workout_id", "athlete_id", "start_time_utc", F.when(k % 3 == 0, "running").alias("sport"), F.when(k % 4 != 0, F.col("duration_sec")).alias("duration_sec"), "distance_m")
    session = w.where(k % 5 != 0).select(
        "workout_id", null.cast("string").alias("sport"), F.when(k % 2 == 0, "Indoor_Cycling").when(k % 11 == 1, "lap_swimming").alias("sub_sport"), F.when(k % 7 == 0, " Morning ").alias("workout_name"), F.when(k % 6 == 0, True).when(k % 6 == 1, False).alias("is_indoor"),
        null.cast("timestamp").alias("start_time_utc"), null.cast("double").alias("duration_sec"), null.cast("double").alias("moving_time_sec"), ((k % 2) * 500.0).alias("distance_m"), (k % 9).cast("double").alias("elevation_gain_m"), F.when(k % 8 == 0, 300).otherwise(0).alias("calories_kcal"),
    )
    return composites.base_rows(w, session).drop("athlete_id", "moving_time_sec")


@query("""WITH w AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Known' WHEN o_orderkey % 3 = 1 THEN ' ' END AS model, o_orderkey % 30 AS product, CASE WHEN o_orderkey % 7 <> 0 THEN 'Watch' || o_orderkey % 5 END AS said FROM orders),
j AS (SELECT k, CASE WHEN model = 'Known' THEN model END AS model, CASE WHEN k % 4 <> 0 THEN coalesce(n_name, said) END AS found FROM w LEFT JOIN nation ON product = n_nationkey)
SELECT k AS workout_id, coalesce(model, found) AS device_model, model IS NULL AND found IS NOT NULL AS filled FROM j""")
def x5_device_model_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    w = o.select(k.alias("workout_id"), F.when(k % 3 == 0, "Known").when(k % 3 == 1, " ").alias("device_model"))
    metadata = o.where(k % 4 != 0).select(k.alias("workout_id"), F.lit(1).alias("manufacturer"), (k % 30).alias("product"), F.when(k % 7 != 0, F.concat(F.lit("Watch"), (k % 5).cast("string"))).alias("product_name"))
    products = table(spark, sf_dir, "nation").select(F.lit(1).alias("manufacturer"), F.col("n_nationkey").alias("product"), F.col("n_name").alias("name"))
    return composites.backfilled_device_model(w, metadata, products)


@query("""WITH w AS (SELECT o_orderkey AS workout_id, o_custkey AS athlete_id, CASE WHEN o_orderkey % 3 = 0 THEN 'ing' || o_orderkey % 500 WHEN o_orderkey % 3 = 1 THEN ' ' END AS ingestion_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'item' || o_orderkey END AS source_item_id, o_orderdate AS ingested_at_utc, CASE WHEN o_orderkey % 2 = 0 THEN 'v0' END AS ingest_version FROM orders),
k AS (SELECT *, coalesce(CASE WHEN trim(ingestion_id) <> '' THEN ingestion_id END, source_item_id) AS ingestion_key FROM w),
n AS (SELECT * FROM k WHERE ingestion_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY athlete_id, ingestion_key ORDER BY ingested_at_utc DESC, workout_id DESC) = 1),
l AS (SELECT o_custkey AS athlete_id, 'item' || o_orderkey AS ingestion_key, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' END AS status, o_orderkey % 6 AS retry_count FROM orders WHERE o_orderkey % 7 = 0)
SELECT n.athlete_id, n.ingestion_key, coalesce(l.status, 'ingested') AS status, coalesce(l.retry_count, 0) AS retry_count, workout_id, coalesce(ingest_version, 'v9') AS ingest_version FROM n LEFT JOIN l ON n.athlete_id = l.athlete_id AND n.ingestion_key = l.ingestion_key""")
def x5_ledger_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of workouts that have none, and what existing rows lack."""
    k, o, none = F.col("o_orderkey"), table(spark, sf_dir, "orders"), F.lit(None).cast("string")
    text_ = lambda what, n: F.concat(F.lit(what), n.cast("string"))
    w = o.select(
        k.alias("workout_id"), F.col("o_custkey").alias("athlete_id"), F.when(k % 3 == 0, text_("ing", k % 500)).when(k % 3 == 1, " ").alias("ingestion_id"), F.when(k % 5 != 0, text_("item", k)).alias("source_item_id"),
        none.alias("file_sha256"), none.alias("source_file_name"), none.alias("source_etag"), none.alias("source_ctag"), F.col("o_orderdate").alias("ingested_at_utc"), F.when(k % 2 == 0, "v0").alias("ingest_version"),
    )
    known = o.where(k % 7 == 0).select(F.col("o_custkey").alias("athlete_id"), text_("item", k).alias("ingestion_key"), F.when(k % 4 == 0, "failed").alias("status"), (k % 6).alias("retry_count"))
    out = ledger.ledger_backfill(w, known, "v9", F.lit("2026-01-01").cast("timestamp"))
    return out.select("athlete_id", "ingestion_key", "status", "retry_count", "workout_id", "ingest_version")


@query("SELECT user_id AS athlete_id, ts::DATE AS day FROM events WHERE event_id % 2 = 0 GROUP BY ALL EXCEPT SELECT user_id, ts::DATE FROM events WHERE event_id % 3 = 0")
def j11_days_not_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("athlete_id"), F.to_date("ts").alias("day"))
    return lookup.not_stored(days.where("event_id % 2 = 0").select("athlete_id", "day").distinct(), days.where("event_id % 3 = 0"), ["athlete_id", "day"])


@query("""WITH c AS (SELECT max(c_custkey) % 100 + 200 AS ftp, max(s_suppkey) % 50 + 130 AS lthr FROM customer, supplier)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 300 > 0 THEN o_orderkey % 300 ELSE ftp END::DOUBLE AS ftp, lthr::DOUBLE AS lthr, 'LTHR' AS basis FROM orders, c""")
def s8_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration document, stored and read back: its parameters where a workout has none of its own."""
    path = files.shared(spark, "config")
    most = lambda t, c: table(spark, sf_dir, t).agg(F.max(c)).first()[0]
    body = {"power": {"ftp_watts": most("customer", "c_custkey") % 100 + 200}, "heart_rate": {"lthr_bpm": most("supplier", "s_suppkey") % 50 + 130, "basis": "LTHR"}}
    spark.createDataFrame([(json.dumps(body, indent=1),)], "value string").coalesce(1).write.text(path)
    params = params_from(files.read_config(spark, path))
    own = F.when(F.col("o_orderkey") % 4 == 1, F.col("o_orderkey") % 300)
    return table(spark, sf_dir, "orders").select("o_orderkey", resolve_ftp(own, params.ftp).alias("ftp"), F.lit(float(params.lthr)).alias("lthr"), F.lit(params.basis).alias("basis"))


@query(f"WITH {WORKOUTS_SQL} SELECT workout_id, sport FROM workouts WHERE athlete_id = 10")
def p14_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.owned(workouts(spark, sf_dir), 10).select("workout_id", "sport")


@query("WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Apple Watch' WHEN 1 THEN 'iPhone' WHEN 2 THEN 'Smartwatch ' || o_orderkey END AS device FROM orders) SELECT o_orderkey, device FROM d WHERE lower(device) LIKE '%watch%'")
def p19_from_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    device_ = F.when(k % 4 == 0, "Apple Watch").when(k % 4 == 1, "iPhone").when(k % 4 == 2, F.concat(F.lit("Smartwatch "), k.cast("string")))
    return quality.from_watches(table(spark, sf_dir, "orders").select("o_orderkey", device_.alias("device")), "device")


@query("""WITH i AS (SELECT o_orderkey AS item_id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'archived' ELSE 'resolved' END AS status FROM orders)
SELECT item_id, status, 'resolved' AS asked FROM i WHERE status = 'resolved' UNION ALL SELECT item_id, status, 'all' FROM i UNION ALL SELECT item_id, status, 'none' FROM i WHERE status <> 'archived'""")
def p13_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "archived").otherwise("resolved")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), status.alias("status"))
    asked = [quality.visible(items, s).withColumn("asked", F.lit(s or "none")) for s in ("resolved", "all", None)]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])
