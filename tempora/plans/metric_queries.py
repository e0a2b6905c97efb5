"""Queries of the per-workout metrics over the record view of events, with SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.operators import blocks
from tempora.operators import metrics as m
from tempora.operators import sequence as s
from tempora.params import PEAK_SECONDS, AthleteParams
from tempora.sources.files import stored
from tempora.sources.views import RECORDS_SQL, USER_RECORDS_SQL, records, records_by_user, table

#: Values that give every metric something to find in the test tables.
FTP, HR_MAX, HR_REST, LTHR = 30.0, 180.0, 60.0, 150.0
PARAMS = AthleteParams(ftp=FTP, hr_max=HR_MAX, hr_rest=HR_REST, lthr=LTHR)
INTERVAL_LEAST = 3

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


_W = "PARTITION BY workout_id ORDER BY elapsed_sec"
_NP = f"""
p AS (SELECT workout_id, elapsed_sec, power_watts FROM records WHERE power_watts IS NOT NULL),
smooth AS (
  SELECT workout_id, CASE WHEN count(*) OVER t = 30 THEN avg(power_watts) OVER t END AS s
  FROM p WINDOW t AS ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
np AS (SELECT workout_id, round(pow(avg(pow(s, 4)), 0.25), 1) AS normalized_power FROM smooth GROUP BY workout_id)"""
_STATS = "stats AS (SELECT workout_id, round(avg(power_watts), 1) AS power_avg, max(elapsed_sec) AS duration_sec FROM records GROUP BY workout_id)"


@query(f"WITH {RECORDS_SQL}, {_NP} SELECT * FROM np")
def m1_normalized_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.normalized_power(records(spark, sf_dir))


@query(f"""WITH {RECORDS_SQL}, {_NP}, {_STATS},
i AS (SELECT *, round(normalized_power / {FTP}, 3) AS intensity_factor, round(normalized_power / power_avg, 2) AS variability_index FROM np JOIN stats USING (workout_id))
SELECT workout_id, normalized_power, power_avg, duration_sec, variability_index, intensity_factor,
  round(duration_sec / 3600 * intensity_factor * intensity_factor * 100, 1) AS tss, round(1 / variability_index, 3) AS pacing_evenness FROM i""")
def m2_training_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    stats = m.channel_stats(r).join(m.normalized_power(r), m.KEY, "left")
    return m.load(stats, FTP).select(m.KEY, "normalized_power", "power_avg", "duration_sec", "variability_index", "intensity_factor", "tss", "pacing_evenness")


_CHANNELS = ", ".join(f"round(avg({c}), {d}) AS {n}_avg, max({c}) AS {n}_max, min({c}) AS {n}_min, count({c}) AS {n}_samples" for c, n, d in (("heart_rate_bpm", "hr", 1), ("power_watts", "power", 1), ("cadence_rpm", "cadence", 1), ("speed_mps", "speed", 2)))


@query(f"WITH {RECORDS_SQL} SELECT workout_id, {_CHANNELS}, max(elapsed_sec) AS duration_sec, max(distance_m) AS distance_m, count(*) AS n_records FROM records GROUP BY workout_id")
def a1_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.channel_stats(records(spark, sf_dir))


_MISSING = "round(least(greatest((1 - count({c}) / max(elapsed_sec)) * 100, 0), 100), 1) AS {n}_missing_pct"


@query(f"WITH {USER_RECORDS_SQL} SELECT workout_id, " + ", ".join(f"CASE WHEN max(elapsed_sec) > 0 AND count({c}) > 0 THEN {_MISSING.format(c=c, n=n).replace(f' AS {n}_missing_pct', '')} END AS {n}_missing_pct" for c, n in (("heart_rate_bpm", "hr"), ("power_watts", "power"), ("cadence_rpm", "cadence"))) + " FROM records GROUP BY workout_id")
def a2_missing_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.data_quality(records_by_user(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT workout_id, bool_or(power_watts IS NOT NULL) AS has_power, bool_or(heart_rate_bpm IS NOT NULL) AS has_hr, false AS has_gps FROM records GROUP BY workout_id")
def a21_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.capabilities(records(spark, sf_dir))


_SUMS = f"""
p AS (SELECT workout_id, elapsed_sec, power_watts FROM records WHERE power_watts IS NOT NULL),
c AS (SELECT workout_id, row_number() OVER w AS rn, sum(power_watts) OVER w AS cs FROM p WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING))"""


def _peaks_sql(widths: list[int]) -> str:
    lags = ", ".join(f"CASE WHEN rn >= {n} THEN (cs - coalesce(lag(cs, {n}) OVER w, 0)) / {n} END AS w{n}" for n in widths)
    return f"{_SUMS}, l AS (SELECT workout_id, {lags} FROM c WINDOW w AS (PARTITION BY workout_id ORDER BY rn)), peaks AS (SELECT workout_id, " + ", ".join(f"round(max(w{n}), 1) AS peak_{n}" for n in widths) + " FROM l GROUP BY workout_id)"


@query(f"WITH {RECORDS_SQL}, {_peaks_sql([5, 30, 180, 300, 480, 1200, 3600])} SELECT * FROM peaks")
def m6_peak_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.peak_power(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL}, {_peaks_sql([5, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 300, 420, 600, 900, 1200, 1800, 2400, 3600])} SELECT workout_id, replace(name, 'peak_', '')::INTEGER AS duration_sec, power FROM (UNPIVOT peaks ON COLUMNS(* EXCLUDE workout_id) INTO NAME name VALUE power)")
def m7_power_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.power_curve(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL}, {_peaks_sql([60, 300, 1200, 3600])} SELECT workout_id, v.k AS minutes, v.p AS power FROM (SELECT workout_id, unnest([{{'k': 1, 'p': peak_60}}, {{'k': 5, 'p': peak_300}}, {{'k': 20, 'p': peak_1200}}, {{'k': 60, 'p': peak_3600}}]) AS v FROM peaks) WHERE v.p IS NOT NULL")
def m8_power_curve_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.power_curve_map(records(spark, sf_dir)).select(m.KEY, F.explode("power_curve").alias("minutes", "power"))


@query(f"""WITH {RECORDS_SQL}, {_peaks_sql(PEAK_SECONDS)} SELECT workout_id, round((0.6 * peak_5 + 0.4 * peak_30) / {FTP}, 3) AS sprint_envelope,
  round((peak_180 + peak_300 + peak_480) / 3 / {FTP}, 3) AS vo2_envelope, round((peak_1200 + peak_3600) / 2 / {FTP}, 3) AS threshold_envelope FROM peaks""")
def m9_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.envelopes(m.peak_power(records(spark, sf_dir)), FTP)


_RUNS = """
o AS (SELECT *, coalesce({flag}, false) AS f FROM {source}),
g AS (SELECT *, row_number() OVER (PARTITION BY workout_id ORDER BY elapsed_sec) - row_number() OVER (PARTITION BY workout_id, f ORDER BY elapsed_sec) AS g FROM o)"""


@query(f"""WITH {RECORDS_SQL}, p AS (SELECT workout_id, elapsed_sec, power_watts FROM records WHERE power_watts IS NOT NULL), {_RUNS.format(flag=f'power_watts > 1.2 * {FTP}', source='p')},
r AS (SELECT workout_id, g FROM g WHERE f GROUP BY workout_id, g HAVING count(*) >= 3), n AS (SELECT workout_id, count(*) AS c FROM r GROUP BY workout_id),
d AS (SELECT workout_id, max(elapsed_sec) AS d FROM records GROUP BY workout_id)
SELECT workout_id, coalesce(c, 0) AS surge_count, round(c / (d / 3600), 3) AS surge_density FROM d LEFT JOIN n USING (workout_id)""")
def m12_surges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.surges(records(spark, sf_dir), FTP)


_HALF_NP = "round(pow(avg(pow({c}, 4)) {f}, 0.25), 1)"


@query(f"""WITH {RECORDS_SQL},
c AS (SELECT workout_id, count(power_watts) AS np, count(heart_rate_bpm) AS nh, max(elapsed_sec) AS d FROM records GROUP BY workout_id),
n AS (SELECT workout_id, least(np, nh) AS n, least(np, nh) // 2 AS mid FROM c WHERE d >= 1800 AND least(np, nh) >= 30),
p0 AS (SELECT workout_id, power_watts, row_number() OVER ({_W}) AS rn FROM records WHERE power_watts IS NOT NULL),
p1 AS (SELECT p0.*, rn > mid AS late FROM p0 JOIN n USING (workout_id) WHERE rn <= n),
p2 AS (SELECT workout_id, late,
  CASE WHEN count(*) OVER a = 30 THEN avg(power_watts) OVER a END AS whole, CASE WHEN count(*) OVER h = 30 THEN avg(power_watts) OVER h END AS half
  FROM p1 WINDOW a AS (PARTITION BY workout_id ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), h AS (PARTITION BY workout_id, late ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
p AS (SELECT workout_id, round(pow(avg(pow(whole, 4)), 0.25), 1) AS np, round(pow(avg(pow(half, 4)) FILTER (NOT late), 0.25), 1) AS np1, round(pow(avg(pow(half, 4)) FILTER (late), 0.25), 1) AS np2 FROM p2 GROUP BY workout_id),
h0 AS (SELECT workout_id, heart_rate_bpm AS b, row_number() OVER ({_W}) AS rn FROM records WHERE heart_rate_bpm IS NOT NULL),
h AS (SELECT workout_id, avg(b) AS h, avg(b) FILTER (rn <= mid) AS h1, avg(b) FILTER (rn > mid) AS h2 FROM h0 JOIN n USING (workout_id) WHERE rn <= n GROUP BY workout_id)
SELECT workout_id, round(np1 / h1, 3) AS ef_first_half, round(np2 / h2, 3) AS ef_second_half, round(np / h, 3) AS ef_overall, round(h2 - h1, 1) AS hr_drift_bpm,
  round(((np1 / h1) / (np2 / h2) - 1) * 100, 2) AS decoupling_pct FROM p JOIN h USING (workout_id)""")
def m15_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.efficiency(records(spark, sf_dir))


@query(f"""WITH {RECORDS_SQL},
p AS (SELECT workout_id, elapsed_sec, power_watts, row_number() OVER ({_W}) AS rn, count(*) OVER (PARTITION BY workout_id) // 4 AS q, count(*) OVER (PARTITION BY workout_id) AS n FROM records WHERE power_watts IS NOT NULL),
d AS (SELECT workout_id, max(elapsed_sec) AS d FROM records GROUP BY workout_id)
SELECT workout_id, round(regr_slope(power_watts, elapsed_sec), 5) AS durability_slope,
  round((avg(power_watts) FILTER (rn > n - q) - avg(power_watts) FILTER (rn <= q)) / any_value(d), 6) AS fatigue_rate FROM p JOIN d USING (workout_id) GROUP BY workout_id""")
def m16_durability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.durability(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT workout_id, round(stddev_samp(power_watts) / avg(power_watts), 3) AS power_cv, round(stddev_samp(cadence_rpm) / avg(cadence_rpm), 3) AS cadence_cv FROM records GROUP BY workout_id")
def a5_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.variability(records(spark, sf_dir))


def _steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose heart rate is known wherever power is, as the correlation needs."""
    return records(spark, sf_dir).where("heart_rate_bpm is not null")


@query(f"""WITH {RECORDS_SQL},
p AS (SELECT workout_id, power_watts AS p, heart_rate_bpm AS h, row_number() OVER ({_W}) AS rn FROM records WHERE power_watts IS NOT NULL AND heart_rate_bpm IS NOT NULL),
c AS (SELECT a.workout_id, lag, corr(a.p, b.h) AS c FROM p a CROSS JOIN (SELECT unnest(range(-60, 61)) AS lag) JOIN p b ON a.workout_id = b.workout_id AND b.rn = a.rn - lag GROUP BY a.workout_id, lag)
SELECT workout_id, arg_max(lag, (c, -lag))::INTEGER AS hr_power_lag_sec FROM c GROUP BY workout_id""")
def m18_hr_power_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.hr_power_lag(_steady(spark, sf_dir))


@query(f"""WITH {RECORDS_SQL}, d AS (SELECT workout_id, elevation_m - lag(elevation_m) OVER ({_W}) AS d FROM records)
SELECT workout_id, round(sum(greatest(d, 0)) FILTER (d IS NOT NULL), 1) AS elevation_gain_m, round(sum(greatest(-d, 0)) FILTER (d IS NOT NULL), 1) AS elevation_loss_m FROM d GROUP BY workout_id""")
def m19_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.elevation(records(spark, sf_dir))


_HR_CUTS = {"HRmax": [f"trunc({HR_MAX}::DOUBLE * {k}::DOUBLE)" for k in (0.6, 0.7, 0.8, 0.9)], "LTHR": [f"trunc({LTHR}::DOUBLE * {k}::DOUBLE)" for k in (0.68999, 0.83999, 0.94999, 1.05999)], "HRR": [f"trunc({HR_REST}::DOUBLE + ({HR_MAX} - {HR_REST})::DOUBLE * {k}::DOUBLE)" for k in (0.6, 0.7, 0.8, 0.9)]}


def _zones_sql(basis: str) -> str:
    h = "CASE WHEN heart_rate_bpm IS NULL THEN NULL " + " ".join(f"WHEN heart_rate_bpm <= {c} THEN {z}" for z, c in enumerate(_HR_CUTS[basis], 1)) + " ELSE 5 END"
    p = "CASE WHEN power_watts IS NULL OR power_watts < 0 OR power_watts >= 99999 THEN NULL " + " ".join(f"WHEN power_watts < trunc({FTP}::DOUBLE * {k}::DOUBLE) THEN {z}" for z, k in enumerate((0.55, 0.75, 0.90, 1.05, 1.20, 1.50), 1)) + " ELSE 7 END"
    return f"WITH {RECORDS_SQL}, z AS (SELECT workout_id, {h} AS h, {p} AS p FROM records) SELECT workout_id, " + ", ".join([f"count(*) FILTER (h = {z}) AS hr_z{z}_sec" for z in range(1, 6)] + ["count(h) AS hr_zone_total_sec"] + [f"count(*) FILTER (p = {z}) AS pwr_z{z}_sec" for z in range(1, 8)] + ["count(p) AS pwr_zone_total_sec", "count(*) FILTER (p <= 2) AS low_aerobic_sec", "count(*) FILTER (p >= 4) AS intensity_sec"]) + " FROM z GROUP BY workout_id"


@query(_zones_sql("HRmax"))
def a4_zone_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.zone_seconds(records(spark, sf_dir), PARAMS)


@query(_zones_sql("LTHR"))
def m20_zones_lthr(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = AthleteParams(ftp=FTP, lthr=LTHR, basis="LTHR")
    return m.zone_seconds(records(spark, sf_dir), reference)


@query(_zones_sql("HRR"))
def m20_zones_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.zone_seconds(records(spark, sf_dir), AthleteParams(ftp=FTP, hr_max=HR_MAX, hr_rest=HR_REST, basis="HRR"))


_HR_CUTS["no rest"] = [f"trunc(60 + ({HR_MAX} - 60)::DOUBLE * {k}::DOUBLE)" for k in (0.6, 0.7, 0.8, 0.9)]


@query(_zones_sql("no rest"))
def m20_zones_without_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.zone_seconds(records(spark, sf_dir), AthleteParams(ftp=FTP, hr_max=HR_MAX, basis="HRR"))


@query("""WITH f AS (SELECT o_orderkey, (150 + o_orderkey % 200)::DOUBLE AS ftp FROM orders),
c AS (SELECT o_orderkey, ftp, [0, trunc(ftp * 0.55::DOUBLE), trunc(ftp * 0.75::DOUBLE), trunc(ftp * 0.90::DOUBLE), trunc(ftp * 1.05::DOUBLE), trunc(ftp * 1.20::DOUBLE), trunc(ftp * 1.50::DOUBLE), ftp * 2] AS b FROM f)
SELECT o_orderkey, z::INTEGER AS zone, b[z]::DOUBLE AS low_w, b[z + 1]::DOUBLE AS high_w FROM c, (SELECT unnest(range(1, 8)) AS z)""")
def m22_power_zone_watts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ftp = (150 + F.col("o_orderkey") % 200).cast("double")
    zones = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.explode(m.power_zone_watts(ftp)).alias("z"))
    return zones.select("o_orderkey", "z.zone", "z.low_w", "z.high_w")


@query(f"""WITH {RECORDS_SQL}, {_RUNS.format(flag=f'power_watts >= 0.9 * {FTP}', source='(SELECT *, row_number() OVER (PARTITION BY workout_id ORDER BY elapsed_sec) - 1 AS rn FROM records)')},
r AS (SELECT workout_id, max(rn) AS e, min(elapsed_sec) AS start_sec, max(elapsed_sec) AS end_sec, round(avg(power_watts), 1) AS avg_power, round(max(power_watts), 1) AS peak_power FROM g WHERE f GROUP BY workout_id, g HAVING count(*) >= {INTERVAL_LEAST}),
a AS (SELECT r.workout_id, e, CASE WHEN count(*) >= 2 AND count(heart_rate_bpm) = count(*) THEN round(regr_slope(heart_rate_bpm, rn), 4) END AS recovery_hr_slope FROM r JOIN g ON r.workout_id = g.workout_id AND rn BETWEEN e + 1 AND e + 10 GROUP BY r.workout_id, e)
SELECT r.workout_id, start_sec, end_sec, (end_sec - start_sec + 1)::BIGINT AS duration_sec, avg_power, peak_power, recovery_hr_slope FROM r LEFT JOIN a ON r.workout_id = a.workout_id AND r.e = a.e""")
def m26_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.intervals(records(spark, sf_dir), FTP, rows=INTERVAL_LEAST, recovery=10)


_GRADE = f"""
s AS (SELECT *, lead(distance_m) OVER w - distance_m AS dd, lead(elevation_m) OVER w - elevation_m AS de, lead(elapsed_sec) OVER w AS nx FROM records WINDOW w AS ({_W})),
gr AS (SELECT *, CASE WHEN count(dd) OVER c >= 3 AND count(de) OVER c >= 3 AND sum(dd) OVER c > 0 THEN sum(de) OVER c / sum(dd) OVER c END AS grade
  FROM s WHERE nx IS NOT NULL WINDOW c AS ({_W} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))"""


@query(f"WITH {RECORDS_SQL}, {_GRADE} SELECT workout_id, elapsed_sec, round(grade, 6) AS grade FROM gr")
def w6_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.grades(records(spark, sf_dir)).select(m.KEY, m.TIME, F.round("grade", 6).alias("grade"))


@query(f"""WITH {RECORDS_SQL}, {_GRADE},
m1 AS (SELECT *, coalesce(grade >= 0.03, false) AS up, row_number() OVER ({_W}) AS rn FROM gr),
m2 AS (SELECT *, max(CASE WHEN up THEN rn END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS lst, min(CASE WHEN up THEN rn END) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM m1),
m3 AS (SELECT *, up OR coalesce(nxt - lst - 1 <= 1, false) AS b FROM m2), {_RUNS.format(flag='b', source='m3')}
SELECT workout_id, count(*) AS duration, round(avg(grade) * 100, 2) AS avg_grade, round(avg(power_watts), 1) AS avg_power,
  round(CASE WHEN avg(heart_rate_bpm) > 0 THEN avg(power_watts) / avg(heart_rate_bpm) END, 3) AS efficiency_factor, min(elapsed_sec) AS start_sec, max(elapsed_sec) AS end_sec,
  min(timestamp_utc) AS start_time_utc, max(timestamp_utc) AS end_time_utc, round(min(distance_m), 1) AS start_distance_m, round(max(distance_m), 1) AS end_distance_m
FROM g WHERE f GROUP BY workout_id, g HAVING count(*) >= 5""")
def m27_climbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.climbs(records(spark, sf_dir), gap=1, rows=5)


@query(f"""WITH {RECORDS_SQL}, o AS (SELECT workout_id, elapsed_sec, coalesce(power_watts > {FTP}, false) AS f, row_number() OVER ({_W}) AS rn FROM records),
n AS (SELECT *, max(CASE WHEN f THEN rn END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS lst, min(CASE WHEN f THEN rn END) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM o)
SELECT workout_id, elapsed_sec, f OR coalesce(nxt - lst - 1 <= 2, false) AS hard FROM n""")
def w7_bridged_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select(m.KEY, m.TIME, (F.col("power_watts") > FTP).alias("hard"))
    return s.bridge_gaps(r, "hard", m.KEY, m.TIME, 2)


@query(f"""WITH {RECORDS_SQL}, {_RUNS.format(flag=f'power_watts >= {FTP}', source='records')}
SELECT workout_id, min(elapsed_sec)::BIGINT AS run_start, max(elapsed_sec)::BIGINT AS run_end, count(*) AS run_rows FROM g WHERE f GROUP BY workout_id, g HAVING count(*) >= 2""")
def w5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.runs(records(spark, sf_dir), F.col("power_watts") >= FTP, m.KEY, m.TIME, least=2)
    return found.select(m.KEY, *[F.col(c).cast("long").alias(c) for c in ("run_start", "run_end", "run_rows")])


@query(f"""WITH {USER_RECORDS_SQL}, x AS (SELECT workout_id, epoch_us(timestamp_utc) / 1e6 AS t FROM records),
g AS (SELECT workout_id, t, t - lag(t) OVER (PARTITION BY workout_id ORDER BY t) AS g FROM x)
SELECT workout_id, count(*) FILTER (g > 1.01) AS gap_count, round(max(g), 3) AS max_gap_sec, coalesce(sum(greatest(round(g) - 1, 0)), 0)::BIGINT AS inserted_bins,
  round(CASE WHEN max(t) > min(t) THEN sum(greatest(round(g) - 1, 0)) / (max(t) - min(t)) * 100 END, 3) AS distortion_pct FROM g GROUP BY workout_id""")
def a22_sampling_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.distortion(s.time_axis(records_by_user(spark, sf_dir), m.KEY), m.KEY, "axis_sec")


@query(f"WITH {RECORDS_SQL}, g AS (SELECT workout_id, abs(elapsed_sec - lag(elapsed_sec) OVER ({_W}) - 1) <= 0.01 AS ok FROM records WHERE event_id % 1000 <> 1) SELECT workout_id, coalesce(bool_and(ok), true) AS regular FROM g GROUP BY workout_id")
def t2_regular_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.is_regular(records(spark, sf_dir).where("event_id % 1000 <> 1"), m.KEY, m.TIME)


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT * FROM records WHERE event_id % 3 <> 0),
b AS (SELECT workout_id, floor(elapsed_sec / 2)::BIGINT AS t, avg(power_watts) AS power_watts, avg(heart_rate_bpm) AS heart_rate_bpm, arg_max(distance_m, elapsed_sec) AS d FROM r GROUP BY ALL),
e AS (SELECT workout_id, unnest(range(min(t), max(t) + 1)) AS t FROM b GROUP BY workout_id)
SELECT e.workout_id, e.t::DOUBLE AS elapsed_sec, round(power_watts, 6) AS power_watts, round(heart_rate_bpm, 6) AS heart_rate_bpm,
  last_value(d IGNORE NULLS) OVER (PARTITION BY e.workout_id ORDER BY e.t ROWS UNBOUNDED PRECEDING) AS distance_m FROM e LEFT JOIN b ON e.workout_id = b.workout_id AND e.t = b.t""")
def t4_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    halved = records(spark, sf_dir).where("event_id % 3 <> 0").withColumn("elapsed_sec", F.col("elapsed_sec") / 2)
    out = s.resample(halved, m.KEY, m.TIME, ["power_watts", "heart_rate_bpm"], ["distance_m"])
    return out.select(m.KEY, m.TIME, F.round("power_watts", 6).alias("power_watts"), F.round("heart_rate_bpm", 6).alias("heart_rate_bpm"), "distance_m")


@query(f"WITH {RECORDS_SQL} SELECT workout_id, round(avg(heart_rate_bpm), 6) AS hr_avg, max(heart_rate_bpm) AS hr_max, round(avg(power_watts), 6) AS power_avg, max(power_watts) AS power_max, round((1 - count(heart_rate_bpm) / count(*)) * 100, 6) AS hr_missing_pct, round((1 - count(power_watts) / count(*)) * 100, 6) AS power_missing_pct FROM records GROUP BY workout_id")
def a23_basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.basic_stats(records(spark, sf_dir))
    return out.select(m.KEY, *[F.round(c, 6).alias(c) if c not in ("hr_max", "power_max") else F.col(c) for c in out.columns if c != m.KEY])


@query(f"WITH {RECORDS_SQL} SELECT workout_id, max(distance_m) AS max_distance_m, arg_max(distance_m, elapsed_sec) AS last_distance_m FROM records WHERE distance_m IS NOT NULL GROUP BY workout_id")
def a30_distance_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records(spark, sf_dir).where("distance_m is not null")
    return own.groupBy(m.KEY).agg(F.max("distance_m").alias("max_distance_m"), F.max_by("distance_m", "elapsed_sec").alias("last_distance_m"))


@query(f"WITH {USER_RECORDS_SQL} SELECT workout_id, elapsed_sec, last_value(power_watts IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS power_watts FROM records")
def w13_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_by_user(spark, sf_dir).select(m.KEY, m.TIME, s.forward_fill(F.col("power_watts"), m.by_time()).alias("power_watts"))


@query(f"WITH {USER_RECORDS_SQL}, p AS (SELECT * FROM records WHERE power_watts IS NOT NULL) SELECT workout_id, elapsed_sec, round(CASE WHEN count(*) OVER w = 30 THEN avg(power_watts) OVER w END, 6) AS mean_30 FROM p WINDOW w AS ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def w1_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records_by_user(spark, sf_dir).where("power_watts is not null")
    return own.select(m.KEY, m.TIME, F.round(s.trailing_mean(F.col("power_watts"), m.by_time(), 30), 6).alias("mean_30"))


@query(f"WITH {USER_RECORDS_SQL} SELECT workout_id, elapsed_sec, ntile AS quarter FROM (SELECT workout_id, elapsed_sec, CASE WHEN rn <= n // 4 THEN 1 WHEN rn > n - n // 4 THEN 4 END AS ntile FROM (SELECT workout_id, elapsed_sec, row_number() OVER ({_W}) AS rn, count(*) OVER (PARTITION BY workout_id) AS n FROM records))")
def w4_outer_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rn = F.count("*").over(Window.partitionBy(m.KEY)), F.row_number().over(m.by_time())
    own = records_by_user(spark, sf_dir).select(m.KEY, m.TIME, n.alias("n"), rn.alias("rn"))
    quarter = F.floor(F.col("n") / 4)
    return own.select(m.KEY, m.TIME, F.when(F.col("rn") <= quarter, 1).when(F.col("rn") > F.col("n") - quarter, 4).alias("quarter"))


def _wide_sql() -> str:
    """The families' own SQL, joined; a lag only where heart rate is known wherever power is."""
    missing = SQL["a2_missing_pct"].replace(USER_RECORDS_SQL, RECORDS_SQL)
    lag = f"""WITH {RECORDS_SQL}, k AS (SELECT workout_id FROM records WHERE power_watts IS NOT NULL GROUP BY workout_id HAVING count(heart_rate_bpm) = count(*))
SELECT * FROM ({SQL["m18_hr_power_lag"]}) SEMI JOIN k USING (workout_id)"""
    load = f"SELECT * EXCLUDE (power_avg, duration_sec) FROM ({SQL['m2_training_load']})"
    parts = [load, missing, *[SQL[n] for n in ("a4_zone_seconds", "a5_variation", "m16_durability", "m12_surges", "m15_efficiency")], lag, *[SQL[n] for n in ("m19_elevation", "m6_peak_power", "m9_envelopes")]]
    return f"SELECT * FROM ({SQL['a1_channel_stats']})" + "".join(f" LEFT JOIN ({p}) USING (workout_id)" for p in parts)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families of records that are numbered and stored once: no family numbers them anew."""
    return m.workout_metrics(stored(m.dealt(records(spark, sf_dir)), "dealt"), PARAMS)


@query(_wide_sql())
def d13_workout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row of all families."""
    return _wide(spark, sf_dir)


_FAMILY_COLUMNS = [c for columns in m.FAMILIES.values() for c in columns]


@query(f"SELECT workout_id, {', '.join(_FAMILY_COLUMNS)} FROM ({_wide_sql()})")
def p7_nested_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families as nested columns, and flat again."""
    return m.flat(m.nested(_wide(spark, sf_dir))).select(m.KEY, *_FAMILY_COLUMNS)


@query(f"""WITH {USER_RECORDS_SQL}, s AS (SELECT workout_id, min(timestamp_utc) AS first, round(avg(speed_mps), 2) AS speed_avg, max(speed_mps) AS speed_max FROM records GROUP BY workout_id)
SELECT workout_id, CASE WHEN workout_id::BIGINT % 3 = 0 THEN TIMESTAMP '2024-02-02' ELSE first END AS start_time_utc, CASE WHEN workout_id::BIGINT % 4 = 0 THEN 300.0 END::DOUBLE AS calories_kcal, speed_avg AS avg_speed_mps, speed_max AS max_speed_mps FROM s""")
def m28_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, k = records_by_user(spark, sf_dir), F.col("workout_id").cast("long")
    known = r.select("workout_id").distinct().where(k % 12 != 1)
    metadata = known.select("workout_id", F.when(k % 3 == 0, F.lit("2024-02-02").cast("timestamp")).alias("start_time_utc"), F.when(k % 4 == 0, 300.0).alias("calories_kcal"))
    return m.passthrough(r, metadata)


_CLIMB_RUNS = SQL["m27_climbs"].partition("SELECT workout_id, count(*) AS duration")[0]
_POSITIONS = {"position_lat": "(event_id % 170 - 85) / 1.7::DOUBLE", "position_long": "(event_id % 350 - 175) / 1.3::DOUBLE"}


@query(_CLIMB_RUNS + "SELECT workout_id, min(elapsed_sec) AS start_sec, " + ", ".join(f"round({f}({sql}, elapsed_sec), 6) AS {side}_{c}" for side, f in (("start", "arg_min"), ("end", "arg_max")) for c, sql in _POSITIONS.items()) + " FROM g WHERE f GROUP BY workout_id, g HAVING count(*) >= 5")
def f33_climb_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where climbs begin and end: positions pass through as they are."""
    k = F.col("event_id")
    placed = records(spark, sf_dir).withColumn("position_lat", (k % 170 - 85) / 1.7).withColumn("position_long", (k % 350 - 175) / 1.3)
    return m.climbs(placed, gap=1, rows=5).select(m.KEY, "start_sec", *[f"{side}_{c}" for side in ("start", "end") for c in _POSITIONS])


#: One athlete with all events as one stream; its readings in order of time.
_STREAM = "s AS (SELECT 'all' AS athlete_id, event_id, ts, CASE WHEN event_id % 17 <> 0 THEN value END AS value, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events)"
_LONG_PEAKS = [1, 60, 1200, 3600]


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value")
    return table(spark, sf_dir, "events").select(F.lit("all").alias("athlete_id"), "event_id", "ts", value)


@query(f"""WITH {_STREAM}, v AS (SELECT *, row_number() OVER w AS n FROM s WHERE value IS NOT NULL WINDOW w AS (ORDER BY ts, event_id)),
m AS (SELECT {", ".join(f"CASE WHEN n >= {w} THEN avg(value) OVER (ORDER BY ts, event_id ROWS {w - 1} PRECEDING) END AS a{w}" for w in _LONG_PEAKS)} FROM v)
SELECT 'all' AS athlete_id, {", ".join(f"round(max(a{w}), 6) AS peak_{w}" for w in _LONG_PEAKS)} FROM m""")
def w2_long_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak means over one key that holds every row: no task has them all."""
    out = blocks.peak_means(_stream(spark, sf_dir), "value", "athlete_id", "ts", _LONG_PEAKS, ["event_id"], span=86_400, rows=4096)
    return out.select("athlete_id", *[F.round(f"peak_{w}", 6).alias(f"peak_{w}") for w in _LONG_PEAKS])


@query(f"""WITH {_STREAM}, f AS (SELECT *, coalesce(value >= 20, false) AS f FROM s), g AS (SELECT *, rn - row_number() OVER (PARTITION BY f ORDER BY ts, event_id) AS g FROM f)
SELECT 'all' AS athlete_id, min(rn) AS run_start, max(rn) AS run_end, count(*) AS run_rows, max(value) AS best FROM g WHERE f GROUP BY g HAVING count(*) >= 3""")
def w5_long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in one key that holds every row."""
    found = blocks.runs(_stream(spark, sf_dir), F.col("value") >= 20, "athlete_id", "ts", ["event_id"], [F.max("value").alias("best")], 3, span=86_400)
    return found.select("athlete_id", *[F.col(c).cast("long").alias(c) for c in ("run_start", "run_end", "run_rows")], "best")


@query(f"""WITH {_STREAM} SELECT event_id, round(sum(value) OVER (ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW), 4) AS load_7d FROM s""")
def w9_event_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load of the seven days before each reading, in one key that holds every row."""
    return blocks.rolling_sum(_stream(spark, sf_dir), "value", "athlete_id", "ts", 604_800, "load_7d").select("event_id", F.round("load_7d", 4).alias("load_7d"))
