"""Rollups, lookups, resolution, state and functions on hand-made rows."""

import datetime as dt
import gzip
import re

import pytest
from pyspark.sql import functions as F

from tempora.functions import dates, numbers, text, zones
from tempora.operators import blocks, lookup, quality, resolve, rollups, state
from tempora.sources import files, ledger


def weeks(spark):
    zones = {f"hr_z{z}_sec": 0 for z in range(1, 6)} | {f"pwr_z{z}_sec": 0 for z in range(1, 8)}
    base = {"athlete_id": "a", **zones}
    rows = [
        base | {"start_time_utc": dt.datetime(2026, 2, 10, 10), "duration_sec": 3600.0, "distance_m": 50000.0, "elevation_gain_m": 700.0, "hr_z2_sec": 2400, "pwr_z2_sec": 2100, "pwr_z4_sec": 600, "decoupling_pct": 3.0},
        base | {"start_time_utc": dt.datetime(2026, 2, 12, 8), "duration_sec": 5400.0, "distance_m": 70000.0, "elevation_gain_m": 900.0, "hr_z2_sec": 3900, "pwr_z2_sec": 3300, "pwr_z4_sec": 420, "decoupling_pct": 2.0},
    ]
    schema = "athlete_id string, start_time_utc timestamp, duration_sec double, distance_m double, elevation_gain_m double, decoupling_pct double, " + ", ".join(f"{z} long" for z in zones)
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)


def test_weekly_rollup(spark):
    r = rollups.weekly(weeks(spark)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.workout_count, r.total_duration_min, r.total_distance_km, r.total_elevation_m) == (2, 150.0, 120.0, 1600.0)
    assert (r.hr_z2_min, r.pwr_z2_min, r.intensity_min, r.avg_decoupling_pct, r.hard_days, r.long_days) == (105.0, 90.0, 17.0, 2.5, 2, 1)


def test_local_week_over_a_clock_change(spark):
    now = F.lit("2026-03-10 12:00:00").cast("timestamp")
    first, last = rollups.local_week_bounds(now, "America/New_York")
    r = spark.range(1).select(first.cast("string").alias("a"), last.cast("string").alias("b"), rollups.week_key(F.lit("2026-03-02").cast("timestamp")).alias("k")).first()
    assert tuple(r) == ("2026-03-02 05:00:00", "2026-03-09 03:59:59", "2026-10")


def test_zone_shares_sum_up(spark):
    shares = [r.pct for r in rollups.zone_distribution(weeks(spark)).collect()]
    assert 99 <= sum(shares) <= 101


def test_rolling_sums_span_eight_and_twenty_nine_days(spark):
    days = [(dt.datetime(2026, 3, d, 9), t) for d, t in ((31, 30.0), (24, 50.0), (23, 40.0), (3, 15.0), (2, 99.0))]
    w = spark.createDataFrame([("a", t, x) for t, x in days], "athlete_id string, start_time_utc timestamp, tss double")
    one, last = state.rolling_at(w, "2026-03-31").first(), state.rolling(w, "2026-03-30", "2026-03-31").orderBy(F.desc("day")).first()
    assert (one.tss_7d, one.tss_28d) == (last.tss_7d, last.tss_28d) == (80.0, 135.0)


def test_readiness(spark):
    row = spark.range(1).select(*[state.readiness(F.lit(h), F.lit(f)).alias(n) for n, h, f in (("a", 3.5, 1.0), ("b", 3.5, None), ("c", 3.5, 0.0))]).first()
    assert row.a == pytest.approx(58.33333333333333) and row.b is None and row.c is None


def test_precedence_and_recency(spark):
    rows = spark.createDataFrame(
        [("a", "withings", 73.2, None), ("a", "garmin", 80.0, 320.0), ("a", "intervals", None, 300.0)], "athlete_id string, data_source string, weight_kg double, ftp_watts double"
    ).select("*", F.lit("2026-03-05").cast("date").alias("effective_date"), F.lit("2026-03-05").cast("timestamp").alias("updated_at_utc"), F.col("data_source").alias("row_key"))
    got = {r.metric: (r.value, r.data_source) for r in resolve.by_precedence(rows, ["athlete_id"], ["weight_kg", "ftp_watts"], {"weight_kg": ["withings", "garmin"], "ftp_watts": ["garmin", "intervals"]}, []+["garmin"]).collect()}
    assert got == {"weight_kg": (73.2, "withings"), "ftp_watts": (320.0, "garmin")}
    newest = {r.metric: r.value for r in resolve.by_recency(rows, ["athlete_id"], ["weight_kg"], ["garmin", "withings"]).collect()}
    assert newest == {"weight_kg": 80.0}
    day = resolve.consolidate_days(rows, ["weight_kg", "ftp_watts"], {"weight_kg": ["withings"], "ftp_watts": ["garmin"]}, ["garmin"]).first()
    assert (day.weight_kg, day.ftp_watts, day.data_sources) == (73.2, 320.0, "garmin,intervals,withings")


def test_as_of_falls_back_to_the_future(spark):
    w = spark.createDataFrame([("a", dt.datetime(2026, 1, 1)), ("a", dt.datetime(2026, 3, 1)), ("b", None)], "athlete_id string, start_time_utc timestamp")
    p = spark.createDataFrame([("a", dt.date(2026, 2, 1), "garmin", dt.datetime(2026, 2, 1), "k", 250.0)], "athlete_id string, effective_date date, data_source string, updated_at_utc timestamp, row_key string, ftp_watts double")
    got = lookup.preferred_as_of(w, p, "athlete_id", "start_time_utc", ["manual"], ["ftp_watts"]).collect()
    assert sorted((r.athlete_id, r.ftp_watts) for r in got if r.athlete_id == "a") == [("a", 250.0), ("a", 250.0)] and len(got) == 3


def test_near_duplicates_cross_a_bucket_edge(spark):
    rows = [("a", k, dt.datetime(2026, 1, 1, 0, minute, sec), d) for k, minute, sec, d in ((1, 9, 59, 100.0), (2, 19, 59, 250.0), (3, 20, 0, None), (4, 9, 59, 900.0))]
    df = spark.createDataFrame(rows, "athlete_id string, id int, t timestamp, d double")
    got = {(r.key_a, r.key_b) for r in lookup.near_duplicate_pairs(df, "athlete_id", "t", "id", "d").collect()}
    assert got == {(1, 2), (2, 3)}


def test_text_and_dates(spark):
    row = spark.range(1).select(
        dates.offset_minutes(F.lit("utc-05:30")).alias("a"), dates.offset_minutes(F.lit("EST")).alias("b"), text.is_indoor(F.lit(" ")).alias("c"),
        text.file_parts(F.lit("2026-01-02-030405-Indoor-Cycling-Watch7,1.fit.gz"))["device"].alias("d"), text.file_parts(F.lit("x.fit")).alias("e"), numbers.number(F.lit("1e999")).alias("f"),
    ).first()
    assert tuple(row) == (-330, None, None, "Watch7,1", None, None)


def test_device_files_are_unpacked_or_set_aside(spark, tmp_path):
    good = bytes([14, 16, 0, 0, 0, 0, 0, 0]) + b".FIT" + b"body"
    (tmp_path / "a.fit").write_bytes(good)
    (tmp_path / "b.fit.gz").write_bytes(gzip.compress(good))
    (tmp_path / "c.fit").write_bytes(b"no")
    (tmp_path / "d.fit.gz").write_bytes(gzip.compress(good)[:-9])
    got = {r.path.rpartition("/")[2]: (r.kind, bytes(r.content) if r.content else None, r.error is None) for r in files.device_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.fit"] == ("plain", good, True) and got["b.fit.gz"] == ("gzip", good, True)
    assert not got["c.fit"][2] and not got["d.fit.gz"][2]


def test_upsert_and_merge(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 5, "d"), (3, 0, None)], "k int, v int, x string")
    assert sorted(map(tuple, ledger.upsert(old, new, ["k"], "v").collect())) == [(1, 2, "c"), (2, 5, "d"), (3, 0, None)]
    assert sorted(map(tuple, ledger.merge(old, new.drop("v"), ["k"]).select("k", "v", "x").collect(),), key=lambda r: r[0]) == [(1, 1, "c"), (2, 5, "d"), (3, None, None)]


def test_contract(spark):
    schema = "file int, name string, kind string, position int, timestamp timestamp, total_elapsed_time double, total_timer_time double, num_sessions int"
    t = dt.datetime(2026, 1, 1)
    rows = [(1, "file_id", "Activity", 0, t, None, None, None), (1, "session", None, 0, t, 10.0, 9.0, None), (1, "record", None, 0, t, None, None, None), (1, "activity", None, 0, t, None, 10.5, 1), (2, "record", None, 0, t, None, None, None), (2, "record", None, 1, t - dt.timedelta(1), None, None, None)]
    got = {r.file: r.violations for r in quality.contract_violations(spark.createDataFrame(rows, schema), "file").collect()}
    assert got == {2: ["one_file_id", "session_missing", "record_order"]}


def test_contract_of_many_files_is_many_tasks(spark, monkeypatch):
    """Tasks follow the messages, not the session's partitions, and each message is dealt and sorted once."""
    monkeypatch.setattr(blocks, "TASK_ROWS", 100)
    file, back = F.floor(F.col("id") / 10), F.col("id") % 70 == 5
    at = F.timestamp_seconds(F.col("id") - F.when(back, 3).otherwise(0))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("total_elapsed_time", "double"), ("total_timer_time", "double"), ("num_sessions", "int"))]
    rows = spark.range(3000).select(file.alias("file"), F.lit("record").alias("name"), F.struct("id").alias("position"), at.alias("timestamp"), *nothing)
    found = quality.contract_violations(rows, "file")
    assert found.rdd.getNumPartitions() == 31
    got = {r.file: "record_order" in r.violations for r in found.collect()}
    assert got == {k: any(i % 70 == 5 for i in range(10 * k, 10 * k + 10)) for k in range(300)}
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bSort \[", plan)) == 1


def test_weeks_without_zones_have_zero_minutes(spark):
    zones = ", ".join(f"{k}_z{z}_sec long" for k, n in (("hr", 5), ("pwr", 7)) for z in range(1, n + 1))
    rows = [(1, dt.datetime(2026, 2, 10), None, None, 10.0 / 3, None, *[None] * 12), (1, dt.datetime(2026, 2, 11), 60.0, None, 1.0, None, *[None] * 11, 400)]
    w = spark.createDataFrame(rows, f"athlete_id int, start_time_utc timestamp, duration_sec double, distance_m double, elevation_gain_m double, decoupling_pct double, {zones}")
    got = rollups.weekly(w).collect()[0]
    assert (got.workout_count, got.total_duration_min, got.hr_z2_min, got.pwr_z2_min, got.low_aerobic_min) == (2, 1.0, 0.0, 0.0, 0.0)
    assert (got.total_elevation_m, got.intensity_min, got.hard_days, got.long_days, got.total_distance_km) == (4.33, 6.67, 1, 0, None)


@pytest.mark.parametrize("day,minutes,zone", [("2026-07-15", -420, "America/Los_Angeles"), ("2026-01-15", 0, "Europe/London"), ("2026-01-15", -300, "America/New_York"), ("2026-07-15", -240, "America/New_York"), ("2026-01-15", 540, "Asia/Tokyo"), ("2026-01-15", -180, "America/Santiago"), ("2026-01-15", 17, None)])
def test_zone_of_an_offset_by_rule(spark, day, minutes, zone):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(day), minutes)], "t timestamp, m int")
    assert zones.with_zone(df, F.col("t"), F.col("m"), F.lit("Asia/Kolkata"), "z").first().z == zone


def test_computed_load_fills_what_the_table_lacks(spark):
    w = spark.createDataFrame([(1, 9, dt.datetime(2026, 3, 5), 30.0), (2, 9, dt.datetime(2026, 3, 5), None), (3, 9, dt.datetime(2026, 3, 6), None)], "workout_id int, athlete_id int, start_time_utc timestamp, tss double")
    computed = spark.createDataFrame([(1, 99.0), (2, 50.0)], "workout_id int, tss double")
    assert [(r.day.day, r.tss) for r in state.daily_tss(w, computed).orderBy("day").collect()] == [(5, 80.0)]
    assert [r.tss for r in state.daily_tss(w).collect()] == [30.0]


def test_rolling_sums_need_no_spine_in_a_shuffle(spark):
    """Sums of sparse and of dense athletes and of nobody, against plain sums; no day without a workout is joined or sorted."""
    last = dt.datetime(2026, 3, 31, 5)
    own = {"dense": {k: float(k % 5 + 1) for k in range(60)}, "sparse": {0: 7.5, 8: 2.0, 36: 4.0}, "early": {39: 9.0, 70: 5.0}, None: {1: 3.0}}
    rows = [(a, last - dt.timedelta(days=k), v) for a, days in own.items() for k, v in days.items()]
    found = state.rolling(spark.createDataFrame(rows, "athlete_id string, start_time_utc timestamp, tss double"), "2026-03-20", "2026-03-31")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    got = {(r.athlete_id, r.day): (r.tss, r.tss_7d, r.tss_28d) for r in found.collect()}
    load = lambda a, k, n: sum(own[a].get(i, 0.0) for i in range(k, k + n + 1)) if a else 0.0
    assert got == {(a, (last - dt.timedelta(days=k)).date()): tuple(load(a, k, n) for n in (0, 7, 28)) for a in own for k in range(12)}


def test_code_tables_come_from_files(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("kind,manufacturer,code,name\nproduct,1,7,b\nproduct,1,7,a\nproduct,2,7,c\nmanufacturer,1,1,maker\nproduct,1,,none\n")
    codes = files.read_codes(spark, f"file://{tmp_path}", "product")
    assert sorted(map(tuple, codes.collect())) == [(1, 7, "a"), (2, 7, "c")]
    rows = spark.createDataFrame([(7,), (8,)], "code int")
    got = lookup.code_names(rows, codes.where("manufacturer = 1"), "code", "product", "name", "device").orderBy("code").collect()
    assert [r.device for r in got] == ["a", "8"]
