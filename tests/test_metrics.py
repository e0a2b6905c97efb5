"""Behaviour on small hand-made workouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions.numbers import rounded
from tempora.operators import metrics as m
from tempora.operators import sequence as s
from tempora.params import AthleteParams, resolve_ftp


def workout(spark, power=None, hr=None, step=1.0, **more):
    n = len(power or hr)
    columns = {"power_watts": power or [None] * n, "heart_rate_bpm": hr or [None] * n, **more}
    rows = [("w", i * step, *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
    schema = "workout_id string, elapsed_sec double, " + ", ".join(f"{c} double" for c in columns)
    return m.with_channels(spark.createDataFrame(rows, schema)).withColumn("timestamp_utc", F.timestamp_seconds("elapsed_sec"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_means(spark):
    r = one(m.channel_stats(workout(spark, [100, 150, 200, 180, 160], [120, 125, 130, 128, 126])))
    assert (r.power_avg, r.hr_avg, r.n_records, r.duration_sec) == (158.0, 125.8, 5, 4.0)


def test_resample_fills_the_spine(spark):
    w = workout(spark, [100, 150, 200, 180, 160], [120, 125, 130, 128, 126], step=2.0)
    assert not one(s.is_regular(w, "workout_id", "elapsed_sec")).regular
    full = s.resample(w, "workout_id", "elapsed_sec", ["power_watts"], ["distance_m"])
    assert full.count() == 9
    assert one(full.agg(F.round(F.avg("power_watts"), 1).alias("p"))).p == 158.0


def test_irregular_groups_are_resampled_and_regular_ones_kept(spark):
    w = workout(spark, [1, 2, 3], step=3.0).union(workout(spark, [1, 2, 3]).withColumn("workout_id", F.lit("v")))
    out = s.require_regular(w, "workout_id", "elapsed_sec", ["power_watts"], ["distance_m"])
    assert {r["workout_id"]: r["count"] for r in out.groupBy("workout_id").count().collect()} == {"w": 7, "v": 3}


def test_one_row_too_many_is_nothing_missing(spark):
    w = workout(spark, [220] * 1001, [140] * 1001)
    r = one(m.data_quality(w))
    assert (r.hr_missing_pct, r.power_missing_pct, r.cadence_missing_pct) == (0.0, 0.0, None)


def test_zone_edges(spark):
    r = one(m.zone_seconds(workout(spark, hr=[30, 50, 100, 199, 220]), AthleteParams(hr_max=200)))
    assert (r.hr_z1_sec, r.hr_z5_sec, r.hr_zone_total_sec) == (3, 2, 5)


def test_lag_follows_the_slices(spark):
    wave = [0] * 40 + [100] * 7 + [0] * 60 + [80] * 11 + [0] * 60
    late = [100 + (wave[i - 15] if i >= 15 else 0) for i in range(len(wave))]
    assert one(m.hr_power_lag(workout(spark, wave, late))).hr_power_lag_sec == -15


def test_lag_needs_rows_and_heart_rate(spark):
    assert one(m.hr_power_lag(workout(spark, [1, 2, 3], [1, 2, 3]))).hr_power_lag_sec is None
    assert one(m.hr_power_lag(workout(spark, list(range(20)), [None] + [100] * 19))).hr_power_lag_sec is None


def test_constant_power(spark):
    w = workout(spark, [200] * 60)
    assert one(m.normalized_power(w)).normalized_power == 200.0
    assert m.normalized_power(workout(spark, [200] * 29)).collect()[0].normalized_power is None
    p = one(m.peak_power(w))
    assert (p.peak_5, p.peak_30, p.peak_180) == (200.0, 200.0, None)


def test_surges_and_density(spark):
    r = one(m.surges(workout(spark, [100, 400, 400, 400, 100, 400, 400, 100, None, 400, None, 400, 400]), 250))
    assert r.surge_count == 2 and r.surge_density == pytest.approx(2 / (12 / 3600), abs=1e-3)
    none = one(m.surges(workout(spark, [100] * 5), 250))
    assert (none.surge_count, none.surge_density) == (0, None)


def test_interval_and_recovery(spark):
    w = workout(spark, [100] * 5 + [300] * 60 + [100] * 5, [120] * 65 + [150, 148, 146, 144, 142])
    r = one(m.intervals(w, 250))
    assert (r.start_sec, r.end_sec, r.duration_sec, r.avg_power, r.peak_power, r.recovery_hr_slope) == (5.0, 64.0, 60, 300.0, 300.0, -2.0)


def test_climb(spark):
    n = 200
    up = [0.0] * 50 + [0.5 * i for i in range(1, 101)] + [50.0] * 50
    w = workout(spark, [200] * n, [150] * n, distance_m=[i * 10.0 for i in range(n)], elevation_m=up)
    r = one(m.climbs(w))
    assert 95 <= r.duration <= 110 and 4.0 < r.avg_grade <= 5.0 and r.avg_power == 200.0 and r.efficiency_factor == 1.333


def test_bridged_gaps(spark):
    flags = [True, False, True, False, False, True, False]
    df = spark.createDataFrame([("w", i, f) for i, f in enumerate(flags)], "k string, t int, f boolean")
    out = [r.f for r in s.bridge_gaps(df, "f", "k", "t", 1).orderBy("t").collect()]
    assert out == [True, True, True, False, False, True, False]


def test_ftp_and_hr_reference(spark):
    df = spark.range(1)
    row = df.select(resolve_ftp(0, None, 210).alias("a"), resolve_ftp(None).alias("b"), m.hr_reference(AthleteParams(lthr=160, cycling_lthr=155, basis="LTHR"), F.lit("Road cycling")).alias("c"), m.hr_reference(AthleteParams(), observed=F.lit(188.0)).alias("d")).first()
    assert tuple(row) == (210.0, 250.0, 155.0, 188.0)


def test_empty_and_absent_channels(spark):
    bare = spark.createDataFrame([], "workout_id string, elapsed_sec double")
    assert m.workout_metrics(m.dealt(bare), AthleteParams()).count() == 0
    row = one(m.workout_metrics(m.dealt(spark.createDataFrame([("w", 0.0), ("w", 1.0)], "workout_id string, elapsed_sec double")), AthleteParams()))
    assert (row.normalized_power, row.tss, row.hr_zone_total_sec, row.surge_count) == (None, None, 0, 0)


def test_reserve_zones_without_a_resting_rate_take_sixty(spark):
    df = spark.createDataFrame([("w", float(i), hr) for i, hr in enumerate([100.0, 150.0, 160.0, 180.0, None])], "workout_id string, elapsed_sec double, heart_rate_bpm double")
    seconds = lambda p: [one(m.zone_seconds(m.with_channels(df), p))[f"hr_z{z}_sec"] for z in range(1, 6)]
    assert seconds(AthleteParams(hr_max=190.0, basis="HRR")) == seconds(AthleteParams(hr_max=190.0, hr_rest=60.0, basis="HRR")) == [1, 1, 1, 0, 1]
    empty = spark.createDataFrame([("w", 0.0, None)], "workout_id string, elapsed_sec double, heart_rate_bpm double")
    assert one(m.zone_seconds(m.with_channels(empty), AthleteParams(basis="HRR"))).hr_zone_total_sec == 0


def test_bridged_gaps_against_a_loop(spark):
    rng = np.random.default_rng(2)
    flags = [[None, False, True][k] for k in rng.integers(0, 3, 400)]
    df = spark.createDataFrame([("w", float(i), f) for i, f in enumerate(flags)], "workout_id string, elapsed_sec double, up boolean")
    got = [r.up for r in s.bridge_gaps(df, "up", "workout_id", "elapsed_sec", 2).orderBy("elapsed_sec").collect()]
    on, want = [i for i, f in enumerate(flags) if f], [bool(f) for f in flags]
    for a, b in zip(on, on[1:]):
        if b - a - 1 <= 2:
            want[a:b] = [True] * (b - a)
    assert got == want


def test_strict_records_are_an_error(spark):
    df = spark.createDataFrame([("a", float(t), 1.0) for t in range(3)] + [("b", t, 1.0) for t in (0.0, 2.0)], "workout_id string, elapsed_sec double, power_watts double")
    assert s.require_regular(df.where("workout_id = 'a'"), "workout_id", "elapsed_sec", ["power_watts"], [], strict=True).count() == 3
    with pytest.raises(ValueError, match="one row a second: b"):
        s.require_regular(df, "workout_id", "elapsed_sec", ["power_watts"], [], strict=True).collect()


def test_parameters_of_a_configuration(spark, tmp_path):
    import json

    from tempora.params import params_from
    from tempora.sources.files import read_config

    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"power": {"ftp_watts": 301}, "heart_rate": {"basis": "LTHR", "lthr_bpm": 171, "hr_max_bpm": None}}))
    assert params_from(read_config(spark, f"file://{path}")) == AthleteParams(ftp=301, lthr=171, basis="LTHR")
    assert params_from({"ftp_watts": 200}) == AthleteParams(ftp=200) and params_from({}) == AthleteParams()


def test_means_on_a_half_round_up_whatever_the_last_bit(spark):
    """Powers whose sum is 161.1 and whose mean, 26.85, comes out as 26.849999999999998."""
    power = [7.58, 42.52, 38.42, 13.5, 25.28, 33.8]
    assert sum(power) / 6 < 26.85
    w = workout(spark, power + [1.0] * 2, [100] * 8, elevation_m=[k / 4 for k in range(8)], distance_m=[2.0 * k for k in range(8)])
    assert one(m.climbs(w.where("elapsed_sec < 7"), gap=1, rows=5)).avg_power == 26.9
    assert one(m.channel_stats(w.where("elapsed_sec < 6"))).power_avg == 26.9
    r = one(spark.range(1).select(rounded(F.lit(-26.849999999999998), 1).alias("a"), rounded(F.lit(float("nan")), 1).alias("b"), rounded(F.lit(1e300), 6).alias("c"), rounded(F.lit(None).cast("double"), 1).alias("d"), rounded(F.lit(float("-inf")), 2).alias("e")))
    assert (r.a, r.b != r.b, r.c, r.d, r.e) == (-26.9, True, 1e300, None, float("-inf"))


def test_a_workout_of_many_blocks_gives_the_same_row(spark, monkeypatch):
    """Blocks of 4,000 seconds and rows give what one block gives, and no window is over a workout's records."""
    rng, n = np.random.default_rng(5), 9000
    columns = {c: np.round(rng.random(n) * 300, 2).tolist() for c in ("power_watts", "heart_rate_bpm", "elevation_m")}
    for k in rng.integers(0, n, 500):
        columns["power_watts"][k] = columns["elevation_m"][k] = None
    w = workout(spark, columns["power_watts"], columns["heart_rate_bpm"], elevation_m=columns["elevation_m"])
    whole = one(m.workout_metrics(m.dealt(w), AthleteParams(ftp=200.0)))
    running, overlapping = m.blocks.running, m.blocks.overlapping
    monkeypatch.setattr(m.blocks, "running", lambda *a, **k: running(*a, **k) if len(a) > 5 else running(*a, span=4000, **k))
    monkeypatch.setattr(m.blocks, "ROWS", 4000)
    for where in (m, m.blocks):
        monkeypatch.setattr(where, "overlapping", lambda *a, **k: overlapping(*a, **k | {"rows": 4000}))
    parts = m.workout_metrics(m.dealt(w), AthleteParams(ftp=200.0))
    row = one(parts)
    for name in set(whole.asDict()) - {m.KEY}:
        assert row[name] == (None if whole[name] is None else pytest.approx(whole[name], rel=1e-9)), name
    assert row.hr_power_lag_sec is not None and row.peak_3600 is not None and row.surge_count > 0
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    specs = [line for line in plan.splitlines() if "Window [" in line]
    assert specs and all("_block" in line for line in specs)
