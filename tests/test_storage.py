"""Clustered and bucketed storage, conditional rewrites, developer fields, the ledger backfill and small filters."""

import datetime as dt
import glob
import os
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tempora.operators import lookup, quality, state
from tempora.plans import composites
from tempora.sources import clustered, device, files, ledger, rewrite

from .test_device import definition, file_of


def summaries(spark, n=60_000):
    """Half of all rows are of athlete 7."""
    k = F.col("id")
    return spark.range(n).select(F.when(k % 2 == 0, 7).otherwise(k % 400).cast("long").alias("athlete_id"), k.alias("workout_id"), F.timestamp_seconds(k * 997 % 1_000_003).alias("start_time_utc"), F.repeat(F.md5(k.cast("string")), 4).alias("rest"))


def test_one_athlete_is_a_few_row_groups(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    clustered.write_clustered(summaries(spark), path, "athlete_id", ["start_time_utc"], 8, 1 << 18)
    groups = [(f, m.row_group(g)) for f in glob.glob(f"{tmp_path}/c/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    place = {groups[0][1].column(c).path_in_schema: c for c in range(groups[0][1].num_columns)}["athlete_id"]
    holds = lambda g, a: g.column(place).statistics.min <= a <= g.column(place).statistics.max
    assert len(groups) >= 16 and len({f for f, _ in groups}) >= 4
    for athlete in (3, 151, 399):
        own = clustered.of_one(spark, path, "athlete_id", athlete)
        assert own.count() == summaries(spark).where(F.col("athlete_id") == athlete).count() > 50
        assert sum(holds(g, athlete) for _, g in groups) <= 2 and len({f for f, g in groups if holds(g, athlete)}) <= 2
        assert f"EqualTo(athlete_id,{athlete})" in own._jdf.queryExecution().executedPlan().toString()
    assert sum(holds(g, 7) for _, g in groups) > len(groups) // 3  # the hot one spans many: no task wrote them all
    assert clustered.of_one(spark, path, "athlete_id", 7).count() == summaries(spark).where("athlete_id = 7").count()


def test_equal_buckets_meet_without_a_shuffle(spark, tmp_path):
    rows = summaries(spark, 5000).select("athlete_id", "workout_id")
    people = spark.range(400).select(F.col("id").alias("athlete_id"), (F.col("id") * 3).alias("x"))
    w = clustered.write_bucketed(rows, "test_bucketed_workouts", f"file://{tmp_path}/w", "athlete_id", 4, ["workout_id"])
    p = clustered.write_bucketed(people, "test_bucketed_people", f"file://{tmp_path}/p", "athlete_id", 4, [])
    out = clustered.with_counts(w, p, "athlete_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert out.count() == 5000 and out.where("x = 21").agg(F.min("n")).first()[0] == out.where("athlete_id = 7").count()
    spark.sql("DROP TABLE test_bucketed_workouts")
    spark.sql("DROP TABLE test_bucketed_people")


def stamps(path):
    return {f.rpartition("month=")[2]: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/month=*/*.parquet")}


def test_only_improved_partitions_are_rewritten(spark, tmp_path):
    rows = []
    for month, workout, known in (("2026-01", "a", 3), ("2026-01", "b", 10), ("2026-02", "c", 5), ("2026-03", "a", 10), ("2026-03", "d", 0)):
        rows += [(workout, float(t), 100.0 + t if t < known else None, month) for t in range(10)]
    path = f"file://{tmp_path}/r"
    spark.createDataFrame(rows, "workout_id string, elapsed_sec double, elevation_m double, month string").coalesce(1).write.partitionBy("month").parquet(path)
    raw = spark.createDataFrame([("a", t + 0.2, 500.0 + t) for t in range(8)] + [("b", 1.0, 1.0), ("c", 50.0, 1.0)], "workout_id string, elapsed_sec double, elevation_m double")
    fill = lambda df: composites.backfilled(df, raw, ["elevation_m"], 0.5)
    before = stamps(f"{tmp_path}/r")
    dry = rewrite.rewrite_improved(spark, path, fill, ["elevation_m"], apply=False)
    want = [("2026-01", "a", 3, 8, True), ("2026-02", "c", 5, 5, False), ("2026-03", "a", 10, 10, False), ("2026-03", "d", 0, 0, False)]
    assert sorted(map(tuple, dry.collect())) == want and stamps(f"{tmp_path}/r") == before
    first = rewrite.rewrite_improved(spark, path, fill, ["elevation_m"])
    after = stamps(f"{tmp_path}/r")
    assert sorted(map(tuple, first.collect())) == want
    assert {m.partition("/")[0] for m in set(before) ^ set(after)} == {"2026-01"}  # only that month's files are others
    stored = spark.read.parquet(path)
    assert stored.count() == 50 and stored.where("workout_id = 'a' and month = '2026-01' and elevation_m >= 500").count() == 5
    assert stored.where("workout_id = 'b' and elevation_m = 100 + elapsed_sec").count() == 10
    second = rewrite.rewrite_improved(spark, path, fill, ["elevation_m"])
    assert second.where("improved").count() == 0 and stamps(f"{tmp_path}/r") == after


def test_streams_in_small_files_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Records that files hold in a few KB meet others, and the keys of holes their rows, by sorted merges."""
    plans, put = [], rewrite.stored
    monkeypatch.setattr(rewrite, "stored", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(df, what))
    rows = spark.range(40).select(F.lit("a").alias("workout_id"), F.col("id").cast("double").alias("elapsed_sec"), F.when(F.col("id") % 5 != 0, 1.0).alias("elevation_m"), F.lit("2026-01").alias("month"))
    rows.write.partitionBy("month").parquet(f"{tmp_path}/r")
    raw = rows.where("elevation_m is null").select("workout_id", "elapsed_sec", F.lit(2.0).alias("elevation_m"))
    found = rewrite.rewrite_improved(spark, f"file://{tmp_path}/r", lambda df: composites.backfilled(df, raw, ["elevation_m"], 0.5), ["elevation_m"])
    assert [tuple(r) for r in found.collect()] == [("2026-01", "a", 32, 40, True)]
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)


def test_a_month_of_one_workout_is_more_than_one_task(spark, tmp_path):
    rows = spark.range(60_000).select(F.lit("a").alias("athlete_id"), F.lit("w").alias("workout_id"), F.timestamp_seconds(1_704_067_200 + F.col("id")).alias("timestamp_utc"), F.col("id").cast("double").alias("elapsed_sec"), F.rand(1).alias("power_watts"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        files.write_records(rows, f"{tmp_path}/r")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    found = [pq.read_table(f).column("elapsed_sec").to_pylist() for f in glob.glob(f"{tmp_path}/r/month=2024-01/*.parquet")]
    assert len(found) > 1 and all(f == sorted(f) for f in found)
    assert sorted(x for f in found for x in f) == [float(k) for k in range(60_000)]


def test_field_summaries_hold_no_key_in_one_task(spark):
    """Samples are the first of all tasks' parts; values are numbered within a part."""
    k = F.col("id")
    fields = spark.range(0, 1000, 1, 8).select(F.when(k % 2 == 0, "m").alias("message"), (k * 7919 % 1000).alias("position"), F.element_at(F.array(F.lit("W"), F.lit(None), F.lit("bpm")), (k % 3 + 1).cast("int")).alias("units"), F.when(k * 7919 % 1000 != 2, (k * 7919 % 1000).cast("string")).alias("value"))
    out = quality.field_summary(fields, ["message"])
    got = {r.message: (r["count"], r.units, r.samples) for r in out.collect()}
    assert got == {"m": (500, ["W", "bpm"], ["0", None, "4"]), None: (500, ["W", "bpm"], ["1", "3", "5"])}
    assert "windowspecdefinition(message#" in out._jdf.queryExecution().optimizedPlan().toString() and "_part#" in out._jdf.queryExecution().optimizedPlan().toString().partition("windowspecdefinition(")[2].partition(")")[0]


def described(index, number, base, name, units, scale=0xFF, offset=0x7F):
    head = definition(1, 206, [(0, 1, 2), (1, 1, 2), (2, 1, 2), (3, 8, 7), (8, 4, 7), (6, 1, 2), (7, 1, 1)])
    return head + bytes([1, index, number, base]) + struct.pack("<8s4sBb", name, units, scale, offset)


def test_developer_fields_by_each_files_dictionary(spark):
    use = definition(0, 20, [(253, 4, 0x86)], "<", [(1, 2, 0), (2, 4, 0), (3, 6, 0), (9, 1, 4)])
    row = lambda t, a, b, c: bytes([0]) + struct.pack("<IhfB", 1_100_000_000 + t, a, b, 0)[:-1] + c + bytes([5])
    one = described(0, 1, 0x83, b"strain", b"kN", 10, 2) + described(0, 2, 0x88, b"oxygen", b"%") + described(0, 3, 0x07, b"mode", b"") + use + row(0, 55, 1.5, b"easy\0\0") + row(1, 0x7FFF, float("nan"), b"\0" * 6)
    two = described(0, 1, 0x83, b"torque", b"Nm") + use + row(0, -7, 2.5, b"x\0\0\0\0\0") + described(0, 1, 0x83, b"torque2", b"Nm", 2) + row(1, 8, 2.5, b"y\0\0\0\0\0")
    files = spark.createDataFrame([("one", bytearray(file_of(one))), ("two", bytearray(file_of(two))), ("cut", bytearray(file_of(one)[:60]))], "path string, content binary")
    decoded = device.decode(files)
    got = sorted((r.path, r.position, r.field, r.value, r.units) for r in device.developer_fields(decoded).collect())
    assert [g for g in got if g[0] == "one"] == sorted([("one", 3, "dev_4_9", "5.0", None), ("one", 3, "dev_mode", "easy", None), ("one", 3, "dev_oxygen", "1.5", "%"), ("one", 3, "dev_strain", "3.5", "kN"), ("one", 4, "dev_4_9", "5.0", None)])
    torque = {(g[1], g[2], g[3], g[4]) for g in got if g[0] == "two" and "torque" in g[2]}
    assert torque == {(1, "dev_torque2", "-3.5", "Nm"), (3, "dev_torque2", "4.0", "Nm")}  # the last description holds
    assert decoded.where("path = 'cut' and message = 'error'").count() == 1 and decoded.where("message = 'record' and path = 'one'").select("position").distinct().count() == 2


def test_ledger_backfill_keeps_what_is_there(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, "a", " ", "item1", None, at), (2, "a", "x", "item2", None, None), (3, "a", "x", None, None, at), (4, "a", None, None, "sha", at), (5, None, "y", None, None, at), (6, "a", None, " ", None, at), (None, "a", "z", None, None, at)]
    w = spark.createDataFrame(rows, "workout_id long, athlete_id string, ingestion_id string, source_item_id string, file_sha256 string, ingested_at_utc timestamp")
    w = w.withColumn("source_file_name", F.lit("f")).withColumn("source_etag", F.lit(None).cast("string")).withColumn("source_ctag", F.lit("c")).withColumn("ingest_version", F.lit(None).cast("string"))
    old = spark.createDataFrame([("a", "item1", "failed", None, "old"), ("b", "x", "failed", 3, "b")], "athlete_id string, ingestion_key string, status string, retry_count int, source_file_name string")
    got = {r.ingestion_key: r for r in ledger.ledger_backfill(w, old, "v1", F.lit("2026-02-02").cast("timestamp")).collect()}
    assert set(got) == {"item1", "x", "sha"}
    assert (got["item1"].status, got["item1"].retry_count, got["item1"].source_file_name, got["item1"].workout_id, got["item1"].source_ctag) == ("failed", 0, "old", 1, "c")
    assert (got["x"].status, got["x"].workout_id, got["x"].ingest_version) == ("ingested", 3, "v1")


def test_small_filters(spark):
    items = spark.createDataFrame([(1, "active"), (2, "archived"), (3, None), (4, "resolved")], "i int, status string")
    ids = lambda s: sorted(r.i for r in quality.visible(items, s).collect())
    assert ids(None) == ids("") == [1, 3, 4] and ids("all") == [1, 2, 3, 4] and ids("archived") == [2] and ids("active") == [1]
    for bad in ("Active", "gone", "none"):
        with pytest.raises(ValueError, match="status must be one of active, resolved, archived, all"):
            quality.visible(items, bad)
    rows = spark.createDataFrame([("a", "Apple Watch"), (None, "watch"), ("b", None), ("a", "Phone")], "athlete_id string, device string")
    assert quality.owned(rows, "a").count() == 2 and quality.from_watches(rows, "device").count() == 2
    days = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "athlete string, day int")
    assert sorted(map(tuple, lookup.not_stored(days, days.where("day = 1 and athlete = 'a'"), ["athlete", "day"]).collect())) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("asked,given", [(1000, 90), (45, 45), (0, 1), (-3, 1)])
def test_history_is_at_most_ninety_days(spark, asked, given):
    w = spark.createDataFrame([(1, "a", dt.datetime(2026, 3, 1), 10.0)], "workout_id long, athlete_id string, start_time_utc timestamp, tss double")
    p = spark.createDataFrame([], "athlete_id string, effective_date date, updated_at_utc timestamp, row_key string, hrv_ln_rmssd double, resting_hr_bpm double, weight_kg double")
    days = sorted(r.day for r in state.history(w, p, "2026-03-10", asked).collect())
    assert len(days) == given and days[-1] == dt.date(2026, 3, 10)
