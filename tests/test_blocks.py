"""Blocked scans against plain loops, on one key that holds every row; and how the work is dealt."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tempora.operators import blocks, lookup, sequence


def stream(seed=1, n=1500):
    """(key, seconds, id, value): most rows are of one key; equal times, gaps of many blocks, nulls."""
    rng = random.Random(seed)
    t, rows = 0.0, []
    for i in range(n):
        t += rng.choice([0, 1, 1, 1, 2, 40, 5000] if i % 50 == 0 else [0, 1, 1, 2])
        rows.append(("all" if i % 20 else f"k{i % 3}", None if i % 211 == 5 else t, i, None if rng.random() < 0.1 else round(rng.uniform(0, 50), 3)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t double, i int, v double").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("span", [3, 50, 1e6])
def test_running_sums(spark, span):
    rows = stream()
    got = {r.i: (r.n, r.s) for r in blocks.running(frame(spark, rows), "k", "t", {"n": F.lit(1), "s": F.col("v")}, ["i"], span).collect()}
    assert len(got) == len(rows)
    for own in by_key(rows).values():
        total = 0.0
        for n, (_, _, i, v) in enumerate(own, 1):
            total += v or 0
            assert got[i][0] == n and math.isclose(got[i][1], total, abs_tol=1e-6)


@pytest.mark.parametrize("span", [7, 1e6])
def test_runs_over_blocks(spark, span):
    rows = stream(2)
    flag = F.col("v") >= 8
    found = blocks.runs(frame(spark, rows), flag, "k", "t", ["i"], [F.max("v").alias("best")], 2, span)
    plain = []
    for k, own in by_key(rows).items():
        at = 0
        while at < len(own):
            end = at
            while end < len(own) and (own[end][3] or 0) >= 8:
                end += 1
            if end - at >= 2:
                plain.append((k, at, end - 1, end - at, max(r[3] for r in own[at:end])))
            at = max(end, at + 1)
    assert sorted((r.k, r.run_start, r.run_end, r.run_rows, r.best) for r in found.collect()) == sorted(plain)
    assert max(r[3] for r in plain) > 15  # longer than a block


@pytest.mark.parametrize("rows_a_block", [40, 100_000])
def test_peaks_over_blocks(spark, rows_a_block):
    rows = stream(3)
    widths = [1, 7, 30, 400, 5000]
    got = {r.k: r for r in blocks.peak_means(frame(spark, rows), "v", "k", "t", widths, ["i"], span=20, rows=rows_a_block).collect()}
    for k, own in by_key(rows).items():
        v = [r[3] for r in own if r[3] is not None]
        for w in widths:
            want = max((sum(v[i : i + w]) / w for i in range(len(v) - w + 1)), default=None)
            assert got[k][f"peak_{w}"] is None if want is None else math.isclose(got[k][f"peak_{w}"], want, rel_tol=1e-9)


def test_rolling_sums_over_time(spark):
    rows = stream(4, 600)
    got = {r.i: r.s for r in blocks.rolling_sum(frame(spark, rows), "v", "k", "t", 60, "s").collect()}
    assert len(got) == len(rows)
    for k, t, i, _ in rows:
        near = [r[3] for r in rows if r[0] == k and t is not None and r[1] is not None and math.floor(t) - 60 <= math.floor(r[1]) <= math.floor(t) and r[3] is not None]
        assert got[i] is None if not near else math.isclose(got[i], sum(near), abs_tol=1e-6)


def test_rolling_sums_cost_no_window_for_each_row(spark):
    """All frames begin at an end of their block, and a block's rows are its seconds, however many rows they have."""
    many = spark.range(60_000).select(F.lit(None).cast("string").alias("k"), (F.col("id") % 300 / 2).alias("t"), F.col("id").alias("i"), F.lit(0.25).alias("v"))
    out = blocks.rolling_sum(many, "v", "k", "t", 60, "s")
    frames = re.findall(r"specifiedwindowframe\(([^)]*\)?)", out._jdf.queryExecution().optimizedPlan().toString())
    assert frames and all(f.startswith("RangeFrame, unboundedpreceding") for f in frames)
    assert out.count() == 60_000
    assert all(r.s == 0.25 * 400 * min(int(r.t) + 1, 61) for r in out.select("t", "s").distinct().collect())


@pytest.mark.parametrize("span", [5, 1000, 1e7])
@pytest.mark.parametrize("fallback", [False, True])
def test_values_are_carried_over_blocks(spark, span, fallback):
    left, right = stream(5, 500), [r for r in stream(6, 400) if r[0] != "k1"]
    right += [("k2", r[1], r[2] + 10_000, r[3]) for r in right[:3]]
    values = {"v": F.col("v"), "whole": F.struct("i", "v")}
    found = blocks.carried(frame(spark, left), frame(spark, right), "k", "t", "t", ["i"], values, ["whole"] if fallback else [], span=span).collect()
    assert len(found) == len(left)
    for r in found:
        mine = sorted((x for x in right if x[0] == r._left.k and x[1] is not None), key=lambda x: (x[1], x[2]))
        before = [x for x in mine if r._left.t is not None and x[1] <= r._left.t]
        known = [x for x in before if x[3] is not None]
        assert r.v == (known[-1][3] if known else None)
        whole = before[-1] if before else mine[-1] if fallback and mine else None
        assert (r.whole and tuple(r.whole)) == (whole and (whole[2], whole[3]))


def test_one_athlete_with_all_rows_is_many_blocks(spark):
    """As-of over one key: every window of rows is dealt by key and block, and no block has many of the rows."""
    days = spark.range(20_000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 7200).alias("t"), F.col("id").alias("row_key"), (F.col("id") % 7).cast("double").alias("w"))
    joined = lookup.as_of(days.select("k", "t"), days.where("row_key % 3 = 0").withColumnRenamed("t", "rt"), "k", "t", "rt", ["row_key"], ["w", "row_key"])
    assert all(r.row_key == r.t.timestamp() // 7200 // 3 * 3 for r in joined.select("t", "row_key").collect())
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(_by#\d+, _block#\d+L?, ", plan)
    sizes = days.groupBy("k", blocks.block_of(days, "t", blocks.SPARSE)).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] == 360 and sizes[1] > 50


def test_blocked_and_plain_forms_agree(spark):
    rows = [(k, float(n), i, v) for k, own in by_key([r for r in stream(8, 400) if r[1] is not None]).items() for n, (_, _, i, v) in enumerate(own)]
    df = frame(spark, rows)
    a, b = sequence.runs(df, F.col("v") > 10, "k", "t", least=2), blocks.runs(df, F.col("v") > 10, "k", "t", least=2, span=30)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    a, b = sequence.peak_means(df, "v", "k", "t", [5, 60]).collect(), {r.k: r for r in blocks.peak_means(df, "v", "k", "t", [5, 60], span=30, rows=50).collect()}
    assert all(x is None and y is None or math.isclose(x, y) for r in a for x, y in ((r.peak_5, b[r.k].peak_5), (r.peak_60, b[r.k].peak_60)))
