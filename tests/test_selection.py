"""Exact medians by bisection, near-duplicate cells, strict mode, against plain Python."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tempora.operators import lookup, selection, sequence


@pytest.mark.parametrize("digits,few", [(2, 1), (3, 4), (1024, 4096)])
def test_medians_of_odd_values(spark, digits, few):
    rng = random.Random(4)
    groups = {
        "one": [7.0], "two": [1.0, 2.0], "equal": [3.5] * 40, "normal": [rng.gauss(0, 1) for _ in range(75)], "even": [rng.randint(0, 9) * 1.0 for _ in range(60)],
        "sizes": [10.0 ** rng.randint(-9, 9) for _ in range(41)], "wide": [-1.7e308, 1.7e308, 0.0, 5.0], "mostly": [0.0] * 50 + [1e-300, 2e-300, 1e300],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None), (None, 1.0)]
    got = {r.g: r for r in selection.spread(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v", digits, few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert (got[g].non_null, got[g].least, got[g].greatest) == (len(vs), min(vs), max(vs))
        assert math.isclose(got[g].median, median(vs), rel_tol=1e-15)


def test_no_median_or_sort_of_a_group_in_the_plan(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), ((F.col("id") * 7919) % 20_011).cast("double").alias("v"))
    found = selection.spread(df, "g", "v", digits=16, few=64)
    assert found.first().median == median((i * 7919) % 20_011 for i in range(20_000))
    assert "median(" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("as median", "")


def test_strict_mode_names_the_intervals(spark):
    df = spark.createDataFrame([("a", float(t)) for t in range(4)] + [("b", t) for t in (0.0, 2.0, 4.0, 9.0)], "w string, t double")
    assert sequence.require_regular(df.where("w = 'a'"), "w", "t", [], [], strict=True).count() == 4
    with pytest.raises(ValueError, match=r"b \(rows=4, median_interval_sec=2.0, min_interval_sec=2.0, max_interval_sec=5.0\)"):
        sequence.require_regular(df, "w", "t", [], [], strict=True)


def brute_pairs(rows, seconds, slack):
    out = set()
    for i, (u, t, k, d) in enumerate(rows):
        for v, s, m, e in rows[i + 1 :]:
            if u == v and k != m and abs(t - s) <= seconds and (d is None or e is None or abs(d - e) <= slack):
                out.add((u, min(k, m), max(k, m)))
    return sorted(out)


@pytest.mark.parametrize("slack", [10.0, 0.0])
def test_near_duplicates_of_odd_rows(spark, slack):
    rng = random.Random(9)
    rows = [(rng.randint(0, 2), rng.randint(0, 4000), k, rng.choice([None, -5.0, 0.0, 9.99, 10.0, 20.0, rng.uniform(-30, 60)])) for k in range(250)]
    df = spark.createDataFrame(rows, "u int, s long, k int, d double").withColumn("t", F.timestamp_seconds("s"))
    got = lookup.near_duplicate_pairs(df, "u", "t", "k", "d", 600, slack)
    assert sorted(map(tuple, got.collect())) == brute_pairs(rows, 600, slack)


def test_many_rows_that_start_together_but_differ(spark):
    """50,000 rows in one bucket of time, no two alike but for a few: the rows that meet stay near their number."""
    df = spark.range(50_000).select(F.lit("a").alias("u"), F.timestamp_seconds(F.col("id") % 300).alias("t"), F.col("id").alias("k"), (F.col("id") * 50.0).alias("d"))
    df = df.unionByName(df.where("k % 10000 = 7").withColumn("k", F.col("k") + 1_000_000))
    got = lookup.near_duplicate_pairs(df, "u", "t", "k", "d", 600, 10.0)
    assert sorted(map(tuple, got.collect())) == [("a", k, k + 1_000_000) for k in range(7, 50_000, 10_000)]
