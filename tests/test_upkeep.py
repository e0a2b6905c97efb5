"""Derived tables under late, corrected and withdrawn rows; listings whose cursor expires."""

import json
import random
import shutil
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tempora.operators import rollups
from tempora.streaming import listing, upkeep

ZONES = [f"hr_z{z}_sec" for z in range(1, 6)] + [f"pwr_z{z}_sec" for z in range(1, 8)]
SCHEMA = "workout_id long, athlete_id string, start_time_utc timestamp, version long, deleted boolean, tss double, duration_sec double, distance_m double, elevation_gain_m double, decoupling_pct double, " + ", ".join(f"{z} long" for z in ZONES)
FIRST = datetime(2026, 1, 1, 6, tzinfo=timezone.utc)


def workout(k, athlete, day, version=1, deleted=False, tss=10.0):
    return (k, athlete, None if day is None else FIRST + timedelta(days=day), version, deleted, tss, 600.0 + k, 1000.0, None, 1.5, *[60] * len(ZONES))


def batches():
    rng = random.Random(5)
    days = {k: rng.randint(0, 120) for k in range(60)}
    late = [workout(k, f"a{k % 3}", days[k], tss=None if k % 9 == 0 else float(k)) for k in range(30, 60)]
    early = [workout(k, f"a{k % 3}", days[k]) for k in range(30)] + [workout(99, "a0", None)]
    fixes = [workout(k, f"a{k % 3}", days[k], 2, tss=77.0) for k in (0, 31, 45)] + [workout(k, f"a{k % 3}", days[k], 2, True) for k in (1, 32)] + [workout(45, "a0", days[45], 1, tss=1.0), workout(7, "lone", 300), workout(7, "lone", 300)]
    return [late, early, fixes, [workout(7, "lone", 300, 2, True)]]


def test_batches_equal_a_full_recompute_and_write_only_what_they_mark(spark, tmp_path):
    path, sent, tables = f"file://{tmp_path}", [], upkeep.Upkeep(f"file://{tmp_path}")
    for number, rows in enumerate(batches()):
        df = spark.createDataFrame(rows, SCHEMA)
        tables.apply(df, number)
        if number == 1:
            tables.apply(df, number)  # a batch that runs again changes nothing
        sent += rows
        newest = {}
        for r in sorted((r for r in sent if r[2]), key=lambda r: r[3]):
            newest[r[0], r[2]] = r
        whole = spark.createDataFrame([r for r in newest.values() if not r[4]], SCHEMA)
        key = lambda r: (r.athlete_id, str(r[1]))
        assert sorted(tables.weekly(spark).collect(), key=key) == sorted(rollups.weekly(whole).collect(), key=key)
        want = {(r.athlete_id, r.day): r for r in upkeep.loads(upkeep.daily_loads(whole)).collect()}
        got = {(r.athlete_id, r.day): r for r in tables.loads(spark).collect()}
        assert got == want and (not want or min(r.tss_28d for r in want.values()) > 0)
        written = {(r.athlete_id, r.week_start.date()) for r in spark.read.parquet(f"{path}/weekly/batch={number}").collect()}
        monday = lambda t: (t - timedelta(days=t.weekday())).date()
        assert written == {(r[1], monday(r[2])) for r in rows if r[2]}
        days = spark.read.parquet(f"{path}/loads/batch={number}").agg(F.count("*"), F.countDistinct("athlete_id", "day")).first()
        assert days[0] == days[1] == len({(r[1], r[2].date() + timedelta(days=k)) for r in rows if r[2] for k in range(29)})
    assert not any(a == "lone" for a, _ in got)


def test_only_months_in_reach_are_read(spark, tmp_path):
    tables = upkeep.Upkeep(f"file://{tmp_path}")
    tables.apply(spark.createDataFrame([workout(k, "a", 20 * k) for k in range(30)], SCHEMA), 0)
    weeks = [datetime(2026, 3, 2).date()]
    schema = spark.createDataFrame([], SCHEMA).withColumn("week", F.lit(None).cast("date")).withColumn("month", F.lit("")).withColumn("batch", F.lit(0).cast("long")).schema
    read = tables._base(spark, weeks, schema)
    scan = next(line for line in read._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    assert "month" in scan and "2026-03" in scan


class Remote:
    """A folder that writes its own listing, one generation after another."""

    def __init__(self, path):
        self.path, self.generation, self.now = path, -1, {}

    def change(self, full=False, **items):
        self.generation += 1
        changed = []
        for item, tag in items.items():
            if tag is None:
                self.now.pop(item, None)
                changed.append({"item": item, "deleted": True})
            else:
                self.now[item] = tag
                changed.append({"item": item, "name": f"{item}.fit", "size": 5, "tag": tag})
        self._write("changes", changed)
        if full:
            self._write("full", [{"item": i, "name": f"{i}.fit", "size": 5, "tag": t} for i, t in self.now.items()])

    def _write(self, kind, rows):
        folder = self.path / kind / f"generation={self.generation}"
        folder.mkdir(parents=True)
        for k, half in enumerate((rows[::2], rows[1::2])):
            (folder / f"part-{k}.json").write_text("\n".join(map(json.dumps, half)))

    def expire(self, before):
        for g in range(before):
            shutil.rmtree(self.path / "changes" / f"generation={g}", ignore_errors=True)


def test_an_expired_cursor_ends_in_the_same_state(spark, tmp_path):
    remote = Remote(tmp_path / "remote")

    def run(name, force=False):
        stream = listing.listing_stream(spark, f"file://{remote.path}", force)
        listing.follow(stream, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-cp").awaitTermination()
        return {r.item: r.tag for r in listing.current_items(spark, f"file://{tmp_path}/{name}").collect()}

    remote.change(True, a="1", b="1", c="1", d="1")
    assert run("steady") == run("slow") == remote.now
    remote.change(a="2", b=None)
    assert run("steady") == remote.now
    remote.change(e="1", b="3", c=None)
    assert run("steady") == remote.now
    remote.change(True, d=None, f="1")
    remote.change(a="5", g="1")
    assert run("steady") == remote.now
    remote.expire(3)  # the slow one would need generation 1
    assert run("slow") == remote.now == {"a": "5", "b": "3", "e": "1", "f": "1", "g": "1"}
    assert run("new") == run("forced", True) == run("slow") == remote.now
    remote.change(g=None)
    assert run("slow") == run("steady") == run("forced", True) == remote.now


def test_a_gap_without_a_full_listing_is_an_error(spark, tmp_path):
    remote = Remote(tmp_path)
    remote.change(a="1")
    remote.change(a="2")
    remote.expire(1)
    reader = listing.ListingReader(f"file://{tmp_path}", False)
    with pytest.raises(RuntimeError, match="generation 0"):
        reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert reader.partitions({"generation": 1}, {"generation": 1}) == []
    assert listing.ListingReader(f"file://{tmp_path}/nothing", False).latestOffset() == {"generation": -1}


def test_nothing_that_grows_is_broadcast(spark, tmp_path, monkeypatch):
    """A few KB of workouts stand for 29 days each: no size by files may send them to the driver."""
    plans, write = [], upkeep.Upkeep._write

    def seen(self, df, name, number):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(self, df, name, number)

    monkeypatch.setattr(upkeep.Upkeep, "_write", seen)
    upkeep.Upkeep(f"file://{tmp_path}").apply(spark.createDataFrame(batches()[0], SCHEMA), 0)
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def test_deliveries_are_written_by_many_tasks(spark, monkeypatch):
    """No part of the tables is gathered in one task on its way to the stream."""
    from tempora.plans import function_queries

    def refused(*_):
        raise AssertionError("gathered in one task")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", refused)
    for name in ("t11_weekly_upkeep", "t8_item_states"):
        assert function_queries.Q[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1
