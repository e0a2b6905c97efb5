"""The device-file decoder on files written here."""

import random
import struct
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tempora.functions import zones
from tempora.sources import device, files


def definition(local, number, fields, order="<", developer=()):
    head = bytes([0x40 | (0x20 if developer else 0) | local, 0, 0 if order == "<" else 1]) + struct.pack(f"{order}HB", number, len(fields))
    out = head + b"".join(bytes(f) for f in fields)
    return out + (bytes([len(developer)]) + b"".join(bytes(f) for f in developer) if developer else b"")


def file_of(body):
    return struct.pack("<BBHI4sH", 14, 16, 2100, len(body), b".FIT", 0) + body + b"\0\0"


T0 = 1_100_000_000


def sample():
    body = definition(0, 0, [(0, 1, 0x00), (1, 2, 0x84), (8, 4, 0x07)]) + bytes([0]) + struct.pack("<BH4s", 4, 260, b"abc\0")
    body += definition(1, 20, [(253, 4, 0x86), (7, 2, 0x84), (3, 1, 0x02), (2, 2, 0x84)])
    for k in range(3):
        body += bytes([1]) + struct.pack("<IHBH", T0 + k, 200 + k, 0xFF if k == 1 else 120 + k, (100 + 500) * 5)
    body += definition(2, 20, [(7, 2, 0x84)], ">", [(0, 1, 0)]) + bytes([0x80 | 2 << 5 | (T0 + 4) & 0x1F]) + struct.pack(">HB", 300, 9)
    return file_of(body)


def test_messages():
    rows = list(device.messages(sample()))
    assert (0, "file_id", "manufacturer", 260.0, None) in rows and (0, "file_id", "field_8", None, "abc") in rows
    power = [v for _, m, f, v, _ in rows if (m, f) == ("record", "power_watts")]
    assert power == [200.0, 201.0, 202.0, 300.0]
    assert [v for _, m, f, v, _ in rows if f == "heart_rate_bpm"] == [120.0, 122.0]
    assert [v for _, m, f, v, _ in rows if (m, f) == ("record", "timestamp")] == [float(T0 + device.EPOCH + k) for k in (0, 1, 2, 4)]


def test_files_become_records(spark, tmp_path):
    (tmp_path / "a.fit").write_bytes(sample())
    (tmp_path / "b.fit").write_bytes(sample()[:40])
    (tmp_path / "c.fit").write_bytes(b"nothing of the kind")
    decoded = device.decode(files.device_files(spark, f"file://{tmp_path}")).cache()
    assert {r.path.rpartition("/")[2] for r in decoded.where("message = 'error'").collect()} == {"b.fit"}
    rows = device.records(decoded).orderBy("elapsed_sec").collect()
    assert [(r.elapsed_sec, r.power_watts, r.heart_rate_bpm, r.elevation_m) for r in rows] == [(0.0, 200.0, 120.0, 100.0), (1.0, 201.0, None, 100.0), (2.0, 202.0, 122.0, 100.0), (4.0, 300.0, None, None)]


def test_zone_of_an_offset_knows_summer_time(spark):
    rows = [("2026-01-15 12:00:00", -300), ("2026-07-15 12:00:00", -240), ("2026-07-15 12:00:00", -300), ("2026-01-15 12:00:00", 330), ("2026-01-15 12:00:00", 7), (None, 60), ("2026-01-15 12:00:00", None), ("1890-01-01 00:00:00", 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, zone int").withColumn("t", F.col("t").cast("timestamp"))
    found = {r.i: r.zone for r in zones.with_zone(df, F.col("t"), F.col("zone"), F.lit("America/New_York")).collect()}
    assert list(map(found.get, range(8))) == ["America/New_York", "America/New_York", "America/Chicago", "Asia/Calcutta", None, None, None, None]
    homes = df.withColumn("home", F.when(F.col("i") == 0, "Nowhere/Land").when(F.col("i") == 1, "America/Toronto"))
    found = {r.i: r.z for r in zones.with_zone(homes, F.col("t"), F.col("zone"), F.col("home"), "z").collect()}
    assert [found[0], found[1]] == ["America/New_York", "America/Toronto"]
    few = zones.with_zone(df, F.col("t"), F.col("zone"), None, "z", ["America/Bogota", "America/New_York"])
    assert {r.i: r.z for r in few.collect()} == {0: "America/Bogota", 1: "America/New_York", 2: "America/Bogota"} | dict.fromkeys(range(3, 8))


def test_intervals_cover_and_agree_with_the_database():
    """Cut at random instants, offsets and best zones equal what the database and the rule say then."""
    rng = random.Random(3)
    for zone in ("Europe/London", "America/Sao_Paulo", "Africa/Casablanca", "Asia/Kathmandu", "Australia/Lord_Howe", "Antarctica/Troll"):
        spans = zones.intervals(zone)
        assert spans[0][0] == zones._epoch(zones.FIRST_YEAR) and spans[-1][1] == zones._epoch(zones.LAST_YEAR)
        assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:]))
        for t in [x for lo, hi, _ in spans for x in (lo, hi - 1)] + [rng.randrange(spans[0][0], spans[-1][1]) for _ in range(300)]:
            assert zones.offset_of(zone, t) == datetime.fromtimestamp(t, ZoneInfo(zone)).utcoffset().total_seconds()
    order = {z: i for i, (z, named) in enumerate(zones.preference()) if named}
    best = zones.best_zones()
    for minutes, lo, hi, zone in rng.sample(best, 40):
        t = rng.randrange(lo, hi)
        fit = [z for z in order if datetime.fromtimestamp(t, ZoneInfo(z)).utcoffset().total_seconds() == minutes * 60]
        year = datetime.fromtimestamp(t, timezone.utc).year
        want = min(fit, key=lambda z: (not zones.has_summer_time(z, year), order[z]), default=None)
        assert want is None or datetime.fromtimestamp(t, ZoneInfo(zone)).utcoffset() == datetime.fromtimestamp(t, ZoneInfo(want)).utcoffset()
        assert want is None or zone == want or zones.intervals(zone) == zones.intervals(want)
