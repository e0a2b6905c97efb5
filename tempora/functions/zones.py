"""From an offset at an instant to an IANA zone, by tables of intervals.

Between two changes of any zone that has an offset, the answer to "which zone has this offset now" is the same. So the
rules of preference are applied once an interval, on the driver, to the time zone database (a table of fixed size), and a
row finds its interval by an equi-join on offset and time bucket with a range condition: no conversion per row."""

from __future__ import annotations

import zoneinfo
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Years whose instants have an answer, the last one not counted.
FIRST_YEAR, LAST_YEAR = 1980, 2041
#: Seconds of a time bucket, and between two looks for a change of a zone's offset.
_BUCKET, _LOOK = 366 * 86_400, 10 * 86_400

#: Fixed order of preference: the first of these that fits wins, then the rest by name.
MAJOR_CITIES = [
    "America/New_York", "America/Toronto", "America/Montreal", "America/Chicago", "America/Mexico_City", "America/Winnipeg", "America/Denver", "America/Edmonton",
    "America/Los_Angeles", "America/Vancouver", "America/Anchorage", "Pacific/Honolulu", "Europe/London", "Europe/Paris", "Europe/Berlin", "Europe/Madrid",
    "Europe/Rome", "Europe/Amsterdam", "Asia/Tokyo", "Asia/Shanghai", "Asia/Hong_Kong", "Asia/Singapore", "Asia/Dubai", "Asia/Seoul", "Asia/Taipei",
    "Australia/Sydney", "Australia/Melbourne", "Pacific/Auckland", "America/Sao_Paulo", "America/Buenos_Aires", "America/Santiago", "Africa/Cairo", "Africa/Johannesburg",
]


def _epoch(year: int, month: int = 1, day: int = 1, hour: int = 0) -> int:
    return int(datetime(year, month, day, hour, tzinfo=timezone.utc).timestamp())


@cache
def intervals(zone: str) -> list[tuple[int, int, int]]:
    """(from, to, seconds east of UTC) of a zone between its changes: epoch seconds, `to` not included."""
    own = zoneinfo.ZoneInfo(zone)
    offset = lambda at: round(datetime.fromtimestamp(at, own).utcoffset().total_seconds())
    at, end = _epoch(FIRST_YEAR), _epoch(LAST_YEAR)
    start, now, out = at, offset(at), []
    while at < end:
        after = min(at + _LOOK, end)
        new = offset(after)
        if new != now:
            lo, hi = at, after  # the change is in (lo, hi]
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
            out.append((start, hi, now))
            start, now = hi, offset(hi)
            if now != new:  # a second change before the next look
                after = hi
        at = after
    return [*out, (start, end, now)] if start < end else out


def offset_of(zone: str, at: int) -> int:
    spans = intervals(zone)
    return spans[max(0, bisect_right(spans, (at, 1 << 62)) - 1)][2]


@cache
def preference() -> list[tuple[str, bool]]:
    """All zones in order of preference, each with whether it names a place; those that don't come last."""
    zones = zoneinfo.available_timezones() - {"localtime", "Factory", "posixrules"}
    named = {z for z in zones if "/" in z and not z.startswith("Etc/")}
    known = [z for z in MAJOR_CITIES if z in named]
    return [(z, True) for z in known + sorted(named - set(known), key=lambda z: (z.count("/"), z))] + [(z, False) for z in sorted(zones - named)]


@cache
def has_summer_time(zone: str, year: int) -> bool:
    """Whether the middle of January and of July differ in that year."""
    return offset_of(zone, _epoch(year, 1, 15, 12)) != offset_of(zone, _epoch(year, 7, 15, 12))


def _split(spans: list[tuple], edges: list[int]) -> Iterator[tuple]:
    """Spans (from, to, ...) cut at the edges, each part with the number of the edge before it."""
    for lo, hi, *rest in spans:
        k = bisect_right(edges, lo) - 1
        while lo < hi:
            end = min(hi, edges[k + 1] if k + 1 < len(edges) else hi)
            yield (k, lo, end, *rest)
            lo, k = end, k + 1


@cache
def best_zones(candidates: tuple[str, ...] | None = None) -> list[tuple[int, int, int, str]]:
    """(minutes, from, to, zone): the preferred zone of an offset, which holds throughout the interval.

    Of all zones those with summer time in that year come first, among them (and among the others) the MAJOR_CITIES in
    order, then by depth of the name and by name; a list of candidates is taken in its own order."""
    order = [(z, False) for z in candidates] if candidates else preference()
    years = [_epoch(y) for y in range(FIRST_YEAR, LAST_YEAR)]
    seen, found = set(), defaultdict(list)
    for rank, (zone, named) in enumerate(order):
        spans = tuple(intervals(zone))
        if (named, spans) in seen:  # it agrees throughout with one that is preferred
            continue
        seen.add((named, spans))
        for k, lo, hi, offset in _split(list(spans), years):
            if offset % 60 == 0:
                summer = named and has_summer_time(zone, FIRST_YEAR + k)
                found[offset // 60, k].append((lo, hi, (not named, not summer, rank), zone))
    out: list[tuple[int, int, int, str]] = []
    for (minutes, _), spans in sorted(found.items()):
        edges = sorted({t for lo, hi, *_ in spans for t in (lo, hi)})
        for lo, hi in zip(edges, edges[1:]):
            over = [(rank, zone) for a, b, rank, zone in spans if a <= lo and hi <= b]
            if over:
                zone = min(over)[1]
                if out and out[-1][0] == minutes and out[-1][2:] == (lo, zone):
                    out[-1] = (minutes, out[-1][1], hi, zone)
                else:
                    out.append((minutes, lo, hi, zone))
    return out


@cache
def _table(kind: str, candidates: tuple[str, ...] | None) -> pa.Table:
    """The intervals of best_zones, or of all zones by name, cut at buckets of time."""
    buckets = list(range(0, _epoch(LAST_YEAR) + _BUCKET, _BUCKET))
    if kind == "best":
        rows = [(minutes, k, lo, hi, zone) for minutes, a, b, zone in best_zones(candidates) for k, lo, hi in _split([(a, b)], buckets)]
    else:
        rows = [(offset // 60, k, lo, hi, zone) for zone, _ in preference() for k, lo, hi, offset in _split(intervals(zone), buckets) if offset % 60 == 0]
    types = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["minutes", "bucket", "lo", "hi", "zone"])


def with_zone(rows: DataFrame, instant: Column, offset: Column, home: Column | None = None, name: str = "zone", candidates: list[str] | None = None) -> DataFrame:
    """rows with the zone of an offset (minutes east of UTC) at an instant: the home zone where it has that offset then,
    else the preferred one of all zones (or of the candidates, in their order) that has; null for none.

    Null instants and offsets, an unknown home zone, and instants outside FIRST_YEAR to LAST_YEAR have no match. The tables
    are of fixed size (some 10,000 intervals, and 100,000 of the zones by name), so they are broadcast."""
    session = rows.sparkSession
    mine = rows.withColumn("_at", F.unix_seconds(instant)).withColumn("_minutes", offset.cast("int"))
    if home is not None:
        mine = mine.withColumn("_home", home)
    mine = mine.withColumn("_bucket", F.floor(F.col("_at") / _BUCKET))

    def interval(side: str, table: pa.Table) -> tuple[DataFrame, Column]:
        t = session.createDataFrame(table).select(*[F.col(c).alias(f"_{side}_{c}") for c in table.column_names])
        own = lambda c: F.col(f"_{side}_{c}")
        return F.broadcast(t), (F.col("_minutes") == own("minutes")) & (F.col("_bucket") == own("bucket")) & (F.col("_at") >= own("lo")) & (F.col("_at") < own("hi"))

    best, met = interval("best", _table("best", tuple(candidates) if candidates else None))
    out = mine.join(best, met, "left")
    zone = F.col("_best_zone")
    if home is not None:
        named, met = interval("named", _table("named", None))
        out = out.join(named, met & (F.col("_home") == F.col("_named_zone")), "left")
        zone = F.coalesce("_named_zone", "_best_zone")
    return out.select(*[F.col(c) for c in rows.columns if c != name], zone.alias(name))
