"""Scalar date and zone functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_or_earliest(text: Column) -> Column:
    """An ISO timestamp (Z or an offset), or the earliest one for what can't be read."""
    return F.coalesce(F.try_to_timestamp(text), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def offset_text(minutes: Column) -> Column:
    """Minutes east of UTC as UTC+HH:MM or UTC-HH:MM."""
    m = F.abs(minutes).cast("int")
    return F.concat(F.lit("UTC"), F.when(minutes >= 0, "+").otherwise("-"), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def offset_minutes(text: Column) -> Column:
    """The minutes of UTC, UTC+H, UTC+HH:MM; null for anything else."""
    clean = F.upper(F.trim(text))
    part = lambda k: F.regexp_extract(clean, r"^UTC([+-]?)(\d{1,2})(?::(\d{1,2}))?$", k)
    minutes = part(2).try_cast("int") * 60 + F.coalesce(part(3).try_cast("int"), F.lit(0))
    long_enough = F.length(clean) >= 6
    return F.when(clean == "UTC", 0).when(long_enough & (part(2) != ""), F.when(part(1) == "-", -minutes).otherwise(minutes))


def inferred_offset(local: Column, utc: Column) -> Column:
    """Minutes between a local wall clock and UTC, to the quarter of an hour; null if more than 3 minutes off one or
    beyond 14 hours."""
    raw = (F.unix_timestamp(local) - F.unix_timestamp(utc)) / 60
    rounded = F.bround(raw / 15) * 15
    return F.when((F.abs(raw - rounded) <= 3) & (F.abs(rounded) <= 14 * 60), rounded.cast("int"))


def daypart(local: Column) -> Column:
    hour = F.hour(local)
    return F.when(hour.between(5, 11), "Morning").when(hour.between(12, 16), "Afternoon").when(hour.between(17, 20), "Evening").when(hour.isNotNull(), "Night")


def sync_window(today: Column, days: Column) -> Column:
    """The days to fetch: today for 0, else the `days` completed days up to yesterday."""
    first, last = F.date_sub(today, F.greatest(days, F.lit(0))), F.when(days > 0, F.date_sub(today, F.lit(1))).otherwise(today)
    return F.sequence(first, last)


def month_keys(first: Column, last: Column) -> Column:
    """YYYY-MM of all months that a range touches."""
    return F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.make_interval(months=F.lit(1))), lambda d: F.date_format(d, "yyyy-MM"))
