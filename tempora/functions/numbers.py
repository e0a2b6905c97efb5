"""Scalar numeric functions: coercion, units, scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """A finite number, or null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def rounded(value: Column | str, digits: int) -> Column:
    """value to `digits` decimals, halves away from zero, as SQL engines round doubles: scaled, rounded and scaled back.

    So a mean of 26.85 that its sum's last bit leaves at 26.849999999999998 is 26.9. From 1e15 on nothing is left to round."""
    x = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(x) < 1e15, F.round(x * 10.0**digits) / 10.0**digits).otherwise(x)


def speed_mps(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit).isin("km/h", "kmh", "kph"), value / 3.6).otherwise(value)


def metres(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit).isin("km", "kilometers"), value * 1000).otherwise(value)


def balance(raw: Column) -> Column:
    """The seven low bits of a raw left-right balance: percent."""
    return raw.bitwiseAND(127)


def scaled(value: Column, exponent: Column, only_negative: bool = False) -> Column:
    """value * 10 ** exponent; with only_negative other exponents leave the value alone."""
    by_ten = value * F.pow(F.lit(10.0), exponent)
    return F.when(exponent < 0, value / F.pow(F.lit(10.0), -exponent)).otherwise(value.cast("double")) if only_negative else by_ten


def minutes(minutes_: Column, hours: Column) -> Column:
    """Whole minutes, from minutes or else hours."""
    return F.when(minutes_.isNotNull(), F.bround(minutes_.try_cast("double"))).otherwise(F.bround(hours.try_cast("double") * 60)).try_cast("int")


def threshold_hr(lthr: Column, max_hr: Column) -> Column:
    """The threshold heart rate, or 85 % of the maximum cut to a whole number; zero counts as unknown."""
    return F.coalesce(F.when(lthr != 0, lthr.cast("double")), F.when(max_hr != 0, F.floor(max_hr * 0.85).cast("double")))


def load_focus(low: Column, high: Column, anaerobic: Column) -> Column:
    """The percentages of three loads, null ones as zero; null unless their sum is positive."""
    zero = F.lit(0.0)
    parts = [F.coalesce(c.cast("double"), zero) for c in (low, high, anaerobic)]
    total = parts[0] + parts[1] + parts[2]
    return F.when(total > 0, F.struct(*[(p / total * 100).alias(n) for p, n in zip(parts, ("low_pct", "high_pct", "anaerobic_pct"))]))
