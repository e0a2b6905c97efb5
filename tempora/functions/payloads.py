"""Functions over JSON payloads and lists of named fields. A payload is text, parsed once to a variant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    return F.try_parse_json(payload)


def first_path(variant: Column, paths: list[str], kind: str = "double") -> Column:
    """The first of the paths that holds something."""
    return F.coalesce(*[F.try_variant_get(variant, p, kind) for p in paths])


# Where each payload keeps its threshold heart rate, in the order in which they are asked.
THRESHOLD_PATHS = [
    ("lactate_threshold", ["$.speed_and_heart_rate.heartRate"], "lactate_threshold_endpoint"),
    ("training_status", ["$.lactateThresholdHeartRate", "$.lactateThreshold.heartRate", "$.recoveryMetrics.lactateThresholdHeartRate", "$.recoveryMetrics.lthr"], "training_status_fallback"),
    ("recovery_metrics", ["$.lactateThresholdHeartRate", "$.lactateThreshold", "$.lthr", "$.recovery.lactateThresholdHeartRate"], "recovery_metrics_endpoint"),
    ("wellness", ["$.lactateThresholdHeartRate", "$.lactateThreshold", "$.lthr", "$.heartRateMetrics.lactateThresholdHeartRate"], "wellness_endpoint"),
]
READINESS_PATHS = ["$.score", "$.trainingReadinessScore", "$.readiness.score", "$.readinessScore", "$.value"]


def threshold_hr(payloads: dict[str, Column]) -> Column:
    """The threshold heart rate out of four variants, the cycling one, and where it was found."""
    cycling = first_path(payloads["lactate_threshold"], ["$.speed_and_heart_rate.heartRateCycling"])
    found = [(first_path(payloads[name], paths), label) for name, paths, label in THRESHOLD_PATHS]
    label = F.coalesce(*[F.when(v.isNotNull(), said) for v, said in found], F.when(cycling.isNotNull(), "lactate_threshold_endpoint_cycling_fallback"))
    return F.struct(F.coalesce(*[v for v, _ in found], cycling).alias("lthr_bpm"), cycling.alias("cycling_lthr_bpm"), label.alias("provenance"))


def readiness(morning: Column, entries: Column) -> Column:
    """The score of the morning entry; else of the entry after waking up, else of the first in the list (variants)."""
    woken = F.filter(entries, lambda e: F.try_variant_get(e, "$.inputContext", "string") == "AFTER_WAKEUP_RESET")
    entry = F.coalesce(morning, F.get(woken, 0), F.get(entries, 0))
    return first_path(entry, READINESS_PATHS)


def missing_fields(variant: Column, required: list[str]) -> Column:
    """Names of required top-level fields that a payload lacks: contract drift."""
    return F.array_compact(F.array(*[F.when(F.try_variant_get(variant, f"$.{f}", "variant").isNull(), f) for f in required]))


def field_map(fields: Column) -> Column:
    """A list of structs (name, value, units) as a map, the last of equal names; rows without name or value go."""
    whole = F.filter(fields, lambda x: x["name"].isNotNull() & x["value"].isNotNull())
    last = F.filter(whole, lambda x, i: ~F.exists(F.slice(whole, i + 2, F.size(whole)), lambda y: y["name"] == x["name"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"], x["value"])))


def promoted(fields: Column, names: list[str]) -> Column:
    """Named fields as columns, the others as a map extra_fields."""
    m = field_map(fields)
    return F.struct(*[F.try_element_at(m, F.lit(n)).alias(n) for n in names], F.map_filter(m, lambda k, _: ~k.isin(names)).alias("extra_fields"))


def measures(kinds: Column, codes: dict[int, str], values: Column) -> Column:
    """Measure-type codes to named columns: the last value of each type in two parallel arrays."""
    pairs = F.arrays_zip(kinds.alias("k"), values.alias("v"))
    last = lambda code: F.element_at(F.filter(pairs, lambda p: p["k"] == code), -1)["v"]
    return F.struct(*[F.when(F.array_contains(kinds, code), last(code)).alias(name) for code, name in codes.items()])


def response(columns: list[str]) -> Column:
    """A row as JSON text without its nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
