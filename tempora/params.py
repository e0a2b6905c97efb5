"""Parameters of an athlete's metrics. Every field may be a number or a Column, so that baselines can come from a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = float | int | str | Column | None


def col(value: Value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# Zone bounds as shares of the reference, durations in seconds, shares of the threshold power.
DEFAULT_FTP = 250.0
HR_ZONES = {
    "HRmax": ([0.50, 0.60, 0.70, 0.80, 0.90], [0.60, 0.70, 0.80, 0.90, 1.00]),
    "LTHR": ([0.01, 0.69, 0.84, 0.95, 1.06], [0.68999, 0.83999, 0.94999, 1.05999, 2.00]),
}
POWER_ZONE_CUTS = [0.55, 0.75, 0.90, 1.05, 1.20, 1.50]
PEAK_SECONDS = [5, 30, 180, 300, 480, 1200, 3600]
CURVE_SECONDS = [5, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 300, 420, 600, 900, 1200, 1800, 2400, 3600]
DEFAULT_HR_REST = 60.0
NP_ROWS = 30
SURGE_SHARE, SURGE_ROWS = 1.2, 3
INTERVAL_SHARE, INTERVAL_ROWS, RECOVERY_ROWS = 0.9, 60, 30
CLIMB_GRADE, CLIMB_WINDOW, CLIMB_GAP, CLIMB_ROWS = 0.03, 10, 5, 60
LAG_ROWS = 60
EFFICIENCY_SECONDS, EFFICIENCY_ROWS = 1800, 30


@dataclass(frozen=True)
class AthleteParams:
    """ftp in watts, heart rates in beats a minute; basis is HRmax, HRR or LTHR; tz is an IANA zone."""

    ftp: Value = DEFAULT_FTP
    hr_max: Value = None
    hr_rest: Value = None
    lthr: Value = None
    cycling_lthr: Value = None
    basis: Value = "HRmax"
    tz: str = "UTC"


#: Keys of a configuration that give each parameter, the first that is there.
CONFIG_KEYS = {
    "ftp": ["power.ftp_watts", "ftp_watts"], "hr_max": ["heart_rate.hr_max_bpm", "hr_max_bpm"], "hr_rest": ["heart_rate.resting_hr_bpm", "resting_hr_bpm"],
    "lthr": ["heart_rate.lthr_bpm", "lthr_bpm"], "cycling_lthr": ["heart_rate.cycling_lthr_bpm", "cycling_lthr_bpm"], "basis": ["heart_rate.basis", "basis"], "tz": ["timezone"],
}


def params_from(config: dict) -> AthleteParams:
    """Parameters of a configuration as nested or flat dicts; what it doesn't name keeps its default."""

    def found(path: str) -> object:
        at: object = config
        for part in path.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return at

    values = {name: next((v for v in map(found, paths) if v is not None), None) for name, paths in CONFIG_KEYS.items()}
    return AthleteParams(**{k: v for k, v in values.items() if v is not None})


def resolve_ftp(*candidates: Value) -> Column:
    """The first candidate over zero, else DEFAULT_FTP."""
    return F.coalesce(*[F.when(col(c) > 0, col(c).cast("double")) for c in candidates], F.lit(DEFAULT_FTP))
