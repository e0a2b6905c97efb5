"""Per-workout metrics over a canonical record stream (workout_id, elapsed_sec and channels).

Each family gives one row per workout; `workout_metrics` joins them. Its families number the records in blocks of time
(`placed`) and look at them in blocks of rows, so no task has to hold a workout; intervals, grades and climbs still take a
workout as one task's window. A channel that is missing or null in all rows gives null metrics. Thresholds are AthleteParams: numbers, or columns of the records."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tempora.functions.numbers import rounded
from tempora.operators import blocks
from tempora.operators.blocks import overlapping
from tempora.operators.sequence import bridge_gaps, centered_sum, difference, ordered, runs, trailing_mean
from tempora.params import (
    CLIMB_GAP,
    CLIMB_GRADE,
    CLIMB_ROWS,
    CLIMB_WINDOW,
    CURVE_SECONDS,
    DEFAULT_HR_REST,
    EFFICIENCY_ROWS,
    EFFICIENCY_SECONDS,
    HR_ZONES,
    INTERVAL_ROWS,
    INTERVAL_SHARE,
    LAG_ROWS,
    NP_ROWS,
    PEAK_SECONDS,
    POWER_ZONE_CUTS,
    RECOVERY_ROWS,
    SURGE_ROWS,
    SURGE_SHARE,
    AthleteParams,
    Value,
    col,
)

KEY, TIME = "workout_id", "elapsed_sec"
POWER, HR = "power_watts", "heart_rate_bpm"
CHANNELS = [POWER, HR, "cadence_rpm", "speed_mps", "distance_m", "elevation_m", "temperature_c", "respiration_rate_brpm", "lr_balance_pct"]


def by_time() -> WindowSpec:
    return ordered(KEY, TIME)


def with_channels(records: DataFrame) -> DataFrame:
    """Absent channels as null columns; NaN counts as null, what isn't a number becomes null."""
    out = records
    for c in CHANNELS:
        value = F.col(c).try_cast("double") if c in records.columns else F.lit(None).cast("double")
        out = out.withColumn(c, F.nanvl(value, F.lit(None).cast("double")))
    return out


#: Channels whose values are counted along a workout.
COUNTS = {"_p": POWER, "_h": HR, "_e": "elevation_m"}
#: What is known of the whole of it: values of power and heart rate, power without a time, timed power without a heart
#: rate, the last time, the highest heart rate.
WHOLE = ["_np", "_nh", "_untimed", "_beatless", "_end", "_top_hr"]


def placed(records: DataFrame, names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Records (all columns, or KEY, TIME and those of keep) with these COUNTS up to each row and facts of the WHOLE
    workout; all of them without names. What is there already is taken as it is."""
    names = names or [*COUNTS, *WHOLE]
    own = records.select(KEY, TIME, *keep, *[n for n in names if n in records.columns]) if keep is not None else records
    power, timed, hr = F.col(POWER).isNotNull(), F.col(TIME).isNotNull(), F.col(HR).isNotNull()
    one = lambda c: F.when(c, 1).otherwise(0)
    whole = {
        "_np": (F.sum, one(power)), "_nh": (F.sum, one(hr)), "_untimed": (F.sum, one(power & ~timed)),
        "_beatless": (F.sum, one(power & timed & ~hr)), "_end": (F.max, F.col(TIME)), "_top_hr": (F.max, F.col(HR)),
    }
    missing = [n for n in names if n not in records.columns]
    counts = {n: one(F.col(COUNTS[n]).isNotNull()) for n in missing if n in COUNTS}
    return blocks.running(own, KEY, TIME, counts, whole={n: whole[n] for n in missing if n in WHOLE}) if missing else own


def _some(value: Column) -> Column:
    """Null instead of zero: what counts as absent in a ratio."""
    return F.when(value != 0, value)


def channel_stats(records: DataFrame) -> DataFrame:
    """Mean, least, greatest and number of values per channel, duration, moving time and distance."""
    digits = {HR: ("hr", 1), POWER: ("power", 1), "cadence_rpm": ("cadence", 1), "speed_mps": ("speed", 2)}
    stats = [f(c, n, d) for c, (n, d) in digits.items() for f in (
        lambda c, n, d: rounded(F.avg(c), d).alias(f"{n}_avg"),
        lambda c, n, d: F.max(c).alias(f"{n}_max"),
        lambda c, n, d: F.min(c).alias(f"{n}_min"),
        lambda c, n, d: F.count(c).alias(f"{n}_samples"),
    )]
    return records.groupBy(KEY).agg(*stats, F.max(TIME).alias("duration_sec"), F.max("distance_m").alias("distance_m"), F.count("*").alias("n_records"))


def passthrough(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """What is handed on as it is: start_time_utc (as stated, else the first record's), calories_kcal as stated, and the mean
    (2 decimals) and greatest speed of the records. metadata: a row a workout at most."""
    own = records.groupBy(KEY).agg(F.min("timestamp_utc").alias("_first"), rounded(F.avg("speed_mps"), 2).alias("avg_speed_mps"), F.max("speed_mps").alias("max_speed_mps"))
    said = metadata.select(KEY, F.col("start_time_utc").alias("_said"), "calories_kcal")
    return own.join(said, KEY, "left").select(KEY, F.coalesce("_said", "_first").alias("start_time_utc"), "calories_kcal", "avg_speed_mps", "max_speed_mps")


def missing_pct(samples: Column, duration: Column) -> Column:
    """Share of the duration without a sample, 0 to 100; null without samples or duration."""
    share = (1 - samples / duration) * 100
    return F.when((duration > 0) & (samples > 0), rounded(F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)), 1))


def data_quality(records: DataFrame) -> DataFrame:
    own = records.groupBy(KEY).agg(F.max(TIME).alias("d"), F.count(HR).alias("h"), F.count(POWER).alias("p"), F.count("cadence_rpm").alias("c"))
    return own.select(KEY, missing_pct(F.col("h"), F.col("d")).alias("hr_missing_pct"), missing_pct(F.col("p"), F.col("d")).alias("power_missing_pct"), missing_pct(F.col("c"), F.col("d")).alias("cadence_missing_pct"))


def capabilities(records: DataFrame) -> DataFrame:
    gps = [c for c in ("position_lat", "position_long") if c in records.columns]
    has_gps = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in gps]) if gps else F.lit(False)
    return records.groupBy(KEY).agg(F.bool_or(F.col(POWER).isNotNull()).alias("has_power"), F.bool_or(F.col(HR).isNotNull()).alias("has_hr"), F.bool_or(has_gps).alias("has_gps"))


def _fourth_root_mean(smooth: Column) -> Column:
    mean = F.pow(F.avg(F.pow(smooth, F.lit(4.0))), F.lit(0.25))
    return F.when(mean > 0, rounded(mean, 1))


def normalized_power(records: DataFrame, rows: int = NP_ROWS) -> DataFrame:
    own = placed(records, ["_p"], [POWER]).where(F.col(POWER).isNotNull()).select(KEY, "_p", POWER)
    seen = overlapping(own, "_p", rows - 1)
    smooth = seen.select(KEY, "_own", trailing_mean(F.col(POWER), ordered([KEY, "_block"], "_p"), rows).alias("_smooth")).where("_own")
    return smooth.groupBy(KEY).agg(_fourth_root_mean(F.col("_smooth")).alias("normalized_power"))


def load(stats: DataFrame, ftp: Value) -> DataFrame:
    """Variability index, intensity factor, training stress and pacing from normalized_power, power_avg, duration_sec."""
    np_, avg = _some(F.col("normalized_power")), _some(F.col("power_avg"))
    out = stats.withColumn("variability_index", rounded(np_ / avg, 2)).withColumn("intensity_factor", rounded(np_ / _some(col(ftp)), 3))
    intensity = F.col("intensity_factor")
    out = out.withColumn("tss", rounded(_some(F.col("duration_sec")) / 3600 * intensity * intensity * 100, 1))
    return out.withColumn("pacing_evenness", rounded(1 / _some(F.col("variability_index")), 3))


def peak_power(records: DataFrame, widths: list[int] | None = None) -> DataFrame:
    own = placed(records, ["_p"], [POWER]).where(F.col(POWER).isNotNull())
    found = blocks.numbered_peaks(own, POWER, KEY, "_p", widths or PEAK_SECONDS)
    # a difference of running sums: its last bits go first, so that a mean of 419.45 rounds up as in the SQL
    return found.select(KEY, *[rounded(F.round(c, 7), 1).alias(c) for c in found.columns if c != KEY])


def power_curve(records: DataFrame, widths: list[int] | None = None) -> DataFrame:
    """The curve in rows: workout_id, duration_sec, power; widths longer than the workout have none."""
    widths = widths or CURVE_SECONDS
    peaks = peak_power(records, widths)
    points = F.explode(F.array(*[F.struct(F.lit(n).alias("duration_sec"), F.col(f"peak_{n}").alias("power")) for n in widths]))
    return peaks.select(KEY, points.alias("p")).select(KEY, "p.*").where("power is not null")


def power_curve_map(records: DataFrame) -> DataFrame:
    """Best mean power by minutes, 1, 5, 20 and 60, as a map without empty entries."""
    minutes = [1, 5, 20, 60]
    peaks = peak_power(records, [m * 60 for m in minutes])
    pairs = F.map_from_arrays(F.array(*[F.lit(m) for m in minutes]), F.array(*[F.col(f"peak_{m * 60}") for m in minutes]))
    return peaks.select(KEY, F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("power_curve"))


def envelopes(peaks: DataFrame, ftp: Value) -> DataFrame:
    """Sprint, VO2 and threshold power as shares of ftp; each needs all of its peaks."""
    share = _some(col(ftp))
    p = lambda n: F.col(f"peak_{n}")
    return peaks.select(
        KEY,
        rounded((0.6 * p(5) + 0.4 * p(30)) / share, 3).alias("sprint_envelope"),
        rounded((p(180) + p(300) + p(480)) / 3 / share, 3).alias("vo2_envelope"),
        rounded((p(1200) + p(3600)) / 2 / share, 3).alias("threshold_envelope"),
    )


def variability(records: DataFrame) -> DataFrame:
    """Coefficients of variation of power and cadence (sample deviation); null unless the mean is positive."""
    cv = lambda c: rounded(F.when(F.avg(c) > 0, F.stddev_samp(c) / F.avg(c)), 3)
    return records.groupBy(KEY).agg(cv(POWER).alias("power_cv"), cv("cadence_rpm").alias("cadence_cv"))


def durability(records: DataFrame) -> DataFrame:
    """Slope of power over time, and the change from the first quarter of rows to the last one per second."""
    own = placed(records, ["_p", "_np", "_untimed", "_end"], [POWER]).where(F.col(POWER).isNotNull() & F.col(TIME).isNotNull())
    rn, n = F.col("_p") - F.col("_untimed"), F.col("_np") - F.col("_untimed")
    quarter = F.floor(n / 4)
    first, last = F.avg(F.when(rn <= quarter, F.col(POWER))), F.avg(F.when(rn > n - quarter, F.col(POWER)))
    return own.groupBy(KEY).agg(rounded(F.regr_slope(POWER, TIME), 5).alias("durability_slope"), rounded((last - first) / _some(F.max("_end")), 6).alias("fatigue_rate"))


def surges(records: DataFrame, ftp: Value, share: float = SURGE_SHARE, rows: int = SURGE_ROWS) -> DataFrame:
    """Runs of at least `rows` non-null rows above share * ftp, and how many an hour (null for none)."""
    own = placed(records, ["_p"]).where(F.col(POWER).isNotNull()).select(KEY, "_p", (F.col(POWER) > share * col(ftp)).alias("_hard"))
    found = blocks.runs(own, F.col("_hard"), KEY, "_p", least=rows, span=blocks.ROWS).groupBy(KEY).agg(F.count("*").alias("_n"))
    out = records.groupBy(KEY).agg(F.max(TIME).alias("_d")).join(found, KEY, "left").withColumn("surge_count", F.coalesce("_n", F.lit(0)).cast("long"))
    return out.select(KEY, "surge_count", rounded(F.when(F.col("surge_count") > 0, F.col("surge_count") / (_some(F.col("_d")) / 3600)), 3).alias("surge_density"))


def efficiency(records: DataFrame, seconds: int = EFFICIENCY_SECONDS, rows: int = EFFICIENCY_ROWS) -> DataFrame:
    """Power over heart rate in both halves, heart-rate drift and decoupling.

    Non-null power and heart-rate rows are numbered on their own and cut to the shorter of the two; a half's normalized
    power starts its smoothing anew. Short workouts, or ones with too few values, have no row."""
    numbered = placed(records, ["_p", "_h", "_np", "_nh", "_end"], [POWER, HR]).withColumn("_n", F.least("_np", "_nh")).where((F.col("_n") >= rows) & (F.col("_end") >= seconds))
    mid = F.floor(F.col("_n") / 2)
    p = numbered.where(F.col(POWER).isNotNull() & (F.col("_p") <= F.col("_n"))).select(KEY, "_p", POWER, (F.col("_p") > mid).alias("_late"))
    mean = lambda by: trailing_mean(F.col(POWER), ordered([KEY, "_block", *by], "_p"), NP_ROWS)
    smooth = overlapping(p, "_p", NP_ROWS - 1).select(KEY, "_late", "_own", mean([]).alias("_all"), mean(["_late"]).alias("_half")).where("_own")
    power = smooth.groupBy(KEY).agg(
        _fourth_root_mean(F.col("_all")).alias("np"),
        _fourth_root_mean(F.when(~F.col("_late"), F.col("_half"))).alias("np1"),
        _fourth_root_mean(F.when(F.col("_late"), F.col("_half"))).alias("np2"),
    )
    h = numbered.where(F.col(HR).isNotNull() & (F.col("_h") <= F.col("_n"))).withColumn("_late", F.col("_h") > mid)
    heart = h.groupBy(KEY).agg(F.avg(HR).alias("h"), F.avg(F.when(~F.col("_late"), F.col(HR))).alias("h1"), F.avg(F.when(F.col("_late"), F.col(HR))).alias("h2"))
    both = power.join(heart, KEY).where("np is not null and np1 is not null and np2 is not null and h > 0 and h1 > 0 and h2 > 0")
    ef1, ef2 = F.col("np1") / F.col("h1"), F.col("np2") / F.col("h2")
    return both.select(
        KEY, rounded(ef1, 3).alias("ef_first_half"), rounded(ef2, 3).alias("ef_second_half"), rounded(F.col("np") / F.col("h"), 3).alias("ef_overall"),
        rounded(F.col("h2") - F.col("h1"), 1).alias("hr_drift_bpm"), rounded((ef1 / ef2 - 1) * 100, 2).alias("decoupling_pct"),
    )


def hr_power_lag(records: DataFrame, reach: int = LAG_ROWS) -> DataFrame:
    """The shift of heart rate, in rows from -reach to reach, that correlates best with power; the first of equal ones.

    A shift of lag pairs power of a row with the heart rate lag rows before it. All shifts come from one sorted window of
    a block; they become rows only inside the task, where their sums per workout and shift are kept. Null below 10 rows, where a
    row with power has no heart rate, or where no shift has a correlation."""
    own = placed(records, ["_p", "_np", "_untimed", "_beatless"], [POWER, HR]).where(F.col(POWER).isNotNull() & F.col(TIME).isNotNull())
    fit = own.where((F.col("_np") - F.col("_untimed") >= 10) & (F.col("_beatless") == 0)).select(KEY, POWER, HR, (F.col("_p") - F.col("_untimed")).alias("_rn"))
    # of row n the heart rates from row n - reach to n + reach, as far as there are rows
    near = F.collect_list(HR).over(ordered([KEY, "_block"], "_rn").rowsBetween(-reach, reach))
    moved = overlapping(fit, "_rn", reach, reach).select(KEY, POWER, "_rn", "_own", near.alias("_near")).where("_own")
    pairs = moved.select(KEY, POWER, F.least(F.col("_rn") - 1, F.lit(reach)).alias("_before"), F.posexplode("_near").alias("_i", "_hr")).withColumn("_lag", F.col("_before") - F.col("_i"))
    c = F.try_divide(F.covar_pop(POWER, "_hr"), F.stddev_pop(POWER) * F.stddev_pop("_hr"))
    scored = pairs.groupBy(KEY, "_lag").agg(c.alias("_c")).where("_c is not null")
    best = scored.groupBy(KEY).agg(F.max_by("_lag", F.struct("_c", -F.col("_lag"))).alias("hr_power_lag_sec"))
    return records.select(KEY).distinct().join(best, KEY, "left")


def elevation(records: DataFrame) -> DataFrame:
    own = placed(records, ["_e"], ["elevation_m"]).where(F.col("elevation_m").isNotNull()).select(KEY, "_e", "elevation_m")
    own = overlapping(own, "_e", 1).select(KEY, "_own", difference(F.col("elevation_m"), ordered([KEY, "_block"], "_e")).alias("_step")).where("_own")
    total = lambda c: rounded(F.when(F.count("*") >= 2, F.sum(c)), 1)
    return own.groupBy(KEY).agg(total(F.greatest("_step", F.lit(0.0))).alias("elevation_gain_m"), total(F.greatest(-F.col("_step"), F.lit(0.0))).alias("elevation_loss_m"))


def hr_reference(params: AthleteParams, sport: Column | None = None, observed: Column | None = None) -> Column:
    """The heart rate that zones refer to: by basis, LTHR (the cycling one for rides) or the maximum; else the highest seen."""
    rides = sport.rlike("(?i)cycl|bike|bik|ride") if sport is not None else F.lit(False)
    lthr = F.when(rides, F.coalesce(col(params.cycling_lthr).cast("double"), col(params.lthr).cast("double"))).otherwise(col(params.lthr).cast("double"))
    chosen = F.when(col(params.basis) == "LTHR", lthr).otherwise(col(params.hr_max).cast("double"))
    return F.coalesce(chosen, observed) if observed is not None else chosen


def hr_zone_bounds(reference: Column, basis: Value = "HRmax", rest: Value = None) -> list[tuple[Column, Column]]:
    """Low and high of five zones, cut to whole beats. HRR spans from rest (60 where unknown) to the reference by the HRmax
    shares. Null without a reference."""
    basis, rest = col(basis), F.coalesce(_some(col(rest).cast("double")), F.lit(DEFAULT_HR_REST))
    cut = lambda c: c.cast("int")
    by_share = lambda name, side, z: cut(reference * HR_ZONES[name][side][z])
    reserve = lambda side, z: cut(rest + (reference - rest) * HR_ZONES["HRmax"][side][z])
    return [tuple(F.when(basis == "LTHR", by_share("LTHR", side, z)).when(basis == "HRR", reserve(side, z)).otherwise(by_share("HRmax", side, z)) for side in (0, 1)) for z in range(5)]


def zone_model(basis: Value) -> Column:
    return F.when(col(basis) == "LTHR", "coggan").otherwise("karvonen")


def _first_zone(tests: Iterable[Column], last: int) -> Column:
    out = None
    for z, test in enumerate(tests, 1):
        out = F.when(test, z) if out is None else out.when(test, z)
    return out.otherwise(last)


def hr_zone(hr: Column, bounds: list[tuple[Column, Column]]) -> Column:
    """The first zone whose high is at or above the heart rate; below and beyond the zones count to the first and last.
    Null without a heart rate or without bounds."""
    return F.when(hr.isNotNull() & bounds[-1][1].isNotNull(), _first_zone([hr <= high for _, high in bounds[:-1]], len(bounds)))


def power_zone_bounds(ftp: Value) -> list[Column]:
    return [(col(ftp) * k).cast("int") for k in POWER_ZONE_CUTS]


def power_zone_watts(ftp: Value) -> Column:
    """Low and high watts of the seven zones, as an array of structs; the last is open and ends at twice the threshold."""
    cuts = [c.cast("double") for c in power_zone_bounds(ftp)]
    ends = zip([F.lit(0.0), *cuts], [*cuts, col(ftp).cast("double") * 2])
    return F.array(*[F.struct(F.lit(z).alias("zone"), low.alias("low_w"), high.alias("high_w")) for z, (low, high) in enumerate(ends, 1)])


def power_zone(power: Column, ftp: Value) -> Column:
    """The first zone whose bound is above the power; negative and impossible power has none."""
    cuts = power_zone_bounds(ftp)
    return F.when((power >= 0) & (power < 99_999), _first_zone([power < c for c in cuts], len(cuts) + 1))


def zone_seconds(records: DataFrame, params: AthleteParams) -> DataFrame:
    """Rows in each of five heart-rate and seven power zones, totals, low aerobic (1, 2) and intensity (4 and up)."""
    bounds = hr_zone_bounds(F.coalesce(hr_reference(params), F.col("_top_hr")), params.basis, params.hr_rest)
    zoned = placed(records, ["_top_hr"]).select(KEY, hr_zone(F.col(HR), bounds).alias("_h"), power_zone(F.col(POWER), params.ftp).alias("_p"))
    count = lambda c, zs, name: F.count_if(F.col(c).isin(zs)).alias(name)
    return zoned.groupBy(KEY).agg(
        *[count("_h", [z], f"hr_z{z}_sec") for z in range(1, 6)], F.count("_h").alias("hr_zone_total_sec"),
        *[count("_p", [z], f"pwr_z{z}_sec") for z in range(1, 8)], F.count("_p").alias("pwr_zone_total_sec"),
        count("_p", [1, 2], "low_aerobic_sec"), count("_p", [4, 5, 6, 7], "intensity_sec"),
    )


def intervals(records: DataFrame, ftp: Value, share: float = INTERVAL_SHARE, rows: int = INTERVAL_ROWS, recovery: int = RECOVERY_ROWS) -> DataFrame:
    """Efforts of at least `rows` rows at share * ftp or more, with the slope of heart rate in the rows after each."""
    agg = [F.min(TIME).alias("_s"), F.max(TIME).alias("_e"), rounded(F.avg(POWER), 1).alias("avg_power"), rounded(F.max(POWER), 1).alias("peak_power")]
    found = runs(records.select(KEY, TIME, POWER), F.col(POWER) >= share * col(ftp), KEY, TIME, agg, rows)
    numbered = records.select(KEY, HR, (F.row_number().over(by_time()) - 1).alias("_rn"), F.count("*").over(Window.partitionBy(KEY)).alias("_n"))
    after = found.select(KEY, "run_end", F.explode(F.sequence(F.col("run_end") + 1, F.col("run_end") + recovery)).alias("_rn")).join(numbered, [KEY, "_rn"])
    # a heart rate that is missing leaves no slope, as would a single row
    slope = after.groupBy(KEY, "run_end").agg(F.when((F.count("*") >= 2) & (F.count(HR) == F.count("*")), rounded(F.regr_slope(F.col(HR), F.col("_rn")), 4)).alias("recovery_hr_slope"))
    out = found.join(slope, [KEY, "run_end"], "left")
    return out.select(KEY, rounded("_s", 1).alias("start_sec"), rounded("_e", 1).alias("end_sec"), F.round(F.col("_e") - F.col("_s") + 1).cast("long").alias("duration_sec"), "avg_power", "peak_power", "recovery_hr_slope")


def grades(records: DataFrame, window: int = CLIMB_WINDOW) -> DataFrame:
    """Adds grade: rise over distance of the steps around the step from this row to the next; null where there is none."""
    step = lambda c: F.lead(c).over(by_time()) - F.col(c)
    steps = records.withColumn("_dd", step("distance_m")).withColumn("_de", step("elevation_m")).withColumn("_more", F.lead(TIME).over(by_time()).isNotNull())
    inner = steps.where("_more")
    sums = inner.withColumn("_sd", centered_sum(F.col("_dd"), by_time(), window, 3)).withColumn("_se", centered_sum(F.col("_de"), by_time(), window, 3))
    return sums.withColumn("grade", F.when(F.col("_sd") > 0, F.col("_se") / F.col("_sd"))).drop("_dd", "_de", "_more", "_sd", "_se")


def climbs(records: DataFrame, grade: float = CLIMB_GRADE, window: int = CLIMB_WINDOW, gap: int = CLIMB_GAP, rows: int = CLIMB_ROWS) -> DataFrame:
    """Runs of at least `rows` rows of that grade, short dips bridged, with their grade, power, efficiency and ends.

    The window is for workouts of at least that many steps, as real ones are."""
    marked = bridge_gaps(grades(records, window).withColumn("_up", F.col("grade") >= grade), "_up", KEY, TIME, gap)
    first, last = (lambda c: F.min_by(c, TIME)), (lambda c: F.max_by(c, TIME))
    agg = [F.avg("grade").alias("_g"), F.avg(POWER).alias("_p"), F.avg(HR).alias("_h"), F.min(TIME).alias("_s"), F.max(TIME).alias("_e"), first("distance_m").alias("_sd"), last("distance_m").alias("_ed"), first("timestamp_utc").alias("start_time_utc"), last("timestamp_utc").alias("end_time_utc")]
    places = [(side, c) for side in ("start", "end") for c in ("position_lat", "position_long") if c in records.columns]
    agg += [(first if side == "start" else last)(c).alias(f"{side}_{c}") for side, c in places]
    found = runs(marked, F.col("_up"), KEY, TIME, agg, rows)
    return found.select(
        KEY, F.col("run_rows").alias("duration"), rounded(F.col("_g") * 100, 2).alias("avg_grade"), rounded("_p", 1).alias("avg_power"),
        rounded(F.when(F.col("_h") > 0, F.col("_p") / F.col("_h")), 3).alias("efficiency_factor"),
        rounded("_s", 1).alias("start_sec"), rounded("_e", 1).alias("end_sec"), "start_time_utc", "end_time_utc",
        rounded("_sd", 1).alias("start_distance_m"), rounded("_ed", 1).alias("end_distance_m"),
        *[rounded(f"{side}_{c}", 6).alias(f"{side}_{c}") for side, c in places],
    )


def basic_stats(records: DataFrame) -> DataFrame:
    """The plain fallback: unrounded means and shares of rows without a value."""
    share = lambda c: (1 - F.count(c) / F.count("*")) * 100
    return records.groupBy(KEY).agg(F.avg(HR).alias("hr_avg"), F.max(HR).alias("hr_max"), F.avg(POWER).alias("power_avg"), F.max(POWER).alias("power_max"), share(HR).alias("hr_missing_pct"), share(POWER).alias("power_missing_pct"))


def dealt(records: DataFrame) -> DataFrame:
    """Records with all channels, `placed`. Store these, or persist and later unpersist them, before `workout_metrics`: its
    families then need not number them anew."""
    return placed(with_channels(records).select(KEY, TIME, *CHANNELS))


def workout_metrics(own: DataFrame, params: AthleteParams) -> DataFrame:
    """One wide row per workout of `dealt` records; params.ftp must be a number or the same in a workout."""
    stats = channel_stats(own).join(normalized_power(own), KEY, "left")
    parts = [load(stats, params.ftp), data_quality(own), zone_seconds(own, params), variability(own), durability(own), surges(own, params.ftp), efficiency(own), hr_power_lag(own), elevation(own)]
    peaks = peak_power(own)
    parts += [peaks, envelopes(peaks, params.ftp)]
    return reduce(lambda a, b: a.join(b, KEY, "left"), parts)


#: The families of a nested metrics row, by the columns of the wide one.
FAMILIES = {
    "session": ["duration_sec", "distance_m", "elevation_gain_m", "elevation_loss_m"],
    "power": ["power_avg", "power_max", "normalized_power", "variability_index", "intensity_factor", "tss"],
    "heart_rate": ["hr_avg", "hr_max", "hr_min"],
    "efficiency": ["ef_first_half", "ef_second_half", "ef_overall", "hr_drift_bpm", "decoupling_pct"],
    "durability": ["durability_slope", "fatigue_rate", "surge_count", "surge_density", "hr_power_lag_sec"],
    "peaks": [f"peak_{n}" for n in PEAK_SECONDS],
}


def nested(metrics: DataFrame, families: dict[str, list[str]] | None = None) -> DataFrame:
    """Wide columns as one struct per family; a family without any value is null."""
    families = families or FAMILIES
    return metrics.select(KEY, *[F.when(F.coalesce(*[F.col(c).cast("double") for c in cs]).isNotNull(), F.struct(*cs)).alias(name) for name, cs in families.items()])


def flat(rows: DataFrame, families: dict[str, list[str]] | None = None) -> DataFrame:
    """The reverse of nested."""
    return rows.select(KEY, *[F.col(f"{name}.{c}").alias(c) for name, cs in (families or FAMILIES).items() for c in cs])
