"""Sequence operators over ordered groups: windows of rows, runs, gaps, resampling.

Every operator partitions by a key and orders by a column within it. Give `by` as small groups (a workout), never as a
whole table: a group is one task's window. Functions that share key and order share one shuffle and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tempora.operators.selection import spread


def ordered(by: str | list[str], order: str | Column | list[str]) -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*(order if isinstance(order, list) else [order]))


def trailing_mean(value: Column, window: WindowSpec, rows: int) -> Column:
    """Mean of the last `rows` rows; null until there are that many. Drop nulls first to count values, not rows."""
    frame = window.rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def centered_sum(value: Column, window: WindowSpec, rows: int, least: int) -> Column:
    """Sum over `rows` rows around this one (an even width reaches one row further back); null below `least` values."""
    frame = window.rowsBetween(-(rows // 2), (rows - 1) // 2)
    return F.when(F.count(value).over(frame) >= least, F.sum(value).over(frame))


def difference(value: Column, window: WindowSpec) -> Column:
    return value - F.lag(value).over(window)


def forward_fill(value: Column, window: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def peak_means(df: DataFrame, value: str, by: str, order: str, widths: list[int], name: str = "peak_{}") -> DataFrame:
    """The highest mean of each width in consecutive non-null rows, per group; null where a group has fewer rows.

    One running sum serves all widths: a window's sum is the difference of two of its values."""
    w = ordered(by, order)
    own = df.where(F.col(value).isNotNull()).select(by, order, value)
    sums = own.select(by, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"), F.row_number().over(w).alias("_rn"), order)
    lags = sums.select(by, "_rn", "_sum", *[F.lag("_sum", n, 0.0).over(w).alias(f"_before_{n}") for n in widths])
    return lags.groupBy(by).agg(*[F.max(F.when(F.col("_rn") >= n, (F.col("_sum") - F.col(f"_before_{n}")) / n)).alias(name.format(n)) for n in widths])


def runs(df: DataFrame, flag: Column, by: str, order: str, carry: list[Column] | None = None, least: int = 1) -> DataFrame:
    """Maximal runs of consecutive rows where flag is true (null counts as false), of at least `least` rows.

    Gives by, run_start and run_end (row numbers from 0), run_rows, and the aggregates in carry over the run's rows."""
    w = ordered(by, order)
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False))).withColumn("_rn", F.row_number().over(w) - 1)
    # rows that are on keep the same count of rows that are off before them
    island = marked.withColumn("_off", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    out = island.groupBy(by, "_off").agg(F.min("_rn").alias("run_start"), F.max("_rn").alias("run_end"), F.count("*").alias("run_rows"), *(carry or []))
    return out.drop("_off").where(F.col("run_rows") >= least)


def bridge_gaps(df: DataFrame, flag: str, by: str, order: str, most: int) -> DataFrame:
    """flag with inner runs of false of at most `most` rows, between rows that are true, set to true (nulls are false)."""
    w = ordered(by, order)
    on = F.coalesce(F.col(flag), F.lit(False))
    marked = df.withColumn("_rn", F.row_number().over(w)).withColumn("_last", F.max(F.when(on, F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = ordered(by, F.desc("_rn"))  # a running minimum from the end: a frame to the end would be summed anew for each row
    marked = marked.withColumn("_next", F.min(F.when(on, F.col("_rn"))).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.col("_next") - F.col("_last") - 1
    return marked.withColumn(flag, on | F.coalesce(gap <= most, F.lit(False))).drop("_rn", "_last", "_next")


def is_regular(df: DataFrame, by: str, time: str, step: float = 1.0, slack: float = 0.01) -> DataFrame:
    """Whether all gaps of a group are step, give or take less than slack: by, regular. A single row is regular."""
    gap = difference(F.col(time), ordered(by, time))
    marked = df.where(F.col(time).isNotNull()).select(by, (F.abs(gap - step) <= slack).alias("_ok"))
    return marked.groupBy(by).agg(F.coalesce(F.bool_and("_ok"), F.lit(True)).alias("regular"))


def distortion(df: DataFrame, by: str, time: str) -> DataFrame:
    """What resampling to one row a second would insert: gap_count, max_gap_sec, inserted_bins, distortion_pct."""
    gaps = df.where(F.col(time).isNotNull()).select(by, time, difference(F.col(time), ordered(by, time)).alias("_gap"))
    inserted = F.sum(F.greatest(F.round("_gap") - 1, F.lit(0.0)))
    span = F.max(time) - F.min(time)
    return gaps.groupBy(by).agg(F.count_if(F.col("_gap") > 1.01).alias("gap_count"), F.round(F.max("_gap"), 3).alias("max_gap_sec"), F.coalesce(inserted, F.lit(0.0)).cast("long").alias("inserted_bins"), F.round(F.when(span > 0, inserted / span * 100), 3).alias("distortion_pct"))


def time_axis(df: DataFrame, by: str, stamp: str = "timestamp_utc", elapsed: str = "elapsed_sec") -> DataFrame:
    """Adds axis_sec: seconds since the epoch by stamp where the group has any, else elapsed; rows without one go."""
    has = F.max(F.col(stamp).isNotNull()).over(Window.partitionBy(by))
    seconds = F.unix_micros(F.col(stamp).cast("timestamp")) / 1e6
    return df.withColumn("axis_sec", F.when(has, seconds).otherwise(F.col(elapsed).cast("double"))).where("axis_sec is not null")


def resample(df: DataFrame, by: str, time: str, mean: list[str], last: list[str], concat: list[str] | None = None) -> DataFrame:
    """One row per whole second from a group's first to its last: means (null in empty bins), last values carried
    forward, arrays joined in order of time (empty in empty bins)."""
    binned = df.withColumn("_bin", F.floor(time).cast("long"))
    ends = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in last]
    arrays = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.coalesce(c, F.array().cast("array<double>")).alias("v")))), lambda x: x["v"])).alias(c) for c in concat or []]
    bins = binned.groupBy(by, "_bin").agg(*[F.avg(c).alias(c) for c in mean], *ends, *arrays)
    spine = bins.groupBy(by).agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi")).select(by, F.explode(F.sequence("_lo", "_hi")).alias("_bin"))
    full = spine.join(bins, [by, "_bin"], "left")
    w = ordered(by, "_bin")
    return full.select(by, F.col("_bin").cast("double").alias(time), *mean, *[forward_fill(F.col(c), w).alias(c) for c in last], *[F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in concat or []])


def irregular(df: DataFrame, by: str, time: str) -> DataFrame:
    """Groups not at one row a second: by, rows, and median, least and greatest interval in seconds (3 decimals)."""
    gaps = df.where(F.col(time).isNotNull()).select(by, difference(F.col(time), ordered(by, time)).alias("_gap")).where("_gap is not null")
    bad = gaps.groupBy(by).agg(F.bool_and(F.abs(F.col("_gap") - 1) <= 0.01).alias("_ok")).where("not _ok").select(by)
    found = spread(gaps.join(bad, by, "left_semi"), by, "_gap")
    names = {"median": "median_interval_sec", "least": "min_interval_sec", "greatest": "max_interval_sec"}
    return found.select(by, (F.col("non_null") + 1).alias("rows"), *[F.round(c, 3).alias(n) for c, n in names.items()])


def require_regular(df: DataFrame, by: str, time: str, mean: list[str], last: list[str], strict: bool = False) -> DataFrame:
    """Groups of one row a second as they are, the others resampled; or, if strict, a ValueError that names the first
    irregular group and its intervals."""
    checked = is_regular(df, by, time)
    if strict:
        bad = checked.where("not regular").select(F.min(by)).first()[0]
        if bad is not None:
            why = irregular(df.where(F.col(by) == bad), by, time).first().asDict()
            raise ValueError(f"records are not at one row a second: {why.pop(by)} ({', '.join(f'{k}={v}' for k, v in why.items())}); resample them or leave strict mode")
        return df.select(by, time, *mean, *last)
    fine = df.join(checked.where("regular"), by, "left_semi").select(by, time, *mean, *last)
    return fine.unionByName(resample(df.join(checked.where("not regular"), by, "left_semi"), by, time, mean, last))
