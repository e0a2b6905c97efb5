"""Scans along time that no key's rows have to go through in one task.

Rows are dealt by key and block of time. A summary of each block (a sum, the last value) is aggregated before its
shuffle; a scan over a key's summaries, one row a block, gives what the blocks before carry into each; and it enters the
block as a first row of its own, so that one window over (key, block) does the rest. Rows are shuffled once; a task holds
blocks, whatever the length of a key's history. Choose `span` so that a block's rows fit a task: a second of a 1 Hz stream
is a row, a month of body metrics some hundred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

#: Seconds of a block: sparse histories, and streams of about a row a second.
SPARSE, DENSE = 30 * 86_400, 50_000
#: Rows of a block where blocks are of rows.
ROWS = 1 << 16
#: Rows of a task where rows are counted first.
TASK_ROWS = 1 << 19


def block_of(df: DataFrame, time: str, span: float) -> Column:
    """The block of a time, which is a date, a timestamp or a number of seconds; null of a null one, NaN is the last."""
    kind = df.schema[time].dataType
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6 if isinstance(kind, (DateType, TimestampType, TimestampNTZType)) else F.col(time)
    return F.floor(F.nanvl(seconds / span, F.lit(float("inf"))))


def counted_out(df: DataFrame, *keys: str) -> DataFrame:
    """df by hash of its keys, some TASK_ROWS rows a task, whatever the rows and the session's number of partitions.

    The rows are counted first, by a job of its own: store those that are dear to compute."""
    return df.repartition(df.count() // TASK_ROWS + 1, *keys)


def carried(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, ties: list[str], values: dict[str, Column], latest: list[str] | None = None, day_end: bool = False, span: float = SPARSE) -> DataFrame:
    """Rows of left as a struct `_left`, and per name of `values` its last non-null value among right rows of the same key
    at or before left_time (ties in time by `ties`, ascending).

    Names in `latest` fall back to the latest value of all, even a later one. day_end: right_time is a date that holds for
    the whole day of left_time. A null time of either side matches nothing, but a left row is never lost."""
    times = F.to_date(left_time) if day_end else F.col(left_time)
    keys, kinds = [f"_k{i}" for i in range(len(ties))], dict(right.dtypes)
    shapes = {n: right.select(c.alias(n)).schema[n].dataType for n, c in values.items()}
    nothing = lambda n: F.lit(None).cast(shapes[n]).alias(n)
    whole = left.select(F.struct(*left.columns).alias("_left")).schema[0].dataType
    l = left.select(F.col(by).alias("_by"), times.alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(kinds[t]).alias(k) for t, k in zip(ties, keys)], F.struct(*left.columns).alias("_left"), *map(nothing, values))  # noqa: E741
    r = right.where(F.col(right_time).isNotNull()).select(F.col(by).alias("_by"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *[F.col(t).alias(k) for t, k in zip(ties, keys)], F.lit(None).cast(whole).alias("_left"), *[c.alias(n) for n, c in values.items()])
    both = l.unionByName(r)
    both = both.withColumn("_block", block_of(both, "_t", span))
    at = F.struct("_t", *keys)
    # only right rows are sorted for their last values; of left rows it takes the blocks that they are in
    last = both.where("_side = 0").groupBy("_by", "_block").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in values])
    seen = both.where("_side = 1").select("_by", "_block").distinct()
    own = last.unionByName(seen, allowMissingColumns=True).groupBy("_by", "_block").agg(*[F.first(n, ignorenulls=True).alias(n) for n in values])
    order = Window.partitionBy("_by").orderBy(F.asc_nulls_first("_block"))
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    newest = [F.last(n, ignorenulls=True).over(all_).alias(f"_latest_{n}") for n in latest or []]
    first = own.select("_by", "_block", F.lit(-1).alias("_side"), *[F.last(n, ignorenulls=True).over(before).alias(n) for n in values], *newest)
    known = [c for c in first.columns if c not in ("_by", "_block", "_side")]
    first = first.where(F.coalesce(*[F.col(c).isNotNull() | F.lit(None) for c in known], F.lit(False)))
    rows = both.unionByName(first, allowMissingColumns=True)
    within = Window.partitionBy("_by", "_block").orderBy(F.col("_side") >= 0, "_t", "_side", *keys).rowsBetween(Window.unboundedPreceding, 0)
    found = [F.when(F.col("_t").isNotNull(), F.last(n, ignorenulls=True).over(within)).alias(n) for n in values]
    # the first row of a block has the latest value of all
    found = [F.coalesce(c, F.first(f"_latest_{n}", ignorenulls=True).over(within)).alias(n) if n in (latest or []) else c for n, c in zip(values, found)]
    return rows.select("_side", "_left", *found).where("_side = 1").drop("_side")


def running(df: DataFrame, by: str, time: str, sums: dict[str, Column], ties: list[str] | None = None, span: float = DENSE, whole: dict[str, tuple[Callable, Column]] | None = None) -> DataFrame:
    """df with running sums (this row's value counted, nulls as 0) along each key in order of time and ties.

    Rows without a time come first, as in an ascending window. `whole` names aggregates of all rows of the key, which each
    row gets as well: a function that aggregates its own results, as F.sum or F.max, and what it is of."""
    whole = whole or {}
    rows = df.withColumn("_block", block_of(df, time, span)).select("_block", F.col(by).alias("_by"), F.col(time).alias("_t"), *[F.col(t).alias(f"_k{i}") for i, t in enumerate(ties or [])], F.struct(*df.columns).alias("_row"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()], *[c.alias(n) for n, (_, c) in whole.items()])
    totals = rows.groupBy("_by", "_block").agg(*[F.sum(n).alias(n) for n in sums], *[f(n).alias(n) for n, (f, _) in whole.items()])
    order = Window.partitionBy("_by").orderBy(F.asc_nulls_first("_block"))
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = totals.select("_by", "_block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums], *[f(n).over(all_).alias(n) for n, (f, _) in whole.items()])
    both = rows.drop(*whole).unionByName(first, allowMissingColumns=True)
    keys = [f"_k{i}" for i in range(len(ties or []))]
    within = Window.partitionBy("_by", "_block").orderBy(F.col("_row").isNotNull(), "_t", *keys).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("_row", *[F.sum(n).over(within).alias(n) for n in sums], *[F.first(n).over(within).alias(n) for n in whole])
    return found.where("_row is not null").select("_row.*", *sums, *whole)


def overlapping(df: DataFrame, number: str, before: int, after: int = 0, rows: int = ROWS) -> DataFrame:
    """df, whose rows are numbered from 1 in each key, in blocks of numbers (`_block`): a block has its own rows (`_own`),
    the `before` rows ahead of them and the `after` rows behind. So windows of that reach see within a key and block what
    they would see in the whole key."""
    size = max(rows, before, after)
    own, place = F.floor((F.col(number) - 1) / size), (F.col(number) - 1) % size
    seen = F.array_compact(F.array(own, F.when(place >= size - before, own + 1), F.when(place < after, own - 1)))
    return df.select("*", F.explode(seen).alias("_block")).withColumn("_own", own == F.col("_block"))


def runs(df: DataFrame, flag: Column, by: str, time: str, ties: list[str] | None = None, carry: list[Column] | None = None, least: int = 1, span: float = DENSE) -> DataFrame:
    """As `sequence.runs`, for keys of any length: by, run_start and run_end (row numbers from 0), run_rows, carry."""
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    counted = running(marked, by, time, {"_rn": F.lit(1), "_off": F.when(F.col("_on"), 0).otherwise(1)}, ties, span)
    # rows that are on keep the same count of rows that are off before them; a long run is aggregated before it is shuffled
    out = counted.where("_on").groupBy(by, "_off").agg((F.min("_rn") - 1).alias("run_start"), (F.max("_rn") - 1).alias("run_end"), F.count("*").alias("run_rows"), *(carry or []))
    return out.drop("_off").where(F.col("run_rows") >= least)


def peak_means(df: DataFrame, value: str, by: str, time: str, widths: list[int], ties: list[str] | None = None, name: str = "peak_{}", span: float = DENSE, rows: int = ROWS) -> DataFrame:
    """As `sequence.peak_means`, for keys of any length: the highest mean of each width in consecutive non-null rows.

    Rows are numbered in blocks of time and dealt anew in blocks of rows."""
    numbered = running(df.where(F.col(value).isNotNull()), by, time, {"_rn": F.lit(1)}, ties, span)
    return numbered_peaks(numbered, value, by, "_rn", widths, name, rows)


def numbered_peaks(df: DataFrame, value: str, by: str, number: str, widths: list[int], name: str = "peak_{}", rows: int = ROWS) -> DataFrame:
    """The same of rows that are numbered from 1 in each key. A window's sum is the difference of two running sums of a
    block, which starts with as many rows of the one before as the widest window has."""
    seen = overlapping(df.select(by, number, value), number, max(widths), rows=rows)
    w = Window.partitionBy(by, "_block").orderBy(number)
    sums = seen.withColumn("_sum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lags = sums.select(by, number, "_own", "_sum", *[F.lag("_sum", n, 0.0).over(w).alias(f"_before_{n}") for n in widths]).where("_own")
    return lags.groupBy(by).agg(*[F.max(F.when(F.col(number) >= n, (F.col("_sum") - F.col(f"_before_{n}")) / n)).alias(name.format(n)) for n in widths])


def rolling_sum(df: DataFrame, value: str, by: str, time: str, seconds: int, name: str) -> DataFrame:
    """df with the sum of value over the rows of the key in the `seconds` before each row's time, that time included.

    Rows are summed a second first, so a block, as long as the window, has at most `seconds` of them whatever the rows.
    A window is the end of one block and the start of the next: two running sums, one from each side, give both, and no
    second is summed anew for each row. Rows of equal time are all counted. Times are whole seconds or are cut to them; a
    row without a time has no sum."""
    kind = df.schema[time].dataType
    at = F.unix_seconds(F.col(time).cast("timestamp")) if isinstance(kind, (DateType, TimestampType, TimestampNTZType)) else F.floor(time)
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(by).alias("_by"), at.alias("_at"), F.col(value).alias("_v"))
    own = F.floor(F.col("_at") / seconds)
    per = rows.where("_at is not null").groupBy("_by", "_at").agg(F.sum("_v").alias("_v"))
    # a second leaves the window `seconds` after it, in the block after its own
    both = F.array(F.struct(own.alias("block"), F.col("_at").alias("at"), F.lit(True).alias("here")), F.struct((own + 1).alias("block"), (F.col("_at") + seconds).alias("at"), F.lit(False).alias("here")))
    seen = per.select("_by", "_v", F.explode(both).alias("_s")).select("_by", "_v", "_s.*")
    w = Window.partitionBy("_by", "block")
    came = F.sum(F.when(F.col("here"), F.col("_v"))).over(w.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    stays = F.sum(F.when(~F.col("here"), F.col("_v"))).over(w.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    sums = seen.select("_by", "here", F.col("at").alias("_at"), came.alias("_came"), stays.alias("_stays")).where("here")
    total = F.when(F.col("_came").isNull() | F.col("_stays").isNull(), F.coalesce("_came", "_stays")).otherwise(F.col("_came") + F.col("_stays"))
    found = sums.select(F.col("_by").alias("_sby"), F.col("_at").alias("_sat"), total.alias(name))
    return rows.join(found, F.col("_by").eqNullSafe(F.col("_sby")) & (F.col("_at") == F.col("_sat")), "left").select("_row.*", name)
