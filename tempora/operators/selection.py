"""Exact order statistics by histogram bisection: no group's values are sorted or gathered.

Each round counts a group's values between two bounds in equal digits, aggregated before the shuffle; the digit that
holds the wanted rank gives the next bounds, which are values that occur. Bounds that meet are the answer; a digit with
few values is gathered and its rank taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.sources.files import stored

#: Digits of a round, values that are gathered of a group at most, and targets up to which they are broadcast.
DIGITS, FEW, BROADCAST = 1024, 4096, 100_000


def _met(values: DataFrame, targets: DataFrame, by: list[str], broadcast: bool) -> DataFrame:
    """Values between the bounds of their group's targets."""
    t = F.broadcast(targets) if broadcast else targets
    return values.join(t, by).where(F.col("_v").between(F.col("lo"), F.col("hi")))


def spread(rows: DataFrame, by: str | list[str], value: str, digits: int = DIGITS, few: int = FEW) -> DataFrame:
    """Per group non_null, least, median and greatest of the values that are neither null nor NaN; the median exact, of
    an even number the mean of the middle two.

    Rows of a null group don't count. A round divides the range of values by `digits`; values of very different size
    take more rounds."""
    by = [by] if isinstance(by, str) else by
    values = rows.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).dropna(subset=by)
    stats = stored(values.groupBy(*by).agg(F.count("*").alias("non_null"), F.min("_v").alias("least"), F.max("_v").alias("greatest")), "spread")
    middle = F.array_distinct(F.array(F.floor((F.col("non_null") + 1) / 2), F.floor(F.col("non_null") / 2) + 1))
    targets = stats.select(*by, F.explode(middle).alias("k"), F.col("least").alias("lo"), F.col("greatest").alias("hi"), F.col("non_null").alias("inside")).withColumn("need", F.col("k"))
    targets = stored(targets, "targets")
    key = [*by, "k"]
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > few)
    n, unsettled = targets.agg(F.count("*"), F.count_if(wide)).first()
    while unsettled:
        # halves: the difference of two doubles may be beyond a double
        digit = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * digits), F.lit(digits - 1))
        counts = _met(values, targets.where(wide), by, n <= BROADCAST).groupBy(*key, digit.alias("digit")).agg(F.count("*").alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.first("need").alias("need"))
        up_to = F.sum("inside").over(Window.partitionBy(*key).orderBy("digit"))
        reached = counts.withColumn("upto", up_to).where(F.col("upto") >= F.col("need")).groupBy(*key).agg(F.min(F.struct("digit", "lo", "hi", "inside", (F.col("need") - (F.col("upto") - F.col("inside"))).alias("need"))).alias("r"))
        targets = stored(targets.where(~wide).unionByName(reached.select(*key, "r.lo", "r.hi", "r.inside", "r.need")), "targets")
        unsettled = targets.where(wide).count()
    taken = _met(values, targets.where("lo < hi"), by, n <= BROADCAST).groupBy(*key).agg(F.sort_array(F.collect_list("_v")).alias("_all"), F.first("need").alias("need"))
    exact = taken.select(*key, F.expr("_all[int(need - 1)]").alias("_at")).unionByName(targets.where("lo = hi").select(*key, F.col("lo").alias("_at")))
    median = exact.groupBy(*by).agg(F.when(F.count("*") == 1, F.max("_at")).otherwise(F.sum(F.col("_at") / 2)).alias("median"))
    return stats.join(median, by).select(*by, "non_null", "least", "median", "greatest")
