"""Backfills that rewrite stored records, and only where something was gained."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.sources.files import stored


def _known(columns: list[str]):
    return reduce(add, [F.col(c).isNotNull().cast("long") for c in columns])


def rewrite_improved(spark: SparkSession, path: str, backfill: Callable[[DataFrame], DataFrame], columns: list[str], key: str = "workout_id", partition: str = "month", apply: bool = True) -> DataFrame:
    """Fill the columns of records stored below path by `partition`, and replace the partitions that hold an improved key.

    Only keys with a null in one of the columns are given to `backfill`, which gives the same rows back. Both versions'
    non-null values are counted a key and partition: a key that has more than before is taken from the new version, all
    others stay as they are, and partitions without such a key are not written. Gives a row for each key that was tried:
    partition, key, before, after, improved. With apply false nothing is written. New partitions are staged in the shared
    folder first; each is replaced at the commit of one write. Keys meet rows by sorted merges: none is broadcast."""
    rows = spark.read.parquet(path)
    names = rows.columns
    holes = rows.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])).select(key).distinct()
    tried = stored(rows.join(holes.hint("merge"), key, "left_semi"), "tried")
    filled = stored(backfill(tried).select(*names), "filled")
    count = lambda df, name: df.groupBy(partition, key).agg(F.sum(_known(columns)).alias(name))
    report = count(tried, "before").join(count(filled, "after").hint("merge"), [partition, key]).withColumn("improved", F.col("after") > F.col("before"))
    report = stored(report, "report")
    better = report.where("improved").select(partition, key).hint("merge")
    months = [r[0] for r in report.where("improved").select(partition).distinct().collect()]  # a row a partition
    if apply and months:
        kept = rows.where(F.col(partition).isin(months)).join(better, [partition, key], "left_anti").select(*names)
        whole = stored(kept.unionByName(filled.join(better, [partition, key], "left_semi").select(*names)), "staged")
        whole.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return report
