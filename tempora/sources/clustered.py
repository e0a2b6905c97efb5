"""Summaries laid out so that one athlete's answer reads one athlete's rows.

Clustered files are ranges of the key, sorted within, in small row groups whose least and greatest keys Parquet records:
a filter on the key that reaches the scan skips the other files' and groups' pages. Bucketed tables are dealt by a hash of
the key once, when they are written: joins and aggregates of tables with equal buckets need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: some thousand summaries.
GROUP_BYTES = 1 << 20


def write_clustered(rows: DataFrame, path: str, key: str, order: list[str], files: int, group_bytes: int = GROUP_BYTES) -> None:
    """Write rows in `files` ranges of (key, order): a key with many rows may span several, no task has them all."""
    ranged = rows.repartitionByRange(files, key, *order).sortWithinPartitions(key, *order)
    ranged.write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.page.size", max(4096, group_bytes // 16)).parquet(path)


def of_one(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """The rows of one key; the comparison reaches the scan."""
    return spark.read.parquet(path).where(F.col(key) == F.lit(value))


def write_bucketed(rows: DataFrame, table: str, path: str, key: str, buckets: int, order: list[str]) -> DataFrame:
    """Write rows as a catalog table of files below path, dealt by key to buckets and sorted within; and the table."""
    spark = rows.sparkSession
    rows.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)
    return spark.table(table)


def with_counts(rows: DataFrame, people: DataFrame, key: str) -> DataFrame:
    """rows of a bucketed table with the columns of people (bucketed alike, a row a key) and n, the key's rows.

    All three meet by sorted merges within buckets: a hint keeps a side that is small from being broadcast, which would
    read it whole in each task."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return rows.hint("merge").join(people.hint("merge"), key).join(n.hint("merge"), key)
