"""Shared helpers: table access, durable intermediate tables, row identity, distributed ranks and components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Without that setting there is a temporary folder where driver and tasks are one process, and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tempora-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to a new folder of `scratch` and read it back; and the folder, for who discards it later."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    return stored(df, what)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of `scratch` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_bytes(uri: str, data: bytes) -> None:
    """Write one file of the shared store from a task: under another name first, then renamed.

    Through pyarrow, which knows the schemes file, hdfs, s3 (also as s3a), gs and abfs."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    if isinstance(store, fs.LocalFileSystem):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    with store.open_output_stream(f"{path}.part") as out:
        out.write(data)
    store.move(f"{path}.part", path)


def slices(texts: pa.Array, size: int) -> list[pa.Array]:
    """Texts in parts of about `size` bytes (a text is never cut); one empty part for no texts."""
    part = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [texts.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def grouped(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about `size` bytes of the text column, so that work on one is bounded."""
    held, had = [], 0
    for b in batches:
        at = 0
        for part in slices(b.column(column), size):
            held.append(b.slice(at, len(part)))
            at, had = at + len(part), had + part.nbytes
            if had >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, had = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, spread: Column) -> DataFrame:
    """Add `name`: gapless ranks from 0 in each of a few thousand groups at most, without one task per group.

    The rows of a group are dealt by `spread` to as many sub-groups as the root of their number, so that neither a
    sub-group nor the list of them is large; ranks run within each, and counts of the sub-groups before it are added.
    Any order among the rows of a group is legal, `order` holds within a sub-group."""
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    same = lambda own: reduce(and_, [F.col(g).eqNullSafe(own[f"_g{i}"]) for i, g in enumerate(group)])
    sizes = df.groupBy(*keys).agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("_n"))
    b = df.join(F.broadcast(sizes), same(sizes)).withColumn("_b", F.pmod(F.xxhash64(spread), F.col("_n"))).drop("_n", *[f"_g{i}" for i in range(len(group))])
    counts = b.groupBy(*keys, F.col("_b").alias("_b2")).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    out = b.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)) - 1)
    out = out.join(base, same(base) & (F.col("_b") == F.col("_b2")))
    return out.withColumn(name, (F.col("_r") + F.col("_base")).cast("long")).drop("_b", "_b2", "_r", "_base", *[f"_g{i}" for i in range(len(group))])


#: A key is hot if it has more than one in HOT_KEYS of all rows, so there are fewer hot keys than that.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with a table of one row per key, whose column `size` counts the key's rows.

    Hot keys (fewer than HOT_KEYS of them) are broadcast, so that no task gets all rows of one; the other keys, none of
    which is hot, are shuffled. Give both as stored tables: they are read twice."""
    n = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.coalesce(F.col(size) * HOT_KEYS > n, F.lit(False))
    few = F.broadcast(table.where(hot))
    rest = rows.join(few.select(key), key, "left_anti").join(table.where(~hot), key)
    return rows.join(few, key).unionByName(rest)


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union the pairs into labels (each points at a smaller or equal index); give pairs that span the same components."""
    keep_i, keep_j = [], []
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        if not len(i):
            break
        hi, lo = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((lo, hi))
        first = np.ones(len(hi), bool)
        first[1:] = hi[order][1:] != hi[order][:-1]
        pick = order[first]
        keep_i.append(i[pick])
        keep_j.append(j[pick])
        labels[hi[pick]] = lo[pick]
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
    none = np.zeros(0, np.int64)
    return (np.concatenate(keep_i), np.concatenate(keep_j)) if keep_i else (none, none)


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """Connected components of an undirected edge table (a long, b long): rows (id, component), component the smallest id.

    Alternating large-star and small-star rounds; each round's edges are a table in the shared folder, until the next. A
    round needs only the minimum of each node's neighbours, which Spark pre-aggregates before its shuffle; the join with it
    deals a hub's rows to one partition, which adaptive execution splits when it is large. Nothing is gathered.
    Vertices without edges are not in the result; null ends, loops and repeated edges are legal and mean nothing more."""
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = stored(e, what)
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(low2, F.col("u") == F.col("n"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select(F.col("n").alias("u"), F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e, after = stored(small, what)
        discard(spark, path)  # a round needs only the table of the one before
        path = after
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow(schema: str) -> pa.Schema:
    """The Arrow schema of flat Spark columns, given as "name type, name type"."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(","))])


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
