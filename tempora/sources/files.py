"""Readers and writers of the library's layouts: partitioned Parquet, JSON landing zones, compressed device files."""

from __future__ import annotations

import gzip
import io
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = T.StructType([
    T.StructField("athlete_id", T.StringType()), T.StructField("workout_id", T.StringType()), T.StructField("timestamp_utc", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in ("elapsed_sec", "power_watts", "heart_rate_bpm", "cadence_rpm", "speed_mps", "distance_m", "position_lat", "position_long", "elevation_m", "temperature_c", "respiration_rate_brpm", "lr_balance_pct")],
    T.StructField("rr_intervals_sec", T.ArrayType(T.DoubleType())), T.StructField("month", T.StringType()),
])
#: Where a device file starts: header size at byte 0, the mark at bytes 8 to 11 (fixed values).
FIT_MARK, FIT_HEADERS = b".FIT", (12, 14)
#: A device file is a few MB; what unpacks to more than this is refused, not read.
UNPACKED_MOST = 256 << 20
_PREPARED = "path string, kind string, content binary, error string"



def shared(spark: SparkSession, what: str) -> str:
    """A new folder that executors and driver share; on one machine alone a temporary one, where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tempora-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to a new shared folder and read back: lineage ends there and lost executors lose nothing."""
    path = shared(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_records(records: DataFrame, path: str, files_per_partition: int = 1) -> None:
    """Replace the months that records hold, and no others; a month is dealt by a hash of its workouts, and what is still
    large for a task is split further, whatever the workouts' sizes."""
    months = records.withColumn("month", F.date_format("timestamp_utc", "yyyy-MM")).withColumn("_deal", F.pmod(F.xxhash64("workout_id"), F.lit(files_per_partition)))
    spread = months.hint("rebalance", "month", "_deal").drop("_deal").sortWithinPartitions("month", "workout_id", "elapsed_sec")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_records(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Records of a time range; months outside are not read, and row groups are skipped by time."""
    rows = spark.read.schema(RECORDS).parquet(path)
    if first:
        rows = rows.where((F.col("month") >= first[:7]) & (F.col("timestamp_utc") >= F.lit(first).cast("timestamp")))
    if last:
        rows = rows.where((F.col("month") <= last[:7]) & (F.col("timestamp_utc") <= F.lit(last).cast("timestamp")))
    return rows


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON payloads of a landing zone, plain or gzip; what doesn't parse stays in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A small JSON document of settings as nested dicts, for `params_from`; empty if it has no rows."""
    row = spark.read.option("multiLine", True).json(path).first()
    return row.asDict(recursive=True) if row else {}


def read_codes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The codes of one kind out of CSV files with the columns kind, manufacturer, code, name: manufacturer, product, name.

    For `code_names` (manufacturers have their own code as product) and `backfilled_device_model`; of a repeated code the
    first name by order of text stays."""
    rows = spark.read.option("header", True).schema("kind string, manufacturer int, code int, name string").csv(path)
    named = rows.where((F.col("kind") == kind) & F.col("code").isNotNull())
    return named.groupBy("manufacturer", F.col("code").alias("product")).agg(F.min("name").alias("name"))


def write_payloads(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table as JSON and report its rows: table, rows, error. A table that fails counts 0 rows."""
    spark, report = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():  # names of tables, not rows
        try:
            df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
            report.append((name, spark.read.text(f"{path}/{name}").count(), None))
        except Exception as why:  # noqa: BLE001  the report says what failed
            report.append((name, 0, str(why)[:500]))
    return spark.createDataFrame(report, "table string, rows long, error string")


def _unpack(data: bytes) -> tuple[str, bytes]:
    if data[:2] == b"\x1f\x8b":
        kind, out = "gzip", gzip.GzipFile(fileobj=io.BytesIO(data)).read(UNPACKED_MOST + 1)
    elif data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [n for n in z.namelist() if n.lower().endswith(".fit")]
            if len(names) != 1:
                raise ValueError(f"{len(names)} device files in the archive")
            kind, out = "zip", z.open(names[0]).read(UNPACKED_MOST + 1)
    else:
        kind, out = "plain", data
    if len(out) > UNPACKED_MOST:
        raise ValueError("too large when unpacked")
    if len(out) < 12 or out[0] not in FIT_HEADERS or out[8:12] != FIT_MARK:
        raise ValueError("not a device file")
    return kind, out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            kind = out = error = None
            try:
                kind, out = _unpack(content.as_py() or b"")
            except (ValueError, OSError, EOFError, zlib.error, zipfile.BadZipFile) as why:
                error = str(why) or type(why).__name__
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([kind], pa.string()), pa.array([out], pa.binary()), pa.array([error], pa.string())], names=["path", "kind", "content", "error"])


def device_files(spark: SparkSession, path: str, pattern: str = "*.fit*") -> DataFrame:
    """Device files, unpacked and checked: path, kind (plain, gzip, zip), content, error. Bad files are rows with an
    error, so that a caller sets them aside."""
    return unpacked(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path))


def unpacked(files: DataFrame) -> DataFrame:
    """As device_files, of a table of path and content."""
    return files.select("path", "content").mapInArrow(_prepare, _PREPARED)


def content_id(content) -> F.Column:
    return F.sha2(content, 256)


def in_lookback(name, modified, first_day) -> F.Column:
    """Whether a file is of the first day or later: by the date in its name, else its time stamp; else it is."""
    dated = F.try_to_date(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1))
    return F.coalesce(dated >= first_day, modified >= first_day.cast("timestamp"), F.lit(True))
