"""A remote folder's listing as a stream of changes, with a cursor that may expire.

Listings lie in a folder as generations: `changes/generation=N/` holds what changed since N - 1 (tombstones included) as
JSON lines, `full/generation=N/` the whole folder as of N. The stream's offset is a generation. A reader that comes in
time takes the changes; one whose next generation has been removed takes the newest full listing, marked so, and the
changes after it, and what the listing lacks is found by an anti-join with the stored state. Both ways end in one state."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tempora.sources.ledger import latest

#: item null: only says that a full listing was read. Fields that a listing lacks are null.
SCHEMA = "item string, name string, size long, tag string, deleted boolean, generation long, full boolean"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri if ":" in uri else f"file://{uri}"))


def _generations(store: fs.FileSystem, path: str, kind: str) -> list[int]:
    found = store.get_file_info(fs.FileSelector(f"{path}/{kind}", allow_not_found=True))
    return sorted(int(m[1]) for f in found if (m := re.search(r"generation=(\d+)$", f.path)))


class Part(InputPartition):
    """One file of a generation, or (no file) the mark of a full listing."""

    def __init__(self, uri: str, file: str | None, generation: int, full: bool):
        self.uri, self.file, self.generation, self.full = uri, file, generation, full


class ListingReader(DataSourceStreamReader):
    def __init__(self, uri: str, force: bool):
        self.uri, self.force = uri, force

    def initialOffset(self) -> dict:
        return {"generation": -1}

    def latestOffset(self) -> dict:
        store, path = _store(self.uri)
        return {"generation": max([*_generations(store, path, "changes"), *_generations(store, path, "full"), -1])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        store, path = _store(self.uri)
        first, last = start["generation"], end["generation"]
        changes = [g for g in _generations(store, path, "changes") if g <= last]
        full = [g for g in _generations(store, path, "full") if g <= last]
        missing = [g for g in range(first + 1, last + 1) if g not in set(changes)]
        parts = []
        if first < last and (first < 0 or missing or self.force) and full:  # nothing yet, an expired cursor, or asked for
            first = full[-1]
            parts = [Part(self.uri, None, first, True), *self._files(store, path, "full", first, True)]
            missing = [g for g in missing if g > first]
        if missing:
            raise RuntimeError(f"no changes and no full listing for generation {missing[0]}")
        return parts + [p for g in changes if g > first for p in self._files(store, path, "changes", g, False)]

    def _files(self, store: fs.FileSystem, path: str, kind: str, generation: int, full: bool) -> list[Part]:
        found = store.get_file_info(fs.FileSelector(f"{path}/{kind}/generation={generation}"))
        return [Part(self.uri, f.path, generation, full) for f in found if f.path.rpartition("/")[2][:1] not in ("_", ".") and f.size]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.file is None:
            yield (None, None, None, None, None, partition.generation, True)
            return
        store, _ = _store(partition.uri)
        with store.open_input_stream(partition.file) as lines:
            rest = b""
            while block := lines.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from (self._row(line, partition) for line in whole if line.strip())
            if rest.strip():
                yield self._row(rest, partition)

    @staticmethod
    def _row(line: bytes, partition: Part) -> tuple:
        x = json.loads(line)
        return (x["item"], x.get("name"), x.get("size"), x.get("tag"), bool(x.get("deleted", False)), partition.generation, partition.full)


class DeltaListing(DataSource):
    """spark.readStream.format("delta_listing").load(folder); option force=true always begins with a full listing."""

    @classmethod
    def name(cls) -> str:
        return "delta_listing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], self.options.get("force", "false") == "true")


def listing_stream(spark: SparkSession, folder: str, force: bool = False) -> DataFrame:
    spark.dataSource.register(DeltaListing)
    return spark.readStream.format("delta_listing").option("force", str(force).lower()).load(folder)


def follow(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a run that brings the state below `path` up to the newest generation and ends."""
    spark = stream.sparkSession
    schema = spark.createDataFrame([], SCHEMA).drop("full").schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.where("item is not null").drop("full")
        listed = batch.where("full").agg(F.max("generation")).first()[0]
        if listed is not None:  # what is stored and not listed is gone
            known = _state(spark, path, schema, number).where("not deleted")
            gone = known.join(batch.where("full and item is not null").select("item"), "item", "left_anti")
            seen = seen.unionByName(gone.withColumn("deleted", F.lit(True)).withColumn("generation", F.lit(listed).cast("long")))
        latest(seen, ["item"], [F.col("generation"), ~F.col("deleted")]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _state(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return latest(rows, ["item"], [F.col("generation"), F.col("batch")]).drop("batch")


def current_items(spark: SparkSession, path: str) -> DataFrame:
    """The items that are in the folder: item, name, size, tag, and the generation of their last change."""
    return _state(spark, path, spark.createDataFrame([], SCHEMA).drop("full").schema).where("not deleted").drop("deleted")
