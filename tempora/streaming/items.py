"""The states of ingested items as a stateful stream: fetched, processed, failed, and dead letters.

One operator holds an item's state by its key: a delivery with a good payload processes it, a bad one fails it, one
without payload leaves it fetched until a timer gives up. Whatever comes after an item is processed does nothing, so
deliveries may be repeated, and those within the watermark's delay may come in any order (later ones are dropped). State lives in the stream's checkpoint and is dropped when nothing
has been heard of an item for `forget`; the tables hold transitions only, so a batch costs what it brings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tempora.sources.ledger import latest

#: What the stream gives: one row a transition; step counts an item's transitions.
TRANSITIONS = "item string, step long, status string, deliveries long, payload string, error string"
_MOVE = Row(*[c.split()[0] for c in TRANSITIONS.split(", ")])
#: The only store that keeps timers.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def required(*fields: str) -> Callable[[str], str | None]:
    """A check of JSON payloads: an object with these fields, none of them null; the error, or None."""

    def check(payload: str) -> str | None:
        try:
            body = json.loads(payload)
        except ValueError:
            return "not JSON"
        if not isinstance(body, dict):
            return "not an object"
        missing = [f for f in fields if body.get(f) is None]
        return "missing " + ", ".join(missing) if missing else None

    return check


class ItemStates(StatefulProcessor):
    """Input per item: payload (null: only announced), at (event time)."""

    def __init__(self, check: Callable[[str], str | None], patience: timedelta, forget: timedelta):
        self.check, self.patience, self.forget = check, round(patience.total_seconds() * 1000), round(forget.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, step long, deliveries long, wake long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, step, deliveries, wake = self.state.get() if self.state.exists() else (None, 0, 0, None)
        moves, newest = [], 0
        for row in rows:
            newest = max(newest, int(row.at.timestamp() * 1000))
            if status == "processed":  # a repeated delivery does nothing
                continue
            deliveries += 1
            error = None if row.payload is None else self.check(row.payload)
            new = status or "fetched" if row.payload is None else "failed" if error else "processed"
            if new != status:
                status, step = new, step + 1
                moves.append((key[0], step, status, deliveries, row.payload, error))
        new_wake = newest + (self.patience if status == "fetched" else self.forget)
        if wake is not None and not moves:  # late rows shorten no wait
            new_wake = max(wake, new_wake)
        if new_wake != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(new_wake)
        self.state.update((status, step, deliveries, new_wake))
        for move in moves:
            yield _MOVE(*move)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, step, deliveries, _ = self.state.get()
        if status == "fetched":
            wake = timerValues.getCurrentWatermarkInMs() + self.forget
            self.handle.registerTimer(wake)
            self.state.update(("failed", step + 1, deliveries, wake))
            yield _MOVE(key[0], step + 1, "failed", deliveries, None, "no payload came")
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def item_states(deliveries: DataFrame, check: Callable[[str], str | None], late: str, patience: timedelta, forget: timedelta) -> DataFrame:
    """Transitions of the items of a stream of deliveries (item string, payload string, at timestamp).

    The stream's session has to keep state in RocksDB (see `session_with_timers`)."""
    own = deliveries.where("item is not null and at is not null").withWatermark("at", late)
    return own.groupBy("item").transformWithState(ItemStates(check, patience, forget), TRANSITIONS, "Append", "EventTime")


def session_with_timers(spark: SparkSession) -> SparkSession:
    """A session of its own beside the caller's, whose settings stay as they are."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(name, spark.conf.get(name))
    return session


def ingest_items(moves: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a run that takes what has landed and ends: transitions to `path`/moves, dead letters to `path`/dead.

    A batch that runs again replaces its own folders."""
    spark = moves.sparkSession
    for name, rows in (("moves", moves), ("dead", moves)):
        spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{path}/{name}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/moves/batch={number}")
        bad = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/moves/batch={number}").where("error is not null")
        bad.write.mode("overwrite").parquet(f"{path}/dead/batch={number}")

    return moves.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """Each item's last state: item, status, deliveries (up to that state), payload, error."""
    return latest(spark.read.schema(TRANSITIONS).parquet(f"{path}/moves"), ["item"], [F.col("step")]).drop("step")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Every payload that failed, and every item that got none in time, also of items that were processed later."""
    return spark.read.schema(TRANSITIONS).parquet(f"{path}/dead").select("item", "step", "payload", "error")
