"""Decoder of binary device files: messages as rows of (path, position, message, field, value, text).

A file is a header, definitions that say which fields a message type has, and messages. The helper below reads one file
of a few MB; Spark deals the files, and everything after it is DataFrame work on the rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the file format: base types with their codes and "no value", message and field numbers.
BASE = {0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF), 0x88: ("f", None), 0x89: ("d", None), 0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x0D: ("B", 0xFF), 0x8E: ("q", (1 << 63) - 1), 0x8F: ("Q", (1 << 64) - 1), 0x90: ("Q", 0)}
TEXT = 0x07
MESSAGES = {0: "file_id", 18: "session", 19: "lap", 20: "record", 21: "event", 23: "device_info", 34: "activity", 78: "hrv", 206: "field_description"}
#: message, field number: name, scale, offset
FIELDS = {
    ("file_id", 0): ("type", 1, 0), ("file_id", 1): ("manufacturer", 1, 0), ("file_id", 2): ("product", 1, 0), ("file_id", 4): ("time_created", 1, 0),
    ("record", 253): ("timestamp", 1, 0), ("record", 0): ("position_lat", 2**31 / 180, 0), ("record", 1): ("position_long", 2**31 / 180, 0), ("record", 2): ("elevation_m", 5, 500),
    ("record", 3): ("heart_rate_bpm", 1, 0), ("record", 4): ("cadence_rpm", 1, 0), ("record", 5): ("distance_m", 100, 0), ("record", 6): ("speed_mps", 1000, 0),
    ("record", 7): ("power_watts", 1, 0), ("record", 13): ("temperature_c", 1, 0), ("record", 73): ("speed_mps", 1000, 0), ("record", 78): ("elevation_m", 5, 500),
    ("session", 253): ("timestamp", 1, 0), ("session", 2): ("start_time", 1, 0), ("session", 5): ("sport", 1, 0), ("session", 6): ("sub_sport", 1, 0),
    ("session", 7): ("total_elapsed_time", 1000, 0), ("session", 8): ("total_timer_time", 1000, 0), ("session", 9): ("total_distance", 100, 0), ("session", 11): ("total_calories", 1, 0),
    ("lap", 253): ("timestamp", 1, 0), ("lap", 254): ("message_index", 1, 0), ("lap", 7): ("total_elapsed_time", 1000, 0), ("lap", 8): ("total_timer_time", 1000, 0), ("lap", 9): ("total_distance", 100, 0),
    ("activity", 253): ("timestamp", 1, 0), ("activity", 0): ("total_timer_time", 1000, 0), ("activity", 1): ("num_sessions", 1, 0), ("hrv", 0): ("time", 1000, 0),
    ("field_description", 0): ("developer_data_index", 1, 0), ("field_description", 1): ("field_definition_number", 1, 0), ("field_description", 2): ("fit_base_type_id", 1, 0),
    ("field_description", 3): ("field_name", 1, 0), ("field_description", 6): ("scale", 1, 0), ("field_description", 7): ("offset", 1, 0), ("field_description", 8): ("units", 1, 0),
}
#: Seconds between 1970 and the format's own start of time.
EPOCH = 631_065_600
_ROWS = "path string, position int, message string, field string, value double, text string"


def messages(data: bytes) -> Iterator[tuple[int, str, str, float | None, str | None]]:
    """position, message, field, value, text of every field that has a value; arrays give a row for each element.

    Developer fields come as dev_INDEX_NUMBER with raw values, read by the base type that the file's own description
    gives (bytes without one); their names, units and scales are left to `developer_fields`."""
    size, end = data[0], data[0] + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise ValueError("a device file is cut off")
    at, kinds, position, clock, types = size, {}, 0, 0, {}
    while at < end:
        head = data[at]
        at += 1
        if head & 0xC0 == 0x40:  # a definition
            order = ">" if data[at + 1] else "<"
            number = int.from_bytes(data[at + 2 : at + 4], "big" if data[at + 1] else "little")
            n = data[at + 4]
            fields = [tuple(data[at + 5 + 3 * k : at + 8 + 3 * k]) for k in range(n)]
            at += 5 + 3 * n
            own = []
            if head & 0x20:
                own = [tuple(data[at + 1 + 3 * k : at + 4 + 3 * k]) for k in range(data[at])]
                at += 1 + 3 * len(own)
            kinds[head & 0x0F] = (order, MESSAGES.get(number, f"message_{number}"), fields, own)
            continue
        short = head & 0x80
        order, name, fields, own = kinds[head >> 5 & 3 if short else head & 0x0F]
        if short:  # the five low bits of the time of this message
            clock += (head & 0x1F) - (clock & 0x1F) & 0x1F
            yield position, name, "timestamp", float(clock + EPOCH), None
        described = {}
        for number, length, base in fields:
            raw = data[at : at + length]
            at += length
            field, scale, offset = FIELDS.get((name, number), (f"field_{number}", 1, 0))
            for x in _values(raw, base, order):
                if isinstance(x, str):
                    yield position, name, field, None, x
                    continue
                if number == 253:
                    clock = x
                described[field] = x
                time = field in ("timestamp", "start_time", "time_created")
                yield position, name, field, float(x + EPOCH) if time else x / scale - offset, None
        if name == "field_description":
            types[described.get("developer_data_index"), described.get("field_definition_number")] = described.get("fit_base_type_id", 0x0D)
        for number, length, index in own:
            for x in _values(data[at : at + length], types.get((index, number), 0x0D), order):
                yield position, name, f"dev_{index}_{number}", None if isinstance(x, str) else float(x), x if isinstance(x, str) else None
            at += length
        position += 1


def _values(raw: bytes, base: int, order: str) -> Iterator[str | int | float]:
    """The values of a field's bytes: a text, or the numbers that are not the type's "no value"."""
    if base == TEXT:
        if text := raw.split(b"\0")[0].decode("utf-8", "replace"):
            yield text
        return
    code, nothing = BASE.get(base, ("B", 0xFF))
    width = struct.calcsize(code)
    for k in range(len(raw) // width):
        (x,) = struct.unpack_from(order + code, raw, k * width)
        if x != nothing and x == x:
            yield x


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "position", "message", "field", "value", "text"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string()]
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            try:
                rows = list(messages(content.as_py()))
            except (ValueError, KeyError, IndexError, struct.error) as why:
                rows = [(-1, "error", type(why).__name__, None, str(why))]
            columns = list(zip(*rows)) if rows else [()] * 5
            arrays = [pa.array([path] * len(rows), kinds[0])] + [pa.array(c, k) for c, k in zip(columns, kinds[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def decode(files: DataFrame) -> DataFrame:
    """Rows of all messages of device files (path, content); a broken file has one row of message `error`."""
    return files.where("content is not null").select("path", "content").mapInArrow(_decode, _ROWS)


def records(decoded: DataFrame) -> DataFrame:
    """The record stream of decoded files, path as workout_id; seconds count from a file's first record, message_position is
    the record's place among the file's messages."""
    channels = ["power_watts", "heart_rate_bpm", "cadence_rpm", "speed_mps", "distance_m", "elevation_m", "position_lat", "position_long", "temperature_c"]
    own = decoded.where("message = 'record'").groupBy(F.col("path").alias("workout_id"), "position").agg(F.max(F.when(F.col("field") == "timestamp", F.col("value"))).alias("at"), *[F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in channels])
    first = own.groupBy("workout_id").agg(F.min("at").alias("first"))
    return own.where("at is not null").join(first, "workout_id").select("workout_id", (F.col("at") - F.col("first")).alias("elapsed_sec"), F.timestamp_seconds("at").alias("timestamp_utc"), F.col("position").alias("message_position"), *channels)


def developer_fields(decoded: DataFrame) -> DataFrame:
    """Developer fields of decoded files by each file's own dictionary: path, position, message, field (dev_NAME), value
    (scaled, as text where it is one), units.

    A file describes a field by index and number, in its last description if there are several; what it doesn't
    describe keeps its index and number as name."""
    told = lambda c, kind: F.max(F.when(F.col("field") == c, F.col(kind))).alias(c)
    said = decoded.where("message = 'field_description'").groupBy("path", "position").agg(*[told(c, "value") for c in ("developer_data_index", "field_definition_number", "scale", "offset")], *[told(c, "text") for c in ("field_name", "units")])
    number = F.concat_ws("_", F.lit("dev"), F.col("developer_data_index").cast("int"), F.col("field_definition_number").cast("int"))
    last = said.groupBy("path", number.alias("field")).agg(F.max_by(F.struct("field_name", "units", "scale", "offset"), "position").alias("d"))
    own = decoded.where(F.col("field").startswith("dev_")).join(last, ["path", "field"], "left")
    scaled = F.col("value") / F.coalesce(F.when(F.col("d.scale") != 0, F.col("d.scale")), F.lit(1.0)) - F.coalesce("d.offset", F.lit(0.0))
    named = F.coalesce(F.concat(F.lit("dev_"), "d.field_name"), "field")
    return own.select("path", "position", "message", named.alias("field"), F.coalesce("text", scaled.cast("string")).alias("value"), F.col("d.units").alias("units"))
