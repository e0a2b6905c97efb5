"""Streams over landed files: late and repeated deliveries, runs one after another, compaction."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tempora.streaming import landing

SCHEMA = "user_id long, ts timestamp, version long, value double"


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"user_id": u, "ts": f"2026-01-{d:02d}T00:00:00Z", "version": v, "value": x}) for u, d, v, x in rows))


def run(spark, tmp_path, adapt=None):
    stream = landing.landing_stream(spark, f"file://{tmp_path}/in", SCHEMA, 1)
    landing.ingest(stream, f"file://{tmp_path}/table", f"file://{tmp_path}/cp", ["user_id"], "version", adapt).awaitTermination()
    now = landing.current_table(spark, f"file://{tmp_path}/table", ["user_id"], "version", stream.schema)
    return sorted((r.user_id, r.version, r.value) for r in now.collect())


def test_upserts_survive_late_and_repeated_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert run(spark, tmp_path) == []
    land(tmp_path / "in", "a.json", [(1, 5, 2, 20.0), (2, 5, 1, 1.0), (1, 5, 1, 10.0)])
    assert run(spark, tmp_path) == [(1, 2, 20.0), (2, 1, 1.0)]
    land(tmp_path / "in", "b.json", [(1, 1, 1, 99.0), (3, 1, 1, None), (2, 6, 1, 2.0)])
    assert run(spark, tmp_path) == [(1, 2, 20.0), (2, 1, 2.0), (3, 1, None)]
    assert run(spark, tmp_path) == [(1, 2, 20.0), (2, 1, 2.0), (3, 1, None)]
    schema = landing.landing_stream(spark, f"file://{tmp_path}/in", SCHEMA).schema
    landing.compact(spark, f"file://{tmp_path}/table", f"file://{tmp_path}/small", ["user_id"], "version", schema)
    again = landing.current_table(spark, f"file://{tmp_path}/small", ["user_id"], "version", schema)
    assert again.count() == 3


def test_an_adapter_shapes_each_batch(spark, tmp_path):
    land(tmp_path / "in", "a.json", [(1, 5, 2, 20.0)])
    assert run(spark, tmp_path, lambda df: df.withColumn("value", F.col("value") * 2)) == [(1, 2, 40.0)]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    land(tmp_path / "in", "a.json", [(1, 1, 1, 1.0), (1, 2, 1, 2.0)])
    land(tmp_path / "in", "b.json", [(1, 20, 1, 4.0)])
    stream = landing.landing_stream(spark, f"file://{tmp_path}/in", SCHEMA, 1)
    windows = landing.windowed_load(stream, "ts", "user_id", "value", "7 days", "7 days", "1 day")
    q = windows.writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(windows.schema).parquet(f"file://{tmp_path}/out").collect()
    assert sum(r.total for r in rows) == 3.0 and all(r.window_to <= dt.datetime(2026, 1, 19) for r in rows)


def test_repeated_deliveries_go(spark, tmp_path):
    land(tmp_path / "in", "a.json", [(1, 5, 1, 1.0), (1, 5, 1, 1.0), (2, 5, 1, 1.0)])
    land(tmp_path / "in", "b.json", [(1, 6, 1, 1.0)])
    once = landing.once_per_key(landing.landing_stream(spark, f"file://{tmp_path}/in", SCHEMA, 1), ["user_id"], "ts", "30 days")
    q = once.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.user_id for r in spark.read.schema(once.schema).parquet(f"file://{tmp_path}/out").collect()) == [1, 2]
