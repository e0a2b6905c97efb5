"""The state machine of ingested items over several runs: order, repetition, timers, dead letters."""

from datetime import datetime, timedelta, timezone

import pytest

from tempora.streaming import items

GOOD, OTHER = '{"value": 1}', '{"value": 2}'


@pytest.fixture(scope="module")
def session(spark):
    return items.session_with_timers(spark)


class Folder:
    def __init__(self, session, path):
        self.session, self.path = session, f"file://{path}"

    def run(self, rows, patience=10):
        at = [(i, p, datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(days=d)) for i, p, d in rows]
        self.session.createDataFrame(at, "item string, payload string, at timestamp").coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = self.session.readStream.schema("item string, payload string, at timestamp").parquet(f"{self.path}/in")
        moves = items.item_states(stream, items.required("value"), "2 days", timedelta(days=patience), timedelta(days=100))
        items.ingest_items(moves, f"{self.path}/out", f"{self.path}/checkpoint").awaitTermination()
        states = {r.item: (r.status, r.payload, r.error) for r in items.current_states(self.session, f"{self.path}/out").collect()}
        dead = sorted((r.item, r.error) for r in items.dead_letters(self.session, f"{self.path}/out").collect())
        return states, dead


def test_items_move_through_their_states(session, tmp_path):
    folder = Folder(session, tmp_path)
    states, dead = folder.run([("a", None, 0), ("b", "{", 0), ("c", GOOD, 0), ("d", "[1]", 1), ("e", None, 1), (None, GOOD, 1)])
    assert states == {"a": ("fetched", None, None), "b": ("failed", "{", "not JSON"), "c": ("processed", GOOD, None), "d": ("failed", "[1]", "not an object"), "e": ("fetched", None, None)}
    assert dead == [("b", "not JSON"), ("d", "not an object")]
    # repeated and contrary deliveries of what is processed do nothing; failed ones recover; a second failure is no transition
    states, dead = folder.run([("c", OTHER, 2), ("c", "{", 2), ("b", GOOD, 2), ("d", '{"value": null}', 2), ("a", GOOD, 3)])
    assert states["c"] == ("processed", GOOD, None) and states["b"] == ("processed", GOOD, None) and states["a"] == ("processed", GOOD, None)
    assert states["d"] == ("failed", "[1]", "not an object") and states["e"] == ("fetched", None, None) and len(dead) == 2
    # time goes on: what was only announced fails, and a payload after that is taken
    states, dead = folder.run([("f", GOOD, 30)])
    assert states["e"] == ("failed", None, "no payload came") and ("e", "no payload came") in dead and states["b"][0] == "processed"
    states, _ = folder.run([("e", GOOD, 31)])
    assert states["e"] == ("processed", GOOD, None)
    # nothing new: nothing changes
    assert folder.run([])[0] == states
    # the caller's session keeps its store
    assert session.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_the_callers_session_is_left_alone(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    own = items.session_with_timers(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before and own.conf.get("spark.sql.session.timeZone") == "UTC"


def test_checks_of_payloads():
    check = items.required("a", "b")
    assert check('{"a": 1, "b": 0}') is None and check('{"a": 1}') == "missing b" and check("") == "not JSON" and check('"x"') == "not an object"
