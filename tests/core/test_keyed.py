"""Timers, time to live, initial state and the join of two streams: rows out of order over several micro-batches, nulls, no rows."""

import time
from datetime import datetime, timedelta, timezone

import pytest

from lodestone.sources.shared import new_path, settings
from lodestone.streaming import keyed, runs

START = datetime(2024, 1, 1)
SCHEMA = "user_id long, event_type string, ts timestamp, cents long"


def source(spark, tmp_path, batches):
    """A stream of the given batches: rows of (user, type, hours, cents)."""
    for n, rows in enumerate(batches):
        made = [(u, t, None if h is None else START + timedelta(hours=h), c) for u, t, h, c in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(0.02)
    return keyed.stream_of(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema)


def run(df, mode="append"):
    """The rows that came out, in order of batches, and the state's rows after each batch."""
    out, spark = [], df.sparkSession
    with settings(spark, runs.PROCESSOR_STORE):
        query = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", new_path(spark, "test-log")).trigger(availableNow=True).start()
        query.awaitTermination()
    return out, [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]


def test_timers_close_idle_sessions_and_drop_their_state(spark, tmp_path):
    batches = [
        [(1, "a", 0, 1), (1, "b", 1, 1), (2, "a", 0.5, 1), (None, "a", 0, 1), (5, "a", None, 1), (3, None, 0, 1)],
        [(1, "a", 4, 1), (1, "c", 2.5, 1), (2, "a", 4, 1), (2, "a", 4, 1)],  # out of order: 2.5 joins 1 and 4
        [(9, "z", 100, 1)],
        [(9, "z", 101, 1)],
        [(9, "z", 300, 1), (1, "late", 3, 1)],  # beyond the watermark: dropped
    ]
    out, state = run(keyed.idle_sessions(source(spark, tmp_path, batches), 2 * 3600, "6 hours"))
    hour = lambda ms: (datetime.utcfromtimestamp(ms / 1000) - START).total_seconds() / 3600
    found = sorted(((u, hour(s), hour(e), n, k) for u, s, e, n, k in out), key=repr)
    assert found == sorted([(1, 0, 4, 4, 3), (2, 0.5, 0.5, 1, 1), (2, 4, 4, 2, 1), (3, 0, 0, 1, 1), (9, 100, 101, 2, 1)], key=repr)
    assert max(state) > state[-1]  # idle users are gone


def test_idle_sessions_of_no_rows(spark, tmp_path):
    assert run(keyed.idle_sessions(source(spark, tmp_path, [[]]), 3600, "1 hour"))[0] == []


def test_balances_begin_with_the_initial_state(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, "a", 0, 5), (2, "a", 0, None)], [(1, "a", 1, 7), (1, "a", 1, 7), (3, "a", 0, 1)]]).select("user_id", "cents")
    initial = spark.createDataFrame([(1, 100), (1, 10), (4, 9)], "user_id long, total long")
    assert sorted(run(keyed.balances(stream, initial), "update")[0]) == [(1, 1, 115), (1, 3, 129), (2, 1, 0), (3, 1, 1)]


@pytest.mark.parametrize(("ttl", "last"), [(1, (1, 1, 7)), (3_600_000, (1, 2, 12))])
def test_balances_are_forgotten_after_their_time_to_live(spark, tmp_path, ttl, last):
    log, out = new_path(spark, "ttl-log"), []
    for rows in ([(1, "a", 0, 5)], [(1, "a", 1, 7)]):
        stream = source(spark, tmp_path, [rows]).select("user_id", "cents")
        found = keyed.balances(stream, spark.createDataFrame([], "user_id long, total long"), ttl)
        with settings(spark, runs.PROCESSOR_STORE):
            query = found.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", log).trigger(once=True).start()
            query.awaitTermination(60)
            query.stop()
    assert out == [(1, 1, 5), last]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join(spark, tmp_path, how):
    batches = [
        [(1, "view", 0, 0), (1, "buy", 1, 1), (2, "buy", 1, 2), (None, "view", 1, 3), (None, "buy", 1, 4)],
        [(2, "view", 0.5, 5), (1, "view", 1, 6), (1, "view", 1, 6), (3, "buy", 2, 7)],  # views that come after what they belong to
        [(1, "buy", 4, 8), (5, "view", 90, 9), (5, "buy", 91, 10)],
        [(6, "view", 200, 11), (6, "buy", 290, 12)],
    ]
    rows = source(spark, tmp_path, batches)
    buys = rows.where("event_type = 'buy'").selectExpr("user_id", "cents AS buy", "ts AS bought")
    views = rows.where("event_type = 'view'").selectExpr("user_id", "cents AS view", "ts AS seen")
    out, state = run(keyed.interval_join(buys, views, "user_id", "bought", "seen", "2 hours", "6 hours", how).select("buy", "view"))
    pairs = [(1, 0), (1, 6), (1, 6), (2, 5), (10, 9)]
    alone = [(7, None), (8, None)] if how == "left" else []
    found = [r for r in out if r[0] != 12 and r[0] != 4]  # 12 is open yet
    assert sorted(found, key=repr) == sorted(pairs + alone, key=repr)
    assert ((4, None) in out) == (how == "left") and max(state) > state[-1]


def test_state_of_idle_sessions_is_by_bucket(spark, tmp_path):
    """Users and their sessions share the state rows and timers of their buckets, and come out as they would alone."""
    users = range(1500)
    batches = [[(u, "ab"[u % 2], h + u % 3, 1) for u in users for h in (0, 1, 10, 20)], [(u, "c", 9 + u % 3, 1) for u in users], [(9999, "z", 200, 1)], [(9999, "z", 200, 1)]]
    out, state = run(keyed.idle_sessions(source(spark, tmp_path, batches), 2 * 3600, "30 hours"))
    hour = lambda ms: (ms - START.replace(tzinfo=timezone.utc).timestamp() * 1000) / 3600_000
    want = [(u, h + u % 3, h + u % 3 + more, n, kinds) for u in users for h, more, n, kinds in ((0, 1, 2, 1), (9, 1, 2, 2), (20, 0, 1, 1))]
    assert sorted((u, hour(s), hour(e), n, k) for u, s, e, n, k in out) == want
    assert max(state) < len(users)
