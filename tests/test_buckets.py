"""Keyed state of streams is held by group of keys: the engine's calls do not grow with the keys."""

import pytest
from helpers import START_S, rows
from pyspark.sql import functions as F
from test_streaming import END, Topic, event, event_stream, run

from millrace.operators.deltas import deltas
from millrace.operators.flags import day_changes
from millrace.streaming import stateful
from millrace.streaming.stateful import stream_day_changes, stream_deltas


@pytest.fixture
def topic(tmp_path):
    return Topic(tmp_path / "topic")


def _states(query):
    return max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])


def test_days_of_many_keys_share_their_state(spark, topic, tmp_path):
    """Far more keys than groups, out of order within the lateness and over two days."""
    n = 3 * stateful.BUCKETS
    first = [event(f"k{i}", 100 + (i * 7) % 29 / 10, i) for i in range(n)]
    topic.put(*first[: n // 2])
    topic.put(*first[n // 2 :], *[event(f"k{i}", 100.05, n + i) for i in range(0, n, 3)])
    topic.put(*[event(f"k{i}", 86_400 + i / 1000, 2 * n + i) for i in range(0, n, 2)])
    topic.put(END)
    out, query = run(spark, stream_day_changes(event_stream(spark, topic), ["key"], ["et", "id"]), tmp_path)
    raw = spark.read.schema("key string, t double, id long").json(topic.path).where("key <> 'end'")
    table = raw.select("key", "id", F.timestamp_seconds(F.col("t") + START_S).alias("et"))
    columns = ["key", "day", "id", "last_day"]
    assert rows(out, *columns) == rows(day_changes(table, ["key"], ["et", "id"]), *columns)
    # One value and at most a few timers and their indexes per group.
    assert _states(query) <= 4 * stateful.BUCKETS



@pytest.mark.parametrize("attributes", ["current", "previous"])
def test_amounts_of_many_keys_share_their_state(spark, topic, tmp_path, attributes):
    """Revisions inside parts and across them; columns of many types keep their values."""
    n = 3 * stateful.BUCKETS
    times = [[round(10 + (i * 7) % 29 / 10, 3) for i in range(n)], [round(20 + i % 5 / 10, 3) for i in range(n)],
             [round(100 + i % 3 / 10, 3) for i in range(n)]]
    data = [{"id": f"k{i}", "tag": 2**53 + 1 + r * n + i, "t": t, "amount": None if i % 11 == r else i + 0.25, "more": {"a": [i, None]},
             "flag": None if i % 2 else True} for r, at in enumerate(times) for i, t in enumerate(at) if r == 0 or i % r == 0]
    for batch in range(3):
        topic.put(*data[batch * len(data) // 3 : (batch + 1) * len(data) // 3])
    topic.put({"id": "end", "tag": -1, "t": 100_000, "amount": 1})
    shape = "id string, tag long, t double, amount decimal(16,2), more struct<a: array<long>>, flag boolean"
    timed = lambda df: df.withColumn("et", F.timestamp_seconds(F.col("t") + START_S))
    stream = timed(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(topic.path))
    out, query = run(spark, stream_deltas(stream, ["id"], ["et", "tag"], ["amount"], attributes, part_s=50), tmp_path)
    table = timed(spark.read.schema(shape).json(topic.path)).where("id <> 'end'")
    want = deltas(table, ["id"], ["et", "tag"], ["amount"], attributes=attributes)
    assert rows(out, *want.columns) == rows(want)
    assert _states(query) <= 4 * stateful.BUCKETS
