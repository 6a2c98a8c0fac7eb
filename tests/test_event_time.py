"""Streams by event time: rows that come out of order in many batches give what the table gives."""

import json
import os
import random
import time

import pytest
from helpers import START_S, change, rows
from pyspark.sql import functions as F
from test_streaming import END, Topic, event, event_stream, run

from millrace import schemas
from millrace.operators.changelog import latest_by_key, merge_cells
from millrace.operators.deltas import deltas
from millrace.operators.enrich import lookup_as_of
from millrace.operators.flags import day_changes
from millrace.operators.logs import first_visits, repair_visitors
from millrace.operators.routing import route
from millrace.plans import dws
from millrace.sources.logs import change_log, page_log, route_changes
from millrace.sources.topics import parse_json, text_topic
from millrace.streaming import aggregates, maintenance, sinks
from millrace.streaming.job import Job
from millrace.streaming.run import count_losses, drain, to_batches
from millrace.streaming.stateful import stream_day_changes, stream_deltas

DAY = 86_400


@pytest.fixture
def topic(tmp_path):
    return Topic(tmp_path / "topic")


def late(rng, messages, time_of, batches=4, lateness=2.9):
    """Messages dealt out to batches in order of arrival, each delayed by less than the lateness."""
    arrived = sorted(messages, key=lambda m: time_of(m) + rng.random() * lateness)
    cuts = sorted(rng.sample(range(1, len(arrived)), batches - 1))
    return [arrived[a:b] for a, b in zip([0, *cuts], [*cuts, len(arrived)])]


def around_midnights(rng, n, days=4):
    """Times within seconds of midnights, and a few others."""
    return [max(0.0, rng.randrange(days) * DAY + rng.uniform(-4, 4)) if rng.random() < 0.8 else rng.uniform(0, days * DAY)
            for _ in range(n)]


@pytest.mark.parametrize("seed", [1])
def test_first_events_of_days_under_disorder(spark, topic, tmp_path, seed):
    rng = random.Random(seed)
    events = [event(rng.choice("aaabcd"), round(t, 3), i) for i, t in enumerate(around_midnights(rng, 200))]
    for batch in late(rng, events, lambda e: e["t"]):
        topic.put(*batch)
    topic.put(END)
    out, _ = run(spark, stream_day_changes(event_stream(spark, topic), ["key"], ["et", "id"]), tmp_path)
    table = event_stream_table(spark, topic).where("key <> 'end'")
    columns = ["key", "day", "id", "last_day"]
    assert rows(out, *columns) == rows(day_changes(table, ["key"], ["et", "id"]), *columns)


def event_stream_table(spark, topic):
    raw = spark.read.schema("key string, t double, id long").json(topic.path)
    return raw.select("key", "id", F.timestamp_seconds(F.col("t") + START_S).alias("et"))


def test_a_key_is_forgotten_after_a_time(spark, topic, tmp_path):
    for i, t in enumerate((0, DAY, 2 * DAY, 6 * DAY, 6 * DAY + 5)):
        topic.put(event("a", t, i))
    topic.put(END)
    kept = stream_day_changes(event_stream(spark, topic), ["key"], ["et", "id"], keep_ms=3 * DAY * 1000)
    out, _ = run(spark, kept, tmp_path)
    assert rows(out, "id", "last_day") == [(0, None), (1, "2024-01-01"), (2, "2024-01-02"), (3, None)]


def test_windows_of_first_events_under_disorder(spark, topic, tmp_path):
    """Page views, logins, home and detail views, payers and buyers over many batches."""
    rng = random.Random(3)
    lines = [{"common": {"mid": rng.choice("aab"), "sid": f"s{rng.randrange(9)}", "vc": rng.choice("vw"), "ch": "c", "ar": "a",
                         "is_new": rng.choice("01"), "uid": rng.choice("xyz")},
              "page": {"page_id": rng.choice(["home", "good_detail", "list"]), "during_time": 10},
              "ts": (START_S + round(t, 3)) * 1000 // 1} for t in around_midnights(rng, 150)]
    lines = [line | {"ts": int(line["ts"]) + i % 7} for i, line in enumerate(lines)]
    for batch in late(rng, lines, lambda m: m["ts"] / 1000):
        topic.put(*batch)
    topic.put({"common": {"mid": "z", "uid": "z", "sid": "z"}, "page": {"page_id": "home"}, "ts": (START_S + 10_000_000) * 1000})
    log = page_log(text_topic(spark, topic.path, streaming=False))
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(topic.path)
    stream = parse_json(raw, schemas.APP_LOG).withColumn("et", F.timestamp_millis("ts"))
    users = lambda df: df.select(F.col("common.uid").alias("user_id"), "et")
    # Rows of one time that differ in nothing else ordered are decided by these columns.
    order = ["et", "tie"]
    tie = lambda df: df.withColumn("tie", F.to_json("common"))
    views = lambda make, df: make(tie(df), order=order)
    for name, streamed, table in [
        ("views", views(aggregates.page_views, stream), views(dws.page_views, log)),
        ("home", aggregates.home_detail_views(stream), dws.home_detail_views(log)),
        ("logins", aggregates.logins(stream), dws.logins(log)),
        ("payers", aggregates.payment_users(users(stream)), dws.payment_users(users(log))),
        ("buyers", aggregates.order_users(users(stream)), dws.order_users(users(log))),
    ]:
        out, _ = run(spark, streamed, tmp_path, name)
        want = table.where("stt < '2024-02-01'")
        assert rows(out, *table.columns) == rows(want) and want.count() > 2, name


@pytest.mark.parametrize("attributes,idle_s", [("current", 40), ("previous", None)])
def test_amount_changes_by_parts_under_disorder(spark, topic, tmp_path, attributes, idle_s):
    """A key with a third of all rows goes through many parts; the rows equal the table's."""
    rng = random.Random(9)
    data = [{"id": "hot" if i % 3 == 0 else rng.choice("abcdefgh"), "tag": i, "t": round(rng.uniform(0, 900), 3),
             "amount": rng.choice([None, rng.randrange(100)])} for i in range(240)]
    for batch in late(rng, data, lambda r: r["t"]):
        topic.put(*batch)
    topic.put({"id": "end", "tag": -1, "t": 100_000, "amount": 1})
    shape = "id string, tag long, t double, amount decimal(16,2)"
    timed = lambda df: df.withColumn("et", F.timestamp_seconds(F.col("t") + START_S))
    stream = timed(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(topic.path))
    out, _ = run(spark, stream_deltas(stream, ["id"], ["et", "tag"], ["amount"], attributes, idle_s, "opened", part_s=30), tmp_path)
    idle = None if idle_s is None else ("et", f"{idle_s} seconds")
    table = timed(spark.read.schema(shape).json(topic.path)).where("id <> 'end'")
    want = deltas(table, ["id"], ["et", "tag"], ["amount"], attributes=attributes, idle=idle, first="opened")
    assert rows(out, *want.columns) == rows(want)


def test_windows_over_amount_changes_in_one_stream(spark, topic, tmp_path):
    rng = random.Random(10)
    data = [{"id": rng.choice("abc"), "tag": i, "t": round(rng.uniform(0, 300), 3), "amount": rng.randrange(100)} for i in range(120)]
    for batch in late(rng, data, lambda r: r["t"]):
        topic.put(*batch)
    topic.put({"id": "end", "tag": -1, "t": 100_000, "amount": 1})
    shape = "id string, tag long, t double, amount decimal(16,2)"
    timed = lambda df: df.withColumn("et", F.timestamp_seconds(F.col("t") + START_S))
    stream = timed(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(topic.path))
    from millrace.operators.windows import window_sums

    sums = lambda df: window_sums(df, {"amount": "amount"}, ["id"])
    out, _ = run(spark, sums(stream_deltas(stream, ["id"], ["et", "tag"], ["amount"], part_s=50)), tmp_path)
    want = sums(deltas(timed(spark.read.schema(shape).json(topic.path)), ["id"], ["et", "tag"], ["amount"]))
    assert rows(out, *want.columns) == rows(want.where("id <> 'end'"))


@pytest.mark.parametrize("begun", [False, True])
def test_repaired_marks_from_engine_state(spark, topic, tmp_path, begun):
    """Days arrive one after the other, disordered inside; visits before the first batch come from a table."""
    rng = random.Random(12)
    lines = [{"common": {"mid": rng.choice(["a", "b", "c", "d", None]), "is_new": rng.choice(["0", "1", "1", None])},
              "page": {"page_id": "p"}, "displays": [{"item": str(i)}], "ts": (START_S + (2 + i // 30) * DAY + rng.randrange(9)) * 1000 + i}
             for i in range(120)]
    before = [{"common": {"mid": m, "is_new": n}, "page": {}, "ts": (START_S + d * DAY) * 1000} for m, n, d in [("a", "1", 1), ("b", "0", 1)]]
    old = Topic(tmp_path / "old")
    old.put(*before)
    for day in range(4):
        topic.put(*lines[30 * day : 30 * day + 30])
    earlier = page_log(text_topic(spark, old.path, streaming=False))
    table = page_log(text_topic(spark, topic.path, streaming=False))
    want = repair_visitors(table.unionByName(earlier) if begun else table).where("page.page_id is not null")
    stream = page_log(spark.readStream.option("maxFilesPerTrigger", 1).text(topic.path))
    rows_ = maintenance.with_visits(stream, seen=first_visits(earlier) if begun else None)
    drain(to_batches(rows_, "split", maintenance.split_logs(f"{tmp_path}/parts"), str(tmp_path)))
    columns = ["common.mid", "common.is_new", "ts"]
    assert rows(spark.read.parquet(f"{tmp_path}/parts/page"), *columns) == rows(want, *columns)


def test_lookup_as_of_the_rows_time(spark, topic, tmp_path):
    rng = random.Random(13)
    changes = [(rng.choice(["a", "a", "b"]), rng.randrange(40) * 900, i, rng.choice(["insert", "update", "delete"]), f"v{i}") for i in range(80)]
    facts = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, rng.randrange(40) * 900, rng.randrange(36_000)]), i) for i in range(150)]
    log = spark.createDataFrame(changes, "id string, t long, seq int, op string, name string").withColumn(
        "et", F.timestamp_seconds(F.col("t") + START_S))
    rows_ = spark.createDataFrame(facts, "key string, t long, n int").withColumn("et", F.timestamp_seconds(F.col("t") + START_S))
    take, more = {"name": "as_named"}, {"order": ["et", "seq"], "op": "op"}
    got = {r["n"]: r["as_named"] for r in lookup_as_of(rows_, log, "key", "id", take, **more).collect()}
    want = {}
    for key, t, n in facts:
        known = sorted((ct, seq, op, name) for k, ct, seq, op, name in changes if k == key and t is not None and ct <= t)
        want[n] = known[-1][3] if known and known[-1][2] != "delete" else None
    assert got == want
    # The same from a stream's batches, against the change log as it stands then.
    for part in range(3):
        topic.put(*[{"key": k, "t": t, "n": n} for k, t, n in facts if n % 3 == part])
    stream = spark.readStream.schema("key string, t long, n int").option("maxFilesPerTrigger", 1).json(topic.path).withColumn(
        "et", F.timestamp_seconds(F.col("t") + START_S))
    write = maintenance.enrich_batches_as_of(sinks.append_batches(f"{tmp_path}/named"), lambda s: {"dim": log}, ("dim", "key", "id", take, more))
    drain(to_batches(stream, "named", write, str(tmp_path)))
    assert {r["n"]: r["as_named"] for r in spark.read.parquet(f"{tmp_path}/named").collect()} == want


def _route(table, sink, columns, sink_type="dim", kind="ALL"):
    return {"source_table": table, "source_type": kind, "sink_table": sink, "sink_type": sink_type, "sink_family": "info",
            "sink_columns": columns, "sink_row_key": "id"}


def test_routes_move_neither_nor_broadcast_the_log(spark, tmp_path):
    log = spark.createDataFrame([("shop", t, "insert", {"id": str(i)}, None, i) for i, t in enumerate(["user", "cart", "other"] * 30)],
                                "database string, table string, type string, data map<string,string>, old map<string,string>, ts long")
    log.write.partitionBy("table").parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    routes = spark.createDataFrame([tuple(_route("user", "dim_user", "id").get(f) for f in schemas.ROUTE.fieldNames())], schemas.ROUTE)
    routed = route(stored, routes, "dim")
    assert routed.count() == 30
    plan = routed._jdf.queryExecution().executedPlan().toString()
    routed.collect()
    text = routed._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in plan
    assert "dynamicpruning" in text


def test_a_route_that_moves_while_the_stream_runs(spark, topic, tmp_path):
    config = Topic(tmp_path / "config")
    job = Job(spark, str(tmp_path / "job"))
    log = lambda: change_log(spark.readStream.option("maxFilesPerTrigger", 1).text(topic.path))
    job.to_batches("routes", lambda: route_changes(spark.readStream.text(config.path)), maintenance.log_routes(job.topic("route_log")))
    write = maintenance.maintain_dimensions(f"{job.folder}/dims", maintenance.logged_routes(job.topic("route_log")), "shop")
    job.to_batches("dims", log, write)
    first, second = _route("user", "dim_a", "id"), _route("user", "dim_b", "id,name")
    for i, step in enumerate([{"op": "c", "after": first, "ts_ms": 1}, {"op": "u", "before": first, "after": second, "ts_ms": 2},
                              {"op": "d", "before": second, "ts_ms": 3}]):
        config.put(step)
        topic.put(change("user", "insert", i, {"id": str(i), "name": "n"}))
        job.drain()
    dims = sinks.read_dimensions(spark, f"{job.folder}/dims")
    assert rows(dims, "sink_table", "row_key") == [("dim_a", "0"), ("dim_b", "1")]
    # A batch that runs again takes the routes it took before, whatever holds now.
    again = change_log(spark.createDataFrame([(json.dumps(change("user", "insert", 0, {"id": "0", "name": "n"})),)], "value string"))
    write(again, 0)
    assert rows(sinks.read_dimensions(spark, f"{job.folder}/dims"), "sink_table", "row_key") == [("dim_a", "0"), ("dim_b", "1")]


def test_a_log_folds_itself_and_survives_retries(spark, tmp_path):
    spark.sql("drop table if exists folding_rows")
    rng = random.Random(14)
    shape = "id string, seq int, op string, v string"
    schema = spark.createDataFrame([], shape).schema
    log = sinks.upsert_log("folding_rows", f"{tmp_path}/rows", schema, ["id"], ["seq"], every=3)
    all_rows = []
    for batch_id in range(8):
        part = [(rng.choice("abcdef"), rng.randrange(50), rng.choice(["update", "delete"]), f"{batch_id}-{i}") for i in range(6)]
        part = list({r[:2]: r for r in part}.values())
        all_rows += [(*r, batch_id) for r in part]
        for _ in range(2 if batch_id in (2, 4, 5) else 1):  # 2 and 5 run again after their fold
            log.write(spark.createDataFrame(part, schema), batch_id)
        table = spark.createDataFrame(all_rows, shape + ", batch_id int")
        want = latest_by_key(table, ["id"], ["seq", "batch_id"], "op").drop("batch_id")
        assert rows(sinks.current_rows(log, spark, ["id"], ["seq"], "op")) == rows(want)
    assert log.read(spark).select("batch_id").distinct().count() <= 3
    assert log.location(spark).endswith("fold=5")
    # Without its catalog entry the log is found again.
    spark.sql("drop table folding_rows")
    assert sinks.upsert_log("folding_rows", f"{tmp_path}/rows", schema, ["id"], ["seq"], every=3).location(spark).endswith("fold=5")
    spark.sql("drop table folding_rows")


def test_a_folding_dimension_log_keeps_late_cells_right(spark, tmp_path):
    spark.sql("drop table if exists folding_dims")
    rng = random.Random(15)
    shape = "sink_table string, row_key string, ts long, op_type string, row map<string,string>"
    schema = spark.createDataFrame([], shape).schema
    log = sinks.dimension_log("folding_dims", f"{tmp_path}/dims", schema, every=2)
    write, all_rows = sinks.log_dimensions(log), []
    for batch_id in range(7):
        part = [(rng.choice(["s", "t"]), str(i), rng.randrange(6), rng.choice(["insert", "update", "update", "delete"]),
                 {rng.choice("xyz"): f"{batch_id}"}) for i in rng.sample(range(4), 3)]
        all_rows += [(*r, batch_id) for r in part]
        write(spark.createDataFrame(part, schema), batch_id)
        want = merge_cells(spark.createDataFrame(all_rows, shape + ", b int"), ["sink_table", "row_key"], ["ts", "b"], "op_type", "row")
        got = sinks.logged_dimensions(log, spark)
        plain = lambda df: rows(df.select("sink_table", "row_key", F.to_json("row")))
        assert plain(got) == plain(want), batch_id
    spark.sql("drop table folding_dims")


def test_lost_rows_are_counted(spark, topic, tmp_path):
    topic.put(change("user", "insert", START_S, {"id": "1"}), "no json", change("user", "insert", START_S + 1, {}))
    topic.put(change("user", "insert", START_S + 2, {"id": "2"}, database="other"), "{", "")
    losses = count_losses(spark)
    log = change_log(spark.readStream.option("maxFilesPerTrigger", 1).text(topic.path), count="parsed")
    from millrace.operators.changelog import clean

    _, query = run(spark, clean(log, "shop", count="clean").select("ts"), tmp_path, "lossy")
    losses.settle(query)
    spark.streams.removeListener(losses)
    assert losses.seen["lossy", "parsed"] == 6 and losses.dropped["lossy", "parsed"] == 3
    assert losses.seen["lossy", "clean"] == 3 and losses.dropped["lossy", "clean"] == 2


def test_order_inside_a_file(spark, topic):
    topic.put(*[change("user", "update", 5, {"id": i, "name": n}) for i, n in [("1", "a"), ("2", "x"), ("1", "b"), ("1", "c"), ("2", "y")]])
    with open(f"{topic.path}/empty.txt", "w"):
        pass
    raw = text_topic(spark, topic.path, streaming=False, numbered=True)
    log = change_log(raw, keep=["position", "part", "line"])
    last = latest_by_key(log.withColumn("id", F.col("data")["id"]), ["id"], ["ts", "position", "part", "line"])
    assert rows(last, "id", F.col("data")["name"]) == [("1", "c"), ("2", "y")]
    assert rows(raw, "line") == [(0,), (1,), (2,), (3,), (4,)]


def test_a_job_runs_stops_and_goes_on(spark, topic, tmp_path):
    """Text to parsed rows to counts, in two streams; a failing stream stops the others."""
    def job(interval=None, broken=False):
        made = Job(spark, str(tmp_path / "job"), interval)
        rows_ = lambda: event_stream(spark, topic)
        made.to_topic("events", rows_)

        def days():
            events = made.read("events", rows_().schema)
            if broken:
                events = events.withColumn("id", F.raise_error(F.lit("broken")).cast("long"))
            return stream_day_changes(events, ["key"], ["et", "id"])

        made.to_topic("days", days)
        return made

    topic.put(event("a", 1, 1), event("b", 2, 2))
    job().drain()
    topic.put(event("a", DAY, 3))
    topic.put(END)
    again = job()
    again.drain()
    read = lambda: rows(spark.read.parquet(again.topic("days")), "key", "id")
    assert read() == [("a", 1), ("a", 3), ("b", 2)]
    live = job("200 milliseconds")
    live.start()
    assert set(live.running) == {"events", "days"} and all(q.isActive for q in live.running.values())
    topic.put(event("late", 1, 9), event("c", 20_000_000, 4))
    topic.put(event("d", 30_000_000, 5))
    end = time.monotonic() + 60
    while ("c", 4) not in read() and time.monotonic() < end:
        live.watch(0.5)
    live.restart("days")
    live.stop()
    assert not live.running and read() == [("a", 1), ("a", 3), ("b", 2), ("c", 4), ("end", -1)]
    with pytest.raises(ValueError):
        live.drain()
    with pytest.raises(ValueError):
        again.to_topic("days", None)
    faulty = job("200 milliseconds", broken=True)
    faulty.start()
    topic.put(event("e", 40_000_000, 6))
    with pytest.raises(Exception, match="broken"):
        faulty.watch(60)
    assert not faulty.running
    assert os.path.isdir(f"{tmp_path}/job/checkpoint-days")
