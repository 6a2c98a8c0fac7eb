"""Streams fed file by file: same rows as the tables, late rows, restarts and sinks."""

import json
import os
import random
import time
from decimal import Decimal

import pytest
from helpers import START_S, at, change, changes, dic, rows
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators.deltas import deltas
from millrace.operators.flags import day_changes
from millrace.operators.joins import keyed_join
from millrace.operators.windows import stamp, tumbling
from millrace.plans import dws, dwd
from millrace.operators.changelog import latest_by_key
from millrace.sources.logs import change_log, order_detail_topic, page_log
from millrace.sources.topics import csv_topic, json_topic, parse_json, stream_path, stream_table, text_topic
from millrace.streaming import aggregates, maintenance, sinks
from millrace.streaming.run import count_late_rows, drain, to_batches, to_files
from millrace.streaming.stateful import stream_day_changes, stream_deltas, stream_distinct, stream_first_seen


class Topic:
    """A folder that gets one file per call, each newer than the one before."""

    def __init__(self, folder):
        self.path, self.files = str(folder), 0
        os.makedirs(self.path, exist_ok=True)

    def put(self, *lines):
        name = f"{self.path}/{self.files:04d}.txt"
        with open(name, "w") as f:
            f.write("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
        os.utime(name, (time.time() - 1000 + self.files,) * 2)
        self.files += 1


@pytest.fixture
def topic(tmp_path):
    return Topic(tmp_path / "topic")


def event_stream(spark, topic, one_by_one=True):
    reader = spark.readStream.schema("key string, t double, id long")
    if one_by_one:
        reader = reader.option("maxFilesPerTrigger", 1)
    raw = reader.json(topic.path)
    return raw.select("key", "id", F.timestamp_seconds(F.col("t") + START_S).alias("et"))


def event(key, t, i):
    return {"key": key, "t": t, "id": i}


# Lets the watermark pass all rows before it; never out itself.
END = {"key": "end", "t": 10_000_000, "id": -1}


def run(spark, df, folder, name="out"):
    query = to_files(df, name, f"{folder}/{name}", str(folder))
    drain(query)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}"), query


def test_rows_after_their_window_closed_are_dropped_and_counted(spark, topic, tmp_path):
    topic.put(event("a", 1, 1), event("a", 7.9, 2))   # watermark 4.9: the first window stays open
    topic.put(event("a", 4, 3), event("a", 9, 4))     # in time; watermark 6.0 closes the first window
    topic.put(event("a", 9.5, 7))                     # rows are held against the watermark one batch later
    topic.put(event("a", 4.5, 5))                     # too late
    topic.put(event("z", 100, 6))
    ev = event_stream(spark, topic).withWatermark("et", "3 seconds")
    counts = stamp(ev.groupBy(tumbling(), "key").agg(F.count(F.lit(1)).alias("n")))
    late = count_late_rows(spark)
    out, _ = run(spark, counts, tmp_path, "late")
    assert rows(out, "stt", "key", "n") == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:00:05", "a", 3)]
    end = time.time() + 20
    while not late.counts["late"] and time.time() < end:  # listeners hear of a batch a little later
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.counts["late"] == 1


def test_large_ids_and_nulls_keep_their_worth(spark, topic, tmp_path):
    big = 2**53 + 1
    topic.put(event("a", 1, big), event("b", 2, None), event("a", 3, big + 2), event("c", 90_000, 1), END)
    firsts = stream_day_changes(event_stream(spark, topic), ["key"], ["et", "id"])
    out, _ = run(spark, firsts, tmp_path, "big")
    assert rows(out, "key", "id") == [("a", big), ("b", None), ("c", 1)]


def test_late_rows_around_midnight_flag_no_day_twice(spark, topic, tmp_path):
    for i, t in enumerate((86_401, 86_399, 86_402, 172_801)):
        topic.put(event("a", t, i))
    topic.put(END)
    firsts = stream_day_changes(event_stream(spark, topic), ["key"], ["et", "id"])
    out, _ = run(spark, firsts, tmp_path, "midnight")
    assert sorted(r["day"] for r in out.collect()) == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_a_late_day_of_a_key_seen_days_before_is_flagged(spark, topic, tmp_path):
    """The last row comes a batch later than the next day's first row, within the lateness."""
    events = [event("a", 5, 1), event("a", 9 * 86_400 + 1, 2), event("a", 9 * 86_400 - 1, 3), event("a", 9 * 86_400 - 0.5, 4)]
    for e in [*events, END]:
        topic.put(e)
    firsts = stream_day_changes(event_stream(spark, topic), ["key"], ["et", "id"])
    out, _ = run(spark, firsts, tmp_path, "late_day")
    table = spark.createDataFrame([(e["key"], e["id"], at(e["t"])) for e in events], "key string, id int, et timestamp")
    columns = ["key", "day", "id", "last_day"]
    assert rows(out, *columns) == rows(day_changes(table, ["key"], ["et", "id"]), *columns)
    assert {r["id"]: r["last_day"] for r in out.collect()} == {1: None, 2: "2024-01-09", 3: "2024-01-01"}


def test_a_later_batch_wins_within_a_second(spark, tmp_path):
    shape = "sink_table string, row_key string, ts long, op_type string, row map<string,string>"
    for i, (op, name) in enumerate((("insert", "old"), ("update", "new"))):
        sinks.put_cells(f"{tmp_path}/dims")(spark.createDataFrame([("t", "1", 7, op, {"name": name})], shape), i)
    assert [r["row"] for r in sinks.read_dimensions(spark, f"{tmp_path}/dims").collect()] == [{"name": "new"}]


def test_day_changes_over_many_batches_equal_the_table(spark, topic, tmp_path):
    rng = random.Random(4)
    events = sorted((event(rng.choice("aaabcd"), rng.randrange(4 * 86400), i) for i in range(120)),
                    key=lambda e: (e["t"], e["id"]))
    for i in range(0, 120, 30):
        topic.put(*events[i:i + 30])
    topic.put(END)
    ev = event_stream(spark, topic)
    out, _ = run(spark, stream_day_changes(ev, ["key"], ["et", "id"]), tmp_path)
    table = spark.createDataFrame([(e["key"], e["id"], at(e["t"])) for e in events], "key string, id int, et timestamp")
    columns = ["key", "day", "id", "last_day"]
    assert rows(out, *columns) == rows(day_changes(table, ["key"], ["et", "id"]), *columns)
    firsts, _ = run(spark, stream_first_seen(ev, ["key"], ["et", "id"]), tmp_path, "firsts")
    want = {}
    for e in events:
        want.setdefault(e["key"], e["id"])
    assert dict(rows(firsts, "key", "id")) == want


def test_restart_neither_repeats_nor_loses(spark, topic, tmp_path):
    topic.put(event("a", 1, 1), event("b", 2, 2))
    days = stream_day_changes(event_stream(spark, topic), ["key"], ["et", "id"])
    run(spark, days, tmp_path)
    topic.put(event("a", 3, 3), event("c", 4, 4), event("a", 86400, 5))
    topic.put(END)
    days = stream_day_changes(event_stream(spark, topic), ["key"], ["et", "id"])
    out, _ = run(spark, days, tmp_path)
    assert rows(out, "key", "id") == [("a", 1), ("a", 5), ("b", 2), ("c", 4)]


def _log_line(mid, t, page, **common):
    return {"common": {"mid": mid, "sid": f"s{mid}", "vc": "v", "ch": "c", "ar": "a", "is_new": "1", **common},
            "page": {"page_id": page, "during_time": 10}, "ts": (START_S + t) * 1000}


def test_page_aggregates_equal_the_table(spark, topic, tmp_path):
    rng = random.Random(5)
    lines = [_log_line(rng.choice("aab"), t, rng.choice(["home", "good_detail", "list"]), uid="u")
             for t in sorted(rng.randrange(60) for _ in range(80))]
    topic.put(*lines, _log_line("z", 10_000, "home", uid="z"))
    # The aggregates set the watermark themselves.
    log = page_log(text_topic(spark, topic.path, streaming=False))
    stream = page_log_stream(spark, topic)
    real = F.col("stt") < "2024-01-01 01:00:00"
    for name, streamed, table in [
        ("views", aggregates.page_views(stream), dws.page_views(log)),
        ("home", aggregates.home_detail_views(stream), dws.home_detail_views(log)),
        ("logins", aggregates.logins(stream), dws.logins(log)),
    ]:
        out, _ = run(spark, streamed, tmp_path, name)
        assert rows(out, *table.columns) == rows(table.where(real)), name


def page_log_stream(spark, topic):
    rows = parse_json(text_topic(spark, topic.path), schemas.APP_LOG)
    return rows.withColumn("et", F.timestamp_millis("ts"))


def _order(order, line, t, province="p1", sku="s1"):
    return [
        change("order_info", "insert", START_S + t, {"id": order, "user_id": "u", "province_id": province}),
        change("order_detail", "insert", START_S + t + 1, {
            "id": line, "order_id": order, "sku_id": sku, "sku_name": "n", "order_price": "2.50", "sku_num": "3",
            "create_time": "2024-01-01 00:00:00", "split_total_amount": "7.00", "split_activity_amount": "0.50"}),
    ]


def test_order_lines_as_a_stream(spark, topic, tmp_path):
    messages = _order("o1", "l1", 0) + _order("o2", "l2", 10) + [
        change("order_detail_activity", "insert", START_S + 2, {"order_detail_id": "l1", "activity_id": "a1"}),
        change("order_detail_coupon", "insert", START_S + 40, {"order_detail_id": "l1", "coupon_id": "too late"}),
        change("order_detail_coupon", "insert", START_S + 11, {"order_detail_id": "l2", "coupon_id": "c2"}),
    ]
    far = _order("oz", "lz", 10_000) + [
        change("order_detail_activity", "insert", START_S + 10_000, {"order_detail_id": "x"}),
        change("order_detail_coupon", "insert", START_S + 10_000, {"order_detail_id": "x"})]
    topic.put(*messages, *far)
    lines = dwd.order_details(change_log(text_topic(spark, topic.path)), "shop", ttl_s=5)
    out, _ = run(spark, lines, tmp_path)
    want = dwd.order_details(changes(spark, messages), "shop", ttl_s=5)
    columns = ["id", "order_id", "user_id", "province_id", "activity_id", "coupon_id", "split_original_amount"]
    assert rows(out.where("id != 'lz'"), *columns) == rows(want, *columns) == [
        ("l1", "o1", "u", "p1", "a1", None, "7.5000"), ("l2", "o2", "u", "p1", None, "c2", "7.5000")]


def test_payments_and_cancellations_as_streams(spark, topic, tmp_path):
    details = spark.createDataFrame(
        [tuple({"id": i, "order_id": o, "split_total_amount": "7.00", "ts": START_S + t}.get(f) for f in
               schemas.ORDER_DETAIL.fieldNames()) for i, o, t in [("l1", "o1", 0), ("l2", "o2", 0), ("l3", "z", 90_000)]],
        schemas.ORDER_DETAIL)
    details.write.json(f"{tmp_path}/details")
    paid = {"payment_status": "1602", "payment_type": "1101"}
    messages = [
        change("payment_info", "update", START_S + 1800, paid | {"order_id": "o1"}, {"payment_status": "1601"}),
        change("payment_info", "update", START_S + 1801, paid | {"order_id": "o2"}, {"payment_status": "1601"}),
        change("payment_info", "update", START_S, paid | {"order_id": "o2"}, {"payment_status": "1600"}),
        change("order_info", "update", START_S + 1805, {"id": "o2", "order_status": "1003",
                                                        "operate_time": "2024-01-01 00:30:05"}, {"order_status": "1001"}),
    ]
    topic.put(*messages)
    codes = dic(spark, {"1101": "card"})
    facts = order_detail_topic(spark, f"{tmp_path}/details")
    log = change_log(text_topic(spark, topic.path))
    out, _ = run(spark, dwd.paid_details(log, facts, codes, "shop"), tmp_path, "paid")
    assert rows(out, "order_detail_id", "payment_type_name") == [("l1", "card")]
    out, _ = run(spark, dwd.cancelled_details(log, facts, "shop", ttl_s=1805), tmp_path, "cancelled")
    assert rows(out, "id", "cancel_time", "date_id") == [("l2", "2024-01-01 00:30:05", "2024-01-01")]


def test_two_streams_need_a_ttl(spark, topic):
    topic.put(event("a", 1, 1))
    ev = event_stream(spark, topic)
    with pytest.raises(ValueError):
        keyed_join(ev, ev, {"key": "key"})


@pytest.mark.parametrize("attributes", ["current", "previous"])
def test_amount_changes_over_batches(spark, topic, tmp_path, attributes):
    """Three batches with disorder inside the lateness, a missing amount and a late revision."""
    rng = random.Random(6)
    data = [{"id": rng.choice(["hot", "hot", *"abcde"]), "tag": str(i), "t": 2 * i + rng.randrange(3),
             "amount": rng.choice([None, rng.randrange(100)])} for i in range(150)]
    data += [{"id": "late", "tag": "x", "t": 10, "amount": 100}, {"id": "late", "tag": "y", "t": 9, "amount": 80}]
    data.sort(key=lambda r: (r["t"], r["tag"]))
    late = next(i for i, r in enumerate(data) if r["tag"] == "y")
    data.insert(late + 2, data.pop(late))
    for at_row in range(0, len(data), 40):
        topic.put(*data[at_row : at_row + 40])
    topic.put({"id": "end", "tag": "z", "t": 10_000, "amount": 1}, {"id": "end", "tag": "zz", "t": 20_000, "amount": 1})
    shape = "id string, tag string, t long, amount decimal(16,2)"

    def timed(df):
        return df.withColumn("et", F.timestamp_seconds(F.col("t") + START_S))

    stream = timed(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(topic.path))
    out, _ = run(spark, stream_deltas(stream, ["id"], ["et", "tag"], ["amount"], attributes), tmp_path, "changes")
    want = deltas(timed(spark.read.schema(shape).json(topic.path)), ["id"], ["et", "tag"], ["amount"], attributes=attributes)
    assert rows(out.where("id <> 'end'"), *want.columns) == rows(want.where("id <> 'end'"))


def test_log_split_over_batches(spark, topic, tmp_path):
    def record(mid, day, **parts):
        return {"common": {"mid": mid, "is_new": "1"}, "ts": (START_S + day * 86400) * 1000} | parts

    topic.put(record("a", 0, page={"page_id": "home"}, displays=[{"item": "1"}, {"item": "2"}]), "broken")
    topic.put(record("a", 1, page={"page_id": "home"}), record("b", 1, start={"entry": "icon"}))
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(topic.path)
    write = maintenance.split_logs(f"{tmp_path}/parts")
    drain(to_batches(maintenance.with_visits(page_log(raw)), "split", write, str(tmp_path)))
    pages = spark.read.parquet(f"{tmp_path}/parts/page")
    assert rows(pages, "common.mid", "common.is_new") == [("a", "0"), ("a", "1")]
    assert spark.read.parquet(f"{tmp_path}/parts/display").count() == 2
    assert rows(spark.read.parquet(f"{tmp_path}/parts/start"), "common.mid", "common.is_new") == [("b", "1")]


def test_upserts_over_batches(spark, tmp_path):
    write = sinks.upserts(f"{tmp_path}/rows", ["id"], ["seq"])
    shape = "id string, seq int, op string, v string"
    batches = [[("a", 1, "insert", "x"), ("b", 2, "insert", "x"), ("a", 3, "update", "y")],
               [("b", 4, "delete", "x"), ("c", 5, "insert", "x")], [("b", 6, "insert", "back"), ("c", 7, "delete", "x")]]
    for batch_id, part in enumerate(batches):
        write(spark.createDataFrame(part, shape), batch_id)
        write(spark.createDataFrame(part, shape), batch_id)
    read = sinks.read_upserts(spark, f"{tmp_path}/rows", ["id"], ["seq"], "op")
    assert rows(read, "id", "v") == [("a", "y"), ("b", "back")]
    sinks.fold_upserts(spark, f"{tmp_path}/rows", f"{tmp_path}/folded", ["id"], ["seq"], "op")
    assert rows(sinks.read_upserts(spark, f"{tmp_path}/folded", ["id"], ["seq"], "op"), "id", "v") == [
        ("a", "y"), ("b", "back")]


def _routes(spark):
    def route(table, kind, sink, sink_type, columns):
        return (table, kind, sink, sink_type, "info", columns, "id", None)

    return spark.createDataFrame([route("user", "ALL", "dim_user", "dim", "id,name"),
                                  route("user", "insert", "topic_new", "dwd", "id"),
                                  route("user", "update", "topic_changed", "dwd", "id,name")], schemas.ROUTE)


def test_dimensions_and_routed_topics(spark, topic, tmp_path):
    topic.put(change("user", "insert", 1, {"id": "1", "name": "n"}), change("user", "insert", 1, {"id": "2", "name": "m"}))
    topic.put(change("user", "update", 2, {"id": "1", "name": "new"}, {"name": "n"}), change("user", "delete", 3, {"id": "2"}))
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(topic.path)
    dims = maintenance.maintain_dimensions(f"{tmp_path}/dims", _routes, "shop")
    drain(to_batches(change_log(raw), "dims", dims, str(tmp_path)))
    state = sinks.read_dimensions(spark, f"{tmp_path}/dims")
    assert [(r.sink_table, r.row_key, r.row) for r in state.collect()] == [("dim_user", "1", {"id": "1", "name": "new"})]
    assert sinks.read_dimensions(spark, f"{tmp_path}/dims", live=_routes(spark).where("sink_table = 'x'")).count() == 0

    facts = maintenance.route_facts(f"{tmp_path}/topics", _routes, "shop")
    drain(to_batches(change_log(raw), "facts", facts, str(tmp_path)))
    lines = spark.read.json(f"{tmp_path}/topics")
    assert rows(lines, "sink_table", "value") == [
        ("topic_changed", '{"id":"1","name":"new","op_type":"update"}'),
        ("topic_new", '{"id":"1","op_type":"insert"}'), ("topic_new", '{"id":"2","op_type":"insert"}')]


def test_lookups_of_a_batch_see_dimensions_as_they_are_then(spark, topic, tmp_path):
    for i, name in enumerate(("old", "new")):
        spark.createDataFrame([("1", name)], "id string, name string").write.parquet(f"{tmp_path}/dim{i}")
    loads = iter((0, 1))
    topic.put(event("1", 1, 1))
    topic.put(event("1", 2, 2), event("2", 2, 3))
    write = maintenance.enrich_batches(
        sinks.append_batches(f"{tmp_path}/named"), lambda session: session.read.parquet(f"{tmp_path}/dim{next(loads)}"),
        lambda dim: [(dim, "key", "id", {"name": "name"})])
    drain(to_batches(event_stream(spark, topic).drop("et"), "named", write, str(tmp_path)))
    assert rows(spark.read.parquet(f"{tmp_path}/named"), "id", "name") == [(1, "old"), (2, "new"), (3, None)]


def test_distinct_rows_of_a_stream(spark, topic, tmp_path):
    topic.put(*[event("a", t, t) for t in range(50)], event("b", 3, 3))
    topic.put(*[event("a", t, t) for t in range(50)], event("c", 60, 60))
    ev = event_stream(spark, topic).withWatermark("et", "3 seconds")
    days = ev.select("key", "id", F.window("et", "1 day").alias("day"))
    out, _ = run(spark, stream_distinct(days, ["key", "day"], ["id"]).select("key"), tmp_path)
    assert rows(out) == [("a",), ("b",), ("c",)]


def test_sink_tables_follow_routing_changes(spark):
    steps = spark.createDataFrame([("c", "dim_a", "id,name", 1), ("r", "dim_b", "id", 2), ("u", "dim_b", "id,more", 3),
                                   ("c", "dim_c", "id", 4), ("d", "dim_c", "id", 5)],
                                  "op string, sink_table string, sink_columns string, ts_ms long")
    spark.sql("drop database if exists millrace_sinks cascade")
    sinks.sync_sinks(spark, steps, "millrace_sinks")
    assert sorted(t.name for t in spark.catalog.listTables("millrace_sinks")) == ["dim_a", "dim_b"]
    assert spark.table("millrace_sinks.dim_b").columns == ["id", "more"]
    spark.sql("drop database millrace_sinks cascade")


def test_window_results_as_json_lines_by_day(spark, tmp_path):
    write = sinks.load_json_lines(f"{tmp_path}/load", drop=["ts"])
    df = spark.createDataFrame([("2024-01-01", "a", None, 1), ("2024-01-02", "b", 5, 2)],
                               "cur_date string, keyword string, n int, ts int")
    write(df, 0)
    write(df, 0)
    loaded = spark.read.text(f"{tmp_path}/load")
    assert rows(loaded.select(F.col("cur_date").cast("string"), "value")) == [
        ("2024-01-01", '{"cur_date":"2024-01-01","keyword":"a"}'),
        ("2024-01-02", '{"cur_date":"2024-01-02","keyword":"b","n":5}')]


def test_csv_and_json_topics(spark, topic, tmp_path):
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    topic.put("1,a", "x,b", "3,c")
    assert rows(csv_topic(spark, topic.path, shape, streaming=False)) == [(1, "a"), (3, "c")]
    out, _ = run(spark, csv_topic(spark, topic.path, shape), tmp_path, "csv")
    assert rows(out) == [(1, "a"), (3, "c")]
    other = Topic(tmp_path / "json")
    other.put({"id": 1, "name": "a"}, "nonsense", {"id": 2})
    out, _ = run(spark, json_topic(spark, other.path, shape), tmp_path, "json-out")
    assert rows(out) == [(1, "a"), (2, None)]


def test_left_join_to_a_keyed_topic(spark, tmp_path):
    left = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(0))], "id int, name string, et timestamp")
    right = spark.createDataFrame([(1, 30, at(1))], "id int, age int, et timestamp")
    joined = keyed_join(left, right, {"id": "id"}, "left")
    sinks.upserts(f"{tmp_path}/t4", ["id"], ["et"])(joined, 0)
    assert rows(sinks.read_upserts(spark, f"{tmp_path}/t4", ["id"], ["et"]), "id", "name", "age") == [
        (1, "a", 30), (2, "b", None)]


def test_a_stream_may_start_from_one_file_or_a_folder(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/ids")
    [one] = [f"{tmp_path}/ids/{f}" for f in os.listdir(f"{tmp_path}/ids") if f.endswith(".parquet")]
    assert stream_path("/a/b.parquet") == "/a/[b].parquet"
    for i, path in enumerate((f"{tmp_path}/ids", one)):
        out, _ = run(spark, stream_table(spark, path), tmp_path, f"copy{i}")
        assert out.count() == 5


def test_refund_counts_and_registrations_as_streams(spark, topic, tmp_path):
    dims = {
        "sku_info": spark.createDataFrame([("s1", "t1", "c3")], "id string, tm_id string, category3_id string"),
        "base_trademark": spark.createDataFrame([("t1", "brand")], "id string, tm_name string"),
        "base_category3": spark.createDataFrame([("c3", "n3", "c2")], "id string, name string, category2_id string"),
        "base_category2": spark.createDataFrame([("c2", "n2", "c1")], "id string, name string, category1_id string"),
        "base_category1": spark.createDataFrame([("c1", "n1")], "id string, name string"),
    }
    shape = "sku_id string, user_id string, order_id string, refund_amount string, t long"
    refunds = [{"sku_id": "s1", "user_id": "u", "order_id": o, "refund_amount": a, "t": t}
               for o, a, t in [("o1", "1.50", 1), ("o1", "2.00", 2), ("o2", "3.00", 4), ("o2", "1.00", 6), ("z", "0", 999)]]
    topic.put(*refunds)

    def typed(raw):
        return raw.withColumn("et", F.timestamp_seconds(F.col("t") + START_S))

    streamed = aggregates.brand_user_refunds(typed(spark.readStream.schema(shape).json(topic.path)), dims)
    table = dws.brand_user_refunds(typed(spark.read.schema(shape).json(topic.path)), dims)
    out, _ = run(spark, streamed, tmp_path, "refunds")
    assert rows(out, *table.columns) == rows(table.where("stt < '2024-01-01 00:01:00'"))
    assert [tuple(map(str, r)) for r in rows(out, "refund_count", "refund_amount", "category1_name")] == [
        ("1", "1.00", "n1"), ("2", "6.50", "n1")]

    users = Topic(tmp_path / "users")
    users.put({"create_time": "2024-01-01 00:00:01"}, {"create_time": "2024-01-01 00:00:02"}, {"create_time": "2025-01-01 00:00:00"})
    out, _ = run(spark, aggregates.registrations(spark.readStream.schema("create_time string").json(users.path)), tmp_path, "reg")
    assert rows(out, "register_ct") == [(2,)]


def test_fact_aggregates_equal_the_table(spark, topic, tmp_path):
    rng = random.Random(7)
    events = [event(rng.choice("aaabc"), rng.randrange(3 * 86400), i) for i in range(60)]
    topic.put(*sorted(events, key=lambda e: e["t"]), event("z", 30 * 86400, 99))
    stream = event_stream(spark, topic).withColumnRenamed("key", "user_id")
    table = spark.read.schema("key string, t double, id long").json(topic.path).select(
        F.col("key").alias("user_id"), F.timestamp_seconds(F.col("t") + START_S).alias("et"))
    real = F.col("stt") < "2024-01-10"
    for name in ("cart_users", "payment_users", "order_users"):
        out, _ = run(spark, getattr(aggregates, name)(stream, "6 hours"), tmp_path, name)
        want = getattr(dws, name)(table, "6 hours").where(real)
        assert rows(out, *want.columns) == rows(want) and want.count(), name


def test_sku_and_province_amounts_equal_the_table(spark, tmp_path):
    shape = ("id string, order_id string, sku_id string, province_id string, split_original_amount string, "
             "split_activity_amount string, split_coupon_amount string, split_total_amount string, et timestamp")
    lines = [("l1", "o1", "s1", "p1", "10", None, "1", "9", at(0)), ("l1", "o1", "s1", "p1", "10", "2", "1", "7", at(1)),
             ("l2", "o1", "s2", "p1", "5", None, None, "5", at(2)), ("l3", "o2", "s1", "p2", "4", None, None, "4", at(7))]
    table = spark.createDataFrame(lines, shape)
    sku = spark.createDataFrame([("s1", "shoe", "sp", "c3", "t1")],
                                "id string, sku_name string, spu_id string, category3_id string, tm_id string")
    named = "id string, name string"
    dims = {"sku_info": sku, "spu_info": spark.createDataFrame([("sp", "spu")], "id string, spu_name string"),
            "base_trademark": spark.createDataFrame([("t1", "brand")], "id string, tm_name string"),
            "base_category3": spark.createDataFrame([("c3", "n3", "c2")], named + ", category2_id string"),
            "base_category2": spark.createDataFrame([("c2", "n2", "c1")], named + ", category1_id string"),
            "base_category1": spark.createDataFrame([("c1", "n1")], named)}
    sums = dws.sku_orders(table, dims)
    assert [tuple(map(str, r)) for r in rows(sums, "stt", "sku_id", "order_amount", "activity_amount", "spu_name")] == [
        ("2024-01-01 00:00:00", "s1", "7.00", "2.00", "spu"), ("2024-01-01 00:00:00", "s2", "5.00", "0.00", "None"),
        ("2024-01-01 00:00:05", "s1", "4.00", "0.00", "spu")]
    provinces = spark.createDataFrame([("p1", "north")], named)
    by_province = dws.province_orders(table, provinces)
    assert [tuple(map(str, r)) for r in rows(by_province, "stt", "province_name", "order_count", "order_amount")] == [
        ("2024-01-01 00:00:00", "north", "1", "12.00"), ("2024-01-01 00:00:05", "None", "1", "4.00")]

    end = [("z", "z", "z", "z", "0", "0", "0", "0", at(9999))]
    spark.createDataFrame(lines + end, shape).write.parquet(f"{tmp_path}/lines")
    stream = stream_table(spark, f"{tmp_path}/lines")
    changed = dws.amount_rows(table.unionByName(spark.createDataFrame(end, shape)), ["et"])
    deltas(changed, ["id"], ["et"], dws.AMOUNTS).write.parquet(f"{tmp_path}/changed")
    out, _ = run(spark, aggregates.sku_orders(stream_table(spark, f"{tmp_path}/changed").withWatermark("et", "3 seconds"), dims), tmp_path, "sku")
    assert rows(out, *sums.columns) == rows(sums)

    moved = deltas(table.unionByName(spark.createDataFrame(end, shape)).select(
        "id", "province_id", "et", F.col("split_total_amount").cast("decimal(16,2)").alias("order_amount")),
        ["id"], ["et"], ["order_amount"], attributes="previous")
    moved.write.parquet(f"{tmp_path}/moved")
    out, _ = run(spark, aggregates.province_orders(
        stream_table(spark, f"{tmp_path}/moved"), stream, provinces), tmp_path, "province")
    assert rows(out, *by_province.columns) == rows(by_province)


def test_latest_by_key_is_the_contract_of_left_joins(spark):
    """A null-extended row followed by its matched row folds to the matched row."""
    log = spark.createDataFrame([(1, 1, None), (1, 2, 30), (2, 1, None)], "id int, seq int, age int")
    assert rows(latest_by_key(log, ["id"], ["seq"]), "id", "age") == [(1, 30), (2, None)]
