"""What queries hold, write and repeat as their tables grow."""

import glob
from decimal import Decimal

import oracle
import pyarrow as pa
import pytest
from helpers import START_S, change, dic, rows, text
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators.deltas import deltas
from millrace.plans import dwd
from millrace.queries import ORACLE, QUERIES
from millrace.session import FREE_SHUFFLES, prepare
from millrace.sources.logs import change_log, order_detail_topic
from millrace.sources.topics import stream_table, text_topic
from millrace.streaming import stateful
from millrace.streaming.run import collected


def _events(spark, path, files, n=600, users=25):
    """Events of a few users, seconds apart, over several files."""
    kinds = F.array(*[F.lit(k) for k in ("view", "click", "purchase", "signup", "error")])
    i = F.col("id")
    spark.range(0, n, 1, files).select(
        i.alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + i * 700).cast("timestamp_ntz").alias("ts"),
        F.pmod(F.xxhash64(i), F.lit(users)).alias("user_id"), F.element_at(kinds, (F.pmod(F.xxhash64(i, F.lit(1)), F.lit(5)) + 1).cast("int")).alias("event_type"),
        (i % 90 / 8).alias("value"), F.concat(F.lit('{"k": '), (i % 50).cast("string"), F.lit("}")).alias("props")).write.parquet(path)


def test_batches_of_a_log_are_those_of_its_replay(spark, tmp_path):
    """The files of a batch are split together, however many they are: one by one, devices are met in the wrong order."""
    _events(spark, f"{tmp_path}/events.parquet", 6)
    con = oracle.duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/job-*"))
    problems, count = oracle.compare(QUERIES["stream_traffic_job"](spark, str(tmp_path)), con, ORACLE["stream_traffic_job"])
    assert not problems and count > 50
    [job] = set(glob.glob(f"{folder}/job-*")) - before
    assert len(glob.glob(f"{job}/parts/page/batch_id=*")) <= 6  # four, the closing row, and the last watermark


def test_state_takes_no_room_in_advance(spark):
    conf = prepare(spark).conf
    assert conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate") == "false"
    assert conf.get("spark.sql.streaming.stateStore.rocksdb.blockSizeKB") == "32"


def test_shuffles_of_streams_are_deleted(spark, tmp_path):
    """With the batch they belong to; the session's own choice stays as it is."""
    def shuffles():
        return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    spark.range(0, 100, 1, 2).select("id", F.timestamp_seconds(F.col("id") + 10).alias("et")).write.parquet(f"{tmp_path}/in")
    kept, before = shuffles(), spark.conf.get(FREE_SHUFFLES, None)
    days = stream_table(spark, f"{tmp_path}/in").withWatermark("et", "1 second").dropDuplicates(["id", "et"])
    assert collected(spark, days, "freed", str(tmp_path)).count() == 100
    assert shuffles() <= kept + 1  # that of the count
    assert spark.conf.get(FREE_SHUFFLES, None) in (before, "false")


def test_lines_wait_packed(spark, tmp_path):
    """The texts of a line are one column in the state of the joins; odd and missing ones come back."""
    texts = {"sku_id": "s", "create_time": "2024-01-01 00:00:00", "sku_num": "2", "order_price": "1.50", "split_total_amount": None}
    log = [change("order_detail", "insert", START_S + i, {**texts, "id": f"l{i}", "order_id": "o", "sku_name": name})
           for i, name in enumerate(["plain", "", "\1|\2n", None])]
    log += [change("order_info", "insert", START_S, {"id": "o", "user_id": "u", "province_id": "\2"}),
            change("order_detail_activity", "insert", START_S, {"order_detail_id": "l1", "activity_id": "a"}),
            change("order_detail_coupon", "insert", START_S, {"order_detail_id": "l2", "coupon_id": "\1"})]
    text(spark, log).coalesce(1).write.text(f"{tmp_path}/log/1")
    text(spark, [change("order_info", "insert", START_S + 10_000, {"id": "end"})]).coalesce(1).write.text(f"{tmp_path}/log/2")
    got = collected(spark, dwd.order_details(change_log(text_topic(spark, f"{tmp_path}/log/*")), "shop", 5), "lines", str(tmp_path))
    want = dwd.order_details(change_log(text_topic(spark, f"{tmp_path}/log/*", streaming=False)), "shop", 5)
    assert rows(got, *want.columns) == rows(want) and got.count() == 4
    for operator in range(3):
        held = spark.read.format("statestore").option("operatorId", operator).option("joinSide", "left").load(f"{tmp_path}/checkpoint-lines")
        assert "_pack" in held.schema["value"].dataType.names and not {"sku_name", "user_id", "activity_id"} & set(held.schema["value"].dataType.names)


def _revisions(spark, path):
    """Three revisions of each of some keys, an hour apart, with a long text that does not pack."""
    i = F.col("id")
    rows = spark.range(600).select(
        (i % 200).alias("key"), (i / 200).cast("int").alias("n"), F.sha2(i.cast("string"), 512).alias("note"),
        F.when(i % 7 != 0, (i - 300) / 4).cast("decimal(16,2)").alias("amount"))
    rows = rows.withColumn("et", F.timestamp_seconds(START_S + 3600 * F.col("n") + F.col("key") % 60))
    rows.coalesce(1).write.parquet(path)
    end = rows.limit(1).withColumn("key", F.lit(-1).cast("long")).withColumn("et", F.timestamp_seconds(F.lit(START_S + 900_000)))
    end.coalesce(1).write.mode("append").parquet(path)
    return rows


def test_of_a_key_only_what_the_next_revision_asks_for_is_held(spark, tmp_path):
    """The state that is never freed has no texts of revisions; amounts come out as decimals, missing and negative ones too."""
    table = _revisions(spark, f"{tmp_path}/in")
    stream = stream_table(spark, f"{tmp_path}/in")
    got = collected(spark, stateful.stream_deltas(stream, ["key"], ["et"], ["amount"]), "held", str(tmp_path))
    assert got.schema["amount"].dataType == table.schema["amount"].dataType
    assert rows(got, *table.columns) == rows(deltas(table, ["key"], ["et"], ["amount"]), *table.columns)
    held = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "held").load(f"{tmp_path}/checkpoint-held")
    assert held.agg(F.sum(F.length("value.blob"))).first()[0] < 200 * 128


def test_parts_hand_on_few_values():
    """What the parts of a task hand to a bucket goes as one value; nothing gets lost or out of place on the way."""
    put = stateful._together("_due")
    names = ["_bucket", "_lane", "_due", "_body"]
    parts = [(i % 5, None, i, stateful.pickle.dumps(([(f"k{i}", i), (f"k{i}", i + 1)], [(0, 1), (None, 0)]), 5)) for i in range(100)]
    parts += [(1, 7, 200, stateful.pickle.dumps(([("x", 1)], []), 5))] * 3
    chunks = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts[i : i + 40])], names=names) for i in (0, 40, 80)]
    whole = [row for chunk in put(iter(chunks)) for row in chunk.to_pylist()]
    assert len(whole) == 6 and {row["_due"] for row in whole} == {95, 96, 97, 98, 99, 200}
    got = []
    for row in whole:
        revisions, pairs = stateful._spread(row["_body"])
        got += [tuple(None if i is None else revisions[i] for i in pair) for pair in pairs] or revisions
    assert sorted(got, key=repr) == sorted([x for i in range(100) for x in (((f"k{i}", i), (f"k{i}", i + 1)), (None, (f"k{i}", i)))] + [("x", 1)] * 3, key=repr)


def test_amounts_come_back_as_they_were():
    kind = pa.decimal128(16, 2)
    whole = pa.array([Decimal("-12.34"), None, Decimal("0.01"), Decimal("99999999999999.99"), Decimal("5")], kind)
    assert stateful._values(whole.slice(1)) == [None, 1, 9999999999999999, 500]
    assert stateful._array(stateful._values(whole), kind).equals(whole)
    assert stateful._array([None], kind).to_pylist() == [None] and stateful._array([], kind).to_pylist() == []
    with pytest.raises(pa.ArrowInvalid):
        stateful._array([10**16], kind)


def test_cancelled_and_paid_lines_wait_packed(spark, tmp_path):
    """The texts of a line are one column in the state; odd and missing ones come back, as in a table."""
    shape = schemas.ORDER_DETAIL
    details = spark.createDataFrame([tuple({"id": f"l{i}", "order_id": "o", "sku_name": name, "coupon_id": "c", "ts": START_S + i}.get(f)
                                           for f in shape.fieldNames()) for i, name in enumerate(["plain", "", "\1|\2n", None])], shape)
    details.write.json(f"{tmp_path}/details")
    text(spark, [change("order_info", "update", START_S + 5, {"id": "o", "order_status": "1003", "operate_time": "2024-01-01 00:00:05"},
                        {"order_status": "1001"}),
                 change("payment_info", "update", START_S + 5, {"order_id": "o", "payment_status": "1602", "payment_type": "1101"},
                        {"payment_status": "1601"})]).write.text(f"{tmp_path}/log")
    codes = dic(spark, {"1101": "card"})
    facts = {"cancelled": lambda log, lines: dwd.cancelled_details(log, lines, "shop", 60), "paid": lambda log, lines: dwd.paid_details(log, lines, codes, "shop")}
    for name, make in facts.items():
        got, want = (make(change_log(text_topic(spark, f"{tmp_path}/log", streaming)), order_detail_topic(spark, f"{tmp_path}/details", streaming))
                     for streaming in (True, False))
        got = collected(spark, got, name, str(tmp_path))
        assert rows(got, *want.columns) == rows(want) and got.count() == 4
        held = spark.read.format("statestore").option("operatorId", 0).option("joinSide", "right").load(f"{tmp_path}/checkpoint-{name}")
        assert "_pack" in held.schema["value"].dataType.names and "sku_name" not in held.schema["value"].dataType.names
