"""How often and how whole rows move: packed texts, folds without sorting all that is read, joins that leave a side in place."""

import random

import pytest
from helpers import START_S, at, change, changes, dic, rows, text
from pyspark.sql import functions as F
from test_queries import SF

from millrace.functions.columns import first_of_pack, joined_packs, packed, rest_of_pack, unpacked
from millrace.operators import changelog, joins
from millrace.operators.changelog import latest_by_key
from millrace.operators.groups import busy_groups
from millrace.operators.joins import near_join
from millrace.plans import dwd
from millrace.queries import QUERIES
from millrace.sources.logs import change_log
from millrace.sources.topics import text_topic
from millrace.streaming.run import to_files

ODD = [None, "", "a", "\1", "\2", "\2n", "\2a", "\2b\1", "\1\2n\2", "é\n\"", "n", " "]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_any_text_comes_back_out_of_a_pack(spark):
    odd = spark.createDataFrame([(a, b, c) for a in ODD for b in ODD for c in ODD[:4]], "a string, b string, c string")
    pack = F.col("_pack")
    moved = odd.withColumn("_pack", packed("a", "b")).withColumn(
        "_pack", joined_packs(packed("c"), rest_of_pack(pack), packed(first_of_pack(pack))))
    assert unpacked(moved, "_pack", ["z", "y", "x"]).where(
        F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y")) & F.col("c").eqNullSafe(F.col("z"))).count() == odd.count()


def test_details_keep_odd_and_missing_texts(spark):
    log = changes(spark, [
        change("order_info", "insert", START_S, {"id": "o\1\2", "user_id": "\2n"}),
        change("order_detail", "insert", START_S, {"id": "\1d", "order_id": "o\1\2", "sku_name": "", "sku_num": "x"}),
        change("order_detail", "insert", START_S + 1, {"id": "\1d", "order_id": "o\1\2", "sku_name": "\2a", "sku_num": "2", "order_price": "1.5"}),
        change("order_detail", "insert", START_S + 2, {"order_id": "o\1\2", "sku_id": "7"}),
        change("order_detail", "insert", START_S + 3, {"id": "none"}),
        change("order_detail_activity", "insert", START_S, {"order_detail_id": "\1d", "activity_rule_id": "\1"}),
        change("order_detail_coupon", "insert", START_S, {"order_detail_id": "\1d", "coupon_id": "\2"})])
    got = dwd.order_details(log, "shop").select(
        "id", "order_id", "user_id", "province_id", "sku_id", "sku_name", "activity_id", "activity_rule_id", "coupon_id",
        "split_original_amount", "ts", "et")
    assert rows(got) == sorted([
        ("\1d", "o\1\2", "\2n", None, None, "\2a", None, "\1", "\2", "3.0000", START_S + 1, at(1).replace(tzinfo=None)),
        (None, "o\1\2", "\2n", None, "7", None, None, None, None, None, START_S + 2, at(2).replace(tzinfo=None))], key=repr)


def test_lines_meet_without_a_sort_before(spark):
    """The last revision of a line is found after the one shuffle by line, and its texts move as one."""
    plan = _plan(QUERIES["fact_order_detail"](spark, SF))
    assert "REPARTITION_BY_COL" in plan
    assert any("max(struct(ts, " in line and "_pack" in line for line in plan.splitlines())


def test_busy_keys_are_folded_before_they_meet(spark, monkeypatch):
    table = spark.createDataFrame([(k, t) for k in "abc" for t in range(50)], "k string, t long")
    monkeypatch.setattr(changelog, "busy_groups", lambda rows, key: busy_groups(rows, key, 10))
    last = latest_by_key(table.unionByName(spark.createDataFrame([("d", 1), ("d", 0)], "k string, t long")), ["k"], ["t"], whole=True)
    assert _plan(last).count("partial_max") == 2
    assert rows(last) == [("a", 49), ("b", 49), ("c", 49), ("d", 1)]


def _side(spark, name, times):
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(times)], f"k string, t double, {name} long").select(
        "k", name, F.timestamp_seconds(F.col("t") + START_S).alias("et"))


@pytest.mark.parametrize("near, many", [(2_000, 1_000), (20, 1_000), (20, 0)])
def test_near_join_gives_all_pairs(spark, monkeypatch, near, many):
    """Whether keys are quiet, busy or too many; a null key meets none."""
    monkeypatch.setattr(joins, "NEAR_ROWS", near)
    monkeypatch.setattr(joins, "MANY_GROUPS", many)
    rng = random.Random(5)
    edges = [("a", float(t)) for t in (0, 30, 36, 72, 66, 41, 5, -5, -30)] + [(None, 0.0)]
    left = _side(spark, "l", edges + [(rng.choice("aab") + rng.choice(["", "", "c"]), rng.randrange(-400, 400) / 2) for _ in range(80)])
    right = _side(spark, "r", edges + [(rng.choice("abc"), rng.randrange(-400, 400) / 2) for _ in range(200)])
    got = near_join(left, right, {"k": "k"}, 30, 5)
    want = left.alias("x").join(right.alias("y"), F.expr(
        "x.k = y.k and y.et between x.et - interval 30 seconds and x.et + interval 5 seconds")).select("x.k", "l", "x.et", "r")
    assert rows(got, "k", "l", "et", "r") == rows(want)


def test_paid_lines_are_not_moved_by_time(spark):
    """They lie with their order already; only payments come to them."""
    plan = _plan(QUERIES["fact_pay_interval"](spark, SF))
    assert "_slot" not in plan


def test_cancelled_lines_lie_with_their_order(spark):
    """They move by line and by order only, packed; the cancellation comes to them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moves = [line for line in _plan(QUERIES["fact_cancel_detail"](spark, SF)).splitlines() if "Exchange" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(moves) == 6  # lines twice; activities, coupons, orders, cancellations
    assert sum("REPARTITION_BY_COL" in line for line in moves) == 1


def test_refunds_of_unknown_codes_do_not_wait(spark, tmp_path):
    """State holds the refund that has names, not the one that has none; both wait for their order."""
    def refund(i, reason):
        data = {"id": i, "order_id": "o", "refund_status": "0702", "refund_type": "1", "refund_reason_type": reason, "refund_reason_txt": "\1"}
        return change("order_refund_info", "update", START_S, data, {"refund_status": "0701"})

    text(spark, [refund("a", "1"), refund("b", "9"), refund("c", None), change(
        "order_info", "update", START_S, {"id": "o", "order_status": "1005", "province_id": "3"}, {"order_status": "1002"})]).write.text(f"{tmp_path}/log")
    facts = dwd.refunds(change_log(text_topic(spark, f"{tmp_path}/log")), dic(spark, {"1": "one"}), "shop", 100)
    query = to_files(facts, "refunds", f"{tmp_path}/out", str(tmp_path))
    query.awaitTermination()
    got = spark.read.schema(facts.schema).parquet(f"{tmp_path}/out")
    assert rows(got, "id", "province_id", "refund_reason_type_name", "refund_reason_txt") == [("a", "3", "one", "\1")]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 2
