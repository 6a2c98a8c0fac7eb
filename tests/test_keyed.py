"""First-time flags, changes and joins against plain Python on small inputs."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from helpers import at, rows, timed
from pyspark.sql import functions as F

from millrace.operators.deltas import busy_groups, deltas
from millrace.operators.enrich import enrich
from millrace.operators.flags import daily_and_new, first_of_day, first_seen, returning
from millrace.operators.joins import interval_join, keyed_join


def test_first_of_day(spark):
    df = timed(spark, [("a", at(1), 1), ("a", at(2), 2), ("a", at(3, 1), 3), ("a", at(4, 2), 4), ("b", at(86399), 5),
                       ("b", at(0, 1), 6)])
    assert rows(first_of_day(df, ["key"], ["et", "id"]), "key", "day", "id") == [
        ("a", "2024-01-01", 1), ("a", "2024-01-02", 3), ("a", "2024-01-03", 4), ("b", "2024-01-01", 5),
        ("b", "2024-01-02", 6)]
    assert rows(first_seen(df, ["key"], ["et", "id"]), "key", "id") == [("a", 1), ("b", 5)]
    assert rows(daily_and_new(df, ["key"]), "key", "day", "is_unique", "is_new") == [
        ("a", "2024-01-01", 1, 1), ("a", "2024-01-02", 1, 0), ("a", "2024-01-03", 1, 0),
        ("b", "2024-01-01", 1, 1), ("b", "2024-01-02", 1, 0)]


def test_returning_counts_from_midnight_of_the_last_day(spark):
    exactly, later = at(0, 7), at(0.001, 7)
    df = timed(spark, [("exact", at(50), 1), ("exact", exactly, 2), ("later", at(50), 3), ("later", later, 4),
                       ("new", at(5, 20), 5)])
    assert rows(returning(df, ["key"], 7), "key", "day", "is_back") == [
        ("exact", "2024-01-01", 0), ("exact", "2024-01-08", 0), ("later", "2024-01-01", 0), ("later", "2024-01-08", 1),
        ("new", "2024-01-21", 0)]


def _random_events(seed, n=400):
    rng = random.Random(seed)
    # One key holds about a third of the rows.
    return [(rng.choice("aaabcdefg"), at(rng.randrange(5 * 86400)), i) for i in range(n)]


def test_first_of_day_against_a_scan_in_time_order(spark):
    events = _random_events(1)
    last, want = {}, []
    for key, et, i in sorted(events, key=lambda e: (e[1], e[2])):
        if last.get(key) != et.date():
            want.append((key, i))
        last[key] = et.date()
    got = rows(first_of_day(timed(spark, events), ["key"], ["et", "id"]), "key", "id")
    assert got == sorted(want, key=repr)


def _amounts(spark, revisions):
    return spark.createDataFrame([(k, t, tag, Decimal(a)) for k, t, tag, a in revisions],
                                 "id string, et timestamp, tag string, amount decimal(16,2)")


REVISIONS = [("one", at(0), "p", "5"), ("two", at(0), "q", "5"), ("two", at(2), "r", "8"),
             ("three", at(0), "s", "5"), ("three", at(4), "t", "5"), ("three", at(9.5), "u", "1")]


def test_changes_of_amounts(spark):
    df = _amounts(spark, REVISIONS)
    assert rows(deltas(df, ["id"], ["et"], ["amount"]).select("tag", F.col("amount").cast("int"))) == [
        ("p", 5), ("q", 5), ("r", 3), ("s", 5), ("t", 0), ("u", -4)]
    assert rows(deltas(df, ["id"], ["et"], ["amount"], attributes="previous").select(
        "tag", F.col("amount").cast("int"))) == [("p", 5), ("q", 3), ("q", 5), ("s", 0), ("s", 5), ("t", -4)]
    assert rows(deltas(df, ["id"], ["et"], ["amount"], idle=("et", "5 seconds")).select(
        "tag", F.col("amount").cast("int")))[-1] == ("u", 1)
    assert deltas(df, ["id"], ["et"], ["amount"]).schema == df.schema


@pytest.mark.parametrize("attributes", ["current", "previous"])
@pytest.mark.parametrize("idle", [None, ("et", "3 hours")])
def test_keys_are_cut_in_parts_with_the_same_result(spark, attributes, idle):
    rng = random.Random(2)
    times = rng.sample(range(9 * 86400), 600)
    data = [(rng.choice(["hot", "hot", "hot", "warm", *"abcdefgh"]), at(t), str(i), str(rng.randrange(1000)))
            for i, t in enumerate(times)]
    df = _amounts(spark, data)
    whole = deltas(df, ["id"], ["et"], ["amount"], F.lit(0), attributes, idle)
    for coarse in (None, F.to_date("et")):
        cut = deltas(df, ["id"], ["et"], ["amount"], coarse, attributes, idle)
        assert rows(cut) == rows(whole) and len(rows(whole)) == 600


def test_any_number_of_busy_keys(spark):
    """3,000 keys with many revisions each: changes add up to the last amounts."""
    df = spark.range(60_000).select(
        (F.col("id") % 3000).cast("string").alias("id"), F.timestamp_seconds(F.col("id") * 7).alias("et"),
        (F.xxhash64("id") % 1000).cast("decimal(16,2)").alias("amount"))
    sums = deltas(df, ["id"], ["et"], ["amount"]).groupBy("id").agg(F.sum("amount").alias("amount"))
    last = df.groupBy("id").agg(F.max_by("amount", "et").alias("amount"))
    assert sums.exceptAll(last).isEmpty() and sums.count() == 3000


def test_missing_amounts_count_as_nothing(spark):
    df = spark.createDataFrame([("a", at(0), None), ("a", at(1), 5), ("a", at(5000), 8), ("b", at(0), 4), ("b", at(9), None)],
                               "id string, et timestamp, amount int")
    sums = deltas(df, ["id"], ["et"], ["amount"]).groupBy("id").agg(F.sum("amount"))
    assert rows(sums) == [("a", 8), ("b", 0)]


def test_changes_read_their_input_once(spark, tmp_path):
    spark.range(100).select(F.col("id"), F.timestamp_seconds("id").alias("et"), F.lit(1).alias("amount")).write.parquet(f"{tmp_path}/t")
    changed = deltas(spark.read.parquet(f"{tmp_path}/t"), ["id"], ["et"], ["amount"])
    changed.collect()
    plan = changed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") - plan.count("ReusedExchange") <= 1


def test_interval_join_edges(spark):
    left = spark.createDataFrame([("o", at(3600), "pay")], "k string, et timestamp, l string")
    times = {"low": 1800, "too early": 1800 - 0.001, "high": 3605, "too late": 3605.001, "same": 3600}
    right = spark.createDataFrame([("o", at(s), n) for n, s in times.items()] + [("x", at(3600), "other")],
                                  "k string, et timestamp, r string")
    out = interval_join(left, right, {"k": "k"}, 1800, 5)
    assert rows(out, "r") == [("high",), ("low",), ("same",)]
    assert out.columns == ["k", "et", "l", "r"]


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(3)
    left = [(rng.choice("aaab"), at(rng.randrange(20000)), f"l{i}") for i in range(150)]
    right = [(rng.choice("aaac"), at(rng.randrange(-2000, 20000)), f"r{i}") for i in range(150)]
    want = sorted(((a[2], b[2]) for a in left for b in right if a[0] == b[0]
                   and a[1] - dt.timedelta(seconds=90) <= b[1] <= a[1] + dt.timedelta(seconds=7)), key=repr)
    out = interval_join(spark.createDataFrame(left, "k string, et timestamp, l string"),
                        spark.createDataFrame(right, "k string, et timestamp, r string"), {"k": "k"}, 90, 7)
    assert rows(out, "l", "r") == want and want


def test_keyed_join_with_and_without_ttl(spark):
    left = spark.createDataFrame([(1, at(0), "a"), (2, at(0), "b"), (3, at(0), "c"), (None, at(0), "d")],
                                 "k int, et timestamp, l string")
    right = spark.createDataFrame([(1, at(5), "x"), (2, at(5.001), "y"), (None, at(0), "z")], "k int, et timestamp, r string")
    assert rows(keyed_join(left, right, {"k": "k"}), "l", "r") == [("a", "x"), ("b", "y")]
    assert rows(keyed_join(left, right, {"k": "k"}, "left", 5), "l", "r") == [
        ("a", "x"), ("b", None), ("c", None), ("d", None)]


def test_chain_with_broken_links(spark):
    facts = spark.createDataFrame([("f1", "s1"), ("f2", "s2"), ("f3", "gone"), ("f4", None)], "f string, sku_id string")
    sku = spark.createDataFrame([("s1", "c1"), ("s2", "lost")], "id string, cat string")
    cat = spark.createDataFrame([("c1", "shoes")], "id string, name string")
    out = enrich(facts, (sku, "sku_id", "id", {"cat": "category_id"}), (cat, "category_id", "id", {"name": "category"}))
    assert rows(out, "f", "category_id", "category") == [
        ("f1", "c1", "shoes"), ("f2", "lost", None), ("f3", None, None), ("f4", None, None)]


def test_amount_changes_of_quiet_keys_take_one_shuffle(spark):
    """Only keys of busy groups are cut into parts; the rows are the same either way, and with some keys of each kind."""
    events = [("ab"[i % 3 > 0], at(i * 997.0), i, Decimal(i * 7 % 11)) for i in range(60)]
    df = timed(spark, events, "id string, et timestamp, tag int, amount decimal(16,2)")
    quiet = deltas(df, ["id"], ["et", "tag"], ["amount"], busy=[])
    assert quiet._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    some = busy_groups(df, ["id"], 30)
    assert len(some) == 1 and busy_groups(df, ["id"]) == [] and len(busy_groups(df, ["id"], 0)) == 2
    want = rows(quiet)
    assert rows(deltas(df, ["id"], ["et", "tag"], ["amount"])) == want
    for busy in (some, busy_groups(df, ["id"], 0)):
        assert rows(deltas(df, ["id"], ["et", "tag"], ["amount"], busy=busy)) == want
