"""Interval joins that repeat the side that is smaller."""

import glob
import random

import pytest
from helpers import START_S, rows
from pyspark.sql import functions as F
from test_queries import SF

from millrace.operators.joins import SLOT_INTERVALS, interval_join
from millrace.queries import QUERIES
from millrace.session import prepare


def _side(spark, name, times):
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(times)], f"k string, t double, {name} long").select(
        "k", name, F.timestamp_seconds(F.col("t") + START_S).alias("et"))


def test_either_side_may_be_spread(spark):
    """The rows are the same, edges of the interval and of slots included, and the other side is not repeated."""
    rng = random.Random(4)
    edges = [("a", float(t)) for t in (0, 30, 36, 72, 66, 41, 5, -5, -30)]
    left = _side(spark, "l", edges + [(rng.choice("ab"), rng.randrange(-400, 400) / 2) for _ in range(200)])
    right = _side(spark, "r", edges + [(rng.choice("ab"), rng.randrange(-400, 400) / 2) for _ in range(200)])
    got = interval_join(left, right, {"k": "k"}, 30, 5, spread="left")
    want = left.alias("x").join(right.alias("y"), F.expr(
        "x.k = y.k and y.et between x.et - interval 30 seconds and x.et + interval 5 seconds")).select("x.k", "l", "x.et", "r")
    assert rows(got, "k", "l", "et", "r") == rows(want) == rows(interval_join(left, right, {"k": "k"}, 30, 5), "k", "l", "et", "r")
    with pytest.raises(ValueError):
        interval_join(left, right, {"k": "k"}, 30, 5, "left", spread="left")


def test_topics_of_details_are_compressed(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/topic-*/*"))
    found = QUERIES["topic_order_details"](spark, SF)
    assert found.count() > 0
    files = [f for f in set(glob.glob(f"{folder}/topic-*/*")) - before if "_SUCCESS" not in f]
    assert files and all(f.endswith(".json.gz") for f in files)


def test_few_rows_are_repeated_for_time_slots(spark):
    """Of rows spread evenly over time about a quarter lie in reach of two slots; a copy of a row is state of a stream."""
    right = _side(spark, "r", [("a", float(t)) for t in range(4000)])
    left = right.withColumnRenamed("r", "l")
    plan = interval_join(left, right, {"k": "k"}, 30, 5)
    repeated = right.withColumn("slots", F.size(F.sequence(*[
        F.floor(F.unix_micros(F.col("et") + F.expr(f"interval {s} seconds")) / F.lit(SLOT_INTERVALS * 36_000_000)) for s in (-5, 30)])))
    assert 4000 < repeated.agg(F.sum("slots")).first()[0] <= 1.3 * 4000
    assert plan.where("l = r").count() == 4000


def test_state_files_are_packed(spark):
    assert prepare(spark).conf.get("spark.sql.streaming.stateStore.rocksdb.compression") == "zstd"


def test_days_are_stored_in_few_files(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/sku-amounts-*/*/*.parquet"))
    assert QUERIES["gmv_of_day"](spark, SF).count() == 1
    files = set(glob.glob(f"{folder}/sku-amounts-*/*/*.parquet")) - before
    assert files and len(files) <= 1.1 * len({f.rsplit("/", 2)[1] for f in files})


def test_rows_for_a_few_folders_are_not_sorted(spark):
    assert prepare(spark).conf.get("spark.sql.maxConcurrentOutputFileWriters") == "32"


def test_shuffles_of_staged_tables_are_deleted(spark):
    """Their files go with the statement that writes the table; the session's own choice stays as it is."""
    from millrace.session import FREE_SHUFFLES, staged

    def shuffles():
        return sum(1 for _ in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()))

    before, kept = spark.conf.get(FREE_SHUFFLES), shuffles()
    table = staged(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    assert table.count() == 7 and spark.conf.get(FREE_SHUFFLES) == before
    staged(table.groupBy("count").agg(F.max("k").alias("k")), "freed")
    assert shuffles() <= kept + 1  # that of the count above
