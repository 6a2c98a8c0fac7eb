"""First visits of streams: held by bucket, seen once by each batch."""

from helpers import START_S, rows
from pyspark.sql import functions as F

from millrace.operators.logs import first_visits
from millrace.sources.logs import page_log
from millrace.sources.topics import text_topic
from millrace.streaming import maintenance, stateful
from millrace.streaming.run import to_batches


def _messages(spark, path, firsts, devices=40):
    """Pages of devices, the first of them at a given second of the day by device."""
    spark.createDataFrame([(
        f'{{"common":{{"mid":"m{i % devices}","is_new":"{int(i < devices)}"}},"page":{{"page_id":"home"}},"ts":{(START_S + s) * 1000}}}',)
        for i, s in enumerate(firsts)], "value string").coalesce(1).write.mode("append").text(path)


def test_a_batch_goes_through_its_state_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 8)
    _messages(spark, f"{tmp_path}/log", [i + 86400 * (i >= 40) for i in range(120)])
    log = page_log(text_topic(spark, f"{tmp_path}/log"))
    write = maintenance.split_logs(f"{tmp_path}/parts", ["ts"])
    query = to_batches(maintenance.with_visits(log, ["ts"]), "visits", write, str(tmp_path))
    query.awaitTermination()
    first = [p for p in query.recentProgress if p["numInputRows"]][0]
    assert first["numInputRows"] == 2 * 120  # records and first visits
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    pages = spark.read.parquet(f"{tmp_path}/parts/page")
    assert pages.count() == 120 and pages.where("common.is_new = '1'").count() == 40


def test_state_begins_with_what_was_seen(spark, tmp_path, monkeypatch):
    """All devices of a bucket that were seen before, whether or not the first batch holds them."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    _messages(spark, f"{tmp_path}/old", range(40))
    _messages(spark, f"{tmp_path}/log", [100 - i for i in range(30)] + [50] * 10)
    seen = first_visits(page_log(text_topic(spark, f"{tmp_path}/old", streaming=False)), ["ts"]).where("mid < 'm2'")
    got = []
    query = to_batches(stateful.stream_first_visits(page_log(text_topic(spark, f"{tmp_path}/log")), ["ts"], seen), "seen",
                       lambda batch, n: got.extend(rows(batch.select("mid", (F.col("ts") / 1000 - START_S).cast("int"), "is_new"))), str(tmp_path))
    query.awaitTermination()
    want = {f"m{i}": i if f"m{i}" < "m2" else 100 - i if i < 30 else 50 for i in range(40)}
    assert sorted(got) == sorted((mid, s, "1") for mid, s in want.items())
