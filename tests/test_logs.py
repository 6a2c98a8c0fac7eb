import json

import pandas as pd
from helpers import START_S, at, rows, text
from pyspark.sql import functions as F

from millrace.functions.columns import json_row
from millrace.functions.keywords import explode_words, words
from millrace.operators.logs import clean_log, first_visits, repair_visitors, split_log
from millrace.operators.windows import window_sums
from millrace.plans import ads, dws
from millrace.sources.logs import page_log

MS = START_S * 1000
DAY = 86_400_000


def record(mid="m", is_new="1", ts=MS, **parts):
    return {"common": {"mid": mid, "uid": "u", "ch": "web", "is_new": is_new}, "ts": ts} | parts


def log(spark, *messages):
    return clean_log(page_log(text(spark, messages)))


def test_cleaning_needs_one_part(spark):
    assert log(spark, record(page={"page_id": "home"}), record(), record(start={"entry": "icon"}), "bad").count() == 2


def test_new_visitor_marks(spark):
    def fixed(*messages):
        out = repair_visitors(log(spark, *messages))
        return rows(out.select("common.mid", "ts", "common.is_new"))

    page = {"page": {"page_id": "home"}}
    assert fixed(record(ts=MS, **page), record(ts=MS + 1, **page), record(ts=MS + DAY, **page)) == [
        ("m", MS, "1"), ("m", MS + 1, "1"), ("m", MS + DAY, "0")]
    # A first record marked old puts the first visit on the day before.
    assert fixed(record(is_new="0", **page), record(ts=MS + 1, **page)) == [("m", MS, "0"), ("m", MS + 1, "0")]
    assert fixed(record("x", **page), record("y", ts=MS + DAY, **page)) == [("x", MS, "1"), ("y", MS + DAY, "1")]


def test_new_visitor_marks_with_earlier_batches(spark):
    page = {"page": {"page_id": "home"}}
    seen = first_visits(log(spark, record(**page)))
    out = repair_visitors(log(spark, record(ts=MS + DAY, **page), record("n", ts=MS + DAY, **page)), seen=seen)
    assert rows(out.select("common.mid", "common.is_new")) == [("m", "0"), ("n", "1")]


def test_split_to_five_outputs(spark):
    message = record(page={"page_id": "home"}, start={"entry": "icon"}, err={"code": "500"},
                     displays=[{"item": "1", "ch": "inner"}, {"item": "2"}], actions=[{"action_id": "like"}])
    parts = split_log(log(spark, message))
    assert {n: p.count() for n, p in parts.items()} == {"start": 1, "display": 2, "action": 1, "err": 1, "page": 1}
    shown = parts["display"].orderBy(F.col("row")["item"]).first().row
    assert shown == {"item": "1", "ch": "web", "mid": "m", "uid": "u", "is_new": "1", "ts": str(MS)}
    assert {"displays", "actions", "err"} <= set(parts["start"].columns)
    assert "displays" not in parts["err"].columns and "err" in parts["err"].columns
    assert not {"displays", "actions", "err"} & set(parts["page"].columns) and "start" in parts["page"].columns


def test_window_edges_and_stamps(spark):
    df = spark.createDataFrame([(at(0), 1), (at(4.999), 2), (at(5), 4)], "et timestamp, n int")
    assert rows(window_sums(df, {"n": "n"})) == [
        ("2024-01-01 00:00:00", "2024-01-01 00:00:05", "2024-01-01", 3),
        ("2024-01-01 00:00:05", "2024-01-01 00:00:10", "2024-01-01", 4)]


def test_words(spark):
    df = spark.createDataFrame([("Red shoe, red!",), ("  ",), (None,), ("Été 2024 鞋子",)], "t string")
    assert rows(explode_words(df, "t")) == [("2024",), ("red",), ("shoe",), ("été",), ("鞋子",)]
    assert rows(df.select(F.size(words(F.col("t"))))) == [(0,), (2,), (3,), (None,)]


def test_a_pandas_splitter_takes_the_place_of_the_built_in_one(spark):
    @F.pandas_udf("array<string>")
    def pairs(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted({t[i:i + 2] for i in range(len(t) - 1)}))

    df = spark.createDataFrame([("红鞋子",)], "t string")
    assert rows(explode_words(df, "t", splitter=pairs)) == [("红鞋",), ("鞋子",)]


def test_keyword_counts_select_searches(spark):
    def search(last, kind, item, ts=MS):
        return record(ts=ts, page={"last_page_id": last, "item_type": kind, "item": item})

    out = dws.keyword_counts(log(
        spark, search("home", "keyword", "red shoe"), search("search", "keyword", "red"), search("list", "keyword", "red"),
        search("home", "sku_id", "red"), search("home", "keyword", None), search("home", "keyword", "red", MS + 5000)))
    assert rows(out, "stt", "keyword", "keyword_count") == [
        ("2024-01-01 00:00:00", "red", 2), ("2024-01-01 00:00:00", "shoe", 1), ("2024-01-01 00:00:05", "red", 1)]


def test_page_views_take_missing_time_as_zero(spark):
    messages = [record(ts=MS + i, page={"page_id": "home", "during_time": t}) for i, t in enumerate((5, None))]
    assert rows(dws.page_views(log(spark, *messages)), "uv_ct", "sv_ct", "pv_ct", "dur_sum") == [(1, 1, 2, 5)]


def test_logins_show_windows_without_a_first_login(spark):
    messages = [record(ts=MS + t, page={"page_id": "home"}) for t in (0, 1, 5000)]
    messages.append(record(ts=MS + 10_000, page={"page_id": "x", "last_page_id": "home"}))
    assert rows(dws.logins(log(spark, *messages)), "stt", "uu_ct", "back_ct") == [
        ("2024-01-01 00:00:00", 1, 0), ("2024-01-01 00:00:05", 0, 0)]


def test_registrations_read_text_times(spark):
    users = spark.createDataFrame([("2024-01-01 00:00:01",), ("2024-01-01 00:00:04",), ("soon",)], "create_time string")
    assert rows(dws.registrations(users), "stt", "register_ct") == [("2024-01-01 00:00:00", 2)]


def test_gmv_report(spark):
    totals = spark.createDataFrame([("2024-01-01", "3.70"), ("2024-01-01", "1.20"), ("2024-01-02", "9")],
                                   "cur_date string, amount string").select(
        "cur_date", F.col("amount").cast("decimal(16,2)").alias("order_amount"))
    assert str(ads.gmv(totals, "2024-01-01").first()[0]) == "4.90"
    answer = ads.gmv_response(ads.gmv(totals, "2024-01-01")).first().response
    assert json.loads(answer) == {"status": 0, "msg": "", "data": 4}
    assert json.loads(ads.gmv_response(ads.gmv(totals)).first().response)["data"] == 0


def test_json_rows_use_snake_names_and_leave_nulls_out(spark):
    df = spark.createDataFrame([("1", None, 5)], "orderId string, skuId string, ts int")
    assert rows(json_row(df, drop=["ts"])) == [('{"order_id":"1"}',)]
