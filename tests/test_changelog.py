import glob
import os
import random

from test_queries import SF
from helpers import START_S, change, changes, dic, rows, text
from pyspark.sql import functions as F

from millrace.functions.columns import camel, money, snake, text_day
from millrace.operators.changelog import clean, latest_by_key, merge_cells
from millrace.plans import dwd
from millrace.plans.dim import dimension, dimension_rows, routed_facts
from millrace.operators.routing import live_routes
from millrace.sources.logs import route_changes
from millrace.sources.topics import parse_json
from millrace import schemas


def test_cleaning_keeps_complete_changes_of_the_database(spark):
    good = [change("t", kind, 5, {"id": kind}) for kind in ("insert", "update", "delete", "bootstrap-insert")]
    bad = [
        "not json", "", "[1]", "12",
        change("t", "insert", 5, {"id": "x"}, database="other"),
        change("t", "bootstrap-start", 5, {"id": "x"}),
        change("t", "insert", 5, {}),
        change("t", "insert", None, {"id": "x"}),
        {"database": "shop", "type": "insert", "ts": 5, "data": {"id": "x"}},
        {"database": "shop", "table": "t", "type": "insert", "ts": 5},
    ]
    log = clean(changes(spark, good + bad), "shop")
    assert rows(log.select(F.col("data")["id"])) == [("bootstrap-insert",), ("delete",), ("insert",), ("update",)]


def test_event_time_is_in_seconds(spark):
    log = changes(spark, [change("t", "insert", START_S, {"id": "1"})])
    assert rows(log.select(F.date_format("et", "yyyy-MM-dd HH:mm:ss"))) == [("2024-01-01 00:00:00",)]


def test_last_row_per_key_with_deletes(spark):
    log = spark.createDataFrame([
        ("a", 1, "insert", "x"), ("a", 2, "update", "y"),
        ("b", 1, "insert", "x"), ("b", 2, "delete", "x"),
        ("c", 1, "insert", "x"), ("c", 2, "delete", "x"), ("c", 3, "insert", "z"),
        ("d", 1, None, "n"),
    ], "key string, ts int, op string, v string")
    assert rows(latest_by_key(log, ["key"], ["ts"], "op"), "key", "v") == [("a", "y"), ("c", "z"), ("d", "n")]
    with_map = log.withColumn("m", F.create_map(F.lit("v"), F.col("v")))
    assert rows(latest_by_key(with_map, ["key"], ["ts"], "op").select("key", F.col("m")["v"])) == [
        ("a", "y"), ("c", "z"), ("d", "n")]


def test_cells_put_skips_nulls_and_delete_clears(spark):
    log = spark.createDataFrame([
        ("a", 1, "insert", {"x": "1", "y": "1"}), ("a", 2, "update", {"x": "2", "y": None}),
        ("b", 1, "insert", {"x": "1", "y": "1"}), ("b", 2, "delete", {"x": "1"}), ("b", 3, "insert", {"y": "3"}),
        ("c", 1, "insert", {"x": "1"}), ("c", 2, "delete", {}),
        ("d", 1, "truncate", {"x": "1"}),
        ("e", 1, "insert", {"old": "1", "x": "1"}), ("e", 2, "delete", {"x": "1"}),  # a column that is no longer named
    ], "key string, ts int, op string, row map<string,string>")
    out = merge_cells(log, ["key"], ["ts"], "op", "row")
    assert {r.key: r.row for r in out.collect()} == {"a": {"x": "2", "y": "1"}, "b": {"y": "3"}}


def _route(table, kind="ALL", sink="sink", sink_type="dim", columns="id,name"):
    return {"source_table": table, "source_type": kind, "sink_table": sink, "sink_type": sink_type,
            "sink_family": "info", "sink_columns": columns, "sink_row_key": "id"}


def _routes(spark, steps, preload=None):
    log = route_changes(text(spark, [
        {"op": op, "before": before, "after": after, "ts_ms": i} for i, (op, before, after) in enumerate(steps)]))
    known = spark.createDataFrame(preload, schemas.ROUTE) if preload else None
    return live_routes(log, preload=known)


def test_routes_in_force(spark):
    live = _routes(spark, [
        ("r", None, _route("a", sink="old")), ("u", _route("a", sink="old"), _route("a", sink="new")),
        ("c", None, _route("b")), ("d", _route("b"), None),
        ("c", None, _route("c")), ("u", _route("c"), _route("moved")),
        ("d", _route("preloaded_gone"), None),
    ], [_route("preloaded"), _route("preloaded_gone"), _route("a", sink="preloaded")])
    assert rows(live, "source_table", "sink_table") == [("a", "new"), ("moved", "sink"), ("preloaded", "sink")]


def test_dimensions_follow_puts_and_deletes(spark):
    routes = _routes(spark, [("r", None, _route("user", sink="dim_user")),
                             ("r", None, _route("fact", "insert", "topic", "dwd"))])
    log = changes(spark, [
        change("user", "bootstrap-insert", 1, {"id": "1", "name": "n1", "secret": "s"}),
        change("user", "update", 2, {"id": "1", "name": "n2"}, {"name": "n1"}),
        change("user", "insert", 1, {"id": "2", "name": "gone"}),
        change("user", "delete", 3, {"id": "2", "name": "gone"}),
        change("other", "insert", 1, {"id": "9"}),
    ])
    state = dimension_rows(log, routes, "shop")
    assert rows(dimension(state, "dim_user", ["id", "name", "secret"])) == [("1", "n2", None)]


def test_facts_are_routed_by_table_and_operation(spark):
    routes = _routes(spark, [("r", None, _route("fact", "insert", "topic_new", "dwd")),
                             ("r", None, _route("fact", "update", "topic_changed", "dwd", "id"))])
    log = changes(spark, [
        change("fact", "bootstrap-insert", 1, {"id": "1", "name": "a", "more": "x"}),
        change("fact", "update", 1, {"id": "2", "name": "b"}, {"name": "a"}),
        change("fact", "delete", 1, {"id": "3", "name": "c"}),
    ])
    out = {r.sink_table: r.row for r in routed_facts(log, routes, "shop").collect()}
    assert out == {"topic_new": {"id": "1", "name": "a", "op_type": "insert"},
                   "topic_changed": {"id": "2", "op_type": "update"}}


def test_cart_adds_count_growth_of_cart_rows_only(spark):
    log = changes(spark, [
        change("cart_info", "insert", 1, {"id": "1", "user_id": "u", "sku_id": "s", "sku_num": "2"}),
        change("cart_info", "update", 1, {"id": "2", "user_id": "u", "sku_id": "s", "sku_num": "5"}, {"sku_num": "3"}),
        change("cart_info", "update", 1, {"id": "3", "user_id": "u", "sku_id": "s", "sku_num": "1"}, {"sku_num": "3"}),
        change("cart_info", "update", 1, {"id": "4", "user_id": "u", "sku_id": "s", "sku_num": "9"}, {"is_checked": "1"}),
        change("cart_info", "update", 1, {"id": "5", "user_id": "u", "sku_id": "s", "sku_num": "many"}, {"sku_num": "3"}),
        change("order_detail", "update", 1, {"id": "6", "sku_num": "9"}, {"sku_num": "3"}),
        change("cart_info", "update", 1, {"id": "7", "sku_num": "9"}, {"sku_num": "3"}, database="other"),
    ])
    assert rows(dwd.cart_adds(log, "shop"), "id", "sku_num") == [("1", "2"), ("2", "2")]


def test_comments_keep_unknown_codes(spark):
    log = changes(spark, [
        change("comment_info", "insert", 1, {"id": "1", "appraise": "1201", "comment_txt": "t"}),
        change("comment_info", "insert", 1, {"id": "2", "appraise": "9"}),
        change("comment_info", "update", 1, {"id": "3", "appraise": "1201"}, {"appraise": "9"}),
    ])
    out = dwd.comments(log, dic(spark, {"1201": "good"}), "shop")
    assert rows(out, "id", "appraise_name") == [("1", "good"), ("2", None)]


def test_refunds_need_any_status_change_and_both_names(spark):
    refund = {"id": "r", "order_id": "o", "sku_id": "s", "refund_type": "1501", "refund_reason_type": "1301",
              "refund_status": "0702", "operate_time": "2024-01-01 10:00:00"}
    log = changes(spark, [
        change("order_refund_info", "update", 1, refund, {"refund_status": "0701"}),
        change("order_refund_info", "update", 1, refund | {"id": "same"}, {"refund_num": "1"}),
        change("order_refund_info", "update", 1, refund | {"id": "unnamed", "refund_type": "0"}, {"refund_status": "x"}),
        change("order_info", "update", 1, {"id": "o", "province_id": "p", "order_status": "1005"}, {"order_status": "1002"}),
    ])
    out = dwd.refunds(log, dic(spark, {"1501": "goods", "1301": "late"}), "shop")
    assert rows(out, "id", "refund_type_name", "refund_reason_type_name", "province_id", "date_id") == [
        ("r", "goods", "late", "p", "2024-01-01")]


def test_text_that_is_no_number_or_date_becomes_null(spark):
    one = spark.createDataFrame([("12.345", "2024-02-03 04:05:06"), ("x", "y")], "n string, t string")
    assert rows(one.select(money("n").cast("string"), text_day(F.col("t")))) == [("12.35", "2024-02-03"), (None, None)]


def test_names():
    assert snake("orderDetailId") == "order_detail_id" and camel("sink_row_key") == "sinkRowKey"
    assert snake("category3Name") == "category3_name"


def test_bad_json_is_dropped_and_other_columns_are_kept(spark):
    raw = spark.createDataFrame([(1, '{"ts": 5}'), (2, "{"), (3, None), (4, "{}")], "n int, value string")
    out = parse_json(raw, schemas.CHANGE_ENVELOPE, keep=["n"])
    assert rows(out, "n", "ts") == [(1, 5), (4, None)]


def test_dimension_rows_of_quiet_keys_move_whole_and_once(spark):
    """One shuffle, of changes and not of cells; keys of busy groups are folded cell by cell to the same rows."""
    from millrace.operators import changelog

    rng = random.Random(8)
    changes = [(rng.choice("abcdefgh"), i, rng.choice(["insert", "update", "update", "delete", "other"]),
                {c: rng.choice(["x", "y", None]) for c in rng.sample("pqrs", rng.randrange(4))}) for i in range(200)]
    changes += [("z", 1, "update", {"p": None}), ("y", 1, "update", {"p": "1"}), ("y", 2, "delete", {})]
    df = spark.createDataFrame(changes, "id string, n long, op string, row map<string,string>")
    merged = changelog.merge_cells(df, ["id"], ["n"], "op", "row")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    want = {}
    for key, _, op, row in sorted(changes, key=lambda c: c[1]):
        if op == "delete":
            want.pop(key, None)
        elif op != "other":
            want.setdefault(key, {}).update({c: x for c, x in row.items() if x is not None})
    want = {k: r for k, r in want.items() if r}
    assert {r["id"]: r["row"] for r in merged.collect()} == want
    parts = changelog._merged_by_cell(df, ["id"], ["n"], "op", "row")
    assert {r["id"]: r["row"] for r in parts.collect()} == want


def test_routes_read_only_the_tables_they_name(spark):
    from millrace.queries import QUERIES

    plan = QUERIES["dim_maintenance"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" in plan and "l_orderkey" not in plan and "event_id" not in plan


def test_a_fold_keeps_whole_changes(spark):
    """A put that nothing overrides stays one row; folded and later changes merge to what all changes do, busy groups too."""
    from millrace.operators import changelog

    rng = random.Random(9)
    changes = [(rng.choice("abcdefgh"), i, rng.choice(["insert", "update", "update", "delete", "other"]),
                {c: rng.choice(["x", "y", None]) for c in rng.sample("pqrs", rng.randrange(4))}, i) for i in range(200)]
    changes += [("z", 1, "insert", {"p": "1", "q": "1", "r": "1"}, 1), ("z", 2, "update", {"q": "2"}, 1), ("y", 1, "delete", {}, 1)]
    rng.shuffle(changes)
    shape = "id string, n long, op string, row map<string,string>, more int"
    first, later = spark.createDataFrame(changes[:150], shape), spark.createDataFrame(changes[150:], shape)
    want = rows(changelog.merge_cells(first.unionByName(later), ["id"], ["n"], "op", "row").select("id", F.to_json("row")))
    folded = changelog.last_cells(first, ["id"], ["n"], "op", "row")
    assert rows(changelog.merge_cells(folded.unionByName(later), ["id"], ["n"], "op", "row").select("id", F.to_json("row"))) == want
    alone = changelog.last_cells(spark.createDataFrame(changes, shape).where("id in ('y', 'z')"), ["id"], ["n"], "op", "row")
    assert rows(alone, "id", "n", "op", F.to_json("row"), "more") == [
        ("y", 1, "delete", "{}", None), ("z", 1, "update", '{"p":"1","r":"1"}', None), ("z", 2, "update", '{"q":"2"}', None)]
    counted, changelog.busy_groups = changelog.busy_groups, lambda df, key: counted(df, key, 0)
    try:
        cells = changelog.last_cells(first, ["id"], ["n"], "op", "row")
    finally:
        changelog.busy_groups = counted
    assert rows(changelog.merge_cells(cells.unionByName(later), ["id"], ["n"], "op", "row").select("id", F.to_json("row"))) == want


def test_a_batch_of_a_large_replay_has_several_files(spark, tmp_path):
    from millrace.queries.streams import replay_in_files

    given = spark.range(4000).select("id", (F.timestamp_seconds(F.col("id"))).alias("at"))
    given.repartition(8).write.parquet(f"{tmp_path}/given.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # a task for every file or two
    try:
        tasks = spark.read.parquet(f"{tmp_path}/given.parquet").rdd.getNumPartitions()
        before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/files-*"))
        replay_in_files(spark, str(tmp_path), "given", "at", [{"id": -1}])
        [folder] = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/files-*")) - before
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    files = sorted(glob.glob(f"{folder}/*.parquet"), key=os.path.getmtime)
    assert tasks > 1 and len(files) == 4 * tasks + 1
    assert sorted(r["id"] for r in spark.read.parquet(folder).collect()) == [-1, *range(4000)]
