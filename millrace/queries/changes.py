"""Change-log, routing and dimension queries."""

from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions.columns import camel, json_row, rename_columns
from millrace.operators.changelog import (
    clean, fields, grew, latest_by_key, merge_cells, moved, of_table, reached, with_op_type,
)
from millrace.operators.routing import route
from millrace.plans.dim import dimension, dimension_rows, routed_facts, routes_in_force
from millrace.queries import views as v
from millrace.queries.registry import query, with_views
from millrace.sources.logs import change_log, route_changes
from millrace.sources.topics import literal, parse_json


def raw_topic(spark, sf_dir):
    """A topic with good and bad messages, one per event."""
    ev = v.events(spark, sf_dir)
    kind = F.col("event_type")
    good = F.struct(
        F.when(F.col("user_id") % 7 == 0, "other").otherwise(v.DATABASE).alias("database"),
        F.lit("user_info").alias("table"),
        F.when(kind == "purchase", "bootstrap-insert").when(kind == "signup", "bootstrap-start")
        .when(kind == "view", "delete").otherwise("insert").alias("type"),
        F.when(F.col("k") != 0, v.row_map(id=F.col("event_id").cast("string")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("data"),
        F.when(F.col("k") != 1, F.floor(F.col("ts") / 1000)).alias("ts"))
    text = F.when(kind == "error", F.concat(F.lit("no json "), F.col("event_id").cast("string"))).otherwise(
        F.to_json(good))
    return ev.select(text.alias("value"))


@query("cdc_clean", with_views(v.EVENTS_SQL, select="""
  select 'user_info' as table_name, cast(event_id as varchar) as id, ts_ms // 1000 as ts,
         case event_type when 'purchase' then 'bootstrap-insert' when 'view' then 'delete' else 'insert' end as type
  from ev where event_type not in ('error', 'signup') and user_id % 7 <> 0 and k not in (0, 1)"""))
def cdc_clean(spark, sf_dir):
    rows = clean(change_log(raw_topic(spark, sf_dir)), v.DATABASE)
    return rows.select(F.col("table").alias("table_name"), *fields("id"), "ts", "type")


@query("cdc_by_table", """
  select cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as user_id,
         cast(epoch(o_orderdate) as bigint) as ts from orders""")
def cdc_by_table(spark, sf_dir):
    return of_table(v.change_log(spark, sf_dir), v.DATABASE, "order_info", "insert").select(
        *fields("id", "user_id"), "ts")


@query("cdc_transition", """
  select cast(o_orderkey as varchar) as id, strftime(o_orderdate + interval '10 minutes', '%Y-%m-%d %H:%M:%S') as at,
         'cancelled' as step from orders where o_orderstatus = 'F'
  union all
  select cast(o_orderkey as varchar), strftime(o_orderdate + interval '20 minutes', '%Y-%m-%d %H:%M:%S'), 'refunding'
  from orders where o_orderstatus = 'P'""")
def cdc_transition(spark, sf_dir):
    rows = of_table(v.change_log(spark, sf_dir), v.DATABASE, "order_info", "update")
    step = (F.when(moved("order_status", "1001", "1003"), "cancelled")
            .when(reached("order_status", "1005"), "refunding"))
    return rows.select(*fields("id", at="operate_time"), step.alias("step")).where(F.col("step").isNotNull())


@query("cdc_quantity_grew", with_views(v.EVENTS_SQL, select="""
  select cast(event_id as varchar) as id, k as before, cast(floor(value) as int) as after
  from ev where event_type = 'purchase' and floor(value) > k"""))
def cdc_quantity_grew(spark, sf_dir):
    rows = of_table(v.cart_changes(spark, sf_dir), v.DATABASE, "cart_info", "update").where(grew("sku_num"))
    return rows.select(*fields("id"), F.col("old")["sku_num"].cast("int").alias("before"),
                       F.col("data")["sku_num"].cast("int").alias("after"))


@query("cdc_latest_by_key", with_views(v.LINES_SQL, select=f"""
  select id, sku_id, flag, cast(price as decimal(18,2)) as price, ts from line qualify {v.LATEST_SQL}"""))
def cdc_latest_by_key(spark, sf_dir):
    rows = v.lines(spark, sf_dir).select("id", "sku_id", "flag", "price", "ts", "seq")
    return latest_by_key(rows, ["id"], ["ts", "seq"]).select(
        "id", "sku_id", "flag", F.col("price").cast("decimal(18,2)").alias("price"), "ts")


@query("cdc_apply_deletes", with_views(v.LINES_SQL, select=f"""
  select id, sku_id, ts from (select * from line qualify {v.LATEST_SQL}) where flag <> 'R'"""))
def cdc_apply_deletes(spark, sf_dir):
    op = F.when(F.col("flag") == "R", "delete").otherwise("update")
    rows = v.lines(spark, sf_dir).select("id", "sku_id", "ts", "seq", op.alias("op"))
    return latest_by_key(rows, ["id"], ["ts", "seq"], op="op").select("id", "sku_id", "ts")


@query("cdc_op_type", with_views(v.EVENTS_SQL, select="""
  select event_type, case event_type when 'purchase' then 'insert' when 'view' then 'delete'
         when 'signup' then 'start' else 'insert' end as op_type, count(*) as n
  from ev where event_type <> 'error' group by all"""))
def cdc_op_type(spark, sf_dir):
    ev = v.events(spark, sf_dir).where(F.col("event_type") != "error")
    kind = F.col("event_type")
    typed = ev.withColumn("type", F.when(kind == "purchase", "bootstrap-insert").when(kind == "view", "delete")
                          .when(kind == "signup", "bootstrap-start").otherwise("insert"))
    return with_op_type(typed).groupBy("event_type", "op_type").agg(F.count(F.lit(1)).alias("n"))


@query("map_subscript", with_views(v.LINES_SQL, select="""
  select id, cast(order_id as varchar) as order_id, cast(null as varchar) as missing, cast(null as varchar) as old_value
  from line"""))
def map_subscript(spark, sf_dir):
    rows = of_table(v.line_changes(spark, sf_dir), v.DATABASE, "order_detail")
    return rows.select(*fields("id", "order_id", "missing"), F.col("old")["id"].alias("old_value"))


@query("json_props_parse", with_views(v.EVENTS_SQL, select="""
  select k, count(*) as n, min(event_id) as first_event from ev group by k"""))
def json_props_parse(spark, sf_dir):
    shape = "k int"
    rows = v.given(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", shape).alias("props")).select("event_id", "props.k")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("json_row_out", """
  select '{"order_key":' || cast(o_orderkey as varchar) || ',"order_status":"' || o_orderstatus || '"'
         || case when o_orderstatus = 'F' then '' else ',"order_priority":"' || o_orderpriority || '"' end || '}' as value
  from orders""")
def json_row_out(spark, sf_dir):
    rows = v.given(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderKey"), F.col("o_orderstatus").alias("orderStatus"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("orderPriority"),
        F.col("o_custkey").alias("skuId"))
    return json_row(rows, drop=["skuId"])


@query("relational_labels", """
  select c_custkey as "cCustkey", c_mktsegment as "cMktsegment" from customer""")
def relational_labels(spark, sf_dir):
    return rename_columns(v.given(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), camel)


# ---- routing -----------------------------------------------------------------------------

def route_row(table, kind, sink, sink_type, columns, key="id"):
    return {"source_table": table, "source_type": kind, "sink_table": sink, "sink_type": sink_type,
            "sink_family": "info", "sink_columns": columns, "sink_row_key": key}


def routes(spark):
    """Routes in force after a snapshot and a few live changes on top of preloaded ones."""
    row = route_row
    orders = row("order_info", "ALL", "dim_order", "dim", "id,user_id,order_status,operate_time")
    cart = row("cart_info", "insert", "dwd_cart_insert", "dwd", "id,user_id,sku_num")
    steps = [
        ("r", None, row("order_info", "ALL", "dim_old", "dim", "id"), 1),
        ("u", row("order_info", "ALL", "dim_old", "dim", "id"), orders, 2),
        ("c", None, row("comment_info", "ALL", "dim_comment", "dim", "id"), 3),
        ("d", row("comment_info", "ALL", "dim_comment", "dim", "id"), None, 4),
        ("c", None, row("cart_info", "delete", "dwd_moved", "dwd", "id"), 5),
        ("u", row("cart_info", "delete", "dwd_moved", "dwd", "id"), cart, 6),
    ]
    raw = literal(spark, [(op, before, after, ts) for op, before, after, ts in steps], schemas.ROUTE_CHANGE)
    text = raw.select(F.to_json(F.struct(*raw.columns)).alias("value"))
    preload = literal(spark, [
        row("order_detail", "insert", "dwd_line", "dwd", "id,sku_id"),
        row("order_info", "ALL", "dim_preloaded", "dim", "id"),
    ], schemas.ROUTE)
    return routes_in_force(route_changes(text), preload)


@query("cdc_route_config", """
  select 'dim_order' as sink_table, cast(o_orderkey as varchar) as row_key, 'insert' as op_type,
         cast(epoch(o_orderdate) as bigint) as ts from orders
  union all
  select 'dim_order', cast(o_orderkey as varchar), 'update', cast(epoch(o_orderdate) as bigint) + 600
  from orders where o_orderstatus = 'F'
  union all
  select 'dim_order', cast(o_orderkey as varchar), 'update', cast(epoch(o_orderdate) as bigint) + d
  from orders, (values (1200), (1800)) t(d) where o_orderstatus = 'P'""")
def cdc_route_config(spark, sf_dir):
    routed = route(clean(v.change_log(spark, sf_dir), v.DATABASE), routes(spark), "dim")
    return routed.select("sink_table", "row_key", "op_type", "ts")


@query("cdc_prune_columns", """
  select cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as user_id,
         cast(null as varchar) as province_id, 4 as cells
  from orders""")
def cdc_prune_columns(spark, sf_dir):
    routed = route(v.order_changes(spark, sf_dir).where(F.col("type") == "insert"), routes(spark), "dim")
    row = F.col("row")
    return routed.select(row["id"].alias("id"), row["user_id"].alias("user_id"),
                         row["province_id"].alias("province_id"), F.size(row).alias("cells"))


@query("dim_maintenance", """
  select cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as user_id,
         case o_orderstatus when 'F' then '1003' when 'P' then '1006' else '1001' end as order_status,
         case o_orderstatus when 'F' then strftime(o_orderdate + interval '10 minutes', '%Y-%m-%d %H:%M:%S')
              when 'P' then strftime(o_orderdate + interval '30 minutes', '%Y-%m-%d %H:%M:%S') end as operate_time
  from orders""")
def dim_maintenance(spark, sf_dir):
    rows = dimension_rows(v.change_log(spark, sf_dir), routes(spark), v.DATABASE)
    return dimension(rows, "dim_order", ["id", "user_id", "order_status", "operate_time"])


@query("dim_put_and_delete", with_views(v.EVENTS_SQL, """
  cell as (
    select user_id, k, event_id, event_type, ts_ms, max(case when event_type = 'error' then event_id end)
           over (partition by user_id) as cleared from ev)""", select="""
  select cast(user_id as varchar) as id,
         max(case when event_type = 'view' then cast(k as varchar) || '@' || cast(event_id as varchar) end)
           filter (event_id = last_view) as seen,
         max(case when event_type = 'click' then cast(k as varchar) || '@' || cast(event_id as varchar) end)
           filter (event_id = last_click) as clicked
  from (select *, max(case when event_type = 'view' then event_id end) over (partition by user_id) as last_view,
               max(case when event_type = 'click' then event_id end) over (partition by user_id) as last_click
        from cell where event_id > coalesce(cleared, -1) and event_type in ('view', 'click'))
  group by user_id"""))
def dim_put_and_delete(spark, sf_dir):
    """Views and clicks each put one cell of the user's row, errors delete the row."""
    ev = v.events(spark, sf_dir).where(F.col("event_type").isin("view", "click", "error"))
    kind = F.col("event_type")
    mark = F.concat_ws("@", F.col("k").cast("string"), F.col("event_id").cast("string"))
    changes = ev.select(
        F.col("user_id").cast("string").alias("id"), "event_id",
        F.when(kind == "error", "delete").otherwise("update").alias("op"),
        v.row_map(seen=F.when(kind == "view", mark), clicked=F.when(kind == "click", mark)).alias("row"))
    rows = merge_cells(changes, ["id"], ["event_id"], "op", "row")
    return rows.select("id", F.col("row")["seen"].alias("seen"), F.col("row")["clicked"].alias("clicked"))


@query("routed_facts", with_views(v.EVENTS_SQL, v.LINES_SQL, select="""
  select 'dwd_cart_insert' as sink_table, cast(event_id as varchar) as id, cast(user_id as varchar) as user_id,
         cast(k as varchar) as sku_num, cast(null as varchar) as sku_id, 'insert' as op_type
  from ev where event_type = 'click'
  union all
  select 'dwd_line', id, null, null, cast(sku_id as varchar), 'insert' from line"""))
def routed_facts_query(spark, sf_dir):
    rows = routed_facts(v.change_log(spark, sf_dir), routes(spark), v.DATABASE)
    row = F.col("row")
    return rows.select("sink_table", *[row[c].alias(c) for c in ("id", "user_id", "sku_num", "sku_id")],
                       row["op_type"].alias("op_type"))


@query("json_topic_table", with_views(v.EVENTS_SQL, select="""
  select cast(event_id as varchar) as id, case when k <> 1 then ts_ms // 1000 end as ts from ev
  where event_type <> 'error' and k <> 0"""))
def json_topic_table(spark, sf_dir):
    """A JSON topic read with a schema; unreadable messages are left out."""
    rows = parse_json(raw_topic(spark, sf_dir), schemas.CHANGE_ENVELOPE)
    return rows.select(*fields("id"), "ts").where(F.col("id").isNotNull())
