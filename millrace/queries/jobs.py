"""Queries over jobs of several streams, live routes, lookups by time, folding logs and counted losses."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from millrace import schemas
from millrace.operators.changelog import clean, latest_by_key
from millrace.operators.enrich import lookup_as_of
from millrace.operators.logs import clean_log
from millrace.plans import dwd
from millrace.plans.dim import dimension
from millrace.queries import views as v
from millrace.queries.aggregates import WIDTH, page_view_sql
from millrace.queries.changes import raw_topic, route_row, routes
from millrace.queries.facts import CLOSED, RETURNED, refund_payment_sql, refund_sql
from millrace.queries.logsplit import REPAIR_SQL, log_text
from millrace.queries.registry import ORACLE, query, with_views
from millrace.queries.streams import LAST, LINE_END, files_together, late_events, replay, replay_in_files
from millrace.session import freed_shuffles, shared_folder
from millrace.sources.logs import LATENESS, change_log, order_detail_topic, page_log, route_changes
from millrace.sources.topics import literal, stream_table, text_topic
from millrace.streaming import aggregates, maintenance, sinks
from millrace.streaming.job import Job
from millrace.streaming.run import collected, count_losses, drain, to_batches, to_files

# ---- lookups at the time of the row ---------------------------------------------------------

AS_OF_SQL = with_views(v.EVENTS_SQL, """
  level as (
    select user_id, et, event_type, k from ev where event_type in ('view', 'error')
    qualify row_number() over (partition by user_id, et order by event_id desc) = 1)""", select="""
  select p.event_id, p.user_id, case when l.event_type = 'view' then l.k end as level
  from ev p asof left join level l on p.user_id = l.user_id and p.et >= l.et where p.event_type = 'purchase'""")
LEVEL = {"k": "level"}
AS_OF = {"order": ["et", "event_id"], "op": "op"}


def _levels(ev):
    """The change log of a user's level: views set it, errors delete it."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return ev.where(F.col("event_type").isin("view", "error")).select("user_id", "event_id", "k", op.alias("op"), "et")


def _purchases(ev):
    return ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "et")


@query("lookup_as_of", AS_OF_SQL)
def lookup_as_of_query(spark, sf_dir):
    """Purchases with the level their user had then."""
    ev = v.events(spark, sf_dir).withColumn("et", F.timestamp_millis("ts"))
    return lookup_as_of(_purchases(ev), _levels(ev), "user_id", "user_id", LEVEL, **AS_OF).drop("et")


@query("stream_lookup_as_of", AS_OF_SQL)
def stream_lookup_as_of(spark, sf_dir):
    """The same for a stream of purchases in several batches, from the change log as it stands at each."""
    folder = shared_folder(spark, "stream")

    def load(session):
        return {"level": _levels(v.events(session, sf_dir).withColumn("et", F.timestamp_millis("ts")))}

    write = maintenance.enrich_batches_as_of(
        sinks.append_batches(f"{folder}/named"), load, ("level", "user_id", "user_id", LEVEL, AS_OF))
    drain(to_batches(_purchases(late_events(spark, sf_dir, "end")), "named", write, folder))
    return spark.read.schema("event_id long, user_id long, level int, batch_id int").parquet(f"{folder}/named").drop("batch_id")


# ---- routing and dimensions -----------------------------------------------------------------

ORDER_END = {"o_orderkey": -5, "o_custkey": -5, "o_orderstatus": "O", "o_orderdate": LAST}
FIRST = route_row("order_info", "ALL", "dim_first", "dim", "id,order_status")
SECOND = route_row("order_info", "ALL", "dim_second", "dim", "id,user_id,order_status")


def _put_lines(rows, path):
    rows.write.mode("append").parquet(path)


@query("stream_live_routes", """
  select case when o_orderkey % 2 = 0 then 'dim_first' else 'dim_second' end as sink_table,
         cast(o_orderkey as varchar) as id, case when o_orderkey % 2 = 1 then cast(o_custkey as varchar) end as user_id,
         case o_orderstatus when 'F' then '1003' when 'P' then '1006' else '1001' end as order_status
  from orders""")
def stream_live_routes(spark, sf_dir):
    """Half of the orders come before their route moves to another dimension, half after it, while the job goes on."""
    job = Job(spark, shared_folder(spark, "job"))
    orders = v.given(spark, sf_dir, "orders")
    config = spark.createDataFrame([], schemas.ROUTE_CHANGE)
    job.to_batches("routes", lambda: route_changes(
        stream_table(spark, job.topic("config"), config.select(F.lit("").alias("value")).schema)), maintenance.log_routes(job.topic("route_log")))
    write = maintenance.maintain_dimensions(
        f"{job.folder}/dims", maintenance.logged_routes(job.topic("route_log")), v.DATABASE)
    job.to_batches("dims", lambda: v.order_changes_of(stream_table(spark, job.topic("orders"), orders.schema)), write)
    for step, (change, part) in enumerate([(("c", None, FIRST), 0), (("u", FIRST, SECOND), 1)], 1):
        told = literal(spark, [(*change, step)], schemas.ROUTE_CHANGE)
        _put_lines(told.select(F.to_json(F.struct(*told.columns)).alias("value")), job.topic("config"))
        _put_lines(orders.where(F.col("o_orderkey") % 2 == part), job.topic("orders"))
        job.drain()
    rows = sinks.read_dimensions(spark, f"{job.folder}/dims")
    return rows.select("sink_table", *[F.col("row")[c].alias(c) for c in ("id", "user_id", "order_status")])


@query("stream_folded_dimensions", ORACLE["dim_maintenance"])
def stream_folded_dimensions(spark, sf_dir):
    """Order changes in several batches to a dimension log that folds itself every second one."""
    folder, table = shared_folder(spark, "stream"), f"dims_{uuid.uuid4().hex}"
    orders = v.order_changes_of(replay_in_files(spark, sf_dir, "orders", "o_orderdate", [ORDER_END]))
    shape = "sink_table string, row_key string, ts long, op_type string, row map<string,string>"
    log = sinks.dimension_log(table, f"{folder}/dims", spark.createDataFrame([], shape).schema, every=2)
    write = sinks.log_dimensions(log)

    def routed(batch, batch_id):
        write(maintenance.routed_dimensions(batch, routes(batch.sparkSession), v.DATABASE), batch_id)

    drain(to_batches(orders, "dims", routed, folder))
    rows = sinks.logged_dimensions(log, spark)
    found = dimension(rows, "dim_order", ["id", "user_id", "order_status", "operate_time"])
    return found.where(F.col("id") != str(ORDER_END["o_orderkey"]))


@query("sink_tables", ORACLE["dim_maintenance"])
def sink_tables(spark, sf_dir):
    """Catalog tables made and dropped as routing changes say, one of them filled with its dimension."""
    database = f"sinks_{uuid.uuid4().hex}"
    steps = [("c", "dim_old", "id", 1), ("c", "dim_order", "id", 2), ("d", "dim_old", "id", 3),
             ("u", "dim_order", "id,user_id,order_status,operate_time", 4)]
    changes = literal(spark, steps, "op string, sink_table string, sink_columns string, ts_ms long")
    folder = shared_folder(spark, "sinks")
    spark.sql(f"create database {database} location '{folder}'")
    sinks.sync_sinks(spark, changes, database)
    rows = maintenance.routed_dimensions(v.order_changes(spark, sf_dir), routes(spark), v.DATABASE)
    rows = sinks.folded_dimensions(rows)
    [name] = [t.name for t in spark.catalog.listTables(database)]
    dimension(rows, name, ["id", "user_id", "order_status", "operate_time"]).write.insertInto(f"{database}.{name}")
    return spark.table(f"{database}.{name}")


# ---- jobs -----------------------------------------------------------------------------------

PAGE_VIEWS = ("stt string, edt string, cur_date string, vc string, ch string, ar string, is_new string, "
              "uv_ct long, sv_ct long, pv_ct long, dur_sum long")


@query("stream_traffic_job", page_view_sql(
    WIDTH, REPAIR_SQL, "(select * from fixed where event_type in ('view', 'click', 'purchase'))"))
def stream_traffic_job(spark, sf_dir):
    """Log text to split topics to page views: a job of three streams over several batches.

    The batches of the log are those of the replay: each has the same number of files in every topic, so a batch of a large
    table is neither taken in pieces nor mixed with the next one.
    """
    job, order = Job(spark, shared_folder(spark, "job")), ["ts", "event_id"]
    ev = late_events(spark, sf_dir, "view", delay_us=1).drop("et")
    together = files_together(v.given(spark, sf_dir, "events"))
    job.to_topic("text", lambda: log_text(v.app_log_of(v.page_log_of(ev))).repartition(together, "event_id"))

    def log():
        text = job.read("text", "event_id long, value string", files_per_batch=together)
        return clean_log(page_log(text, keep=["event_id"]))

    job.to_batches("split", lambda: maintenance.with_visits(log(), order), maintenance.split_logs(f"{job.folder}/parts", order))
    fields = log().select("event_id", "common", "page", "ts", "et").schema.fields
    shape = StructType([StructField(f.name, f.dataType) for f in fields])  # without the mark of the watermark

    def views():
        pages = spark.readStream.schema(shape).parquet(f"{job.folder}/parts/page/batch_id=*")
        return aggregates.page_views(pages, WIDTH, ["et", "event_id"])

    job.to_topic("page_views", views)
    job.drain()
    return spark.read.schema(PAGE_VIEWS).parquet(job.topic("page_views"))


@query("stream_losses", with_views(v.EVENTS_SQL, select="""
  select 'parsed' as step, count(*) as seen, count(*) filter (event_type = 'error') as dropped from ev
  union all
  select 'clean', count(*), count(*) filter (event_type = 'signup' or user_id % 7 = 0 or k in (0, 1))
  from ev where event_type <> 'error'"""))
def stream_losses(spark, sf_dir):
    """How many messages of a stream were no JSON, and how many changes no clean ones."""
    folder = shared_folder(spark, "stream")
    raw_topic(spark, sf_dir).repartition(3).write.parquet(f"{folder}/raw")
    raw = stream_table(spark, f"{folder}/raw", files_per_batch=1)
    losses, name = count_losses(spark), f"losses-{uuid.uuid4().hex}"
    stream = to_files(clean(change_log(raw, count="parsed"), v.DATABASE, "clean").select("ts"), name, f"{folder}/out", folder)
    drain(stream)
    losses.settle(stream)
    spark.streams.removeListener(losses)
    counts = [(step, losses.seen[name, step], losses.dropped[name, step]) for step in ("parsed", "clean")]
    return literal(spark, counts, "step string, seen long, dropped long")


@query("stream_late_rows", with_views(v.EVENTS_SQL, """
  cut as (select quantile_disc(ts_ms, 0.5) as middle from ev)""", select="""
  select count(*) filter (user_id % 5 <> 0 or ts_ms > middle) as kept, count(*) filter (user_id % 5 = 0 and ts_ms <= middle) as late
  from ev, cut"""))
def stream_late_rows(spark, sf_dir):
    """A fifth of the users' events of the first half come after all others; they are left out and counted."""
    folder = shared_folder(spark, "stream")
    ev = v.events(spark, sf_dir)
    middle = ev.agg(F.expr("percentile_disc(0.5) within group (order by ts)")).first()[0]
    late = (F.col("user_id") % 5 == 0) & (F.col("ts") <= middle)
    end = spark.createDataFrame([(-1, -1, "end", 0.0, int(LAST.timestamp()) * 1000, 0)], ev.schema)
    for part in (ev.where(~late), end, end.withColumn("ts", F.col("ts") + 1), ev.where(late)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events")
    rows = stream_table(spark, f"{folder}/events", ev.schema, files_per_batch=1).withColumn("et", F.timestamp_millis("ts"))
    firsts = rows.withWatermark("et", LATENESS).dropDuplicatesWithinWatermark(["event_id", "ts"]).select("event_id")
    losses, name = count_losses(spark), f"late-{uuid.uuid4().hex}"
    stream = to_files(firsts, name, f"{folder}/out", folder)
    drain(stream)
    losses.settle(stream)
    spark.streams.removeListener(losses)
    kept = spark.read.schema("event_id long").parquet(f"{folder}/out").where(F.col("event_id") >= 0)
    return kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("late", F.lit(losses.counts[name]).cast("long"))


# ---- topics ---------------------------------------------------------------------------------

@query("topic_line_order", """
  select c_nationkey as id, cast(max_by(c_custkey, c_custkey) as varchar) as last from customer group by c_nationkey""")
def topic_line_order(spark, sf_dir):
    """Changes that share key and second stand in one text file; the line decides."""
    folder = shared_folder(spark, "topic")
    rows = v.given(spark, sf_dir, "customer").coalesce(1).sortWithinPartitions("c_custkey")
    message = F.to_json(F.struct(
        F.lit(v.DATABASE).alias("database"), F.lit("customer").alias("table"), F.lit("update").alias("type"), F.lit(5).alias("ts"),
        v.row_map(id=F.col("c_nationkey").cast("string"), last=F.col("c_custkey").cast("string")).alias("data")))
    rows.select(message.alias("value")).write.text(folder)
    log = change_log(text_topic(spark, folder, streaming=False, numbered=True), keep=["position", "part", "line"])
    keyed = log.select(F.col("data")["id"].cast("bigint").alias("id"), F.col("data")["last"].alias("last"), "ts", "position", "part", "line")
    return latest_by_key(keyed, ["id"], ["ts", "position", "part", "line"]).select("id", "last")


@query("topic_order_details", ORACLE["fact_order_detail"])
def topic_order_details(spark, sf_dir):
    """Order-line facts written to their JSON topic by one job and scanned by another."""
    folder = shared_folder(spark, "topic")
    details = dwd.order_details(v.change_log(spark, sf_dir), v.DATABASE, order=("ts", "seq")).drop("et")
    details.write.json(folder, compression="gzip")
    return order_detail_topic(spark, folder, streaming=False).drop("et")


# ---- detail facts as streams ----------------------------------------------------------------

# Given orders and lines lie years apart.
TTL_S = 20 * 366 * 86400


def _orders(spark, sf_dir, watermark=True):
    return v.order_changes_of(replay(spark, sf_dir, "orders", ORDER_END), watermark)


def _log(spark, sf_dir, *ends, tables):
    """Changes of lines and orders in one log with one watermark, as a topic of all tables has it, stored by table."""
    lines = v.line_changes_of(v.lines_of(replay(spark, sf_dir, "lineitem", *ends)), watermark=False, tables=tables)
    return lines.unionByName(_orders(spark, sf_dir, watermark=False)).withWatermark("et", LATENESS)


@query("stream_comments", ORACLE["fact_comment_lookup"])
def stream_comments(spark, sf_dir):
    changes = v.comment_changes_of(replay(spark, sf_dir, "documents"))
    facts = dwd.comments(changes, v.base_dic(spark, sf_dir), v.DATABASE)
    return collected(spark, facts, "comments", shared_folder(spark, "stream")).drop("et")


# A line's offers and order count within this time of it.
DETAIL_TTL_S = 400 * 86400


@query("stream_order_detail", with_views(v.LINES_SQL, select=f"""
  select l.id, cast(o_custkey as varchar) as user_id, cast(cast(round(a.discount * 100) as int) as varchar) as activity_id,
         cast(cast(round(c.tax * 100) as int) as varchar) as coupon_id, cast(l.price as varchar) as price, l.ts
  from line l join orders on o_orderkey = l.order_id and abs(l.ts - epoch(o_orderdate)) <= {DETAIL_TTL_S}
  left join line a on a.id = l.id and a.discount >= 0.05 and abs(a.ts - l.ts) <= {DETAIL_TTL_S}
  left join line c on c.id = l.id and c.tax >= 0.04 and abs(c.ts - l.ts) <= {DETAIL_TTL_S}"""))
def stream_order_detail(spark, sf_dir):
    """Four streams joined; each revision of a line comes with each of its activities and coupons."""
    ends = {**LINE_END, "l_discount": 0.05, "l_tax": 0.04}
    log = _log(spark, sf_dir, ends, tables=("order_detail", "order_detail_activity", "order_detail_coupon"))
    details = dwd.order_details(log, v.DATABASE, DETAIL_TTL_S)
    rows = collected(spark, details, "details", shared_folder(spark, "stream"))
    return rows.select("id", "user_id", "activity_id", "coupon_id", _price().alias("price"), "ts")


def _price():
    return (F.col("split_total_amount").cast("decimal(16,2)") + F.col("split_activity_amount").cast("decimal(16,2)")).cast(
        "decimal(16,2)").cast("string")


@query("stream_refunds", refund_sql(RETURNED))
def stream_refunds(spark, sf_dir):
    log = _log(spark, sf_dir, tables=("order_refund_info",))
    facts = dwd.refunds(log, v.base_dic(spark, sf_dir), v.DATABASE, TTL_S)
    return collected(spark, facts, "refunds", shared_folder(spark, "stream")).drop("et")


@query("stream_refund_payments", refund_payment_sql(CLOSED, CLOSED))
def stream_refund_payments(spark, sf_dir):
    log = _log(spark, sf_dir, tables=("order_refund_info", "refund_payment"))
    facts = dwd.refund_payments(log, v.base_dic(spark, sf_dir), v.DATABASE, TTL_S)
    return collected(spark, facts, "refund_payments", shared_folder(spark, "stream")).drop("et")


def _detail_stream(spark, sf_dir):
    """Order-line facts from their topic, as a stream."""
    folder = shared_folder(spark, "topic")
    with freed_shuffles(spark):
        dwd.order_details(v.change_log(spark, sf_dir), v.DATABASE, order=("ts", "seq")).drop("et").write.json(folder, compression="gzip")
    return order_detail_topic(spark, folder)


@query("stream_cancel_detail", ORACLE["fact_cancel_detail"])
def stream_cancel_detail(spark, sf_dir):
    facts = dwd.cancelled_details(_orders(spark, sf_dir), _detail_stream(spark, sf_dir), v.DATABASE, TTL_S)
    return collected(spark, facts, "cancelled", shared_folder(spark, "stream")).drop("et")


@query("stream_pay_detail", ORACLE["fact_pay_interval"])
def stream_pay_detail(spark, sf_dir):
    log = _log(spark, sf_dir, tables=("payment_info",))
    facts = dwd.paid_details(log, _detail_stream(spark, sf_dir), v.base_dic(spark, sf_dir), v.DATABASE)
    return collected(spark, facts, "paid", shared_folder(spark, "stream")).drop("et")
