"""Streaming queries, replayed over the given tables.

A replay takes a table and a second source with far-future rows in one go, so that the watermark
closes every real window and join; nothing of the far-future rows themselves comes out. A replay in
files lets the rows of a table arrive late and out of order, a file per batch. Outputs,
state and checkpoints go below the shared folder of the session.
"""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.enrich import lookup
from millrace.operators.joins import interval_join, keyed_join
from millrace.operators.flags import mark_returning
from millrace.operators.windows import stamp, tumbling, window_sums
from millrace.plans import dwd, dws
from millrace.plans.dim import dimension
from millrace.queries import views as v
from millrace.queries.aggregates import DELTA_SQL, SKU_SUMS, STAMPS, WIDTH
from millrace.queries.changes import routes
from millrace.queries.logsplit import log_text
from millrace.queries.registry import ORACLE, query, with_views
from millrace.session import shared_folder
from millrace.sources.logs import LATENESS, page_log
from millrace.operators.logs import clean_log
from millrace.sources.topics import csv_topic, stream_table
from millrace.streaming import aggregates, maintenance, sinks
from millrace.streaming.run import collected, drain, to_batches, to_files
from millrace.streaming.stateful import stream_day_changes, stream_deltas, stream_distinct

LAST = dt.datetime(2200, 1, 1)


def replay(spark, sf_dir, name, *far_future):
    """The table as a stream, with rows after all others from a source of their own."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    rows = stream_table(spark, path, schema)
    if not far_future:
        return rows
    extra = shared_folder(spark, "far-future")
    spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in far_future], schema).coalesce(
        1).write.parquet(extra)
    return rows.unionByName(stream_table(spark, extra, schema))


# Rows of a replay in files arrive up to this much after their time, less than the lateness.
DELAY_US = 2_900_000
FILES = 4


def files_together(rows) -> int:
    """The files that a batch of a replay of a table has: as many as its scan has tasks."""
    return max(1, rows.rdd.getNumPartitions())


def replay_in_files(spark, sf_dir, name, time, far_future, files=FILES, delay_us=DELAY_US):
    """The table as a stream of files, one per batch, in order of arrival: a row's time plus a delay by its hash.

    So rows overtake each other inside files and across them. Rows far in the future end it. A batch of a large table
    has as many files as its scan has tasks, so that no task writes or reads a batch alone.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    arrival = F.unix_micros(F.col(time).cast("timestamp")) + F.pmod(F.xxhash64(*rows.columns), F.lit(delay_us))
    late = rows.withColumn("_arrival", arrival)
    cuts = late.agg(F.percentile_approx("_arrival", [i / files for i in range(1, files)])).first()[0] or []
    folder, together = shared_folder(spark, "files"), files_together(rows)
    # Files are taken up by the time they were written.
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = late if low is None else late.where(F.col("_arrival") > low)
        part = part if high is None else part.where(F.col("_arrival") <= high)
        part = part.drop("_arrival")
        (part.repartition(together) if together > 1 else part.coalesce(1)).write.mode("append").parquet(folder)
    ends = [tuple(r.get(f) for f in rows.columns) for r in far_future]
    spark.createDataFrame(ends, rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return stream_table(spark, folder, rows.schema, files_per_batch=together)


def _event_ends(kinds):
    return [{"event_id": -1 - i, "ts": LAST, "user_id": -1 - i, "event_type": kind, "value": 0.0, "props": '{"k": 0}'}
            for i, kind in enumerate(kinds)]


def event_stream(spark, sf_dir, *kinds):
    """Events as a stream, closed by one far-future event of each kind."""
    rows = replay(spark, sf_dir, "events", *_event_ends(kinds))
    return v.events_of(rows).withColumn("et", F.timestamp_millis("ts"))


def late_events(spark, sf_dir, *kinds, delay_us=DELAY_US):
    """Events as a stream of several files, out of order within the lateness."""
    rows = replay_in_files(spark, sf_dir, "events", "ts", _event_ends(kinds), delay_us=delay_us)
    return v.events_of(rows).withColumn("et", F.timestamp_millis("ts"))


@query("stream_tumbling", with_views(v.EVENTS_SQL, select=f"""
  select {STAMPS}, event_type, count(*) as n, cast(sum(k) as bigint) as k_sum from ev group by all"""))
def stream_tumbling(spark, sf_dir):
    ev = event_stream(spark, sf_dir, "end").withWatermark("et", LATENESS)
    counts = stamp(ev.groupBy(tumbling(WIDTH), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum")))
    return collected(spark, counts, "tumbling", shared_folder(spark, "stream"))


@query("stream_interval_join", ORACLE["join_interval_events"])
def stream_interval_join(spark, sf_dir):
    ev = event_stream(spark, sf_dir, "purchase", "click")

    def side(kind, name):
        rows = ev.where(F.col("event_type") == kind).select(F.col("event_id").alias(name), "user_id", "et")
        return rows.withWatermark("et", LATENESS)

    joined = interval_join(side("purchase", "purchase_id"), side("click", "click_id"), {"user_id": "user_id"},
                           dwd.PAY_WITHIN_S, dwd.PAY_AHEAD_S)
    return collected(spark, joined, "interval_join", shared_folder(spark, "stream")).drop("et")


@query("stream_left_join", with_views(v.EVENTS_SQL, select="""
  select p.event_id as purchase_id, c.event_id as signup_id, p.user_id
  from ev p left join ev c on p.user_id = c.user_id and c.event_type = 'signup'
       and c.et between p.et - interval '1 hour' and p.et + interval '1 hour'
  where p.event_type = 'purchase'"""))
def stream_left_join(spark, sf_dir):
    """Purchases with sign-ups of the same user within an hour; the others come out with null."""
    ev = event_stream(spark, sf_dir, "purchase", "signup")

    def side(kind, name):
        rows = ev.where(F.col("event_type") == kind).select(F.col("event_id").alias(name), "user_id", "et")
        return rows.withWatermark("et", LATENESS)

    joined = keyed_join(side("purchase", "purchase_id"), side("signup", "signup_id"), {"user_id": "user_id"},
                        "left", ttl_s=3600)
    rows = collected(spark, joined, "left_join", shared_folder(spark, "stream"))
    return rows.where(F.col("purchase_id") >= 0).drop("et")


@query("stream_lookup_join", with_views(v.EVENTS_SQL, select="""
  select event_id, k % 30 as code, n_name as name from ev left join nation on n_nationkey = k % 30"""))
def stream_lookup_join(spark, sf_dir):
    ev = event_stream(spark, sf_dir).select("event_id", (F.col("k") % 30).alias("code"))
    named = lookup(ev, v.given(spark, sf_dir, "nation"), "code", "n_nationkey", {"n_name": "name"})
    return collected(spark, named, "lookup_join", shared_folder(spark, "stream"))


@query("stream_first_of_day", ORACLE["flag_first_of_day"])
def stream_first_of_day(spark, sf_dir):
    ev = late_events(spark, sf_dir, "end")
    firsts = stream_day_changes(ev, ["user_id"], ["et", "event_id"], ["event_type"])
    rows = collected(spark, firsts, "first_of_day", shared_folder(spark, "stream"))
    return rows.select("user_id", "day", "event_id", "event_type")


@query("stream_returning_user", ORACLE["flag_returning_user"])
def stream_returning_user(spark, sf_dir):
    firsts = stream_day_changes(late_events(spark, sf_dir, "end"), ["user_id"], ["et", "event_id"])
    rows = collected(spark, mark_returning(firsts, 2), "returning", shared_folder(spark, "stream"))
    return rows.drop("et")


@query("stream_page_view", ORACLE["win_page_view"])
def stream_page_view(spark, sf_dir):
    log = v.page_log_of(late_events(spark, sf_dir, "end").drop("et"))
    views = aggregates.page_views(log, WIDTH, ["et", "event_id"])
    return collected(spark, views, "page_view", shared_folder(spark, "stream"))


@query("stream_login", ORACLE["win_login"])
def stream_login(spark, sf_dir):
    """The closing event is a view, as only views and sign-ups count as logins."""
    log = v.page_log_of(late_events(spark, sf_dir, "view").drop("et"))
    return collected(spark, aggregates.logins(log, WIDTH, back_days=2), "login", shared_folder(spark, "stream"))


@query("stream_dedup", """
  select distinct user_id, strftime(ts, '%Y-%m-%d') as day from events""")
def stream_dedup(spark, sf_dir):
    """Users of each day; the state of a day is dropped when the watermark has passed it."""
    ev = event_stream(spark, sf_dir, "end").withWatermark("et", LATENESS)
    days = ev.select("user_id", "event_id", F.window("et", "1 day").alias("day"))
    named = stream_distinct(days, ["user_id", "day"], ["event_id"]).select("user_id", F.date_format("day.start", "yyyy-MM-dd").alias("day"))
    return collected(spark, named, "dedup", shared_folder(spark, "stream")).where(F.col("user_id") >= 0)


def _line_stream(spark, sf_dir, *far_future):
    return v.lines_of(replay(spark, sf_dir, "lineitem", *far_future))


LINE_END = {"l_orderkey": -1, "l_partkey": -1, "l_suppkey": -1, "l_linenumber": 0, "l_quantity": 0.0,
            "l_extendedprice": 0.0, "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": "R", "l_linestatus": "F",
            "l_shipdate": LAST}
# Lets the change of LINE_END itself out, which then closes the windows of a second job.
LINE_AFTER = {**LINE_END, "l_orderkey": -2, "l_shipdate": LAST + dt.timedelta(days=1)}


@query("stream_delta", ORACLE["delta_last_value"])
def stream_delta(spark, sf_dir):
    rows = _line_stream(spark, sf_dir, LINE_END).select(
        "id", "sku_id", "ts", "seq.*", "et",
        (F.col("price") - F.col("activity")).cast("decimal(16,2)").alias("order_amount"))
    changed = collected(spark, stream_deltas(rows, ["id"], ["ts", *v.REVISION], ["order_amount"], "previous"), "delta",
                        shared_folder(spark, "stream"))
    return changed.select("id", "sku_id", "ts", F.col("order_amount").cast("decimal(18,2)").alias("order_amount"))


@query("stream_sku_amounts", with_views(DELTA_SQL, select=f"""
  select {STAMPS}, sku_id, {SKU_SUMS} from changed group by all"""))
def stream_sku_amounts(spark, sf_dir):
    """Line changes in one stream, their sums per window and product in a second one."""
    rows = _line_stream(spark, sf_dir, LINE_END, LINE_AFTER).select(
        "id", "sku_id", "et", "seq.*", F.col("price").alias("original_amount"),
        F.col("activity").alias("activity_amount"), F.col("coupon").alias("coupon_amount"),
        (F.col("price") - F.col("activity")).cast("decimal(16,2)").alias("order_amount"))
    amounts = ["original_amount", "activity_amount", "coupon_amount", "order_amount"]
    folder = shared_folder(spark, "stream")
    drain(to_files(stream_deltas(rows, ["id"], ["et", *v.REVISION], amounts), "changes", f"{folder}/changes", folder))
    changed = spark.readStream.schema(rows.schema).parquet(f"{folder}/changes").withWatermark("et", LATENESS)
    sums = window_sums(changed, {a: a for a in amounts}, ["sku_id"], WIDTH)
    out = collected(spark, sums, "sku_amounts", folder)
    return out.withColumns({a: F.col(a).cast("decimal(18,2)") for a in amounts})


def _line_files(spark, sf_dir, *ends):
    """Order lines in files, out of order within the lateness, with the buyer and province of their order."""
    orders = v.given(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey")
    rows = v.lines_of(replay_in_files(spark, sf_dir, "lineitem", "l_shipdate", ends))
    return rows.join(orders, "order_id", "left").select(
        "id", "order_id", "sku_id", F.col("o_custkey").alias("user_id"),
        (F.col("o_custkey") % 25).cast("int").alias("province_id"),
        F.col("price").alias("split_original_amount"), F.col("activity").alias("split_activity_amount"),
        F.col("coupon").alias("split_coupon_amount"),
        (F.col("price") - F.col("activity")).cast("decimal(16,2)").alias("split_total_amount"), "seq.*", "et")


@query("stream_order", ORACLE["win_order"])
def stream_order(spark, sf_dir):
    users = aggregates.order_users(_line_files(spark, sf_dir, LINE_END), WIDTH)
    return collected(spark, users, "order", shared_folder(spark, "stream"))


@query("stream_sku_order", ORACLE["win_sku_order"])
def stream_sku_order(spark, sf_dir):
    """Line changes and their sums in one stream, with the whole product chain."""
    rows = dws.amount_rows(_line_files(spark, sf_dir, LINE_END), ["et", *v.REVISION])
    changed = stream_deltas(rows, ["id"], ["et", *v.REVISION], dws.AMOUNTS)
    sums = aggregates.sku_orders(changed, v.dimensions(spark, sf_dir), WIDTH)
    out = collected(spark, sums, "sku_order", shared_folder(spark, "stream"))
    return out.withColumns({a: F.col(a).cast("decimal(18,2)") for a in dws.AMOUNTS})


@query("stream_province_order", ORACLE["win_province_order"])
def stream_province_order(spark, sf_dir):
    """Changes at the time of the revision before go to a topic, which a second stream reads whole."""
    order, folder = ["et", *v.REVISION], shared_folder(spark, "stream")
    lines = _line_files(spark, sf_dir, LINE_END, LINE_AFTER)
    rows = lines.select("id", "province_id", *order, F.col("split_total_amount").alias("order_amount"))
    changed = stream_deltas(rows, ["id"], order, ["order_amount"], "previous")
    drain(to_files(changed, "changes", f"{folder}/changes", folder))
    topic = stream_table(spark, f"{folder}/changes", rows.schema)
    details = v.lines_of(replay(spark, sf_dir, "lineitem", LINE_END, LINE_AFTER))
    orders = v.given(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey")
    details = details.join(orders, "order_id", "left").select(
        "order_id", (F.col("o_custkey") % 25).cast("int").alias("province_id"), "seq.*", "et")
    sums = aggregates.province_orders(topic, details, v.dimensions(spark, sf_dir)["base_province"], WIDTH, order)
    rows = collected(spark, sums, "province_order", folder)
    return rows.withColumn("order_amount", F.col("order_amount").cast("decimal(18,2)"))


@query("stream_delta_idle", ORACLE["delta_four_amounts"])
def stream_delta_idle(spark, sf_dir):
    """Changes of four amounts; a line is forgotten 30 days after its last revision."""
    rows = dws.amount_rows(_line_files(spark, sf_dir, LINE_END), ["et", *v.REVISION])
    changed = stream_deltas(rows, ["id"], ["et", *v.REVISION], dws.AMOUNTS, idle_s=30 * 86400)
    out = collected(spark, changed, "idle", shared_folder(spark, "stream"))
    return out.select("id", "sku_id", F.unix_seconds("et").alias("ts"), *[F.col(a).cast("decimal(18,2)").alias(a) for a in dws.AMOUNTS])


@query("stream_refund_brand_user", ORACLE["win_refund_brand_user"])
def stream_refund_brand_user(spark, sf_dir):
    refunds = _line_stream(spark, sf_dir, LINE_END).where(F.col("flag") == "R").select(
        "et", "sku_id", "order_id", F.col("supplier_id").alias("user_id"), F.col("price").alias("refund_amount"))
    sums = aggregates.brand_user_refunds(refunds, v.dimensions(spark, sf_dir), WIDTH)
    rows = collected(spark, sums, "refunds", shared_folder(spark, "stream"))
    return rows.withColumn("refund_amount", F.col("refund_amount").cast("decimal(18,2)"))


@query("stream_log_split", with_views(v.EVENTS_SQL, select="""
  select part, count(*) as n, cast(sum(event_id) as bigint) as event_ids from (
    select event_id, unnest(case event_type when 'view' then ['page', 'display', 'display', 'action']
      when 'click' then ['page', 'action'] when 'purchase' then ['page', 'err'] when 'signup' then ['start']
      else ['err', 'display', 'display'] end) as part from ev) group by part"""))
def stream_log_split(spark, sf_dir):
    text = log_text(v.app_log_of(v.page_log_of(event_stream(spark, sf_dir).drop("et"))))
    log = clean_log(page_log(text, keep=["event_id"]))
    folder = shared_folder(spark, "stream")
    order = ["ts", "event_id"]
    drain(to_batches(maintenance.with_visits(log, order), "log_split", maintenance.split_logs(f"{folder}/parts", order), folder))
    parts = [spark.read.parquet(f"{folder}/parts/{p}").select(F.lit(p).alias("part"), "event_id")
             for p in ("start", "display", "action", "err", "page")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("event_ids"))


@query("stream_upsert", ORACLE["cdc_apply_deletes"])
def stream_upsert(spark, sf_dir):
    op = F.when(F.col("flag") == "R", "delete").otherwise("update")
    rows = _line_stream(spark, sf_dir).select("id", "sku_id", "ts", "seq", op.alias("op"))
    folder = shared_folder(spark, "stream")
    drain(to_batches(rows, "upsert", sinks.upserts(f"{folder}/rows", ["id"], ["ts", "seq"]), folder))
    current = sinks.read_upserts(spark, f"{folder}/rows", ["id"], ["ts", "seq"], "op", rows.schema)
    return current.select("id", "sku_id", "ts")


@query("stream_dimensions", ORACLE["dim_maintenance"])
def stream_dimensions(spark, sf_dir):
    """Order changes routed and logged batch by batch, read back as a dimension."""
    orders = v.order_changes_of(replay(spark, sf_dir, "orders"))
    folder = shared_folder(spark, "stream")
    write = maintenance.maintain_dimensions(f"{folder}/dims", routes, v.DATABASE)
    drain(to_batches(orders, "dimensions", write, folder))
    rows = sinks.read_dimensions(spark, f"{folder}/dims", live=routes(spark))
    return dimension(rows, "dim_order", ["id", "user_id", "order_status", "operate_time"])


@query("stream_cart_add", ORACLE["fact_cart_add_delta"])
def stream_cart_add(spark, sf_dir):
    changes = v.cart_changes_of(event_stream(spark, sf_dir).drop("et"))
    return collected(spark, dwd.cart_adds(changes, v.DATABASE), "cart_add", shared_folder(spark, "stream")).drop("et")


@query("stream_keyword_count", ORACLE["win_keyword_count"])
def stream_keyword_count(spark, sf_dir):
    """The closing search event is a click on product 0, as only searches advance this watermark."""
    names = v.given(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("item"))
    ev = event_stream(spark, sf_dir, "click").drop("et").join(names, "k", "left")
    counts = aggregates.keyword_counts(v.page_log_of(ev), WIDTH)
    return collected(spark, counts, "keywords", shared_folder(spark, "stream"))


@query("stream_home_detail_uv", ORACLE["win_home_detail_uv"])
def stream_home_detail_uv(spark, sf_dir):
    log = v.page_log_of(late_events(spark, sf_dir, "view").drop("et"))
    return collected(spark, aggregates.home_detail_views(log, WIDTH), "home_detail", shared_folder(spark, "stream"))


@query("stream_register", ORACLE["win_register"])
def stream_register(spark, sf_dir):
    users = event_stream(spark, sf_dir, "signup").where(F.col("event_type") == "signup").select(
        F.date_format("et", "yyyy-MM-dd HH:mm:ss").alias("create_time"))
    return collected(spark, aggregates.registrations(users, WIDTH), "register", shared_folder(spark, "stream"))


@query("stream_cart_uu", ORACLE["win_cart_uu"])
def stream_cart_uu(spark, sf_dir):
    ev = event_stream(spark, sf_dir, "click").drop("et")
    adds = dwd.cart_adds(v.cart_changes_of(ev, watermark=False), v.DATABASE)
    return collected(spark, aggregates.cart_users(adds, WIDTH), "cart_uu", shared_folder(spark, "stream"))


@query("stream_payment", ORACLE["win_payment"])
def stream_payment(spark, sf_dir):
    paid = late_events(spark, sf_dir, "purchase").where(F.col("event_type") == "purchase").select("user_id", "et")
    return collected(spark, aggregates.payment_users(paid, WIDTH), "payment", shared_folder(spark, "stream"))


@query("stream_route_topics", with_views(v.EVENTS_SQL, select="""
  select 'dwd_cart_insert' as sink_table,
         '{"id":"' || cast(event_id as varchar) || '","user_id":"' || cast(user_id as varchar) || '","sku_num":"'
         || cast(k as varchar) || '","op_type":"insert"}' as value
  from ev where event_type = 'click'"""))
def stream_route_topics(spark, sf_dir):
    """Cart changes written to the topics their routes name, as JSON rows with their operation."""
    changes = v.cart_changes_of(event_stream(spark, sf_dir).drop("et"))
    folder = shared_folder(spark, "stream")
    write = maintenance.route_facts(f"{folder}/topics", routes, v.DATABASE)
    drain(to_batches(changes, "topics", write, folder))
    return spark.read.schema("value string, batch_id int, sink_table string").json(f"{folder}/topics").select(
        "sink_table", "value")


@query("stream_load_json", with_views(v.EVENTS_SQL, select="""
  select strftime(et, '%Y-%m-%d') as cur_date, event_type, count(*) as n from ev group by all"""))
def stream_load_json(spark, sf_dir):
    """Window results loaded as JSON lines by day and summed up from there."""
    ev = event_stream(spark, sf_dir, "end").withWatermark("et", LATENESS)
    counts = stamp(ev.groupBy(tumbling(WIDTH), "event_type").agg(F.count(F.lit(1)).alias("n")))
    folder = shared_folder(spark, "stream")
    drain(to_batches(counts, "load", sinks.load_json_lines(f"{folder}/load"), folder))
    loaded = spark.read.schema("stt string, event_type string, n long, batch_id int, cur_date string").json(f"{folder}/load")
    return loaded.groupBy("cur_date", "event_type").agg(F.sum("n").alias("n"))


@query("topic_csv", "select c_custkey as id, c_name as name, c_mktsegment as segment from customer")
def topic_csv(spark, sf_dir):
    """Customers sent through a CSV topic and read back with a schema."""
    shape = "id long, name string, segment string"
    folder = shared_folder(spark, "stream")
    rows = replay(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    drain(to_files(rows, "csv", f"{folder}/topic", folder, format="csv"))
    return csv_topic(spark, f"{folder}/topic", StructType.fromDDL(shape), streaming=False)
