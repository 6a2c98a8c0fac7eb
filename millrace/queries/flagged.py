"""First-time, returning and change queries."""

from pyspark.sql import functions as F

from millrace.operators.deltas import deltas
from millrace.operators.enrich import enrich, flat_sku, lookup
from millrace.operators.flags import daily_and_new, first_of_day, first_seen, returning
from millrace.queries import views as v
from millrace.queries.registry import query, with_views

AMOUNTS = ["original_amount", "activity_amount", "coupon_amount", "order_amount"]


def _timed(spark, sf_dir):
    return v.events(spark, sf_dir).select(
        "event_id", "user_id", "event_type", F.timestamp_millis("ts").alias("et"))


DAYS_SQL = v.EVENTS_SQL + """,
flagged as (
  select *, strftime(et, '%Y-%m-%d') as day,
         lag(cast(et as date)) over (partition by user_id order by et, event_id) as last_day from ev)"""


@query("flag_first_of_day", with_views(DAYS_SQL, select="""
  select user_id, day, event_id, event_type from flagged where last_day is distinct from cast(et as date)"""))
def flag_first_of_day(spark, sf_dir):
    return first_of_day(_timed(spark, sf_dir), ["user_id"], ["et", "event_id"], ["event_type"]).drop("et")


@query("flag_first_seen", with_views(v.EVENTS_SQL, select="""
  select user_id, event_type, event_id from ev
  qualify row_number() over (partition by user_id, event_type order by et, event_id) = 1"""))
def flag_first_seen(spark, sf_dir):
    return first_seen(_timed(spark, sf_dir), ["user_id", "event_type"], ["et", "event_id"]).drop("et")


@query("flag_daily_and_new", with_views(DAYS_SQL, select="""
  select user_id, day, event_id, 1 as is_unique, case when last_day is null then 1 else 0 end as is_new
  from flagged where last_day is distinct from cast(et as date)"""))
def flag_daily_and_new(spark, sf_dir):
    return daily_and_new(_timed(spark, sf_dir), ["user_id"], ["et", "event_id"]).drop("et")


@query("flag_returning_user", with_views(DAYS_SQL, select="""
  select user_id, day, event_id, 1 as is_unique,
         case when et > cast(last_day as timestamp) + interval '2 days' then 1 else 0 end as is_back
  from flagged where last_day is distinct from cast(et as date)"""))
def flag_returning_user(spark, sf_dir):
    return returning(_timed(spark, sf_dir), ["user_id"], 2, ["et", "event_id"]).drop("et")


def _revisions(spark, sf_dir):
    return v.lines(spark, sf_dir).select(
        "id", "sku_id", "ts", "seq", "et", F.col("price").alias("original_amount"),
        F.col("activity").alias("activity_amount"), F.col("coupon").alias("coupon_amount"),
        (F.col("price") - F.col("activity")).cast("decimal(16,2)").alias("order_amount"))


def _money(*names):
    return [F.col(n).cast("decimal(18,2)").alias(n) for n in names]


@query("delta_last_value", with_views(v.LINES_SQL, select=f"""
  select id, coalesce(lag(sku_id) over w, sku_id) as sku_id, coalesce(lag(ts) over w, ts) as ts,
         cast(price - activity - coalesce(lag(price - activity) over w, 0) as decimal(18,2)) as order_amount
  from line window w as (partition by id order by {v.REVISION_SQL})"""))
def delta_last_value(spark, sf_dir):
    rows = _revisions(spark, sf_dir).select("id", "sku_id", "ts", "seq", "et", "order_amount")
    changed = deltas(rows, ["id"], ["ts", "seq"], ["order_amount"], attributes="previous")
    return changed.select("id", "sku_id", "ts", *_money("order_amount"))


@query("delta_four_amounts", with_views(v.LINES_SQL, """
  whole as (
    select *, price - activity as total, ts - lag(ts) over w <= 30 * 86400 as near,
           lag(price) over w as price0, lag(activity) over w as activity0, lag(coupon) over w as coupon0,
           lag(price - activity) over w as total0
    from line window w as (partition by id order by """ + v.REVISION_SQL + "))", select="""
  select id, sku_id, ts,
         cast(price - case when near then price0 else 0 end as decimal(18,2)) as original_amount,
         cast(activity - case when near then activity0 else 0 end as decimal(18,2)) as activity_amount,
         cast(coupon - case when near then coupon0 else 0 end as decimal(18,2)) as coupon_amount,
         cast(total - case when near then total0 else 0 end as decimal(18,2)) as order_amount
  from whole"""))
def delta_four_amounts(spark, sf_dir):
    """Changes of four amounts at once; a revision more than 30 days after the last counts whole."""
    rows = _revisions(spark, sf_dir)
    changed = deltas(rows, ["id"], ["ts", "seq"], AMOUNTS, idle=("et", "30 days"))
    return changed.select("id", "sku_id", "ts", *_money(*AMOUNTS))


# ---- enrichment --------------------------------------------------------------------------

@query("enrich_single", """
  select o_orderkey as order_id, o_custkey % 25 as province_id, n_name as province_name
  from orders left join nation on n_nationkey = o_custkey % 25""")
def enrich_single(spark, sf_dir):
    orders = v.given(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 25).alias("province_id"))
    return lookup(orders, v.dimensions(spark, sf_dir)["base_province"], "province_id", "id", {"name": "province_name"})


@query("enrich_snowflake", with_views(v.LINES_SQL, v.DIMENSIONS_SQL, select="""
  select sku_id, n, sku_name, spu_id, spu_name, trademark_id, trademark_name, category3_id, category3_name,
         category2_id, category2_name, category1_id, category1_name
  from (select sku_id, count(*) as n from line group by 1) left join chain using (sku_id)"""))
def enrich_snowflake(spark, sf_dir):
    sold = v.lines(spark, sf_dir).groupBy("sku_id").agg(F.count(F.lit(1)).alias("n"))
    return lookup(sold, flat_sku(v.dimensions(spark, sf_dir)), "sku_id", "sku_id", {
        c: c for c in ("sku_name", "spu_id", "spu_name", "trademark_id", "trademark_name", "category3_id",
                       "category3_name", "category2_id", "category2_name", "category1_id", "category1_name")})


@query("enrich_supplier_chain", """
  select s_suppkey as supplier_id, s_nationkey as nation_id, n_name as nation_name, n_regionkey as region_id,
         r_name as region_name
  from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def enrich_supplier_chain(spark, sf_dir):
    suppliers = v.given(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("nation_id"))
    return enrich(
        suppliers,
        (v.given(spark, sf_dir, "nation"), "nation_id", "n_nationkey",
         {"n_name": "nation_name", "n_regionkey": "region_id"}),
        (v.given(spark, sf_dir, "region"), "region_id", "r_regionkey", {"r_name": "region_name"}))


@query("enrich_missing_key", with_views(v.EVENTS_SQL, select="""
  select event_id, k % 30 as code, n_name as name from ev left join nation on n_nationkey = k % 30"""))
def enrich_missing_key(spark, sf_dir):
    ev = v.events(spark, sf_dir).select("event_id", (F.col("k") % 30).alias("code"))
    return lookup(ev, v.given(spark, sf_dir, "nation"), "code", "n_nationkey", {"n_name": "name"})
