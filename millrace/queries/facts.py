"""Detail-fact queries."""

from pyspark.sql import functions as F

from millrace.plans import dwd
from millrace.operators.joins import interval_join, keyed_join
from millrace.queries import views as v
from millrace.queries.registry import query, with_views

DIC_SQL = "dic as (select cast(n_nationkey as varchar) as dic_code, n_name as dic_name from nation)"

FACT_LINE_SQL = v.LINES_SQL + f""",
latest as (select * from line qualify {v.LATEST_SQL}),
act as (select id as line_id, cast(cast(round(discount * 100) as int) as varchar) as activity_id,
               cast(supplier_id as varchar) as activity_rule_id
        from line where discount >= 0.05 qualify {v.LATEST_SQL}),
cou as (select id as line_id, cast(cast(round(tax * 100) as int) as varchar) as coupon_id
        from line where tax >= 0.04 qualify {v.LATEST_SQL}),
fact as (
  select l.id, cast(l.order_id as varchar) as order_id, cast(o_custkey as varchar) as user_id,
         cast(l.sku_id as varchar) as sku_id, 'sku-' || cast(l.sku_id as varchar) as sku_name,
         cast(o_custkey % 25 as varchar) as province_id, act.activity_id, act.activity_rule_id, cou.coupon_id,
         strftime(l.et, '%Y-%m-%d') as date_id, strftime(l.et, '%Y-%m-%d %H:%M:%S') as create_time,
         cast(l.sku_num as varchar) as sku_num,
         cast(cast(cast(l.sku_num as decimal(16,2)) * l.price as decimal(33,4)) as varchar) as split_original_amount,
         cast(l.activity as varchar) as split_activity_amount, cast(l.coupon as varchar) as split_coupon_amount,
         cast(cast(l.price - l.activity as decimal(16,2)) as varchar) as split_total_amount, l.ts
  from latest l join orders on o_orderkey = l.order_id
  left join act on act.line_id = l.id left join cou on cou.line_id = l.id)"""


def _details(spark, sf_dir):
    log = v.change_log(spark, sf_dir)
    return log, dwd.order_details(log, v.DATABASE, order=("ts", "seq"))


@query("fact_comment_lookup", with_views(DIC_SQL, select="""
  select cast(doc_id as varchar) as id, source as user_id, lang as sku_id,
         cast(n_chars % 30 as varchar) as appraise, dic_name as appraise_name, text as comment_txt, doc_id as ts
  from documents left join dic on dic_code = cast(n_chars % 30 as varchar)"""))
def fact_comment_lookup(spark, sf_dir):
    return dwd.comments(v.change_log(spark, sf_dir), v.base_dic(spark, sf_dir), v.DATABASE).drop("et")


@query("fact_cart_add_delta", with_views(v.EVENTS_SQL, select="""
  select cast(event_id as varchar) as id, cast(user_id as varchar) as user_id, cast(k as varchar) as sku_id,
         case event_type when 'click' then cast(k as varchar)
              else cast(cast(floor(value) as int) - k as varchar) end as sku_num,
         ts_ms // 1000 as ts
  from ev where event_type = 'click' or (event_type = 'purchase' and floor(value) > k)"""))
def fact_cart_add_delta(spark, sf_dir):
    return dwd.cart_adds(v.change_log(spark, sf_dir), v.DATABASE).drop("et")


@query("fact_order_detail", with_views(FACT_LINE_SQL, select="select * from fact"))
def fact_order_detail(spark, sf_dir):
    return _details(spark, sf_dir)[1].drop("et")


@query("fact_cancel_detail", with_views(FACT_LINE_SQL, select="""
  select id, order_id, user_id, sku_id, sku_name, province_id, activity_id, activity_rule_id, coupon_id,
         strftime(o_orderdate + interval '10 minutes', '%Y-%m-%d') as date_id, sku_num,
         strftime(o_orderdate + interval '10 minutes', '%Y-%m-%d %H:%M:%S') as cancel_time,
         split_original_amount, split_activity_amount, split_coupon_amount, split_total_amount,
         cast(epoch(o_orderdate) as bigint) + 600 as ts
  from fact join orders on cast(o_orderkey as varchar) = order_id where o_orderstatus = 'F'"""))
def fact_cancel_detail(spark, sf_dir):
    log, details = _details(spark, sf_dir)
    return dwd.cancelled_details(log, details, v.DATABASE).drop("et")


@query("fact_pay_interval", with_views(FACT_LINE_SQL, DIC_SQL, """
  pay as (select cast(order_id as varchar) as order_id, cast(supplier_id % 30 as varchar) as payment_type,
                 ts + sku_id % 3600 as ts from line where status = 'F')""", select="""
  select id as order_detail_id, fact.order_id, user_id, sku_id, sku_name, province_id, activity_id,
         activity_rule_id, coupon_id, payment_type as payment_type_code, dic_name as payment_type_name,
         strftime(make_timestamp(pay.ts * 1000000), '%Y-%m-%d %H:%M:%S') as callback_time, sku_num,
         split_original_amount, split_activity_amount, split_coupon_amount,
         split_total_amount as split_payment_amount, pay.ts
  from pay join fact on pay.order_id = fact.order_id and fact.ts between pay.ts - 1800 and pay.ts + 5
  join dic on payment_type = dic_code"""))
def fact_pay_interval(spark, sf_dir):
    log, details = _details(spark, sf_dir)
    return dwd.paid_details(log, details, v.base_dic(spark, sf_dir), v.DATABASE).drop("et")


def refund_sql(lines):
    return with_views(v.LINES_SQL, DIC_SQL, select=f"""
  select id, cast(supplier_id as varchar) as user_id, cast(order_id as varchar) as order_id,
         cast(sku_id as varchar) as sku_id, cast(o_custkey % 25 as varchar) as province_id,
         strftime(et, '%Y-%m-%d') as date_id, strftime(et, '%Y-%m-%d %H:%M:%S') as operate_time,
         d1.dic_code as refund_type, d1.dic_name as refund_type_name, d2.dic_code as refund_reason_type,
         d2.dic_name as refund_reason_type_name, 'worn' as refund_reason_txt, cast(sku_num as varchar) as refund_num,
         cast(price as varchar) as refund_amount, ts
  from ({lines}) join orders on o_orderkey = order_id and o_orderstatus = 'P'
  join dic d1 on d1.dic_code = cast(supplier_id % 25 as varchar)
  join dic d2 on d2.dic_code = cast(sku_id % 30 as varchar)""")


RETURNED = "select * from line where flag = 'R'"
CLOSED = RETURNED + " and status = 'F'"


@query("fact_refund_two_lookups", refund_sql(f"{RETURNED} qualify {v.LATEST_SQL}"))
def fact_refund_two_lookups(spark, sf_dir):
    return dwd.refunds(v.change_log(spark, sf_dir), v.base_dic(spark, sf_dir), v.DATABASE, order=("ts", "seq")).drop("et")


def refund_payment_sql(paid, done):
    return with_views(v.LINES_SQL, DIC_SQL, select=f"""
  select p.id, cast(o_custkey as varchar) as user_id, cast(p.order_id as varchar) as order_id,
         cast(p.sku_id as varchar) as sku_id, cast(o_custkey % 25 as varchar) as province_id,
         dic_code as payment_type_code, dic_name as payment_type_name, strftime(p.et, '%Y-%m-%d') as date_id,
         strftime(p.et, '%Y-%m-%d %H:%M:%S') as callback_time, cast(r.sku_num as varchar) as refund_num,
         cast(p.price as varchar) as refund_amount, p.ts
  from ({paid}) p join ({done}) r on p.order_id = r.order_id and p.sku_id = r.sku_id
  join orders on o_orderkey = p.order_id and o_orderstatus = 'P'
  join dic on dic_code = cast(p.supplier_id % 30 as varchar)""")


@query("fact_refund_pay_composite", refund_payment_sql(
    f"{CLOSED} qualify {v.LATEST_SQL}", f"{CLOSED} qualify {v.LATEST_SQL.replace('partition by id', 'partition by order_id, sku_id')}"))
def fact_refund_pay_composite(spark, sf_dir):
    return dwd.refund_payments(v.change_log(spark, sf_dir), v.base_dic(spark, sf_dir), v.DATABASE, order=("ts", "seq")).drop("et")


@query("join_interval_events", with_views(v.EVENTS_SQL, select="""
  select p.event_id as purchase_id, c.event_id as click_id, p.user_id
  from ev p join ev c on p.user_id = c.user_id and c.et between p.et - interval '30 minutes' and p.et + interval '5 seconds'
  where p.event_type = 'purchase' and c.event_type = 'click'"""))
def join_interval_events(spark, sf_dir):
    """Clicks up to 30 minutes before and 5 seconds after a purchase of the same user."""
    ev = v.events(spark, sf_dir).withColumn("et", F.timestamp_millis("ts"))
    bought = ev.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("purchase_id"), "user_id", "et")
    clicked = ev.where(F.col("event_type") == "click").select(F.col("event_id").alias("click_id"), "user_id", "et")
    return interval_join(bought, clicked, {"user_id": "user_id"}, dwd.PAY_WITHIN_S, dwd.PAY_AHEAD_S).drop("et")


@query("join_left_unmatched", """
  select o_orderkey as order_id, c_custkey as customer_id, c_name as name
  from orders left join customer on o_custkey = c_custkey and c_mktsegment = 'MACHINERY'""")
def join_left_unmatched(spark, sf_dir):
    """A regular left join; orders of other customers stay with nulls."""
    orders = v.given(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey")
    customers = v.given(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "MACHINERY").select(
        "c_custkey", F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))
    return keyed_join(orders, customers, {"o_custkey": "c_custkey"}, "left").drop("o_custkey")
