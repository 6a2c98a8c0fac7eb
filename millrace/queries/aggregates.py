"""Window aggregate and report queries.

The given events are sparse, so most queries use 6-hour windows to have several rows in a group;
``win_page_view_5s`` keeps the default width.
"""

from pyspark.sql import functions as F

from millrace.functions.keywords import explode_words
from millrace.operators.windows import stamp, tumbling
from millrace.plans import ads, dwd, dws
from millrace.queries import views as v
from millrace.queries.registry import query, with_views
from millrace.session import shared_folder

WIDTH = "6 hours"
STAMPS = v.window_sql(WIDTH)


def _longs(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _money(df, *names):
    return df.withColumns({n: F.col(n).cast("decimal(18,2)") for n in names})


@query("win_keyword_count", with_views(v.EVENTS_SQL, """
  searched as (
    select et, lower(p_name) as text from ev join part on p_partkey = k
    where event_type in ('click', 'purchase') and k % 2 = 0),
  word as (select et, unnest(list_distinct(string_split_regex(text, '[^\\p{L}\\p{M}\\p{N}]+'))) as keyword from searched)""",
    select=f"select {STAMPS}, keyword, count(*) as keyword_count from word where keyword <> '' group by all"))
def win_keyword_count(spark, sf_dir):
    return dws.keyword_counts(v.search_log(spark, sf_dir), WIDTH)


@query("keyword_split_texts", """
  select keyword, count(*) as turns, count(distinct conv_id) as conversations
  from (select conv_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'))) as keyword
        from conversations)
  where keyword <> '' group by keyword""")
def keyword_split_texts(spark, sf_dir):
    """Distinct words of whole conversation turns, counted over turns and conversations."""
    turns = v.given(spark, sf_dir, "conversations").select("conv_id", "text")
    # Words are counted per conversation first, so a frequent word is spread over conversations.
    per_conversation = explode_words(turns, "text").groupBy("keyword", "conv_id").agg(
        F.count(F.lit(1)).alias("turns"))
    return per_conversation.groupBy("keyword").agg(
        F.sum("turns").alias("turns"), F.count("conv_id").alias("conversations"))


def page_view_sql(width, views=v.PAGE_SQL, pages="page"):
    return with_views(views, f"""
  flagged as (
    select *, case when lag(day) over (partition by mid order by et, event_id) is distinct from day then 1 else 0 end as uv,
           case when row_number() over (partition by sid order by et, event_id) = 1 then 1 else 0 end as sv
    from {pages})""", select=f"""
  select {v.window_sql(width)}, vc, ch, ar, is_new, cast(sum(uv) as bigint) as uv_ct, cast(sum(sv) as bigint) as sv_ct,
         count(*) as pv_ct, cast(sum(during_time) as bigint) as dur_sum
  from flagged group by all""")


@query("win_page_view", page_view_sql(WIDTH))
def win_page_view(spark, sf_dir):
    return dws.page_views(v.page_log(spark, sf_dir), WIDTH, ["et", "event_id"])


@query("win_page_view_5s", page_view_sql("5 seconds"))
def win_page_view_5s(spark, sf_dir):
    return dws.page_views(v.page_log(spark, sf_dir), order=["et", "event_id"])


@query("win_home_detail_uv", with_views(v.PAGE_SQL, """
  flagged as (
    select *, lag(day) over (partition by mid, page_id order by et, event_id) is distinct from day as first
    from page where page_id in ('home', 'good_detail'))""", select=f"""
  select {STAMPS}, cast(sum(case when page_id = 'home' then 1 else 0 end) as bigint) as home_uv_ct,
         cast(sum(case when page_id = 'good_detail' then 1 else 0 end) as bigint) as good_detail_uv_ct
  from flagged where first group by all"""))
def win_home_detail_uv(spark, sf_dir):
    return dws.home_detail_views(v.page_log(spark, sf_dir), WIDTH)


@query("win_login", with_views(v.PAGE_SQL, """
  flagged as (
    select *, lag(day) over (partition by uid order by et, event_id) as last_day
    from page where uid is not null and (last_page_id is null or last_page_id = 'login'))""", select=f"""
  select {STAMPS}, cast(sum(case when last_day is distinct from day then 1 else 0 end) as bigint) as uu_ct,
         cast(sum(case when last_day is distinct from day and et > cast(last_day as timestamp) + interval '2 days'
                       then 1 else 0 end) as bigint) as back_ct
  from flagged group by all"""))
def win_login(spark, sf_dir):
    return dws.logins(v.page_log(spark, sf_dir), WIDTH, back_days=2)


@query("win_register", with_views(v.EVENTS_SQL, select=f"""
  select {STAMPS}, count(*) as register_ct from ev where event_type = 'signup' group by all"""))
def win_register(spark, sf_dir):
    users = v.events(spark, sf_dir).where(F.col("event_type") == "signup").select(
        F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd HH:mm:ss").alias("create_time"))
    return dws.registrations(users, WIDTH)


@query("win_cart_uu", with_views(v.EVENTS_SQL, """
  added as (
    select user_id, event_id, date_trunc('second', et) as et from ev
    where event_type = 'click' or (event_type = 'purchase' and floor(value) > k)),
  flagged as (
    select *, lag(cast(et as date)) over (partition by user_id order by et, event_id) is distinct from cast(et as date) as first
    from added)""", select=f"""
  select {STAMPS}, count(*) as cart_add_uu_ct from flagged where first group by all"""))
def win_cart_uu(spark, sf_dir):
    return dws.cart_users(dwd.cart_adds(v.change_log(spark, sf_dir), v.DATABASE), WIDTH)


def _users_sql(view, key, unique, new):
    return f"""
  flagged as (
    select et, lag(cast(et as date)) over (partition by {key} order by et) as last_day, cast(et as date) as day
    from {view})""", f"""
  select {STAMPS}, count(*) as {unique}, cast(sum(case when last_day is null then 1 else 0 end) as bigint) as {new}
  from flagged where last_day is distinct from day group by all"""


_PAY = _users_sql("(select * from ev where event_type = 'purchase')", "user_id",
                  "payment_suc_unique_user_count", "payment_suc_new_user_count")


@query("win_payment", with_views(v.EVENTS_SQL, _PAY[0], select=_PAY[1]))
def win_payment(spark, sf_dir):
    paid = v.events(spark, sf_dir).where(F.col("event_type") == "purchase").select(
        "user_id", F.timestamp_millis("ts").alias("et"))
    return dws.payment_users(paid, WIDTH)


_ORDER = _users_sql("detail", "user_id", "order_unique_user_count", "order_new_user_count")
_ORDER_ID = _users_sql("line", "order_id", "order_unique_user_count", "order_new_user_count")


@query("win_order", with_views(v.DETAIL_SQL, _ORDER[0], select=_ORDER[1]))
def win_order(spark, sf_dir):
    return dws.order_users(v.detail_facts(spark, sf_dir), WIDTH)


@query("win_order_by_order", with_views(v.LINES_SQL, _ORDER_ID[0], select=_ORDER_ID[1]))
def win_order_by_order(spark, sf_dir):
    return dws.order_users(v.lines(spark, sf_dir), WIDTH, key="order_id")


DELTA_SQL = v.LINES_SQL + f""",
changed as (
  select id, sku_id, et, price - coalesce(lag(price) over w, 0) as original_amount,
         activity - coalesce(lag(activity) over w, 0) as activity_amount,
         coupon - coalesce(lag(coupon) over w, 0) as coupon_amount,
         price - activity - coalesce(lag(price - activity) over w, 0) as order_amount
  from line window w as (partition by id order by {v.REVISION_SQL}))"""

SKU_SUMS = ", ".join(f"cast(sum({a}) as decimal(18,2)) as {a}" for a in dws.AMOUNTS)


@query("win_sku_order", with_views(DELTA_SQL, v.DIMENSIONS_SQL, select=f"""
  select s.*, chain.* exclude (sku_id) from
    (select {STAMPS}, sku_id, {SKU_SUMS} from changed group by all) s left join chain using (sku_id)"""))
def win_sku_order(spark, sf_dir):
    rows = dws.sku_orders(_line_facts(spark, sf_dir), v.dimensions(spark, sf_dir), WIDTH, ["et", "seq"])
    return _money(rows, *dws.AMOUNTS)


def _line_facts(spark, sf_dir):
    """The columns of the line facts that need no order."""
    return v.lines(spark, sf_dir).select(
        "id", "order_id", "sku_id", F.col("price").alias("split_original_amount"),
        F.col("activity").alias("split_activity_amount"), F.col("coupon").alias("split_coupon_amount"),
        (F.col("price") - F.col("activity")).cast("decimal(16,2)").alias("split_total_amount"), "seq", "ts", "et")


def _sku_amounts(spark, sf_dir, **options):
    return dws.sku_amounts(_line_facts(spark, sf_dir), WIDTH, ["et", "seq"], **options)


@query("win_sku_order_by_line", with_views(DELTA_SQL, select=f"""
  select {STAMPS}, id, sku_id, {SKU_SUMS} from changed group by all"""))
def win_sku_order_by_line(spark, sf_dir):
    return _money(_sku_amounts(spark, sf_dir, grain="id"), *dws.AMOUNTS)


@query("win_province_order", with_views(v.DETAIL_SQL, f"""
  changed as (
    select coalesce(lag(et) over w, et) as et, coalesce(lag(province_id) over w, province_id) as province_id,
           total - coalesce(lag(total) over w, 0) as amount, 0 as opened
    from detail window w as (partition by id order by {v.REVISION_SQL})),
  opened as (
    select et, province_id, 0 as amount, 1 as opened from detail
    qualify row_number() over (partition by order_id order by {v.REVISION_SQL}) = 1)""", select=f"""
  select s.*, n_name as province_name from (
    select {STAMPS}, cast(province_id as int) as province_id, cast(sum(opened) as bigint) as order_count,
           cast(sum(amount) as decimal(18,2)) as order_amount
    from (select * from changed union all select * from opened) group by all) s
  left join nation on n_nationkey = province_id"""))
def win_province_order(spark, sf_dir):
    rows = dws.province_orders(v.detail_facts(spark, sf_dir), v.dimensions(spark, sf_dir)["base_province"],
                               WIDTH, ["et", "seq"])
    return _money(rows, "order_amount")


@query("win_refund_brand_user", with_views(v.LINES_SQL, v.DIMENSIONS_SQL, select=f"""
  select {STAMPS}, supplier_id as user_id, trademark_id, category3_id, trademark_name, category3_name, category2_id,
         category2_name, category1_id, category1_name, count(distinct order_id) as refund_count,
         cast(sum(price) as decimal(18,2)) as refund_amount
  from line left join chain using (sku_id) where flag = 'R' group by all"""))
def win_refund_brand_user(spark, sf_dir):
    refunds = v.lines(spark, sf_dir).where(F.col("flag") == "R").select(
        "et", "sku_id", "order_id", F.col("supplier_id").alias("user_id"), F.col("price").alias("refund_amount"))
    return _money(dws.brand_user_refunds(refunds, v.dimensions(spark, sf_dir), WIDTH), "refund_amount")


@query("agg_first_row_attrs", with_views(v.EVENTS_SQL, select=f"""
  select {STAMPS}, event_type, min_by(user_id, event_id) as user_id, min_by(k, event_id) as k, count(*) as n
  from ev group by 1, 2, 3, event_type"""))
def agg_first_row_attrs(spark, sf_dir):
    """Totals per window with the other columns taken from the first row."""
    ev = v.events(spark, sf_dir).withColumn("et", F.timestamp_millis("ts"))
    first = F.min(F.struct("et", "event_id", "user_id", "k")).alias("first")
    rows = ev.groupBy(tumbling(WIDTH), "event_type").agg(first, F.count(F.lit(1)).alias("n"))
    return stamp(rows.select("window", "event_type", "first.user_id", "first.k", "n"))


@query("agg_distinct_ids", with_views(v.LINES_SQL, select="""
  select supplier_id, strftime(et, '%Y-%m') as month, count(distinct order_id) as orders,
         cast(sum(price) as decimal(18,2)) as amount
  from line group by all"""))
def agg_distinct_ids(spark, sf_dir):
    rows = v.lines(spark, sf_dir).withColumn("month", F.date_format("et", "yyyy-MM"))
    return _money(rows.groupBy("supplier_id", "month").agg(
        F.count_distinct("order_id").alias("orders"), F.sum("price").alias("amount")), "amount")


@query("gmv_by_day", with_views(DELTA_SQL, select="""
  select strftime(et, '%Y-%m-%d') as cur_date, cast(sum(order_amount) as decimal(18,2)) as order_amount
  from changed group by all"""))
def gmv_by_day(spark, sf_dir):
    return _money(ads.gmv_by_day(_sku_amounts(spark, sf_dir)), "order_amount")


@query("gmv_response", with_views(DELTA_SQL, select="""
  select cur_date, '{"status":0,"msg":"","data":' || cast(cast(trunc(amount) as bigint) as varchar) || '}' as response
  from (select strftime(et, '%Y-%m-%d') as cur_date, sum(order_amount) as amount from changed group by all)"""))
def gmv_response(spark, sf_dir):
    return ads.gmv_response(ads.gmv_by_day(_sku_amounts(spark, sf_dir)))


@query("gmv_of_day", with_views(DELTA_SQL, select="""
  select cast(coalesce(sum(order_amount), 0) as decimal(18,2)) as order_amount
  from changed where strftime(et, '%Y-%m-%d') = '1998-07-01'"""))
def gmv_of_day(spark, sf_dir):
    """One day out of the stored aggregate, which is partitioned by day.

    Rows of a day meet before they are written, so there are about as many files as days; days with very many rows are split.
    """
    path = shared_folder(spark, "sku-amounts")
    _sku_amounts(spark, sf_dir).hint("rebalance", "cur_date").write.partitionBy("cur_date").parquet(path)
    stored = spark.read.option("recursiveFileLookup", "false").parquet(path)
    stored = stored.withColumn("cur_date", F.col("cur_date").cast("string"))
    return _money(ads.gmv(stored, "1998-07-01"), "order_amount")
