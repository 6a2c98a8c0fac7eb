"""The given tables seen as warehouse inputs, for Spark and, as text, for the SQL statements.

==================  ==========================================================================
events              page log; cart changes; registrations
orders              order changes: one insert each, then cancelled (F) or refunded (P)
lineitem            order lines and their revisions, activities, coupons, payments, refunds
documents           comments
nation, region      provinces, code names, product categories
part                products, trademarks
==================  ==========================================================================
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.logs import event_seconds
from millrace.sources.topics import table

DATABASE = "shop"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, f"{sf_dir}/{name}.parquet")


def _text(column) -> Column:
    return F.col(column).cast("string") if isinstance(column, str) else column.cast("string")


def row_map(**entries) -> Column:
    """A row as a string map."""
    pairs = []
    for key, value in entries.items():
        pairs += [F.lit(key), value if isinstance(value, Column) else F.lit(value)]
    return F.create_map(*pairs)


def seconds(column) -> Column:
    return F.unix_seconds(F.col(column).cast("timestamp"))


def stamp_text(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss")


# ---- page log ----------------------------------------------------------------------------

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(given(spark, sf_dir, "events"))


def events_of(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id", "user_id", "event_type", "value",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def page_log_of(ev: DataFrame) -> DataFrame:
    """The page log; ``event_id`` decides between events of the same millisecond."""
    kind = F.col("event_type")
    page_id = F.when(kind == "view", "home").when(kind == "click", "good_detail").otherwise(kind)
    last_page = (F.when(kind == "signup", "login").when(kind == "click", "search")
                 .when(kind == "purchase", "home").when(kind == "error", "list"))
    day = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd")
    item = F.col("item") if "item" in ev.columns else _text("k")
    return ev.select(
        F.struct(
            _text("user_id").alias("mid"),
            F.when(F.col("user_id") % 10 != 0, _text("user_id")).alias("uid"),
            F.concat_ws("-", _text("user_id"), day).alias("sid"),
            kind.alias("ch"),
            F.concat(F.lit("v"), _text(F.col("k") % 3)).alias("vc"),
            _text(F.col("user_id") % 5).alias("ar"),
            F.when((F.col("user_id") + F.col("k")) % 3 == 0, "0").otherwise("1").alias("is_new"),
        ).alias("common"),
        F.struct(
            page_id.alias("page_id"),
            last_page.alias("last_page_id"),
            F.when(F.col("k") % 2 == 0, "keyword").otherwise("sku_id").alias("item_type"),
            item.alias("item"),
            F.round(F.col("value") * 100).cast("bigint").alias("during_time"),
        ).alias("page"),
        "ts", "event_id", "k", kind.alias("event_type"),
        F.timestamp_millis("ts").alias("et"))


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_log_of(events(spark, sf_dir))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page log with product names as items."""
    names = given(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("item"))
    return page_log_of(events(spark, sf_dir).join(names, "k", "left"))


def app_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return app_log_of(page_log(spark, sf_dir))


def app_log_of(log: DataFrame) -> DataFrame:
    """Log records with some of page, start, err, displays and actions, by event type."""
    kind, k = F.col("event_type"), F.col("k")

    def element(**entries):
        return row_map(**entries)

    shown = F.array(element(item=_text("k"), pos="1"), element(item=_text(k + 1), pos="2", ch="inner"))
    acted = F.array(element(action_id="like", item=_text("k")))
    return log.select(
        "common",
        F.when(kind.isin("view", "click", "purchase"), F.col("page")).alias("page"),
        F.when(kind == "signup", element(entry="icon", k=_text("k"))).alias("start"),
        F.when(kind.isin("error", "purchase"), element(code=_text("k"))).alias("err"),
        F.when(kind.isin("view", "error"), shown).alias("displays"),
        F.when(kind.isin("click", "view"), acted).alias("actions"),
        "ts", "event_id")


EVENTS_SQL = """ev as (
  select event_id, user_id, event_type, value, date_trunc('milliseconds', ts) as et,
         epoch_us(ts) // 1000 as ts_ms, cast(json_extract_string(props, '$.k') as int) as k
  from events)"""

PAGE_SQL = EVENTS_SQL + """,
page as (
  select event_id, et, ts_ms, k, event_type, cast(user_id as varchar) as mid,
         case when user_id % 10 <> 0 then cast(user_id as varchar) end as uid,
         cast(user_id as varchar) || '-' || strftime(et, '%Y-%m-%d') as sid,
         event_type as ch, 'v' || cast(k % 3 as varchar) as vc, cast(user_id % 5 as varchar) as ar,
         case when (user_id + k) % 3 = 0 then '0' else '1' end as is_new,
         case event_type when 'view' then 'home' when 'click' then 'good_detail' else event_type end as page_id,
         case event_type when 'signup' then 'login' when 'click' then 'search' when 'purchase' then 'home'
                         when 'error' then 'list' end as last_page_id,
         case when k % 2 = 0 then 'keyword' else 'sku_id' end as item_type,
         cast(round(value * 100) as bigint) as during_time,
         strftime(et, '%Y-%m-%d') as day
  from ev)"""


def window_sql(width: str = "6 hours", et: str = "et") -> str:
    """The three window stamps, as select columns."""
    start = f"time_bucket(interval '{width}', {et})"
    return (f"strftime({start}, '%Y-%m-%d %H:%M:%S') as stt, "
            f"strftime({start} + interval '{width}', '%Y-%m-%d %H:%M:%S') as edt, "
            f"strftime({start}, '%Y-%m-%d') as cur_date")


# ---- order lines -------------------------------------------------------------------------

# Revisions of a line are ordered by ship date and, within a date, by these columns.
REVISION = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _amount(expression: Column) -> Column:
    return F.round(expression, 2).cast("decimal(16,2)")


def lines_of(raw: DataFrame) -> DataFrame:
    """Order lines with amounts; ``id`` repeats once per revision and ``seq`` orders revisions."""
    price = F.col("l_extendedprice").cast("decimal(16,2)")
    ts = seconds("l_shipdate")
    return raw.select(
        F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").cast("int").alias("sku_num"),
        price.alias("price"),
        _amount(price * F.col("l_discount").cast("decimal(4,2)")).alias("activity"),
        _amount(price * F.col("l_tax").cast("decimal(4,2)")).alias("coupon"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.struct(*REVISION).alias("seq"),
        ts.alias("ts"), F.timestamp_seconds(ts).alias("et"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(given(spark, sf_dir, "lineitem"))


def detail_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-line facts in the shape the aggregates take, with buyer and province."""
    orders = given(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey")
    rows = lines(spark, sf_dir).join(orders, "order_id")
    return rows.select(
        "id", "order_id", "sku_id", F.col("o_custkey").alias("user_id"),
        (F.col("o_custkey") % 25).cast("int").alias("province_id"),
        F.col("price").alias("split_original_amount"), F.col("activity").alias("split_activity_amount"),
        F.col("coupon").alias("split_coupon_amount"),
        (F.col("price") - F.col("activity")).cast("decimal(16,2)").alias("split_total_amount"),
        "seq", "ts", "et")


LINES_SQL = """line as (
  select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as id, l_orderkey as order_id,
         l_partkey as sku_id, l_suppkey as supplier_id, cast(l_quantity as int) as sku_num,
         cast(l_extendedprice as decimal(16,2)) as price,
         cast(round(cast(l_extendedprice as decimal(16,2)) * cast(l_discount as decimal(4,2)), 2) as decimal(16,2)) as activity,
         cast(round(cast(l_extendedprice as decimal(16,2)) * cast(l_tax as decimal(4,2)), 2) as decimal(16,2)) as coupon,
         l_discount as discount, l_tax as tax, l_returnflag as flag, l_linestatus as status,
         l_partkey, l_suppkey, l_quantity, l_extendedprice,
         cast(epoch(l_shipdate) as bigint) as ts, l_shipdate as et
  from lineitem)"""

REVISION_SQL = "ts, l_partkey, l_suppkey, l_quantity, l_extendedprice"
LATEST_SQL = ("row_number() over (partition by id order by ts desc, l_partkey desc, l_suppkey desc, "
              "l_quantity desc, l_extendedprice desc) = 1")

DETAIL_SQL = LINES_SQL + """,
detail as (
  select line.*, o_custkey as user_id, o_custkey % 25 as province_id, price - activity as total
  from line join orders on o_orderkey = order_id)"""


# ---- database change log -----------------------------------------------------------------

def _change(rows: DataFrame, table: str, change_type, data: Column, old: Column | None = None,
            seq: Column | None = None, watermark: bool = True) -> DataFrame:
    kind = F.lit(change_type) if isinstance(change_type, str) else change_type
    order = seq if seq is not None else F.struct(*[F.lit(None).cast(t).alias(c) for c, t in zip(
        REVISION, ("bigint", "bigint", "double", "double"))])
    log = rows.select(
        F.lit(DATABASE).alias("database"), F.lit(table).alias("table"), kind.alias("type"),
        data.alias("data"), (old if old is not None else F.lit(None).cast("map<string,string>")).alias("old"),
        F.col("ts"), order.alias("seq"))
    return event_seconds(log) if watermark else log.withColumn("et", F.timestamp_seconds("ts"))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_changes_of(given(spark, sf_dir, "orders"))


def order_changes_of(raw: DataFrame, watermark: bool = True) -> DataFrame:
    """Every order is placed; status F is cancelled after 10 minutes, P refunded after 20 and 30."""
    orders = raw.select(
        "o_orderkey", "o_custkey", "o_orderstatus", seconds("o_orderdate").alias("placed"))

    def state(code, operated):
        return row_map(id=_text("o_orderkey"), user_id=_text("o_custkey"),
                       province_id=_text(F.col("o_custkey") % 25), order_status=code, operate_time=operated)

    def step(status, before, after, delay):
        rows = orders.where(F.col("o_orderstatus") == status).withColumn("ts", F.col("placed") + delay)
        return _change(rows, "order_info", "update", state(after, stamp_text(F.col("ts"))),
                       row_map(order_status=before), watermark=watermark)

    placed = _change(orders.withColumn("ts", F.col("placed")), "order_info", "insert",
                     state("1001", F.lit(None).cast("string")), watermark=watermark)
    return (placed.unionByName(step("F", "1001", "1003", 600))
            .unionByName(step("P", "1002", "1005", 1200))
            .unionByName(step("P", "1005", "1006", 1800)))


def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_changes_of(lines(spark, sf_dir))


def line_changes_of(rows: DataFrame, watermark: bool = True, tables=None) -> DataFrame:
    """Order lines, their activities and coupons, payments and refunds, all from the order lines.

    ``tables`` names the only ones that are wanted: a stream scans its source for each part of a log, taken or not.
    """
    seq = F.col("seq")
    detail = _change(rows, "order_detail", "insert", row_map(
        id=F.col("id"), order_id=_text("order_id"), sku_id=_text("sku_id"),
        sku_name=F.concat(F.lit("sku-"), _text("sku_id")), create_time=stamp_text(F.col("ts")),
        sku_num=_text("sku_num"), order_price=_text("price"),
        split_total_amount=_text((F.col("price") - F.col("activity")).cast("decimal(16,2)")),
        split_activity_amount=_text("activity"), split_coupon_amount=_text("coupon")), seq=seq, watermark=watermark)
    activity = _change(rows.where(F.col("discount") >= 0.05), "order_detail_activity", "insert", row_map(
        order_detail_id=F.col("id"), activity_id=_text(F.round(F.col("discount") * 100).cast("int")),
        activity_rule_id=_text("supplier_id")), seq=seq, watermark=watermark)
    coupon = _change(rows.where(F.col("tax") >= 0.04), "order_detail_coupon", "insert", row_map(
        order_detail_id=F.col("id"), coupon_id=_text(F.round(F.col("tax") * 100).cast("int"))), seq=seq, watermark=watermark)
    paid = rows.where(F.col("status") == "F").withColumn("ts", F.col("ts") + F.col("sku_id") % 3600)
    payment = _change(paid, "payment_info", "update", row_map(
        order_id=_text("order_id"), payment_type=_text(F.col("supplier_id") % 30),
        callback_time=stamp_text(F.col("ts")), payment_status="1602"), row_map(payment_status="1601"), watermark=watermark)

    returned = rows.where(F.col("flag") == "R")

    def refund_state(code):
        return row_map(
            id=F.col("id"), order_id=_text("order_id"), sku_id=_text("sku_id"), refund_status=code,
            refund_type=_text(F.col("supplier_id") % 25), refund_num=_text("sku_num"), refund_amount=_text("price"),
            refund_reason_type=_text(F.col("sku_id") % 30), refund_reason_txt=F.lit("worn"),
            user_id=_text("supplier_id"), operate_time=stamp_text(F.col("ts")))

    agreed = _change(returned, "order_refund_info", "update", refund_state("0702"), row_map(refund_status="0701"), seq=seq, watermark=watermark)
    closed = returned.where(F.col("status") == "F")
    done = _change(closed, "order_refund_info", "update", refund_state("0705"), row_map(refund_status="0702"), seq=seq, watermark=watermark)
    repaid = _change(closed, "refund_payment", "update", row_map(
        id=F.col("id"), order_id=_text("order_id"), sku_id=_text("sku_id"),
        payment_type=_text(F.col("supplier_id") % 30), callback_time=stamp_text(F.col("ts")),
        total_amount=_text("price"), refund_status="1602"), row_map(refund_status="1601"), seq=seq, watermark=watermark)
    parts = [("order_detail", detail), ("order_detail_activity", activity), ("order_detail_coupon", coupon),
             ("payment_info", payment), ("order_refund_info", agreed), ("order_refund_info", done), ("refund_payment", repaid)]
    log, *others = [part for table, part in parts if tables is None or table in tables]
    for part in others:
        log = log.unionByName(part)
    return log


def cart_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cart_changes_of(events(spark, sf_dir))


def cart_changes_of(ev: DataFrame, watermark: bool = True) -> DataFrame:
    """Clicks add entries, purchases change quantities, errors delete entries."""
    rows = ev.where(F.col("event_type").isin("click", "purchase", "error")).withColumn(
        "ts", F.floor(F.col("ts") / 1000))
    kind = (F.when(F.col("event_type") == "click", "insert")
            .when(F.col("event_type") == "purchase", "update").otherwise("delete"))
    bought = F.when(F.col("event_type") == "purchase", F.floor(F.col("value"))).otherwise(F.col("k"))
    data = row_map(id=_text("event_id"), user_id=_text("user_id"), sku_id=_text("k"),
                   sku_num=_text(bought.cast("int")))
    old = F.when(F.col("event_type") == "purchase", row_map(sku_num=_text("k")))
    return _change(rows, "cart_info", kind, data, old, watermark=watermark)


def comment_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comment_changes_of(given(spark, sf_dir, "documents"))


def comment_changes_of(raw: DataFrame) -> DataFrame:
    rows = raw.withColumn("ts", F.col("doc_id"))
    return _change(rows, "comment_info", "insert", row_map(
        id=_text("doc_id"), user_id=F.col("source"), sku_id=F.col("lang"),
        appraise=_text(F.col("n_chars") % 30), comment_txt=F.col("text")))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes of all source tables in one log; ``seq`` orders changes of one second."""
    log = order_changes(spark, sf_dir)
    for part in (line_changes, cart_changes, comment_changes):
        log = log.unionByName(part(spark, sf_dir))
    return log


# ---- dimensions --------------------------------------------------------------------------

def base_dic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "nation").select(
        _text("n_nationkey").alias("dic_code"), F.struct(F.col("n_name").alias("dic_name")).alias("info"))


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Products with trademark and three category levels: nation, region and a half of the regions."""
    part = given(spark, sf_dir, "part")
    nation = given(spark, sf_dir, "nation")
    region = given(spark, sf_dir, "region")
    return {
        "sku_info": part.select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("sku_name"), F.col("p_size").alias("spu_id"),
            (F.col("p_size") % 30).alias("category3_id"), F.col("p_brand").alias("tm_id")),
        "spu_info": part.select(F.col("p_size").alias("id")).distinct().withColumn(
            "spu_name", F.concat(F.lit("spu-"), _text("id"))),
        "base_trademark": part.select(F.col("p_brand").alias("id")).distinct().withColumn(
            "tm_name", F.upper("id")),
        "base_category3": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                                        F.col("n_regionkey").alias("category2_id")),
        "base_category2": region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"),
                                        (F.col("r_regionkey") % 2).alias("category1_id")),
        "base_category1": region.select((F.col("r_regionkey") % 2).alias("id")).distinct().withColumn(
            "name", F.concat(F.lit("half-"), _text("id"))),
        "base_province": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
    }


# Category 3 is missing for p_size % 30 >= 25, so the chain has broken links.
DIMENSIONS_SQL = """sku_info as (
  select p_partkey as id, p_name as sku_name, p_size as spu_id, p_size % 30 as category3_id, p_brand as tm_id from part),
chain as (
  select s.id as sku_id, s.sku_name, s.spu_id, 'spu-' || cast(s.spu_id as varchar) as spu_name,
         s.tm_id as trademark_id, upper(s.tm_id) as trademark_name,
         s.category3_id, n.n_name as category3_name, n.n_regionkey as category2_id,
         r.r_name as category2_name, r.r_regionkey % 2 as category1_id,
         'half-' || cast(r.r_regionkey % 2 as varchar) as category1_name
  from sku_info s left join nation n on s.category3_id = n.n_nationkey
  left join region r on n.n_regionkey = r.r_regionkey)"""
