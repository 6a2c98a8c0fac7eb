"""Windowed aggregates over streams; the same rules as ``plans.dws`` on tables.

Inputs are streams with event time ``et`` and no watermark: it is set once per branch, before the
first step with state. Windows come out when the watermark has passed them. First events of a day are
final by then, so the rows equal those of the table however rows come within the lateness.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.enrich import category_steps, enrich, flat_sku, lookup
from millrace.operators.flags import mark_new, mark_returning
from millrace.operators.windows import WIDTH, stamp, tumbling, window_sums
from millrace.functions.columns import money
from millrace.plans import dws
from millrace.sources.logs import LATENESS
from millrace.streaming.stateful import stream_day_changes, stream_first_seen


def keyword_counts(log: DataFrame, width: str = WIDTH, lateness: str = LATENESS, splitter=dws.words) -> DataFrame:
    counted = dws.keyword_rows(log, splitter).withWatermark("et", lateness).groupBy(tumbling(width), "keyword").agg(
        F.count(F.lit(1)).alias("keyword_count"))
    return stamp(counted)


def page_views(log: DataFrame, width: str = WIDTH, order=("et",), lateness: str = LATENESS) -> DataFrame:
    rows = dws.page_view_rows(log, order)

    def part(df, **set_to):
        counts = {c: F.lit(0) for c in ("uv", "sv", "pv", "dur")} | set_to
        return df.select("et", *dws.VISITOR, *[v.cast("long").alias(c) for c, v in counts.items()])

    views = part(rows.withWatermark("et", lateness), pv=F.lit(1), dur=F.col("during_time"))
    visitors = part(stream_day_changes(rows, ["mid"], order, dws.VISITOR, lateness=lateness), uv=F.lit(1))
    sessions = part(stream_first_seen(rows, ["sid"], order, dws.VISITOR, lateness), sv=F.lit(1))
    return window_sums(views.unionByName(visitors).unionByName(sessions), dws.PAGE_VIEW_SUMS, dws.VISITOR, width)


def home_detail_views(log: DataFrame, width: str = WIDTH, lateness: str = LATENESS) -> DataFrame:
    rows = log.where(F.col("page.page_id").isin(dws.HOME, dws.DETAIL)).select(
        "et", F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"))
    firsts = stream_day_changes(rows, ["mid", "page_id"], lateness=lateness)
    return window_sums(firsts, {
        "home_uv_ct": F.when(F.col("page_id") == dws.HOME, 1).otherwise(0),
        "good_detail_uv_ct": F.when(F.col("page_id") == dws.DETAIL, 1).otherwise(0),
    }, width=width)


def logins(log: DataFrame, width: str = WIDTH, back_days: int = dws.RETURN_AFTER_DAYS,
           lateness: str = LATENESS) -> DataFrame:
    rows = dws.login_rows(log)
    flagged = mark_returning(stream_day_changes(rows, ["uid"], lateness=lateness), back_days)
    zeros = rows.withWatermark("et", lateness).select("et", F.lit(0).alias("is_unique"), F.lit(0).alias("is_back"))
    return window_sums(zeros.unionByName(flagged.select("et", "is_unique", "is_back")),
                       {"uu_ct": "is_unique", "back_ct": "is_back"}, width=width)


def registrations(users: DataFrame, width: str = WIDTH, lateness: str = LATENESS) -> DataFrame:
    timed = users.select(F.try_to_timestamp("create_time").alias("et")).where(F.col("et").isNotNull())
    return stamp(timed.withWatermark("et", lateness).groupBy(tumbling(width)).agg(
        F.count(F.lit(1)).alias("register_ct")))


def cart_users(adds: DataFrame, width: str = WIDTH, lateness: str = LATENESS) -> DataFrame:
    return window_sums(stream_day_changes(adds, ["user_id"], lateness=lateness), {"cart_add_uu_ct": F.lit(1)}, width=width)


def payment_users(payments: DataFrame, width: str = WIDTH, lateness: str = LATENESS) -> DataFrame:
    return window_sums(mark_new(stream_day_changes(payments, ["user_id"], lateness=lateness)), {
        "payment_suc_unique_user_count": "is_unique", "payment_suc_new_user_count": "is_new"}, width=width)


def order_users(details: DataFrame, width: str = WIDTH, key: str = "user_id", lateness: str = LATENESS) -> DataFrame:
    return window_sums(mark_new(stream_day_changes(details, [key], lateness=lateness)), {
        "order_unique_user_count": "is_unique", "order_new_user_count": "is_new"}, width=width)


def sku_orders(changed: DataFrame, dims: dict[str, DataFrame], width: str = WIDTH) -> DataFrame:
    """Amounts per window and product from line changes, of the same stream (see ``stateful.stream_deltas``) or of
    a topic with a watermark on ``et``."""
    sums = window_sums(changed, {a: a for a in dws.AMOUNTS}, ["sku_id"], width)
    return sums.join(flat_sku(dims), "sku_id", "left")


def province_orders(changed: DataFrame, details: DataFrame, provinces: DataFrame, width: str = WIDTH,
                    order=("et",), lateness: str = LATENESS) -> DataFrame:
    """Amount changes of lines and first lines of orders, per window and province."""
    amounts = changed.withWatermark("et", lateness).select(
        "et", "province_id", "order_amount", F.lit(0).alias("opened"))
    opened = stream_first_seen(details, ["order_id"], order, ["province_id"], lateness).select(
        "et", "province_id", F.lit(0).cast("decimal(16,2)").alias("order_amount"), F.lit(1).alias("opened"))
    sums = window_sums(amounts.unionByName(opened), {"order_count": "opened", "order_amount": "order_amount"},
                       ["province_id"], width)
    return lookup(sums, provinces, "province_id", "id", {"name": "province_name"})


def brand_user_refunds(refunds: DataFrame, dims: dict[str, DataFrame], width: str = WIDTH,
                       lateness: str = LATENESS) -> DataFrame:
    """Amounts are summed from all rows, orders counted from one row per window, group and order."""
    rows = refunds.select("et", "sku_id", "user_id", "order_id",
                          money(F.col("refund_amount")).alias("refund_amount")).withWatermark("et", lateness)
    keyed = lookup(rows, dims["sku_info"], "sku_id", "id", {"tm_id": "trademark_id", "category3_id": "category3_id"})
    group = ["user_id", "trademark_id", "category3_id"]
    per_order = keyed.groupBy(tumbling(width), *group, "order_id").agg(F.sum("refund_amount").alias("refund_amount"))
    sums = per_order.groupBy(F.window(F.window_time("window"), width).alias("window"), *group).agg(
        F.count("order_id").alias("refund_count"), F.sum("refund_amount").alias("refund_amount"))
    return enrich(stamp(sums), *category_steps(dims))
