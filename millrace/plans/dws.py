"""Windowed aggregates.

Inputs are the page log (``common``, ``page``, ``et``) and the detail facts (``ts``, ``et``) as
tables. ``order`` lists the columns that decide which of two events of a key came first. The
default window is 5 seconds wide.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import money
from millrace.functions.keywords import explode_words, words
from millrace.operators.deltas import deltas
from millrace.operators.enrich import category_steps, enrich, flat_sku, lookup
from millrace.operators.flags import daily_and_new, first_of_day, first_seen, returning
from millrace.operators.windows import WIDTH, stamp, tumbling, window_sums

# Pages and item types the aggregates select on.
HOME, DETAIL, SEARCH, LOGIN, KEYWORD = "home", "good_detail", "search", "login", "keyword"
RETURN_AFTER_DAYS = 7

VISITOR = ["vc", "ch", "ar", "is_new"]
AMOUNTS = ["original_amount", "activity_amount", "coupon_amount", "order_amount"]


def keyword_rows(log: DataFrame, splitter=words) -> DataFrame:
    """One row per distinct word of each search."""
    searches = log.where(
        F.col("page.last_page_id").isin(HOME, SEARCH)
        & (F.col("page.item_type") == KEYWORD)
        & F.col("page.item").isNotNull()
    ).select("et", F.col("page.item").alias("_text"))
    return explode_words(searches, "_text", splitter=splitter)


def keyword_counts(log: DataFrame, width: str = WIDTH, splitter=words) -> DataFrame:
    """Searches per window and word."""
    counted = keyword_rows(log, splitter).groupBy(tumbling(width), "keyword").agg(
        F.count(F.lit(1)).alias("keyword_count"))
    return stamp(counted)


def page_view_rows(log: DataFrame, order=("et",)) -> DataFrame:
    common = [F.col(f"common.{c}").alias(c) for c in ["mid", "sid", *VISITOR]]
    extra = [c for c in order if c != "et"]
    return log.select("et", *extra, *common, F.coalesce("page.during_time", F.lit(0)).alias("during_time"))


PAGE_VIEW_SUMS = {"uv_ct": "uv", "sv_ct": "sv", "pv_ct": "pv", "dur_sum": "dur"}


def page_views(log: DataFrame, width: str = WIDTH, order=("et",)) -> DataFrame:
    """Visitors of the day, new sessions, views and time per window and visitor class.

    Visitors and sessions are first events per (device, day) and per session, views are counted
    in place; the three parts are summed up together. No part shuffles all rows.
    """
    rows = page_view_rows(log, order)

    def part(df, **set_to):
        counts = {c: F.lit(0).cast("long") for c in ("uv", "sv", "pv", "dur")} | set_to
        return df.select("et", *VISITOR, *[v.cast("long").alias(c) for c, v in counts.items()])

    views = part(rows, pv=F.lit(1), dur=F.col("during_time"))
    visitors = part(first_of_day(rows, ["mid"], order, VISITOR), uv=F.lit(1))
    sessions = part(first_seen(rows, ["sid"], order, VISITOR), sv=F.lit(1))
    # The views are summed per window before the union, so they meet the few first events as totals.
    keys = [F.window("et", width).alias("window"), *VISITOR]
    totals = [p.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("uv", "sv", "pv", "dur")])
              for p in (views, visitors, sessions)]
    united = totals[0].unionByName(totals[1]).unionByName(totals[2])
    return stamp(united.groupBy("window", *VISITOR).agg(
        *[F.sum(v).alias(k) for k, v in PAGE_VIEW_SUMS.items()]))


def home_detail_views(log: DataFrame, width: str = WIDTH) -> DataFrame:
    """Devices that see the home page, and any detail page, for the first time that day."""
    rows = log.where(F.col("page.page_id").isin(HOME, DETAIL)).select(
        "et", F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"))
    firsts = first_of_day(rows, ["mid", "page_id"])
    return window_sums(firsts, {
        "home_uv_ct": F.when(F.col("page_id") == HOME, 1).otherwise(0),
        "good_detail_uv_ct": F.when(F.col("page_id") == DETAIL, 1).otherwise(0),
    }, width=width)


def login_rows(log: DataFrame) -> DataFrame:
    last_page = F.col("page.last_page_id")
    return log.where(
        (last_page.isNull() | (last_page == LOGIN)) & F.col("common.uid").isNotNull()
    ).select("et", F.col("common.uid").alias("uid"))


def logins(log: DataFrame, width: str = WIDTH, back_days: int = RETURN_AFTER_DAYS) -> DataFrame:
    """Users of the day and users back after a pause; windows with logins but no first one show zeros."""
    rows = login_rows(log)
    flagged = returning(rows, ["uid"], back_days).select(
        tumbling(width), F.col("is_unique").alias("uu"), F.col("is_back").alias("back"))
    zeros = rows.select(tumbling(width)).distinct().select("window", F.lit(0).alias("uu"), F.lit(0).alias("back"))
    return stamp(flagged.unionByName(zeros).groupBy("window").agg(
        F.sum("uu").alias("uu_ct"), F.sum("back").alias("back_ct")))


def registrations(users: DataFrame, width: str = WIDTH) -> DataFrame:
    """New users per window of their text ``create_time``."""
    timed = users.select(F.try_to_timestamp("create_time").alias("et"))
    return stamp(timed.where(F.col("et").isNotNull()).groupBy(tumbling(width)).agg(
        F.count(F.lit(1)).alias("register_ct")))


def cart_users(adds: DataFrame, width: str = WIDTH) -> DataFrame:
    """Users of the day who put something into a cart."""
    return window_sums(first_of_day(adds, ["user_id"]), {"cart_add_uu_ct": F.lit(1)}, width=width)


def payment_users(payments: DataFrame, width: str = WIDTH) -> DataFrame:
    """Payers of the day and first-ever payers."""
    return window_sums(daily_and_new(payments, ["user_id"]), {
        "payment_suc_unique_user_count": "is_unique", "payment_suc_new_user_count": "is_new"}, width=width)


def order_users(details: DataFrame, width: str = WIDTH, key: str = "user_id") -> DataFrame:
    """Buyers of the day and first-ever buyers; ``key="order_id"`` counts orders instead."""
    return window_sums(daily_and_new(details, [key]), {
        "order_unique_user_count": "is_unique", "order_new_user_count": "is_new"}, width=width)


def amount_rows(details: DataFrame, order) -> DataFrame:
    """Order lines with the four amounts as decimals, for :func:`sku_amounts` and its stream form."""
    extra = [c for c in order if c != "et"]
    return details.select(
        "id", "sku_id", "et", *extra,
        money(F.col("split_original_amount")).alias("original_amount"),
        F.coalesce(money(F.col("split_activity_amount")), F.lit(0)).cast("decimal(16,2)").alias("activity_amount"),
        F.coalesce(money(F.col("split_coupon_amount")), F.lit(0)).cast("decimal(16,2)").alias("coupon_amount"),
        money(F.col("split_total_amount")).alias("order_amount"))


def sku_amounts(details: DataFrame, width: str = WIDTH, order=("et",), grain: str = "sku_id") -> DataFrame:
    """Ordered amounts per window and product; ``grain="id"`` keeps one row per order line.

    Revisions of a line count with their change only.
    """
    changed = deltas(amount_rows(details, order), ["id"], list(order), AMOUNTS)
    keys = ["sku_id"] if grain == "sku_id" else ["id", "sku_id"]
    return window_sums(changed, {a: a for a in AMOUNTS}, keys, width)


def sku_orders(details: DataFrame, dims: dict[str, DataFrame], width: str = WIDTH, order=("et",),
               grain: str = "sku_id") -> DataFrame:
    """:func:`sku_amounts` with the whole product chain, flattened to one row per product and joined once."""
    amounts = sku_amounts(details, width, order, grain)
    return amounts.join(flat_sku(dims), "sku_id", "left")


def province_orders(details: DataFrame, provinces: DataFrame, width: str = WIDTH, order=("et",)) -> DataFrame:
    """Ordered amount and new orders per window and province.

    A change of a line counts where and when the revision before it did. The first row of an order
    is the first revision of one of its lines, so both parts come from the same rows.
    """
    extra = [c for c in order if c != "et"]
    rows = details.select("id", "order_id", "province_id", "et", *extra,
                          money(F.col("split_total_amount")).alias("order_amount"))
    changed = deltas(rows, ["id"], list(order), ["order_amount"], attributes="previous", first="_first")
    opened = first_seen(changed.where("_first"), ["order_id"], order, ["province_id"])
    money_part = changed.select("et", "province_id", "order_amount", F.lit(0).alias("opened"))
    order_part = opened.select("et", "province_id", F.lit(0).cast("decimal(16,2)").alias("order_amount"),
                               F.lit(1).alias("opened"))
    sums = window_sums(money_part.unionByName(order_part),
                       {"order_count": "opened", "order_amount": "order_amount"}, ["province_id"], width)
    return lookup(sums, provinces, "province_id", "id", {"name": "province_name"})


def brand_user_refunds(refunds: DataFrame, dims: dict[str, DataFrame], width: str = WIDTH) -> DataFrame:
    """Refunded amount and distinct refunded orders per window, user, trademark and category.

    The distinct count is spread by order id before it is summed up, so a hot group is counted
    by many tasks.
    """
    keyed = lookup(
        refunds.select("et", "sku_id", "user_id", "order_id", money(F.col("refund_amount")).alias("refund_amount")),
        dims["sku_info"], "sku_id", "id", {"tm_id": "trademark_id", "category3_id": "category3_id"})
    group = ["user_id", "trademark_id", "category3_id"]
    per_order = keyed.groupBy(tumbling(width), *group, "order_id").agg(F.sum("refund_amount").alias("refund_amount"))
    sums = per_order.groupBy("window", *group).agg(
        F.count("order_id").alias("refund_count"), F.sum("refund_amount").alias("refund_amount"))
    return enrich(stamp(sums), *category_steps(dims))
