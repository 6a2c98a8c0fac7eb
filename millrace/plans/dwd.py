"""Detail facts out of the database change log.

Every function takes the change log (see ``sources.logs.change_log``) as a table or a stream, and
dimensions as tables. Fact columns are text, as in the log; each fact carries ``ts`` in seconds
and event time ``et``.

``ttl_s`` limits regular joins to changes whose event times lie that close. Tables may leave it
out, streams need it: they forget a row after that time, so a match further apart is lost on a
stream and found in a table without ``ttl_s``. With the same ``ttl_s`` both give the same rows. A
column list under ``order`` decides between revisions of one key in a table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import (
    first_of_pack, joined_packs, money, packed, rest_of_pack, text_day, unpacked, whole)
from millrace.operators.changelog import fields, grew, latest_by_key, moved, of_table, reached
from millrace.operators.enrich import lookup
from millrace.operators.joins import keyed_join, near_join

# Order, payment and refund states in the change log.
ORDERED, CANCELLED, REFUNDING, REFUNDED = "1001", "1003", "1005", "1006"
UNPAID, PAID = "1601", "1602"
REFUND_AGREED, REFUND_DONE, REFUND_PAID = "0702", "0705", "1602"
# A payment belongs to details ordered up to 30 minutes before and 5 seconds after it.
PAY_WITHIN_S, PAY_AHEAD_S = 30 * 60, 5

DETAIL_COLUMNS = [
    "id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id",
    "activity_rule_id", "coupon_id", "date_id", "create_time", "sku_num", "split_original_amount",
    "split_activity_amount", "split_coupon_amount", "split_total_amount", "ts", "et",
]


def _dic(facts: DataFrame, dic: DataFrame, key: str, name: str, how: str) -> DataFrame:
    return lookup(facts, dic, key, "dic_code", {"info.dic_name": name}, how)


def _known(rows: DataFrame, dic: DataFrame, key: str) -> DataFrame:
    """Rows whose code is in the dictionary, for an inner lookup that comes after a join."""
    return rows.join(dic.select(F.col("dic_code").alias("_code")), F.col(key) == F.col("_code"), "left_semi")


def comments(changes: DataFrame, dic: DataFrame, database: str) -> DataFrame:
    """New comments with the name of their appraise code, null where the code is unknown."""
    new = of_table(changes, database, "comment_info", "insert").select(
        *fields("id", "user_id", "sku_id", "appraise", "comment_txt"), "ts", "et")
    return _dic(new, dic, "appraise", "appraise_name", "left").select(
        "id", "user_id", "sku_id", "appraise", "appraise_name", "comment_txt", "ts", "et")


def cart_adds(changes: DataFrame, database: str) -> DataFrame:
    """Units put into carts: whole quantity of a new entry, the increase of a grown one."""
    rows = of_table(changes, database, "cart_info").where(
        (F.col("type") == "insert") | ((F.col("type") == "update") & grew("sku_num")))
    increase = whole(F.col("data")["sku_num"]) - whole(F.col("old")["sku_num"])
    added = F.when(F.col("type") == "insert", F.col("data")["sku_num"]).otherwise(increase.cast("string"))
    return rows.select(*fields("id", "user_id", "sku_id"), added.alias("sku_num"), "ts", "et")


def order_details(changes: DataFrame, database: str, ttl_s: int | None = None, order=("ts",)) -> DataFrame:
    """Order lines with their order, activity and coupon; one row per line in a table.

    In a table the inputs are folded to the last row per key first. Lines, activities and coupons
    are then all partitioned by line id, so only the join with orders moves the lines again. Without ``ttl_s`` they
    move with their texts packed into one. A stream emits joined rows and leaves the folding to a keyed sink; its lines
    move, and wait in the state of each join, with all texts that are no key packed into one.
    """
    if not changes.isStreaming and ttl_s is None:
        return _packed_details(changes, database, list(order))

    def last(rows, *key):
        kept = rows if changes.isStreaming else latest_by_key(rows, list(key), list(order))
        return kept.drop(*[c for c in order if c != "ts"])

    extra = [c for c in order if c != "ts"]

    def inserted(table, *columns):
        return of_table(changes, database, table, "insert").select(*columns, "ts", "et", *extra)

    data = F.col("data")
    original = (money(data["sku_num"]) * money(data["order_price"])).cast("string")
    lines = last(inserted(
        "order_detail",
        *fields("id", "order_id", "sku_id", "sku_name", "create_time", "sku_num", "split_total_amount",
                "split_activity_amount", "split_coupon_amount"),
        original.alias("split_original_amount")), "id")
    orders = last(inserted("order_info", *fields("id", "user_id", "province_id")), "id").drop("ts")
    activities = last(inserted("order_detail_activity", *fields(
        "order_detail_id", "activity_id", "activity_rule_id")), "order_detail_id").drop("ts")
    coupons = last(inserted("order_detail_coupon", *fields(
        "order_detail_id", "coupon_id")), "order_detail_id").drop("ts")

    def join_orders(rows):
        return keyed_join(rows, orders, {"order_id": "id"}, ttl_s=ttl_s)

    def join_activities(rows):
        return keyed_join(rows, activities, {"id": "order_detail_id"}, "left", ttl_s)

    def join_coupons(rows):
        return keyed_join(rows, coupons, {"id": "order_detail_id"}, "left", ttl_s)

    if changes.isStreaming:
        # A stream joins the inner side first: outer rows wait for the watermark, inner rows do not.
        packs = lines.select("id", "order_id", "ts", "et", packed(*MOVING_TEXTS).alias("_pack"))
        ordered = join_orders(packs).select("id", "ts", "et", joined_packs("_pack", packed("order_id", *ORDER_TEXTS)).alias("_pack"))
        acted = join_activities(ordered).select("id", "ts", "et", joined_packs("_pack", packed(*ACTIVITY_TEXTS)).alias("_pack"))
        joined = unpacked(join_coupons(acted), "_pack", [*MOVING_TEXTS, "order_id", *ORDER_TEXTS, *ACTIVITY_TEXTS])
    else:
        joined = join_orders(join_coupons(join_activities(lines)))
    return joined.withColumn("date_id", text_day(F.col("create_time"))).select(*DETAIL_COLUMNS)


# The texts of a line, its activity and its coupon, in the order they are packed in.
LINE_TEXTS = ["sku_id", "sku_name", "create_time", "sku_num", "order_price", "split_total_amount", "split_activity_amount",
              "split_coupon_amount"]
ACTIVITY_TEXTS, COUPON_TEXTS, ORDER_TEXTS = ["activity_id", "activity_rule_id"], ["coupon_id"], ["user_id", "province_id"]
# Those of a line of a stream, whose original amount is known before.
MOVING_TEXTS = ["sku_id", "sku_name", "create_time", "sku_num", "split_total_amount", "split_activity_amount",
                "split_coupon_amount", "split_original_amount"]


def _packed_details(changes: DataFrame, database: str, order: list[str]) -> DataFrame:
    """The table form of :func:`order_details` without a limit of time, partitioned by order."""
    extra = [c for c in order if c != "ts"]
    data = F.col("data")

    def last(table, key, *texts, whole=False):
        rows = of_table(changes, database, table, "insert").select(
            data[key].alias(key), packed(*texts).alias("_pack"), "ts", *extra)
        return latest_by_key(rows, [key], order, whole=whole)

    # The event time lies close to ts, so their distance is short as text.
    ahead = (F.unix_micros("et") - F.coalesce("ts", F.lit(0)) * 1_000_000).cast("string")
    lines = last("order_detail", "id", data["order_id"], ahead, *[data[c] for c in LINE_TEXTS], whole=True).select("id", "ts", "_pack")

    def offers(table, texts):
        rows = last(table, "order_detail_id", *[data[c] for c in texts])
        return rows.select("order_detail_id", F.col("_pack").alias(f"_{texts[0]}"))

    joined = keyed_join(lines, offers("order_detail_activity", ACTIVITY_TEXTS), {"id": "order_detail_id"}, "left")
    joined = keyed_join(joined, offers("order_detail_coupon", COUPON_TEXTS), {"id": "order_detail_id"}, "left")
    none = {texts[0]: packed(*[F.lit(None).cast("string")] * len(texts)) for texts in (ACTIVITY_TEXTS, COUPON_TEXTS)}
    moving = joined.select(
        first_of_pack(F.col("_pack")).alias("order_id"), "ts",
        joined_packs(packed("id"), rest_of_pack(F.col("_pack")), *[F.coalesce(f"_{c}", n) for c, n in none.items()]).alias("_pack"))
    orders = last("order_info", "id", data["user_id"], data["province_id"]).select("id", F.col("_pack").alias("_order"))
    ordered = keyed_join(moving, orders, {"order_id": "id"})
    flat = unpacked(ordered, "_pack", ["id", "_ahead", *LINE_TEXTS, *ACTIVITY_TEXTS, *COUPON_TEXTS])
    return unpacked(flat, "_order", ORDER_TEXTS).withColumns({
        "split_original_amount": (money("sku_num") * money("order_price")).cast("string"),
        "et": F.timestamp_micros(F.col("_ahead").cast("long") + F.coalesce("ts", F.lit(0)) * 1_000_000),
        "date_id": text_day(F.col("create_time"))}).select(*DETAIL_COLUMNS)


def _join_lines(join, lines: DataFrame, *kept: str) -> DataFrame:
    """``join`` of order lines; the texts of a stream's lines, but for ``kept``, wait for it packed into one."""
    texts = [f.name for f in lines.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in kept]
    if not (lines.isStreaming and texts):
        return join(lines)
    packs = lines.select(*[c for c in lines.columns if c not in texts], packed(*texts).alias("_pack"))
    return unpacked(join(packs), "_pack", texts)


def cancelled_details(changes: DataFrame, details: DataFrame, database: str, ttl_s: int | None = None) -> DataFrame:
    """Lines of orders that went from ordered to cancelled, stamped with the cancellation."""
    cancels = of_table(changes, database, "order_info", "update").where(
        moved("order_status", ORDERED, CANCELLED)).select(
        *fields("id", cancel_time="operate_time"), "ts", "et")
    lines = details.drop("ts", "date_id", "create_time").withColumnRenamed("id", "line_id")
    joined = _join_lines(lambda rows: keyed_join(cancels, rows, {"id": "order_id"}, ttl_s=ttl_s, spread="left"), lines, "order_id")
    return joined.withColumnsRenamed({"id": "order_id", "line_id": "id"}).withColumn(
        "date_id", text_day(F.col("cancel_time"))).select(
        "id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id",
        "coupon_id", "date_id", "sku_num", "cancel_time", "split_original_amount", "split_activity_amount",
        "split_coupon_amount", "split_total_amount", "ts", "et")


def paid_details(changes: DataFrame, details: DataFrame, dic: DataFrame, database: str) -> DataFrame:
    """Lines of orders paid successfully, near in time, with the name of the payment type."""
    payments = of_table(changes, database, "payment_info", "update").where(
        moved("payment_status", UNPAID, PAID)).select(
        *fields("order_id", "callback_time", payment_type_code="payment_type"), "ts", "et")
    lines = details.drop("ts", "date_id", "create_time").withColumnsRenamed(
        {"id": "order_detail_id", "split_total_amount": "split_payment_amount"})
    joined = _join_lines(lambda rows: near_join(payments, rows, {"order_id": "order_id"}, PAY_WITHIN_S, PAY_AHEAD_S), lines, "order_id")
    return _dic(joined, dic, "payment_type_code", "payment_type_name", "inner").select(
        "order_detail_id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id",
        "activity_rule_id", "coupon_id", "payment_type_code", "payment_type_name", "callback_time", "sku_num",
        "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_payment_amount",
        "ts", "et")


def _last_status(changes: DataFrame, rows: DataFrame, key, order) -> DataFrame:
    """In a table the last change per key that reached a status, so a status set twice counts once."""
    kept = rows if changes.isStreaming else latest_by_key(rows, list(key), list(order))
    return kept.drop(*[c for c in order if c != "ts"])


# The texts of a refund, in the order they are packed in.
REFUND_TEXTS = ["id", "user_id", "sku_id", "refund_type", "refund_num", "refund_amount", "refund_reason_type", "refund_reason_txt",
                "operate_time"]


def refunds(changes: DataFrame, dic: DataFrame, database: str, ttl_s: int | None = None, order=("ts",)) -> DataFrame:
    """Agreed refunds of orders in refund, with the names of type and reason; one row per refund in a table.

    In a table both sides are folded to the last row per key by ``order`` first. A stream emits a row for each pair and
    leaves the folding to a keyed sink. Refunds of unknown codes, which have no name, are left out before the
    join, and the others move, and wait in the state of a stream, with their texts packed into one.
    """
    extra = [c for c in order if c != "ts"]
    agreed = _last_status(changes, of_table(changes, database, "order_refund_info", "update").where(
        reached("refund_status", REFUND_AGREED)).select(
        *fields("id", "user_id", "order_id", "sku_id", "refund_type", "refund_num", "refund_amount",
                "refund_reason_type", "refund_reason_txt", "operate_time"), "ts", "et", *extra), ["id"], order)
    orders = _last_status(changes, of_table(changes, database, "order_info", "update").where(
        reached("order_status", REFUNDING)).select(*fields("id", "province_id"), "ts", "et", *extra), ["id"], order).drop("ts")
    known = _known(_known(agreed, dic, "refund_type"), dic, "refund_reason_type")
    moving = known.select("order_id", "ts", "et", packed(*REFUND_TEXTS).alias("_pack"))
    joined = unpacked(keyed_join(moving, orders, {"order_id": "id"}, ttl_s=ttl_s), "_pack", REFUND_TEXTS)
    named = _dic(joined, dic, "refund_type", "refund_type_name", "inner")
    named = _dic(named, dic, "refund_reason_type", "refund_reason_type_name", "inner")
    return named.withColumn("date_id", text_day(F.col("operate_time"))).select(
        "id", "user_id", "order_id", "sku_id", "province_id", "date_id", "operate_time", "refund_type",
        "refund_type_name", "refund_reason_type", "refund_reason_type_name", "refund_reason_txt",
        "refund_num", "refund_amount", "ts", "et")


def refund_payments(changes: DataFrame, dic: DataFrame, database: str, ttl_s: int | None = None, order=("ts",)) -> DataFrame:
    """Refunds paid out, matched to their refund by order and product and to their order; folded as :func:`refunds`."""
    extra = [c for c in order if c != "ts"]
    paid = _last_status(changes, of_table(changes, database, "refund_payment", "update").where(
        reached("refund_status", REFUND_PAID)).select(
        *fields("id", "order_id", "sku_id", "callback_time", payment_type_code="payment_type",
                refund_amount="total_amount"), "ts", "et", *extra), ["id"], order)
    done = _last_status(changes, of_table(changes, database, "order_refund_info", "update").where(
        reached("refund_status", REFUND_DONE)).select(*fields("order_id", "sku_id", "refund_num"), "ts", "et", *extra),
        ["order_id", "sku_id"], order).drop("ts")
    orders = _last_status(changes, of_table(changes, database, "order_info", "update").where(
        reached("order_status", REFUNDED)).select(*fields("id", "user_id", "province_id"), "ts", "et", *extra), ["id"], order).drop("ts")
    joined = keyed_join(paid, done, {"order_id": "order_id", "sku_id": "sku_id"}, ttl_s=ttl_s)
    joined = keyed_join(joined, orders, {"order_id": "id"}, ttl_s=ttl_s)
    named = _dic(joined, dic, "payment_type_code", "payment_type_name", "inner")
    return named.withColumn("date_id", text_day(F.col("callback_time"))).select(
        "id", "user_id", "order_id", "sku_id", "province_id", "payment_type_code", "payment_type_name",
        "date_id", "callback_time", "refund_num", "refund_amount", "ts", "et")
