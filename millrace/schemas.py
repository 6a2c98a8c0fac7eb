"""Record shapes of the warehouse inputs."""

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# One row change of a source database; ``ts`` counts seconds, ``old`` holds the changed columns only.
CHANGE_ENVELOPE = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("data", STRING_MAP),
    T.StructField("old", STRING_MAP),
    T.StructField("ts", T.LongType()),
])

COMMON = _strings("mid", "uid", "sid", "ch", "vc", "ar", "is_new")

PAGE = T.StructType(
    _strings("page_id", "last_page_id", "item_type", "item").fields
    + [T.StructField("during_time", T.LongType())]
)

# One device report; ``ts`` counts milliseconds.
APP_LOG = T.StructType([
    T.StructField("common", COMMON),
    T.StructField("page", PAGE),
    T.StructField("start", STRING_MAP),
    T.StructField("err", STRING_MAP),
    T.StructField("displays", T.ArrayType(STRING_MAP)),
    T.StructField("actions", T.ArrayType(STRING_MAP)),
    T.StructField("ts", T.LongType()),
])

# Where the rows of one source table go, and which of their columns are kept.
ROUTE = _strings("source_table", "source_type", "sink_table", "sink_type", "sink_family",
                 "sink_columns", "sink_row_key", "sink_extend")

# A change of a routing row as captured from its database: op is c, r, u or d.
ROUTE_CHANGE = T.StructType([
    T.StructField("op", T.StringType()),
    T.StructField("before", ROUTE),
    T.StructField("after", ROUTE),
    T.StructField("ts_ms", T.LongType()),
])

ORDER_DETAIL = T.StructType(
    _strings("id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id",
             "activity_rule_id", "coupon_id", "date_id", "create_time", "sku_num",
             "split_original_amount", "split_activity_amount", "split_coupon_amount",
             "split_total_amount").fields
    + [T.StructField("ts", T.LongType())]
)
