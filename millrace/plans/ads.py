"""Reports on the aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import DAY


def gmv(sku_orders: DataFrame, cur_date: str | None = None) -> DataFrame:
    """Ordered amount of one day, today if none is given; 0 for a day without orders.

    ``cur_date`` is the partition column of the stored aggregate, so only that day is read.
    """
    wanted = F.lit(cur_date) if cur_date is not None else F.date_format(F.current_date(), DAY)
    return sku_orders.where(F.col("cur_date") == wanted).agg(
        F.coalesce(F.sum("order_amount"), F.lit(0)).alias("order_amount"))


def gmv_by_day(sku_orders: DataFrame) -> DataFrame:
    return sku_orders.groupBy("cur_date").agg(F.sum("order_amount").alias("order_amount"))


def gmv_response(totals: DataFrame) -> DataFrame:
    """The amount as the JSON answer of the report: cut to whole units."""
    body = F.struct(F.lit(0).alias("status"), F.lit("").alias("msg"),
                    F.col("order_amount").cast("bigint").alias("data"))
    kept = [c for c in totals.columns if c != "order_amount"]
    return totals.select(*kept, F.to_json(body).alias("response"))
