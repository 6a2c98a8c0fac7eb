"""Tumbling event-time windows and their stamps."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import DAY, SECOND

WIDTH = "5 seconds"


def tumbling(width: str = WIDTH, event_time: str = "et") -> Column:
    return F.window(event_time, width).alias("window")


def stamp(df: DataFrame) -> DataFrame:
    """Start, end and day of the window as text, in place of the window itself."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.date_format("window.start", SECOND).alias("stt"),
        F.date_format("window.end", SECOND).alias("edt"),
        F.date_format("window.start", DAY).alias("cur_date"),
        *rest,
    )


def window_sums(df: DataFrame, sums: dict[str, Column | str], keys=(), width: str = WIDTH) -> DataFrame:
    """Stamped sums per window and key; partial sums are taken before the shuffle."""
    totals = [F.sum(value).alias(name) for name, value in sums.items()]
    return stamp(df.groupBy(tumbling(width), *keys).agg(*totals))
