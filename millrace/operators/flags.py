"""First-time and returning flags over keyed events.

Each rule looks at the first event of a key and day, or of a key. These are minima, folded per
task before the shuffle, so a key with very many events moves one row per task and day; no task
ever sorts all events of a key. Only rows with a flag come out.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import DAY


def first_rows(df: DataFrame, keys, order, keep=()) -> DataFrame:
    """The first row per key by ``order``, with the columns in ``order`` and ``keep``.

    Rows without a value in the first order column, the event time, are no events. With one order
    column and nothing else to keep this is a plain hash-aggregated minimum.
    """
    df = df.where(F.col(order[0]).isNotNull())
    if len(order) == 1 and not keep:
        return df.groupBy(*keys).agg(F.min(order[0]).alias(order[0]))
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *keep)).alias("_first"))
    return first.select(*keys, "_first.*")


def first_of_day(df: DataFrame, key, order=("et",), keep=()) -> DataFrame:
    """The first event of each key on each day, with that ``day``. ``order`` starts with ``et``."""
    firsts = first_rows(df.withColumn("day", F.to_date("et")), [*key, "day"], list(order), list(keep))
    return firsts.withColumn("day", F.date_format("day", DAY))


def first_seen(df: DataFrame, key, order=("et",), keep=()) -> DataFrame:
    """The first event ever of each key."""
    return first_rows(df, list(key), list(order), list(keep))


def day_changes(df: DataFrame, key, order=("et",), keep=()) -> DataFrame:
    """First events per key and day, with the key's day before in ``last_day`` (null at first).

    The window sees one row per key and day.
    """
    days = first_of_day(df, key, order, keep)
    return days.withColumn("last_day", F.lag("day").over(W.partitionBy(*key).orderBy("day")))


def daily_and_new(df: DataFrame, key, order=("et",), keep=()) -> DataFrame:
    """``is_unique`` on the first event of a day, ``is_new`` on the first event ever."""
    return mark_new(day_changes(df, key, order, keep))


def mark_new(changes: DataFrame) -> DataFrame:
    return changes.withColumns({
        "is_unique": F.lit(1),
        "is_new": F.when(F.col("last_day").isNull(), 1).otherwise(0),
    }).drop("last_day")


def returning(df: DataFrame, key, days: int = 7, order=("et",), keep=()) -> DataFrame:
    """First event per day; ``is_back`` when the day before lies more than ``days`` days back."""
    return mark_returning(day_changes(df, key, order, keep), days)


def mark_returning(changes: DataFrame, days: int = 7) -> DataFrame:
    """The gap runs from midnight of the last day to the event itself."""
    waited = F.col("et") > F.to_timestamp("last_day", DAY) + F.expr(f"interval {days * 24} hours")
    return changes.withColumns({
        "is_unique": F.lit(1),
        "is_back": F.when(waited, 1).otherwise(0),
    }).drop("last_day")
