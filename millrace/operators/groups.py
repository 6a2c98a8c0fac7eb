"""Groups of keys that are counted to tell which keys may have very many rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The number of groups that keys are counted by, and the rows beyond which a group is busy.
GROUPS, GROUP_ROWS = 1 << 18, 500_000


def group_of(key) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(GROUPS))


def busy_groups(df: DataFrame, key, rows: int = GROUP_ROWS) -> list[int]:
    """The groups of keys with more rows than that; there are at most ``GROUPS``."""
    return [r["group"] for r in df.groupBy(group_of(key).alias("group")).count().where(F.col("count") > rows).collect()]
