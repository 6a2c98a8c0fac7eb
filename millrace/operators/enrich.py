"""Adding dimension attributes to facts.

No side is force-broadcast: Spark broadcasts a dimension whose size is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles, with skew splitting, above it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import hour


def lookup(facts: DataFrame, dimension: DataFrame, key: str, dimension_key: str, take: dict[str, str],
           how: str = "left") -> DataFrame:
    """Join one dimension and take its columns under new names: ``{"info.dic_name": "type_name"}``.

    A left lookup keeps facts without a match with nulls; an inner lookup drops them.
    """
    side = dimension.select(F.col(dimension_key).alias("_dim_key"),
                            *[F.col(source).alias(name) for source, name in take.items()])
    return facts.join(side, F.col(key) == F.col("_dim_key"), how).drop("_dim_key")


def enrich(facts: DataFrame, *steps: tuple[DataFrame, str, str, dict[str, str]]) -> DataFrame:
    """A chain of left lookups; a later step may use a key that an earlier one brought in."""
    for dimension, key, dimension_key, take in steps:
        facts = lookup(facts, dimension, key, dimension_key, take)
    return facts


def category_steps(dims: dict[str, DataFrame]) -> list:
    """Names of trademark and of the three category levels, from ``trademark_id`` and ``category3_id``."""
    return [
        (dims["base_trademark"], "trademark_id", "id", {"tm_name": "trademark_name"}),
        (dims["base_category3"], "category3_id", "id",
         {"name": "category3_name", "category2_id": "category2_id"}),
        (dims["base_category2"], "category2_id", "id",
         {"name": "category2_name", "category1_id": "category1_id"}),
        (dims["base_category1"], "category1_id", "id", {"name": "category1_name"}),
    ]


def sku_steps(dims: dict[str, DataFrame]) -> list:
    """The whole chain from ``sku_id``: product, trademark and categories."""
    return [
        (dims["sku_info"], "sku_id", "id", {"sku_name": "sku_name", "spu_id": "spu_id",
                                            "category3_id": "category3_id", "tm_id": "trademark_id"}),
        (dims["spu_info"], "spu_id", "id", {"spu_name": "spu_name"}),
        *category_steps(dims),
    ]


def flat_sku(dims: dict[str, DataFrame]) -> DataFrame:
    """The snowflake around a product as one row per ``sku_id``."""
    return enrich(dims["sku_info"].select(F.col("id").alias("sku_id")), *sku_steps(dims))


def lookup_as_of(facts: DataFrame, changes: DataFrame, key: str, dimension_key: str, take: dict[str, str],
                 order=("et",), op: str | None = None, deleted: str = "delete") -> DataFrame:
    """Take columns of the dimension row that was in force at each fact's event time ``et``.

    ``changes`` is the dimension's change log with its own ``et``: whole rows, the last one before the
    fact counts, a change at the same time included. ``order`` starts with ``et`` and decides between
    changes of one key. A key that ``op`` last marked as deleted, or that has no change yet, gives nulls; so
    do facts without a key or time, which all stay.

    Facts and changes of a key are laid out in time together, cut by hour. Inside an hour a window carries
    the last change on; from hour to hour one row per key goes on. So neither a key with very many
    facts nor one with very many changes lies in one task, and a change is never spread over
    the time it lasts.
    """
    names = list(take.values())
    row = F.struct(*[F.col(source).alias(name) for source, name in take.items()])
    alive = F.lit(True) if op is None else ~F.col(op).eqNullSafe(deleted)
    version = F.struct(alive.alias("alive"), F.struct(*order).alias("at"), row.alias("row"))
    steps = changes.where(F.col(dimension_key).isNotNull() & F.col("et").isNotNull()).select(
        F.col(dimension_key).alias("_key"), "et", version.alias("_version"), F.lit(None).cast(facts.schema).alias("_fact"))
    able = F.col(key).isNotNull() & F.col("et").isNotNull()
    asked = facts.where(able).select(
        F.col(key).alias("_key"), "et", F.lit(None).cast(steps.schema["_version"].dataType).alias("_version"),
        F.struct(*facts.columns).alias("_fact"))
    both = steps.unionByName(asked).withColumn("_part", hour())
    carried = both.groupBy("_key", "_part").agg(F.max_by("_version", "_version.at").alias("_last"))
    earlier = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    handed = carried.select("_key", "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_handed")).where(
        F.col("_handed").isNotNull())
    # At one time changes come before facts, among themselves by their order.
    inside = W.partitionBy("_key", "_part").orderBy("et", F.col("_version").isNull(), "_version.at").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    known = both.withColumn("_seen", F.last("_version", ignorenulls=True).over(inside)).where(F.col("_fact").isNotNull())
    found = known.join(handed, ["_key", "_part"], "left").withColumn("_in_force", F.coalesce("_seen", "_handed"))
    value = F.when(F.col("_in_force.alive"), F.col("_in_force.row"))
    done = found.select("_fact.*", *[value[n].alias(n) for n in names])
    rest = facts.where(~able).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in done.schema.fields[len(facts.columns):]])
    return done.unionByName(rest)
