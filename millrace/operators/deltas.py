"""Amount changes between successive revisions of one record."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import hour
from millrace.operators.groups import busy_groups, group_of

PART = "_part"


def deltas(df: DataFrame, key, order, amounts, coarse: Column | None = None, attributes: str = "current",
           idle: tuple[str, str] | None = None, known: str | None = None, first: str | None = None,
           busy: list[int] | None = None) -> DataFrame:
    """Replace each amount by its change against the revision before; a first revision stays whole.

    ``order`` must decide between any two revisions of a key. ``attributes="previous"`` emits a
    change with all other columns of the revision before, ``"current"`` with its own. A missing
    amount counts as nothing, so all changes of a record add up to its last amount.
    ``idle=("et", "5 seconds")`` forgets a revision once that much event time has passed.

    Rows are counted first by group of keys. In most groups no key can have very many revisions, so a window of the key
    finds the one before each, through one shuffle. The keys of ``busy`` groups (see ``operators.groups``; counted here
    unless given) are cut into parts by ``coarse``, a column that never falls along ``order``; by default the hour of the
    event time ``et``. Inside a part a revision finds the one before it in the part's own window. Only the first and
    last revisions of the parts meet in a window of the whole key, at most two for each part. So no task sorts
    all revisions of a key with very many.

    ``known`` names a column that is true on revisions which only serve as a past; they are not
    emitted, and neither is the column. ``first`` names a boolean column to add, true on revisions
    without one before them.
    """
    if attributes not in ("current", "previous"):
        raise ValueError("attributes is 'current' or 'previous'")
    whole = F.struct(*df.columns)
    busy = busy_groups(df, key) if busy is None else busy
    crowded = group_of(key).isin(busy) if busy else F.lit(False)
    before = df.where(~crowded).withColumn("_before", F.lag(whole).over(W.partitionBy(*key).orderBy(*order)))
    if busy:
        parts = df.where(crowded).withColumn(PART, hour() if coarse is None else coarse)
        before = before.unionByName(_before_in_parts(parts, df.columns, key, order))

    if known is not None:
        before = before.where(~F.col(known))
    if idle is not None:
        time, span = idle
        kept = F.col(time) <= F.col(f"_before.{time}") + F.expr(f"interval {span}")
        before = before.withColumn("_before", F.when(kept, F.col("_before")))
    out = [_emitted(f, f.name in amounts, attributes) for f in df.schema if f.name != known]
    return before.select(*out, *([F.col("_before").isNull().alias(first)] if first else []))


def _before_in_parts(rows: DataFrame, columns, key, order) -> DataFrame:
    """The rows with the revision before each, found inside parts and between their ends."""
    whole = F.struct(*columns)
    in_part = W.partitionBy(*key, PART).orderBy(*order)
    rows = rows.withColumns({
        "_before": F.lag(whole).over(in_part),
        "_ends": F.lead(F.lit(True)).over(in_part).isNull(),
    })
    inside = rows.where(F.col("_before").isNotNull())
    edges = rows.where(F.col("_before").isNull() | F.col("_ends"))
    handed_on = F.lag(whole).over(W.partitionBy(*key).orderBy(PART, *order))
    opening = edges.withColumn("_handed", handed_on).where(F.col("_before").isNull())
    return inside.select(*columns, "_before").unionByName(
        opening.select(*columns, F.col("_handed").alias("_before")))


def _emitted(field: T.StructField, is_amount: bool, attributes: str) -> Column:
    """The column as it leaves; a change of an amount keeps the type of the amount."""
    column = field.name
    before = F.col(f"_before.{column}")
    if is_amount:
        change = (F.coalesce(F.col(column), F.lit(0)) - F.coalesce(before, F.lit(0))).cast(field.dataType)
        return F.when(F.col("_before").isNull(), F.col(column)).otherwise(change).alias(column)
    if attributes == "previous":
        return F.when(F.col("_before").isNull(), F.col(column)).otherwise(before).alias(column)
    return F.col(column)
