"""Selecting from and folding up a database change log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import op_type, whole
from millrace.operators.groups import busy_groups, group_of
from millrace.sources.topics import counted

# The change kinds that are let through.
CHANGE_TYPES = ("insert", "update", "delete", "bootstrap-insert")


def clean(rows: DataFrame, database: str, count=None) -> DataFrame:
    """Complete changes of one database, of a known kind and with a non-empty row; ``count`` as in ``topics.counted``."""
    return counted(rows, (
        (F.col("database") == database)
        & F.col("table").isNotNull()
        & F.col("ts").isNotNull()
        & F.col("type").isin(*CHANGE_TYPES)
        & (F.size("data") > 0)
    ), count)


def of_table(rows: DataFrame, database: str, table: str, change_type: str | None = None) -> DataFrame:
    picked = (F.col("database") == database) & (F.col("table") == table)
    if change_type is not None:
        picked = picked & (F.col("type") == change_type)
    return rows.where(picked)


def moved(column: str, before: str, after: str) -> Column:
    """The column went from one given value to another."""
    return (F.col("old")[column] == before) & (F.col("data")[column] == after)


def reached(column: str, after: str) -> Column:
    """The column changed, from whatever it was, to a given value."""
    return F.col("old")[column].isNotNull() & (F.col("data")[column] == after)


def grew(column: str) -> Column:
    """The integer column changed to a larger value."""
    return whole(F.col("data")[column]) > whole(F.col("old")[column])


def fields(*names: str, **renamed: str) -> list[Column]:
    """Columns out of the row map: ``fields("id", cancel_time="operate_time")``."""
    plain = [F.col("data")[n].alias(n) for n in names]
    return plain + [F.col("data")[source].alias(alias) for alias, source in renamed.items()]


def latest_by_key(rows: DataFrame, key, order, op: str | None = None, deleted: str = "delete",
                  whole: bool = False) -> DataFrame:
    """The last row per key; keys whose last row is a deletion are gone.

    ``order`` must decide between any two rows of a key. The maximum is taken per task before
    the shuffle, so a key with very many revisions moves one row per task. That sorts all rows a task reads, which wide
    rows do not fit into memory for. With ``whole`` they are counted first by group of keys, and only keys of busy groups
    are folded before the rows meet.
    """
    if whole:
        busy = busy_groups(rows, key)
        if busy:
            crowded = group_of(key).isin(busy)
            rows = rows.where(~crowded).unionByName(latest_by_key(rows.where(crowded), key, order))
        rows = rows.repartition(*key)
    rest = [c for c in rows.columns if c not in key]
    if any(isinstance(f.dataType, T.MapType) for f in rows.schema):
        last = F.max_by(F.struct(*rest), F.struct(*order))
    else:  # the maximum of one struct is cheaper, but maps have no order
        last = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    last = rows.groupBy(*key).agg(last.alias("_last"))
    flat = last.select(*key, "_last.*").select(*rows.columns)
    return flat if op is None else flat.where(~F.col(op).eqNullSafe(deleted))


def _last_cells(rows: DataFrame, key, order, op: str, row: str) -> DataFrame:
    """The last value of each cell and, as the cell without a name, the last deletion: ``_column``, ``_value``, ``_at``."""
    entry = "array<struct<key: string, value: string>>"
    put = F.map_entries(F.map_filter(F.col(row), lambda _, value: value.isNotNull())).cast(entry)
    gone = F.lit(None).cast("string")  # the cell without a name stands for a deletion
    remove = F.array(F.struct(gone.alias("key"), gone.alias("value"))).cast(entry)
    steps = F.when(F.col(op).isin("insert", "update"), put).when(F.col(op) == "delete", remove)
    cells = rows.select(*key, F.struct(*order).alias("_at"), F.explode(steps).alias("_cell"))
    return cells.groupBy(*key, F.col("_cell.key").alias("_column")).agg(
        F.max_by("_cell.value", "_at").alias("_value"), F.max("_at").alias("_at"))


def last_cells(rows: DataFrame, key, order, op: str, row: str) -> DataFrame:
    """The changes that :func:`merge_cells` still needs: puts with the cells that no later change holds, and deletions.

    Merging these together with any later changes gives what merging all changes would. Columns other than
    the key, ``order``, ``op`` and ``row`` become null. As there, the few changes of most keys meet whole, so a put
    stays one row; a busy group gives a row per cell.
    """
    key, order = list(key), list(order)
    busy = busy_groups(rows, key)
    crowded = group_of(key).isin(busy) if busy else F.lit(False)
    steps = _last_whole(rows.where(~crowded), key, order, op, row)
    if busy:
        cells = _last_cells(rows.where(crowded), key, order, op, row)
        put = F.when(F.col("_column").isNotNull(), F.create_map("_column", "_value"))
        steps = steps.unionByName(cells.select(*key, "_at", put.alias("_put")))
    made = {op: F.when(F.col("_put").isNull(), "delete").otherwise("update"),
            row: F.coalesce("_put", F.create_map().cast("map<string,string>"))}
    values = [F.col(c) if c in key else F.col(f"_at.{c}").alias(c) if c in order
              else made[c].alias(c) if c in made else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    return steps.select(*values)


def merge_cells(rows: DataFrame, key, order, op: str, row: str) -> DataFrame:
    """Row maps per key after all puts and deletes, cell by cell.

    An insert or update overwrites the cells it holds and leaves absent or null cells alone; a
    delete removes the whole row, whatever columns it had; other operations are ignored. ``order``
    must decide between any two changes of a key. Rows are counted first by group of keys. The few changes of a
    key of most groups meet whole, through one shuffle. In a busy group each cell is folded on its own, so
    the shuffle carries the last value per cell and task.
    """
    key, order = list(key), list(order)
    busy = busy_groups(rows, key)
    crowded = group_of(key).isin(busy) if busy else F.lit(False)
    merged = _merged_whole(rows.where(~crowded), key, order, op, row)
    return merged.unionByName(_merged_by_cell(rows.where(crowded), key, order, op, row)) if busy else merged


def _met(rows: DataFrame, key, order, op: str, row: str) -> DataFrame:
    """The last deletion of each key as ``_gone``, the last put as ``_last`` and all puts after that deletion as ``_puts``, the latest first.

    The changes meet before they are collected, as collecting in the tasks that read them would sort all they read."""
    put = F.when(F.col(op).isin("insert", "update"), F.map_filter(F.col(row), lambda _, value: value.isNotNull()))
    steps = rows.where(F.col(op).isin("insert", "update", "delete")).select(*key, F.struct(*order).alias("_at"), put.alias("_put"))
    filled = F.size("_put") > 0
    met = steps.repartition(*key).groupBy(*key).agg(
        F.max(F.when(F.col("_put").isNull(), F.col("_at"))).alias("_gone"),
        F.max(F.when(filled, F.col("_at"))).alias("_last"),
        F.collect_list(F.when(filled, F.struct("_at", "_put"))).alias("_puts"))
    alive = F.filter("_puts", lambda p: F.col("_gone").isNull() | (p["_at"] > F.col("_gone")))
    later = F.array_sort(alive, lambda a, b: F.when(a["_at"] > b["_at"], -1).when(a["_at"] < b["_at"], 1).otherwise(0))
    only = F.when(F.col("_gone").isNull() | (F.col("_last") > F.col("_gone")), F.col("_puts")).otherwise(F.slice("_puts", 1, 0))
    return met.select(*key, "_gone", "_last", F.when(F.size("_puts") > 1, later).otherwise(only).alias("_puts"))


def _last_whole(rows: DataFrame, key, order, op: str, row: str) -> DataFrame:
    """What is left of the changes of keys with few of them: ``_at`` and ``_put``, which is null for the last deletion."""
    met = _met(rows, key, order, op, row)

    def left(put, place):
        later = F.slice("_puts", F.lit(1), place)
        cells = F.map_filter(put["_put"], lambda name, _: ~F.exists(later, lambda p: F.map_contains_key(p["_put"], name)))
        return F.struct(put["_at"].alias("_at"), cells.alias("_put"))

    cells = F.when(F.size("_puts") > 1, F.filter(F.transform("_puts", left), lambda p: F.size(p["_put"]) > 0)).otherwise(F.col("_puts"))
    gone = F.array(F.struct(F.col("_gone").alias("_at"), F.lit(None).cast("map<string,string>").alias("_put")))
    none = F.slice("_puts", 1, 0)
    steps = F.concat(cells, F.when(F.col("_gone").isNotNull(), gone).otherwise(none))
    return met.select(*key, F.explode(steps).alias("_step")).select(*key, "_step._at", "_step._put")


def _merged_whole(rows: DataFrame, key, order, op: str, row: str) -> DataFrame:
    """The merge of keys with few changes: the last put of each column after the last deletion."""
    met = _met(rows, key, order, op, row)
    met = met.where(F.col("_last").isNotNull() & (F.col("_gone").isNull() | (F.col("_last") > F.col("_gone"))))
    latest = met.select(*key, F.transform("_puts", lambda p: p["_put"]).alias("_puts"))
    named = latest.withColumn("_names", F.array_sort(F.array_distinct(F.flatten(F.transform("_puts", F.map_keys)))))

    def value(name):
        return F.element_at(F.filter("_puts", lambda p: F.map_contains_key(p, name)), 1)[name]

    only = F.map_from_arrays("_names", F.transform("_names", lambda name: F.col("_puts")[0][name]))
    merged = F.when(F.size("_puts") == 1, only).otherwise(F.map_from_arrays("_names", F.transform("_names", value)))
    return named.select(*key, merged.alias(row))


def _merged_by_cell(rows: DataFrame, key, order, op: str, row: str) -> DataFrame:
    last = _last_cells(rows, key, order, op, row)
    folded = last.groupBy(*key).agg(
        F.max(F.when(F.col("_column").isNull(), F.col("_at"))).alias("_gone"),
        F.collect_list(F.when(F.col("_column").isNotNull(), F.struct("_column", "_value", "_at"))).alias("_cells"))
    alive = F.filter("_cells", lambda c: F.col("_gone").isNull() | (c["_at"] > F.col("_gone")))
    named = F.sort_array(F.transform(alive, lambda c: F.struct(c["_column"].alias("key"), c["_value"].alias("value"))))
    return folded.select(*key, F.map_from_entries(named).alias(row)).where(F.size(row) > 0)


def with_op_type(rows: DataFrame) -> DataFrame:
    return rows.withColumn("op_type", op_type("type"))
