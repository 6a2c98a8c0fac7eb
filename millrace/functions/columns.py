"""Column expressions shared by the jobs."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "yyyy-MM-dd"
SECOND = "yyyy-MM-dd HH:mm:ss"


def from_seconds(ts) -> Column:
    return F.timestamp_seconds(ts)


def from_millis(ts) -> Column:
    return F.timestamp_millis(ts)


def day(event_time) -> Column:
    """Calendar day of an event, as text, in the session zone."""
    return F.date_format(event_time, DAY)


def hour(event_time="et") -> Column:
    """Start of the hour of an event: a coarse order for ``operators.deltas``."""
    return F.date_trunc("hour", event_time)


def text_day(text) -> Column:
    """Calendar day of a timestamp held as text; text that is no timestamp gives null."""
    return F.date_format(F.try_to_timestamp(text), DAY)


def money(text) -> Column:
    """Two-digit amount; text that is no number gives null instead of failing the job."""
    return F.col(text).try_cast("decimal(16,2)") if isinstance(text, str) else text.try_cast("decimal(16,2)")


def whole(text) -> Column:
    return F.col(text).try_cast("int") if isinstance(text, str) else text.try_cast("int")


def op_type(change_type) -> Column:
    """Operation name of a change, with initial-load changes counted as plain ones."""
    return F.regexp_replace(change_type, "^bootstrap-", "")


def keep_columns(row, names) -> Column:
    """The entries of a string map whose key is in the array ``names``."""
    return F.map_filter(row, lambda key, _: F.array_contains(names, key))


def merge_maps(row, winner) -> Column:
    """Both maps as one; on a shared key the value of ``winner`` stays."""
    rest = F.map_filter(row, lambda key, _: ~F.map_contains_key(winner, key))
    return F.map_concat(rest, winner)


def _plain(part: Column) -> Column:
    text = F.replace(F.replace(part, F.lit("\2a"), F.lit("\1")), F.lit("\2b"), F.lit("\2"))
    return F.when(part != "\2n", text)


def packed(*texts) -> Column:
    """Texts as one, for rows on their way through a shuffle, where every column costs more than a short text.

    Any text, and null, comes back by :func:`unpacked`. The rare texts that hold the marks themselves are escaped
    element by element; doing so in line for all would make a method too long to be compiled.
    """
    columns = [F.col(t) if isinstance(t, str) else t for t in texts]
    together = F.concat_ws("", *columns)
    odd = together.contains("\1") | together.contains("\2")
    escaped = F.transform(F.array(*columns), lambda t: F.replace(F.replace(t, F.lit("\2"), F.lit("\2b")), F.lit("\1"), F.lit("\2a")))
    return F.when(odd, F.array_join(escaped, "\1", "\2n")).otherwise(joined_packs(*[F.coalesce(t, F.lit("\2n")) for t in columns]))


def joined_packs(*packs: Column) -> Column:
    return F.concat_ws("\1", *packs)


def first_of_pack(pack: Column) -> Column:
    return _plain(F.substring_index(pack, "\1", 1))


def rest_of_pack(pack: Column) -> Column:
    """A pack without its first text."""
    return F.substr(pack, F.instr(pack, "\1") + 1)


def unpacked(rows: DataFrame, pack: str, names) -> DataFrame:
    """The rows with the texts of a pack as columns in its place."""
    parts = rows.withColumn(pack, F.split(pack, "\1"))
    texts = [_plain(F.element_at(pack, i + 1)).alias(name) for i, name in enumerate(names)]
    return parts.select(*[c for c in rows.columns if c != pack], *texts)


def struct_map(struct: str, fields) -> Column:
    """A struct of strings as a map without its null fields."""
    pairs = F.map_from_arrays(
        F.array(*[F.lit(f) for f in fields]),
        F.array(*[F.col(f"{struct}.{f}").cast("string") for f in fields]),
    )
    return F.map_filter(pairs, lambda _, value: value.isNotNull())


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m.group(1).lower(), name)


def camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m.group(1).upper(), name)


def rename_columns(df: DataFrame, rule) -> DataFrame:
    """Rename every column by ``rule``, for example :func:`camel` on a relational scan."""
    return df.withColumnsRenamed({c: rule(c) for c in df.columns})


def json_row(df: DataFrame, drop=(), column: str = "value") -> DataFrame:
    """Each row as one line of JSON with snake-case names; null fields are left out."""
    kept = rename_columns(df.drop(*drop), snake)
    return kept.select(F.to_json(F.struct(*kept.columns)).alias(column))
