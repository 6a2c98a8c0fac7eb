"""Search text to words."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of letters, digits or combining marks of any script.
BREAK = r"[^\p{L}\p{M}\p{N}]+"


def words(text) -> Column:
    """The distinct lower-case words of a text; null for null."""
    parts = F.split(F.lower(text), BREAK)
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def explode_words(df: DataFrame, text: str, alias: str = "keyword", splitter=words) -> DataFrame:
    """One row per distinct word; rows without text or words disappear.

    ``splitter`` maps a text column to an array of words, so a dictionary segmenter wrapped in a
    pandas UDF can take the place of the built-in split.
    """
    return df.select("*", F.explode(splitter(F.col(text))).alias(alias)).drop(text)
