"""App log text to the five traffic topics."""

from pyspark.sql import DataFrame

from millrace.operators.logs import clean_log, repair_visitors, split_log
from millrace.session import staged
from millrace.sources.logs import page_log


def repaired_records(raw: DataFrame, order=("ts",), keep=()) -> DataFrame:
    """Clean records with repaired new-visitor marks out of a table of messages.

    The text is parsed once: the parsed records are staged, as the repair reads them twice and
    the first time only needs device, mark and time.
    """
    records = staged(clean_log(page_log(raw, keep)), "records")
    return repair_visitors(records, list(order))


def traffic_topics(raw: DataFrame, order=("ts",), keep=()) -> dict[str, DataFrame]:
    """Start, display, action, err and page rows of a table of messages."""
    return split_log(repaired_records(raw, order, keep))
