"""Starting streams. Each pipeline has its own checkpoint folder, named after it."""

import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.session import freed_shuffles

# Fixed value: time between checkpoints of a continuously running job.
INTERVAL = "3 seconds"

BatchWriter = Callable[[DataFrame, int], None]


def _configured(rows: DataFrame, name: str, folder: str, mode: str, interval: str | None):
    writer = (rows.writeStream.queryName(name).outputMode(mode)
              .option("checkpointLocation", f"{folder}/checkpoint-{name}"))
    # Without an interval the stream takes what is there and ends.
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def to_files(rows: DataFrame, name: str, path: str, folder: str, interval: str | None = None,
             format: str = "parquet", partition_by=()) -> StreamingQuery:
    """Append to a topic folder; the file sink commits each batch once."""
    writer = _configured(rows, name, folder, "append", interval).format(format)
    with freed_shuffles(rows.sparkSession):
        return (writer.partitionBy(*partition_by) if partition_by else writer).start(path)


def to_broker(rows: DataFrame, name: str, topic: str, folder: str, interval: str | None = None,
              **options: str) -> StreamingQuery:
    """Append a ``value`` column to a broker topic, where the connector is on the class path."""
    writer = _configured(rows, name, folder, "append", interval).format("kafka")
    with freed_shuffles(rows.sparkSession):
        return writer.option("topic", topic).options(**options).start()


def to_batches(rows: DataFrame, name: str, write: BatchWriter, folder: str,
               interval: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to ``write``, which must give the same result when a batch is retried."""
    with freed_shuffles(rows.sparkSession):
        return _configured(rows, name, folder, "append", interval).foreachBatch(write).start()


def drain(query: StreamingQuery) -> None:
    """Wait for a stream without interval to take in all that is there."""
    query.awaitTermination()


def collected(spark: SparkSession, rows: DataFrame, name: str, folder: str) -> DataFrame:
    """Run a stream over what is there and read its output back as a table."""
    path = f"{folder}/{name}"
    drain(to_files(rows, name, path, folder))
    return spark.read.schema(rows.schema).parquet(path)


class Losses(StreamingQueryListener):
    """Counts, by name of the stream, what its whole run left out.

    ``late`` is what stateful steps dropped as older than the watermark: rows, or for a windowed aggregation the partial sums
    of a task. ``dropped[name, count]`` and ``seen[name, count]`` come from the steps that ``topics.counted`` counts.
    """

    def __init__(self):
        self.counts: Counter = Counter()
        self.dropped: Counter = Counter()
        self.seen: Counter = Counter()
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.counts[progress.name] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        for count, row in progress.observedMetrics.items():
            self.seen[progress.name, count] += row["seen"]
            self.dropped[progress.name, count] += row["dropped"]
        self.batches[str(progress.runId)] = progress.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def settle(self, query: StreamingQuery, seconds: float = 30) -> None:
        """Wait until the numbers of a stream's last batch are in; listeners hear of a batch a little later."""
        end = time.monotonic() + seconds
        last = query.lastProgress
        while last is not None and self.batches.get(str(query.runId), -1) < last["batchId"] and time.monotonic() < end:
            time.sleep(0.05)


LateRows = Losses


def count_losses(spark: SparkSession) -> Losses:
    """Start counting late and bad rows of all streams of a session."""
    listener = Losses()
    spark.streams.addListener(listener)
    return listener


count_late_rows = count_losses
