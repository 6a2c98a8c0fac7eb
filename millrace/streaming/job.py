"""Jobs: named streams that hand rows on through topics, with their folders, run and stopped together."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.session import made
from millrace.streaming.run import BatchWriter, to_batches, to_files


class Job:
    """Streams by name, in the order they are added; each reads sources or topics of those before it.

    Topics lie below ``folder/topics``, checkpoints beside them by the name of the stream, so a job made
    anew over the same folder goes on where the last one stopped. With an ``interval`` the streams
    run side by side until they are stopped; without one they take what is there, one after the other.
    What a stream reads is given as a function, called whenever the stream starts.
    """

    def __init__(self, spark: SparkSession, folder: str, interval: str | None = None):
        self.spark, self.folder, self.interval = spark, folder.rstrip("/"), interval
        self.starts: dict[str, Callable[[], StreamingQuery]] = {}
        self.running: dict[str, StreamingQuery] = {}

    def topic(self, name: str) -> str:
        """The folder of a topic, there from the first call on."""
        return made(self.spark, f"{self.folder}/topics/{name}")

    def read(self, topic: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
        """A topic as a stream."""
        reader = self.spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(self.topic(topic))

    def to_topic(self, name: str, rows: Callable[[], DataFrame], partition_by=()) -> None:
        """Add a stream that appends to the topic of its own name."""
        self._add(name, lambda: to_files(rows(), name, self.topic(name), self.folder, self.interval, partition_by=partition_by))

    def to_batches(self, name: str, rows: Callable[[], DataFrame], write: BatchWriter) -> None:
        """Add a stream whose batches go to ``write``."""
        self._add(name, lambda: to_batches(rows(), name, write, self.folder, self.interval))

    def _add(self, name: str, start: Callable[[], StreamingQuery]) -> None:
        if name in self.starts:
            raise ValueError(f"the job has a stream {name} already")
        self.starts[name] = start

    def start(self, *names: str) -> None:
        """Start the streams named, or all of them, side by side; those that run go on."""
        for name in names or self.starts:
            if name not in self.running or not self.running[name].isActive:
                self.running[name] = self.starts[name]()

    def drain(self, *names: str) -> None:
        """Run streams without interval, one after the other, until each has taken what is there."""
        if self.interval:
            raise ValueError("a job with an interval is started and stopped")
        for name in names or self.starts:
            self.start(name)
            self.running[name].awaitTermination()

    def watch(self, seconds: float | None = None) -> None:
        """Wait for that long or for ever. If a stream fails, the others are stopped and its error is raised."""
        try:
            waited = 0.0
            while self.running and (seconds is None or waited < seconds):
                for query in self.running.values():
                    if query.awaitTermination(0.2):
                        return
                    waited += 0.2
        except BaseException:
            self.stop()
            raise

    def stop(self, *names: str) -> None:
        """Stop the streams named, or all, last ones first; they go on from their checkpoints when started again."""
        for name in reversed(names or list(self.running)):
            self.running[name].stop()
            self.running.pop(name)

    def restart(self, *names: str) -> None:
        """Stop and start anew, for example after what a stream reads has changed."""
        self.stop(*names)
        self.start(*names)
