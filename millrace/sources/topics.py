"""Topics and tables as DataFrames, batch or streaming.

A topic is a folder of files by default. ``format="kafka"`` reads the same topic from a broker
where the connector is on the class path.
"""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import camel, rename_columns


def _reader(spark: SparkSession, streaming: bool):
    return spark.readStream if streaming else spark.read


def stream_path(path: str) -> str:
    """The same path as a glob, so that a stream may start from a folder or from one file."""
    head, _, last = path.rstrip("/").rpartition("/")
    return f"{head}/[{last[0]}]{last[1:]}"


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 files_per_batch: int | None = None) -> DataFrame:
    """A parquet dataset as a stream of its files."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(stream_path(path))


# The end of a line of a text file.
LINE_END = r"\r\n|\r|\n"


def text_topic(spark: SparkSession, topic: str, streaming: bool = True, format: str = "text",
               numbered: bool = False, **options: str) -> DataFrame:
    """Raw messages as one ``value`` string; a broker is read from its latest offset.

    ``part`` and ``position`` tell the order of arrival: the partition and offset of a broker, the
    file and the time it was written for files, whose lines share it. ``numbered`` adds ``line``, the place of
    a message in its file, counted from 0 (null for a broker); each file is then read whole by one task, so
    files have to be of moderate size. Keep these columns through parsing as last order columns
    where two changes of a key may carry one time: ``position``, ``part``, ``line``.
    """
    if format == "kafka":
        settings = {"startingOffsets": "latest" if streaming else "earliest", **options}
        rows = _reader(spark, streaming).format("kafka").option("subscribe", topic).options(**settings).load()
        line = [F.lit(None).cast("int").alias("line")] if numbered else []
        return rows.select(F.col("value").cast("string").alias("value"), F.col("partition").cast("string").alias("part"),
                           F.col("offset").alias("position"), *line)
    rows = _reader(spark, streaming).format("text").options(**options).option("wholetext", numbered).load(topic).select(
        "value", F.col("_metadata.file_path").alias("part"), F.unix_micros("_metadata.file_modification_time").alias("position"))
    if not numbered:
        return rows
    lines = F.split(F.regexp_replace("value", f"({LINE_END})\\z", ""), LINE_END)
    return rows.where(F.col("value") != "").select("part", "position", F.posexplode(lines).alias("line", "value")).select(
        "value", "part", "position", "line")


def counted(rows: DataFrame, good: Column, count: str | Observation | None) -> DataFrame:
    """The rows that are good; ``count`` gets how many were ``seen`` and how many ``dropped``.

    A stream takes a name, whose numbers arrive with the progress of every batch (see ``streaming.run.Losses``),
    a table an ``Observation``. Without it nothing is counted.
    """
    sound = F.coalesce(good, F.lit(False))
    if count is not None:
        rows = rows.observe(count, F.count(F.lit(1)).alias("seen"), F.count_if(~sound).alias("dropped"))
    return rows.where(sound)


def parse_json(raw: DataFrame, schema: T.StructType, keep=(), count: str | Observation | None = None) -> DataFrame:
    """Typed rows of a text topic; messages that are no JSON objects are dropped, and counted if wanted.

    The parsed record is unnested by a generator: later filters and projections then work on its
    columns instead of each parsing the text again.
    """
    marked = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    message = F.when(F.trim("value") == "", "{").otherwise(F.col("value"))  # a blank one is broken, not an empty record
    parsed = F.from_json(message, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.where(F.col("value").isNotNull()).select(*keep, F.inline(F.array(parsed)))
    return counted(rows, F.col("_bad").isNull(), count).drop("_bad")


def json_topic(spark: SparkSession, topic: str, schema: T.StructType, streaming: bool = True,
               **options: str) -> DataFrame:
    """A JSON topic as a table; a broker is read from its earliest offset."""
    if options.get("format") == "kafka":
        options.setdefault("startingOffsets", "earliest")
    return parse_json(text_topic(spark, topic, streaming, **options), schema)


def csv_topic(spark: SparkSession, topic: str, schema: T.StructType, streaming: bool = True) -> DataFrame:
    """A CSV topic as a table; lines that do not fit the schema are dropped."""
    return _reader(spark, streaming).schema(schema).option("mode", "DROPMALFORMED").csv(topic)


def relational(spark: SparkSession, url: str, query: str, rename: bool = True,
               parts: tuple[str, str, str, int] | None = None, **options: str) -> DataFrame:
    """A relational query with snake-case labels turned to camel case.

    ``parts`` is (column, lowest, highest, number of parts): the query is then read over that many
    connections, cut by ranges of the column, which must be one of its columns.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if parts is not None:
        column, low, high, number = parts
        reader = (reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high)
                  .option("numPartitions", number))
    rows = reader.load()
    return rename_columns(rows, camel) if rename else rows


def literal(spark: SparkSession, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)
