"""Session settings and the shared folder for streaming state and written intermediates."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Day boundaries and window stamps are strings, so the zone is part of every result.
# Skewed shuffle partitions are split at run time even where that costs a second shuffle.
# Streaming state lives in RocksDB: keyed state per partition may outgrow the heap. Its files lie on the local disk and
# once more in the checkpoint, so they are packed tightly, and no room is set aside for them: that is 4 MB for the list of files
# of every partition of every store, whatever is in it. Blocks of 32 KB pack better than those of 4.
# Rows for a few folders are written to open files instead of being sorted by folder first.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.maxConcurrentOutputFileWriters": "32",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "32",
}


def prepare(spark: SparkSession, zone: str = "UTC") -> SparkSession:
    """Apply the runtime settings the jobs rely on to an existing session.

    The zone is part of every result. The other settings only fill in what the session leaves open.
    """
    spark.conf.set("spark.sql.session.timeZone", zone)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or the context's checkpoint folder, which every executor can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# Whether the shuffle files of a statement go when it ends, and not some time after its plan is collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Statements that run, and streams that start, inside delete what they shuffled: a stream does so at the end of each batch."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    For a result that several later steps read and that is dear to compute: they then scan only
    their columns, and a lost executor costs a scan instead of the whole computation. What was shuffled for it is
    deleted once it is written, as nothing reads it again.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def made(spark: SparkSession, path: str) -> str:
    """The path, which is a folder now if it was none: a stream may start from it before anything is in it."""
    store, place = _place(spark, path)
    store.mkdirs(place)
    return path


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    store, place = _place(spark, f"{path}/_SUCCESS")
    return store.exists(place)


def folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders ``prefix<number>`` right below a path."""
    store, place = _place(spark, path)
    if not store.exists(place):
        return []
    names = [entry.getPath().getName() for entry in store.listStatus(place)]
    return [int(name.removeprefix(prefix)) for name in names if name.startswith(prefix)]
