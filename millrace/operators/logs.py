"""Cleaning, repairing and splitting app logs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions.columns import from_millis, merge_maps, struct_map

# The parts of a record of which at least one must be present.
PARTS = ("actions", "start", "err", "displays", "page")
COMMON_FIELDS = schemas.COMMON.fieldNames()


def clean_log(log: DataFrame) -> DataFrame:
    some = F.lit(False)
    for part in PARTS:
        some = some | F.col(part).isNotNull()
    return log.where(some)


def first_visits(log: DataFrame, order=("ts",)) -> DataFrame:
    """First record per device: its order columns and its new-visitor mark."""
    return log.groupBy(F.col("common.mid").alias("mid")).agg(
        F.min(F.struct(*order, F.col("common.is_new").alias("is_new"))).alias("first"))


def repair_visitors(log: DataFrame, order=("ts",), seen: DataFrame | None = None) -> DataFrame:
    """Set ``is_new`` to 0 on records marked new on another day than the device's first visit.

    The first visit is the day of the first record when that is marked new, else the day before.
    ``seen`` holds first records of earlier batches in the shape of :func:`first_visits`.

    Only devices with a mark to correct are joined back, usually a small share; a hot device
    among them is split by the skew join.
    """
    at = F.to_date(from_millis("ts"))
    marked_new = F.col("common.is_new") == "1"
    per_device = log.groupBy(F.col("common.mid").alias("mid")).agg(
        F.min(F.struct(*order, F.col("common.is_new").alias("is_new"))).alias("first"),
        F.min(F.when(marked_new, at)).alias("_low"),
        F.max(F.when(marked_new, at)).alias("_high"),
    )
    if seen is not None:
        per_device = (
            per_device.unionByName(seen, allowMissingColumns=True)
            .groupBy("mid")
            .agg(F.min("first").alias("first"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        )
    first_day = from_millis(F.col("first.ts"))
    since = F.when(F.col("first.is_new") == "1", F.to_date(first_day)).otherwise(
        F.date_sub(F.to_date(first_day), 1))
    wrong = (
        per_device.withColumn("_since", since)
        .where((F.col("_low") != F.col("_since")) | (F.col("_high") != F.col("_since")))
        .select(F.col("mid").alias("_mid"), "_since")
    )
    joined = log.join(wrong, F.col("common.mid") == F.col("_mid"), "left")
    stale = marked_new & F.col("_since").isNotNull() & (at != F.col("_since"))
    fixed = F.when(stale, F.lit("0")).otherwise(F.col("common.is_new"))
    return joined.withColumn("common", F.col("common").withField("is_new", fixed)).drop("_mid", "_since")


def split_log(log: DataFrame) -> dict[str, DataFrame]:
    """Five outputs of one log; a record may reach several of them.

    A start record goes out whole, an err record without displays and actions, a page record also
    without err. Displays and actions become one row per element, as a map joined with the common
    fields and the record's time, which win over element fields of the same name.
    """
    rest = [c for c in log.columns if c not in ("displays", "actions")]

    def elements(part: str) -> DataFrame:
        common = F.map_concat(struct_map("common", COMMON_FIELDS),
                              F.create_map(F.lit("ts"), F.col("ts").cast("string")))
        others = [c for c in log.columns if c not in schemas.APP_LOG.fieldNames() or c == "ts"]
        return log.select(*others, common.alias("_common"), F.explode(part).alias("_element")).select(
            *others, merge_maps(F.col("_element"), F.col("_common")).alias("row"))

    return {
        "start": log.where(F.col("start").isNotNull()),
        "display": elements("displays"),
        "action": elements("actions"),
        "err": log.where(F.col("err").isNotNull()).select(*rest),
        "page": log.where(F.col("page").isNotNull()).select(*[c for c in rest if c != "err"]),
    }
