"""Small inputs for rule tests."""

import datetime as dt
import json

from pyspark.sql import functions as F

from millrace.sources.logs import change_log

UTC = dt.timezone.utc
START = dt.datetime(2024, 1, 1, tzinfo=UTC)
START_S = int(START.timestamp())


def at(seconds=0.0, day=0):
    return START + dt.timedelta(days=day, seconds=seconds)


def text(spark, messages):
    return spark.createDataFrame([(m if isinstance(m, str) else json.dumps(m),) for m in messages], "value string")


def change(table, kind, ts, data, old=None, database="shop"):
    row = {"database": database, "table": table, "type": kind, "ts": ts, "data": data}
    return row | ({"old": old} if old is not None else {})


def changes(spark, messages):
    return change_log(text(spark, messages))


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def dic(spark, names):
    frame = spark.createDataFrame([(code, (name,)) for code, name in names.items()],
                                  "dic_code string, info struct<dic_name: string>")
    return frame


def timed(spark, events, columns="key string, et timestamp, id int"):
    return spark.createDataFrame(events, columns)


def day_text(column="et"):
    return F.date_format(column, "yyyy-MM-dd")
