"""Retail warehouse jobs on Spark: change logs and page logs in, layered facts and aggregates out."""
