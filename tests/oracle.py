"""Compare a query with its SQL statement on DuckDB."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _rows(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_plain(r[i]) for i in at] for r in rows), key=repr)


def compare(df, con, sql):
    """A list of differences, empty when columns and rows agree; and the number of rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"], 0
    want = _rows(names, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if len(want) != len(got):
        problems.append(f"{len(got)} rows, expected {len(want)}")
    problems += [f"got {g} expected {w}" for g, w in zip(got, want) if repr(g) != repr(w)][:3]
    return problems, len(want)
