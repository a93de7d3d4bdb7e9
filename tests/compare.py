"""Order-free comparison of a Spark result with a check query's result."""

from __future__ import annotations

import datetime as dt
import math

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def check_engine(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def check_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def spark_types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def check_types(con, sql):
    return {r[0]: str(r[1]).lower() for r in con.execute(f"describe {sql}").fetchall()}


SAME = {("bigint", "bigint"), ("int", "integer"), ("string", "varchar"), ("double", "double"),
        ("boolean", "boolean"), ("timestamp_ntz", "timestamp"), ("date", "date")}


def type_differences(spark, check):
    return {c: (spark[c], check.get(c)) for c in spark
            if c in check and (spark[c], check[c]) not in SAME}
