"""Compares a query's rows with those of its SQL in DuckDB, whatever the order of rows and columns."""

import datetime
import decimal
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def compare(spark_df, con, sql):
    """None if both agree, else what differs."""
    result = con.execute(sql)
    names = sorted(d[0] for d in result.description)
    mine = sorted(spark_df.columns)
    if names != mine:
        return f"columns {mine} against {names}"
    order = [d[0] for d in result.description]
    theirs = Counter(tuple(plain(row[order.index(n)]) for n in names) for row in result.fetchall())
    ours = Counter(tuple(plain(row[n]) for n in names) for row in spark_df.collect())
    if ours == theirs:
        return None
    return f"{sum(ours.values())} against {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:2]}; only there {list((theirs - ours).items())[:2]}"
