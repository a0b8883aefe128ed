"""Spark rows and DuckDB rows of one query, in one form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v + 0.0, 6) + 0.0) if isinstance(v, float) else str(v)


def _rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(_plain, r)) for r in df[names].itertuples(index=False, name=None))


def assert_same(spark_df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert _rows(spark_df.toPandas()) == _rows(con.sql(sql).df())
