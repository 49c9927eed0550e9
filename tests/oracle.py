"""Holds a query's rows against its SQL on the same tables."""

import os

import duckdb


def rows(frame):
    cols = sorted(frame.columns)

    def text(v):
        if v is None or v != v:
            return None
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return cols, sorted([tuple(text(v) for v in r) for r in frame[cols].astype(object).values.tolist()], key=str)


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    a, b = rows(query(spark, sf_dir).toPandas()), rows(con.sql(sql).df())
    assert a[0] == b[0]
    assert a[1] == b[1]
