"""Holds a query against its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return None if value is None else str(value)


def rows(columns, records):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=repr)


def check(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert rows(columns, [r.asDict() for r in got.collect()]) == rows(columns, [dict(zip(names, r, strict=True)) for r in want.fetchall()])
