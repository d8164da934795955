"""Compare a query's rows with those of its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Spark's types and DuckDB's.
TYPES = {
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "array<string>": "VARCHAR[]",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def check(df, con, sql):
    asked = con.sql(sql)
    names = list(asked.columns)
    assert sorted(names) == sorted(df.columns)
    kinds = dict(zip(names, map(str, asked.types), strict=True))
    assert {
        c: TYPES.get(t, t) for c, t in df.dtypes if not t.startswith("decimal")
    } == {c: kinds[c] for c, t in df.dtypes if not t.startswith("decimal")}
    assert rows(df.columns, df.collect()) == rows(names, asked.fetchall())
