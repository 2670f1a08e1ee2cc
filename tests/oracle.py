"""Compares a query with its SQL on the same Parquet files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, float):
        return f"{value:.6f}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    relation = connect(sf_dir).sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return [f"columns {sorted(df.columns)} and {sorted(relation.columns)}"]
    cols = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    theirs = sorted(tuple(map(plain, r)) for r in relation.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    if mine == theirs:
        return []
    return [f"{len(mine)} and {len(theirs)} rows", *[f"{a} | {b}" for a, b in zip(mine, theirs) if a != b][:3]]
