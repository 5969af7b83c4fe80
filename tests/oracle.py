"""Rows of a DataFrame and of DuckDB's answer, made alike."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "replace") and hasattr(value, "microsecond"):
        return str(value.replace(tzinfo=None))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def same(df, con, sql):
    answer = con.sql(sql)
    assert sorted(df.columns) == sorted(answer.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(answer.columns, answer.fetchall())
