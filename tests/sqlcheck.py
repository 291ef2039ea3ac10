"""Rows of a Spark frame against the rows of DuckDB SQL over the same tables."""

from __future__ import annotations

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return round(value, 6) if isinstance(value, float) else value


def sorted_rows(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


def sql_rows(sql, folder=SMALL, views=None):
    con = duckdb.connect()
    for file in os.listdir(folder) if views is None else []:
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    for name, table in (views or {}).items():
        con.register(name, table)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()], names


def same(df, sql, folder=SMALL, views=None):
    expected, names = sql_rows(sql, folder, views)
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    assert sorted_rows([r.asDict() for r in df.collect()], columns) == sorted_rows(expected, columns)
