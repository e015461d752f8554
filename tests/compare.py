"""Run a query in Spark and its SQL in the checking engine and compare whole results."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in rows)


def spark_rows(df):
    return sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, text):
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    return sorted_rows(names, cursor.fetchall())
