"""Rows of a query and of its SQL in DuckDB, comparable."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object)
    return columns, sorted(map(tuple, values.where(values.notna(), None).values.tolist()), key=str)


def duck_rows(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return rows(con.sql(sql).df())
