"""Compare a query with its SQL in DuckDB, as the driver does."""

import glob
import os

import duckdb


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(str(r[c]) for c in names) for r in frame.collect())


def sql_rows(sql, data_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in got.fetchall())
