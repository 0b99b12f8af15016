"""Every registered query with SQL gives DuckDB's rows on the same tables."""

import glob
import importlib.util
import os

import duckdb
import pytest

spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py"))
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, duck, data_dir):
    frame = entry.queries()[name](spark, data_dir)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    wanted = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall())
    assert got, "no rows"
    if got != wanted:
        lost, more = [r for r in wanted if r not in set(got)], [r for r in got if r not in set(wanted)]
        pytest.fail(f"{len(got)} rows for {len(wanted)}\nlost {lost[:2]}\nmore {more[:2]}")
