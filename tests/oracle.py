"""Run a query and its SQL side by side."""

import os
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(frame[columns].astype(str).itertuples(index=False, name=None))


def same(spark, sf_dir, query, sql):
    got = rows(query(spark, sf_dir).toPandas())
    want = rows(connect(sf_dir).execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
