"""Runs a query and its oracle SQL on the same tables and compares columns, row counts and values."""

import glob
import os

import duckdb
import pandas as pd

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connection(sf_dir: str = SF):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if isinstance(x, float):
            return None if x != x else (int(x) if x == int(x) else round(x, 6))
        if x is None or x is pd.NA or x is pd.NaT:
            return None
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(cell(x) for x in row) for row in frame.itertuples(index=False)), key=repr)


def difference(spark, con, query, sql: str, sf_dir: str = SF) -> str:
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if not a:
        return "no rows"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ: {str(bad[:2])[:600]}" if bad else ""
