"""Run registered queries in Spark and their SQL twins in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return "null"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return f"{float(v):.9g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def differences(spark, con, name: str, sf_dir: str) -> tuple[str, float, float]:
    """('' if equal, Spark seconds, DuckDB seconds)."""
    import __spark_entry__ as entry

    start = time.time()
    mine = entry.queries()[name](spark, sf_dir).toPandas()
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ("" if len(mine) else "no rows"), took, 0.0
    start = time.time()
    other = con.execute(sql).fetchdf()
    duck = time.time() - start
    if sorted(mine.columns) != sorted(other.columns):
        return f"columns {sorted(mine.columns)} vs {sorted(other.columns)}", took, duck
    kinds = {c: (mine[c].dtype.kind, other[c].dtype.kind) for c in mine.columns if mine[c].dtype.kind != other[c].dtype.kind and {mine[c].dtype.kind, other[c].dtype.kind} != {"f", "i"}}
    a, b = _canon(mine), _canon(other)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", took, duck
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]} {sorted(mine.columns)}", took, duck
    return (f"kinds {kinds}" if kinds else ""), took, duck


if __name__ == "__main__":
    import __spark_entry__ as entry

    from doubtscope.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for n in names:
        try:
            why, s, d = differences(spark, con, n, sf)
        except Exception as e:  # noqa: BLE001
            why, s, d = f"{type(e).__name__}: {str(e)[:700]}", 0.0, 0.0
        print(f"{'ok ' if not why else 'BAD'} {n:28s} spark {s:6.2f}s duck {d:6.2f}s {why}", flush=True)
