"""Run every registered query beside its SQL: ``python tests/check_queries.py [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from recordmill import get_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


def compare(spark, con, folder: str, name: str) -> tuple[str, int, float, float]:
    start = time.time()
    df = entry_module.queries()[name](spark, folder)
    got = df.toPandas()
    spent, start = time.time() - start, time.time()
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return "rows only", len(got), spent, 0.0
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}", len(got), spent, time.time() - start
    types = {c: SQL_TYPES.get(t, t) for c, t in df.dtypes}
    wanted = {c[0]: str(c[1]) for c in con.execute(f"DESCRIBE {sql}").fetchall()}
    if types != wanted:
        differ = {c: (types[c], wanted[c]) for c in types if types[c] != wanted[c]}
        return f"types {differ}", len(got), spent, time.time() - start
    left, right = rows(got), rows(want)
    verdict = "ok" if left == right else f"{len(left)} / {len(right)} rows: " + str(
        [(a, b) for a, b in zip(left, right) if a != b][:2]
    )
    return verdict, len(got), spent, time.time() - start


def main() -> None:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = get_session("check", 8), connect(folder)
    bad = 0
    for name in sys.argv[1:] or entry_module.queries():
        try:
            verdict, count, spent, sql = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            verdict, count, spent, sql = f"{type(error).__name__}: {str(error)[:600]}", 0, 0.0, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:26} {verdict[:900]}  n={count} spark={spent:.2f}s sql={sql:.2f}s", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
