"""Run registered queries beside their SQL twins: python -m tests.compare [sf dir] [name ...]."""

from __future__ import annotations

import sys
import threading
import time
from contextlib import contextmanager
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of plain text, columns in name order."""
    columns = []
    for name in sorted(df.columns):
        s = df[name]
        if str(s.dtype).startswith("datetime"):
            text = s.dt.strftime("%Y-%m-%d %H:%M:%S").where(s.notna(), "~")
        elif pd.api.types.is_bool_dtype(s):
            text = s.astype("object").map(lambda v: "~" if pd.isna(v) else str(bool(v)))
        elif pd.api.types.is_float_dtype(s):
            text = s.map(lambda v: "~" if pd.isna(v) else repr(float(v)))
        else:
            text = s.map(lambda v: "~" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else str(v))
        columns.append(text.tolist())
    return sorted(zip(*columns)) if columns else []


def whole(rows: list[tuple]) -> list[tuple]:
    """Whole floats as integers: nullable integer columns arrive as floats in pandas."""
    return [tuple(v[:-2] if v.endswith(".0") and v[:-2].lstrip("-").isdigit() else v for v in row) for row in rows]


@contextmanager
def limit(cancel, seconds: float = 75.0):
    """Cancel one side of a comparison that takes too long."""
    timer = threading.Timer(seconds, cancel)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def compare(spark, con, name: str, build, sql: str | None, folder: str) -> tuple[bool, str]:
    start = time.time()
    with limit(spark.sparkContext.cancelAllJobs):
        got = build(spark, folder).toPandas()
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)} rows {took:.1f}s"
    with limit(con.interrupt):
        want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns differ: spark-only {set(got.columns) - set(want.columns)} sql-only {set(want.columns) - set(got.columns)}"
    a, b = whole(canonical(got)), whole(canonical(want))
    if a == b:
        return True, f"{len(a)} rows {took:.1f}s"
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return False, f"rows {len(a)} vs {len(b)}\n  {sorted(got.columns)}\n  spark {only_a}\n  sql   {only_b}"


def main() -> int:
    from airloom.session import build_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or list(queries):
        try:
            ok, note = compare(spark, con, name, queries[name], sqls.get(name), folder)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
