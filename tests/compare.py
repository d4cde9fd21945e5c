"""Runs registered queries beside their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return float(f"{float(v):.9g}")
    return v


def rows_of(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        odd = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
        return f"{name}: {len(ours)} and {len(theirs)} rows; {odd}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    where = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = duck(where), e.queries(), e.oracle_sql()
    import time

    bad = 0
    for n in sys.argv[2:] or q:
        t = time.time()
        try:
            said = differences(spark, con, n, q[n], o[n], where) if n in o else f"rows {q[n](spark, where).count()} (no SQL)"
        except Exception as x:  # noqa: BLE001
            said = f"{n}: {type(x).__name__} {str(x)[:600]}"
        bad += bool(said and "no SQL" not in said)
        print(f"{time.time() - t:6.1f} s  {n}  {said or 'equal'}", flush=True)
    sys.exit(bad > 0)
