"""Side-by-side run of registered queries and their SQL: python -m tests.oracle FOLDER [NAME...]"""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

import duckdb
import pandas as pd


def normal(df: pd.DataFrame) -> list[tuple]:
    cells = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(round(float(x), 4) if isinstance(x, float) else str(x) for x in row) for row in cells.itertuples(index=False, name=None)), key=str)


def differs(spark, d: str, f, sql: str) -> str:
    """What differs between a query and its SQL on a folder; empty if nothing does."""
    df = f(spark, d)
    got = df.toPandas()
    con = duckdb.connect()
    for p in sorted(Path(d).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    rel = con.sql(sql)
    want = rel.df()
    names = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    other = {c: (t, kinds.get(c)) for c, t in df.dtypes if names.get(t, t) != kinds.get(c)}
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if other:
        return f"types {other}"
    a, b = normal(got), normal(want)
    if a == b:
        return ""
    x, y = set(a) - set(b), set(b) - set(a)
    return f"{len(a)} and {len(b)} rows; only here {sorted(x, key=str)[:2]}, only there {sorted(y, key=str)[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("FATAL")
    qs, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or qs:
        t = time.time()
        try:
            said = differs(spark, sys.argv[1], qs[name], sql[name]) if name in sql else f"(no SQL) {qs[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:500]}"
        print(f"{'ok' if not said else '..' if said[0] == '(' else 'NO'} {name} {time.time() - t:.1f} s {said[:700]}", flush=True)
