"""Holds queries against DuckDB on the same tables."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(arrow) -> list:
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    return sorted((tuple(plain(v) for v in r) for r in zip(*cols)), key=repr)


def differences(spark, fn, sql: str, folder: str, con=None) -> str | None:
    """What differs between a query and its SQL, or None."""
    mine = fn(spark, folder).toArrow()
    other = (con or connect(folder)).execute(sql).to_arrow_table()
    kinds = lambda t: {f.name: str(f.type).replace("large_", "") for f in t.schema}
    if kinds(mine) != kinds(other):
        return f"schema {kinds(mine)} against {kinds(other)}"
    a, b = rows_of(mine), rows_of(other)
    if a == b:
        return None
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows against {len(b)}: {only_a} / {only_b}"


if __name__ == "__main__":  # python tests/compare.py FOLDER [NAME...]
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con, sqls = connect(folder), entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            out = differences(spark, fn, sqls[name], folder, con) if name in sqls else f"rows {fn(spark, folder).count()} (no SQL)"
        except Exception as e:
            out = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(out) and "(no SQL)" not in str(out)
        print(f"{name}: {out or 'equal'} [{time.time() - t:.1f} s]", flush=True)
    print("different:", bad)
