"""Compare queries with their SQL in DuckDB: python tests/compare.py [DIR] [NAME...]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if isinstance(x, (decimal.Decimal, float)):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(d: str):
    import duckdb

    c = duckdb.connect()
    for p in sorted(Path(d).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"create view {p.stem} as select * from read_parquet('{src}')")
    return c


def differences(spark, d: str, name: str, f, sql: str) -> str:
    df = f(spark, d)
    mine = rows_of(df.columns, df.collect())
    r = duck(d).execute(sql)
    cols = [x[0] for x in r.description]
    theirs = rows_of(cols, r.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    if mine == theirs:
        return ""
    a, b = set(mine), set(theirs)
    return f"rows {len(mine)} against {len(theirs)}; only here {sorted(a - b, key=repr)[:3]}; only there {sorted(b - a, key=repr)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from factloom.session import build_session

    spark = build_session(__import__("os").environ.get("COMPARE_MASTER", "local[8]"))
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    sql = entry.oracle_sql()
    for name in names:
        began = time.time()
        try:
            if name in sql:
                said = differences(spark, d, name, entry.queries()[name], sql[name]) or "equal"
            else:
                said = f"{len(entry.queries()[name](spark, d).collect())} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:600]
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
