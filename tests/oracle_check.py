"""Compare registered Spark queries with their DuckDB SQL twins.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from prism.plans.registry import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, sf_dir, name, con, verbose=True):
    fn = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    cols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return ("rows-only", len(srows), t1 - t0, None)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(cols) != sorted(dcols):
        return ("SCHEMA", len(srows), t1 - t0, f"spark={cols} duck={dcols}")
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    dorder = [dcols.index(cols[i]) for i in order]
    s = rows_key([tuple(norm(r[i]) for i in order) for r in srows])
    d = rows_key([tuple(norm(r[i]) for i in dorder) for r in drows])
    if len(s) != len(d):
        return ("ROWCOUNT", len(srows), t1 - t0, f"spark={len(s)} duck={len(d)}")
    if s != d:
        diff = [(a, b) for a, b in zip(s, d) if a != b][:3]
        return ("VALUES", len(srows), t1 - t0, f"cols={[cols[i] for i in order]} first diffs={diff}")
    return ("ok", len(srows), t1 - t0, None)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.queries())
    from prism.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            status, nrows, secs, info = compare(spark, sf_dir, n, con)
        except Exception as e:  # noqa: BLE001
            status, nrows, secs, info = "ERROR", -1, 0.0, repr(e)[:600]
        if status not in ("ok", "rows-only"):
            bad += 1
        print(f"{status:9s} {n:40s} rows={nrows:<7d} {secs:6.2f}s {info or ''}", flush=True)
    print(f"{bad} failing of {len(names)}")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
