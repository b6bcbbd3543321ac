"""Run registered queries against their DuckDB twins (same rules as the driver gate).

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if os.environ.get("ORACLE_EXACT"):
            return v
        return round(v, 9) if abs(v) < 1e6 else float(f"{v:.12g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(sdf), "spark_sec": round(t1 - t0, 2)}
    if not sql:
        res["status"] = "rows-only"
        return res
    ddf = con.execute(sql).df()
    res["oracle_rows"] = len(ddf)
    if sorted(sdf.columns) != sorted(ddf.columns):
        res["status"] = f"SCHEMA {sorted(sdf.columns)} vs {sorted(ddf.columns)}"
        return res
    a, b = rows_of(sdf), rows_of(ddf)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT"
        return res
    diffs = [(x, y) for x, y in zip(a, b) if x != y]
    res["status"] = "ok" if not diffs else f"VALUES ({len(diffs)} rows differ)"
    if diffs:
        res["example"] = diffs[0]
    return res


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from propwise.session import get_session
    import __spark_entry__ as E

    spark = get_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in names or list(qs):
        try:
            r = compare(spark, con, sf_dir, n, qs[n], sqls.get(n))
        except Exception as exc:  # report and continue
            r = {"name": n, "status": f"ERROR {type(exc).__name__}: {str(exc)[:300]}"}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
