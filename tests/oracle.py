"""Spark-vs-DuckDB comparison, the same checks the driver runs: row count,
column names, and an order-insensitive comparison of the values.

Usage: python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


REL_TOL, ABS_TOL = 1e-7, 1e-9


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _same(x, y) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=REL_TOL, abs_tol=ABS_TOL)
    return x == y


def rows_of(records, cols):
    """Rows in an order that float noise does not change: by the exact
    columns first, then by the floats at a few digits."""
    out = [tuple(_norm(r[c]) for c in cols) for r in records]
    floats = {i for r in out for i, v in enumerate(r) if isinstance(v, float)}
    exact = [i for i in range(len(cols)) if i not in floats]

    def order(t):
        return ([(t[i] is None, str(t[i])) for i in exact]
                + [(t[i] is None, f"{t[i]:.4g}" if t[i] is not None else "") for i in sorted(floats)])
    return sorted(out, key=order)


def compare(spark, con, name, build, sql, sf_dir):
    t0 = time.time()
    sdf = build(spark, sf_dir)
    srows = [r.asDict() for r in sdf.collect()]
    scols = sdf.columns
    ts = time.time() - t0
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(ts, 2)}
    t1 = time.time()
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    td = time.time() - t1
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows),
           "spark_s": round(ts, 2), "duck_s": round(td, 2)}
    if sorted(scols) != sorted(dcols):
        res.update(ok=False, why=f"columns differ: spark-only {sorted(set(scols)-set(dcols))} "
                                 f"sql-only {sorted(set(dcols)-set(scols))}")
        return res
    cols = sorted(scols)
    a, b = rows_of(srows, cols), rows_of(drows, cols)
    if len(a) != len(b):
        res.update(ok=False, why="row count differs")
        return res
    bad = [(x, y) for x, y in zip(a, b) if not all(map(_same, x, y))]
    if bad:
        x, y = bad[0]
        diffs = [(c, x[i], y[i]) for i, c in enumerate(cols) if not _same(x[i], y[i])]
        res.update(ok=False, why=f"{len(bad)} rows differ; first: {diffs[:6]}")
        return res
    res["ok"] = True
    return res


def main(argv):
    sys.path.insert(0, ".")
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from retail_signal.session import get_spark
    import __spark_entry__ as E
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    fails = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        fails += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILURES {fails}")


if __name__ == "__main__":
    main(sys.argv)
