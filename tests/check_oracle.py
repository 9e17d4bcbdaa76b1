"""Run registered queries next to their SQL in DuckDB and report differences.

usage: python tests/check_oracle.py [sf_dir] [name or prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canon(v)}" for k, v in sorted(value.items())) + "}"
    if hasattr(value, "asDict"):
        return canon(value.asDict())
    if isinstance(value, int):
        return f"{float(value):.6f}"
    return str(value)


def compare(spark, con, sf, name, fn, sql):
    """None when equal, else a short description of the first difference."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(got)
    index = [names.index(c) for c in cols]
    want = sorted(tuple(canon(r[i]) for i in index) for r in cur.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        diff = [(c, g, w) for c, g, w in zip(cols, *bad[0]) if g != w]
        return f"{len(bad)} rows differ, first {dict(zip(cols, bad[0][0]))} :: {diff}"[:900], len(got)
    return None, len(got)


def session():
    from strideflow.session import build

    return build(
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    fns, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in fns if not args or any(n.startswith(a) for a in args)]
    spark, con = session(), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for n in names:
        t = time.time()
        try:
            if n in oracles:
                problem, rows = compare(spark, con, sf, n, fns[n], oracles[n])
            else:
                problem, rows = None, fns[n](spark, sf).count()
        except Exception as exc:  # report and go on with the other queries
            problem, rows = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        failed += problem is not None
        tag = "ok  " if problem is None else "FAIL"
        print(f"{tag} {n:40s} rows={rows:<7d} {time.time() - t:5.1f}s"
              f"{'' if n in oracles else ' (no SQL)'} {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
