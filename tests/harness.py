"""Run a query and its oracle side by side and compare the values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, bool) or v is None:
        return repr(v)
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = canonical(cols, cur.fetchall())
    problems = []
    if sorted(df.columns) != sorted(cols):
        problems.append(f"columns {sorted(df.columns)} != {sorted(cols)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        problems.append(f"values differ\n   spark : {extra}\n   oracle: {missing}")
    return len(got), problems


def main(names, sf="sf0.01"):
    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or sorted(queries):
        t0 = time.time()
        try:
            if name in oracle:
                n, problems = compare(spark, con, sf_dir, queries[name], oracle[name])
            else:
                n, problems = len(queries[name](spark, sf_dir).collect()), []
        except Exception as e:  # report and go on
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in oracle else "rows")
        print(f"{mark:5}{name:28}{n:8} rows {time.time() - t0:6.1f}s", flush=True)
        for p in problems:
            print("    ", p[:2500], flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = next((a for a in args if a.startswith("sf")), "sf0.01")
    main([a for a in args if not a.startswith("sf")], sf)
