"""Compare registered queries with their SQL oracles: python tests/oracle_check.py [sf] [name …]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    return {"bool": "bool", "int": "int", "float": "float", "str": "str"}.get(type(value).__name__, type(value).__name__)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        values = []
        for i in order:
            v = r[i]
            if isinstance(v, float) and math.isnan(v):
                v = None
            values.append((kind(v), v))
        out.append(tuple(values))
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, name, sf_dir, queries, oracles) -> str:
    df = queries[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return f"rows only: {len(got)}" if got else "EMPTY (rows only)"
    res = con.sql(oracles[name])
    want_cols, want = rows_of(res.columns, res.fetchall())
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y]
        return f"VALUES {len(bad)} of {len(got)} differ, e.g. {diff[:4]}"
    return f"ok {len(got)}" if got else "EMPTY"


def main(argv) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tarmac.session import local_session

    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    q, o = queries(), oracle_sql()
    wanted = argv[1:] or list(q)
    wanted = [n for n in q if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)] if argv[1:] else wanted
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            result = compare(spark, con, name, sf_dir, q, o)
        except Exception as error:  # report and go on
            result = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        good = result.startswith(("ok", "rows only"))
        bad += not good
        print(f"{'PASS' if good else 'FAIL'} {name} {time.time() - start:.1f}s {result}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} pass, {sum(n in o for n in wanted)} with SQL")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
