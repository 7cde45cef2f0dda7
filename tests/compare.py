"""Run registered queries against their SQL checks: python tests/compare.py <sf_dir> [name ...]"""

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
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "item"):
        v = v.item()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_kind(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty text when both engines give the same columns, types and values."""
    df = fn(spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want_cols, want = _rows(cols, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    spark_types = dict(df.dtypes)
    expected = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wrong = [(c, spark_types[c], types[c]) for c in got_cols if expected.get(spark_types[c]) != types[c]]
    if wrong:
        return f"types {wrong}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return ""


def main() -> int:
    from stockloom.session import local_session
    import __spark_entry__ as e

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                msg = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                msg = f"(rows only: {len(fn(spark, sf_dir).collect())})"
        except Exception as err:
            msg = f"ERROR {type(err).__name__} {str(err)[:600]}"
        state = "ok" if msg == "" or msg.startswith("(rows") else "FAIL"
        bad += state == "FAIL"
        print(f"{state:4} {time.time() - t:6.2f}s {name} {msg}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
