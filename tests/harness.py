"""Runs registered queries next to their oracle SQL.  ``python -m tests.harness [--sf DIR] [name ...]``"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
DATA = os.environ.get("LABELMILL_DATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def canonical(columns, rows):
    """Rows with columns sorted by name, as a sorted list."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(df, con, sql):
    """(same, message) of a Spark result and an oracle result: names, types, values."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    oracle_types = {d[0]: str(d[1]) for d in cur.description}
    want = canonical(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs oracle {sorted(names)}"
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return False, f"{len(got)} rows vs oracle {len(want)}; first {got[:2]} vs {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first {bad[0]} ({sorted(names)})"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = {n: (t, oracle_types[n]) for n, t in types.items() if kinds.get(t, t) not in oracle_types[n]}
    return True, f"{len(got)} rows" + (f", types {odd}" if odd else "")


def main(argv=None) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from labelmill.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default=f"{DATA}/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    spark = build_session("harness", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(args.sf), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            ok, note = compare(df, con, oracles[name]) if name in oracles else (True, f"{df.count()} rows, no oracle")
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
            if args.names:
                traceback.print_exc()
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
