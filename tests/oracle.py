"""Run a registered query and its SQL oracle side by side and compare the values."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if v != v else f"{v + 0.0:.6f}" if v else "0.000000"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _cell(v.tolist())
    return str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(q, spark, sf_dir, con):
    started = time.time()
    df = q(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if q.sql is None:
        return True, f"rows-only {len(mine)} rows", took
    cursor = con.execute(q.sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    types = dict(zip(names, [str(d[1]) for d in cursor.description]))
    a_names, a = canonical(df.columns, mine)
    b_names, b = canonical(names, theirs)
    if a_names != b_names:
        return False, f"columns {a_names} vs {b_names}", took
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    odd = [(n, t, types[n]) for n, t in df.dtypes
           if kinds.get(t) and kinds[t] != types[n] and types[n] in
           ("BIGINT", "INTEGER", "DOUBLE", "VARCHAR", "BOOLEAN", "HUGEINT")]
    note = f" TYPES {odd}" if odd else ""
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows; spark {only_a} sql {only_b}{note}", took
    return not odd, f"{len(a)} rows{note}", took


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__  # noqa: F401  (fills the registry)
    from trackspark.plans.registry import REGISTRY
    from trackspark.session import local_session
    sf_dir = f"/root/testdata/sf{argv[0]}"
    wanted = argv[1:] or [""]
    spark, con = local_session("oracle"), connect(sf_dir)
    bad = []
    for name, q in REGISTRY.items():
        if not any(name.startswith(w) or w in name for w in wanted):
            continue
        try:
            ok, note, took = compare(q, spark, sf_dir, con)
        except Exception as exc:  # report and keep going
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:<34} {took:6.2f}s  {note}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad or "none")


if __name__ == "__main__":
    main(sys.argv[1:])
