"""Compare registered queries with their SQL: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, norm(v)) for k, v in value.items()))
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    t0 = time.time()
    got = df.collect()
    took = time.time() - t0
    cols, rows = rows_of(df.columns, [tuple(r) for r in got])
    if sql is None:
        return None, len(rows), took, ""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    ocols, orows = rows_of(names, cur.fetchall())
    if cols != ocols:
        return False, len(rows), took, f"columns {cols} != {ocols}"
    if rows != orows:
        ours, theirs = set(rows), set(orows)
        extra = list(ours - theirs)[:3]
        missing = list(theirs - ours)[:3]
        return False, len(rows), took, f"{len(rows)} vs {len(orows)} rows\n   spark only {extra}\n   sql only   {missing}"
    return True, len(rows), took, ""


def main():
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    folder = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry
    from veilgrain.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = args[1:] or list(queries)
    wanted = [q for w in wanted for q in queries if q == w or (w.endswith("*") and q.startswith(w[:-1]))]
    bad = 0
    for name in wanted:
        try:
            ok, n, took, why = compare(spark, con, folder, queries[name], oracle.get(name))
        except Exception as err:  # report and go on
            ok, n, took, why = False, -1, 0.0, f"{type(err).__name__}: {str(err)[:1500]}"
        mark = {True: "ok  ", False: "FAIL", None: "rows"}[ok]
        bad += ok is False
        print(f"{mark} {name:28s} rows={n:<8d} {took:6.2f}s {why}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} fine")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
