"""Compare registered queries with their SQL twins in DuckDB.

    python -m tests.oracle [--sf DIR] [--explain] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """Return (ok, message, spark seconds, rows)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, "rows only", took, len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}", took, len(got)
    a, b = _rows(df.columns, got), _rows(cols, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}", took, len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} differ of {len(a)}: {sorted(cols)}\n   got  {bad[0][0]}\n   want {bad[0][1]}", took, len(got)
    kinds = {c: {type(v).__name__ for v in col if v is not None} for c, col in zip(df.columns, zip(*got))} if got else {}
    kinds2 = {c: {type(v).__name__ for v in col if v is not None} for c, col in zip(cols, zip(*want))} if want else {}
    odd = [c for c in kinds if kinds[c] != kinds2.get(c)]
    return (not odd), (f"types differ: {[(c, kinds[c], kinds2.get(c)) for c in odd]}" if odd else "ok"), took, len(got)


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("sparkcurate-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    explain = False
    names = []
    while argv:
        a = argv.pop(0)
        if a == "--sf":
            sf_dir = argv.pop(0)
        elif a == "--explain":
            explain = True
        else:
            names.append(a)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = []
    for n in names or list(queries):
        chosen += [n] if n in queries else [q for q, f in queries.items() if f.__module__.endswith("." + n)]
    spark, con = session(), connect(sf_dir)
    failed = []
    for name in chosen:
        try:
            if explain:
                queries[name](spark, sf_dir).explain("formatted")
            ok, msg, took, rows = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, msg, took, rows = False, f"{type(e).__name__}: {str(e)[:900]}", 0.0, -1
        print(f"{'OK  ' if ok else 'FAIL'} {name:24s} {took:6.2f}s {rows:7d} rows  {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(chosen) - len(failed)} of {len(chosen)} ok; failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
