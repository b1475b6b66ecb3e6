"""Run registered queries in Spark and their oracle SQL in DuckDB on the same
parquet tables and compare (row count, column names, sorted values).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _spark_type(t: str) -> str:
    return {"int": "int32", "bigint": "int64", "double": "float64", "float": "float32",
            "string": "string", "boolean": "bool", "timestamp_ntz": "timestamp",
            "array<string>": "list<string>"}.get(t, t)


def _duck_type(t: str) -> str:
    return {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "FLOAT": "float32",
            "VARCHAR": "string", "BOOLEAN": "bool", "TIMESTAMP": "timestamp",
            "VARCHAR[]": "list<string>"}.get(t, t)


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = [c for c in rel.columns]
    d_rows = [tuple(_norm(x) for x in r) for r in rel.fetchall()]
    problems = []
    s_types = {f.name: _spark_type(f.dataType.simpleString()) for f in sdf.schema.fields}
    d_types = {c: _duck_type(str(t)) for c, t in zip(rel.columns, rel.types)}
    bad = {c: (s_types[c], d_types.get(c)) for c in s_types
           if c in d_types and s_types[c] != d_types[c]}
    if bad:
        problems.append(f"types {bad}")
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    else:
        order = [d_cols.index(c) for c in s_cols]
        d_rows = [tuple(r[i] for i in order) for r in d_rows]
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    elif not problems:
        a, b = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        if diff:
            problems.append(f"{len(diff)} differing rows, e.g. {diff[:3]}")
    return problems, len(s_rows), t1 - t0


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    from fairgate.session import local_session
    import __spark_entry__ as entry
    spark = local_session()
    con = duck(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in oracle:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"  rows-only {name}: {n} rows {time.time()-t0:.1f}s")
            continue
        try:
            problems, n, secs = compare(spark, con, name, fn, oracle[name], sf_dir)
        except Exception as e:  # report and continue with the next query
            problems, n, secs = [f"error {type(e).__name__}: {str(e)[:400]}"], -1, 0
        status = "OK  " if not problems else "FAIL"
        failed += bool(problems)
        print(f"{status} {name}: {n} rows {secs:.1f}s {'; '.join(problems)}")
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
