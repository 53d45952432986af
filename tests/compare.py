"""Run registered queries against their SQL twins and compare every value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from bytesieve.plans.tables import GIVEN


def connect(sf_dir: str):
    con = duckdb.connect()
    for g in GIVEN:
        con.execute(f"create view {g} as select * from '{sf_dir}/{g}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([norm(r[i]) for i in order]) for r in rows))


def family(t: str) -> str:
    t = t.lower()
    if t in ("int", "integer", "smallint", "tinyint"):
        return "int"
    if t in ("bigint", "long"):
        return "bigint"
    if t in ("string", "varchar"):
        return "varchar"
    return t


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: family(str(d[1])) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}", t1 - t0, t2 - t1, len(got)
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    msg = ""
    if len(a) != len(b):
        msg = f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        msg += f" {len(bad)} differ: {bad[0][0][:300]} | {bad[0][1][:300]}"
    types = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    diff = {c: (types[c], want_types[c]) for c in types if types[c] != want_types[c]}
    if diff and not msg:
        msg = "" if all(set(p) <= {"int", "bigint", "hugeint"} for p in diff.values()) and "-t" not in sys.argv else f"types {diff}"
        if any("hugeint" in p for p in diff.values()):
            msg = f"types {diff}"
    return msg, t1 - t0, t2 - t1, len(got)


if __name__ == "__main__":
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from bytesieve import session
    from bytesieve.plans import catalog
    spark = session.build(master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g",
                                               "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf)
    names = [a for a in sys.argv[1:] if not a.startswith("-")]
    fails = 0
    for n, fn in catalog.queries().items():
        if names and not any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names):
            continue
        sql = catalog.oracle_sql().get(n)
        try:
            if sql is None:
                t0 = time.time()
                print(f"{n:28s} rows-only {len(fn(spark, sf).collect())} {time.time() - t0:.2f}s", flush=True)
                continue
            msg, ts, td, k = compare(spark, con, n, fn, sql, sf)
        except Exception as e:  # report and go on
            msg, ts, td, k = "ERR " + str(e)[:700], 0, 0, 0
        fails += bool(msg)
        print(f"{n:28s} {'ok ' if not msg else 'BAD'} rows={k} spark={ts:.2f}s duck={td:.2f}s {msg}", flush=True)
    print("failures", fails)
