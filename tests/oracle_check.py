"""Compare queries with their SQL twins: python -m tests.oracle_check [sf] [name ...]"""

import glob
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

ROOT = os.environ.get("TESTDATA", "/root/testdata")


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df):
    df = df.reindex(sorted(df.columns), axis=1)
    out = pd.DataFrame({c: df[c].map(lambda x: None if x is None or (not isinstance(x, str) and pd.isna(x)) else
                                     (format(x, ".9g") if isinstance(x, float) else str(x))) for c in df.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def differences(got, want):
    """None if equal, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in got.columns
             if {got[c].dtype.kind, want[c].dtype.kind} == {"i", "f"} and not got[c].isna().any()]
    if kinds:
        return f"types {kinds}"
    a, b = normal(got), normal(want)
    if not a.equals(b):
        bad = (a.fillna("NULL") != b.fillna("NULL")).any(axis=1)
        return f"{bad.sum()} rows differ, e.g.\n{a[bad].head(3).to_string()}\n{b[bad].head(3).to_string()}"
    return None


def main(argv):
    from placelens.session import drop_stages, get_session
    from placelens.plans import all_queries
    from oracles import all_sql
    sf_dir = f"{ROOT}/{argv[0] if argv else 'sf0.001'}"
    spark = get_session(**{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.master": "local[8]",
                           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="placelens-oracle-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql = all_sql()
    wanted = argv[1:] or list(all_queries())
    failed = []
    for name, fn in all_queries().items():
        if not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in wanted):
            continue
        t = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            res = differences(got, con.execute(sql[name]).df()) if name in sql else None
            note = "" if name in sql else "(no twin)"
            print(f"{'OK ' if res is None else 'BAD'} {name} rows={len(got)} spark={t1 - t:.1f}s "
                  f"duck={time.time() - t1:.1f}s {note} {res or ''}", flush=True)
        except Exception as e:   # report and go on with the next query
            res = str(e)[:1500]
            print(f"ERR {name} {res}", flush=True)
        if res:
            failed.append(name)
        drop_stages(spark)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
