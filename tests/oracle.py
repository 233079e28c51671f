"""Runs a query and its DuckDB text on the same tables and compares rows and column names."""

import glob
import math
import os


def canonical(v):
    if isinstance(v, float) and v == int(v) and not math.isinf(v):
        return repr(float(v))
    return repr(v)


def differences(spark, name, query, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    rows = sorted(tuple(canonical(v) for _, v in sorted(zip(columns, r))) for r in want.fetchall())
    got = query(spark, sf_dir)
    found = sorted(tuple(canonical(v) for _, v in sorted(zip(got.columns, r))) for r in got.collect())
    if sorted(columns) != sorted(got.columns):
        return f"{name}: columns {sorted(got.columns)} instead of {sorted(columns)}"
    if rows != found:
        odd = [x for x in found if x not in set(rows)][:3]
        missing = [x for x in rows if x not in set(found)][:3]
        return f"{name}: {len(found)} rows instead of {len(rows)}; only in Spark {odd}; only in SQL {missing}"
    return None
