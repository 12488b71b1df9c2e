"""Compare queries with their SQL in DuckDB: python tests/oracle.py sf_dir [name ...]."""

import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = Counter(tuple(shown(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols, (sorted(rel.columns), cols)
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(shown(r[i]) for i in at) for r in rel.fetchall())
    return got, want


if __name__ == "__main__":
    import __spark_entry__ as e
    from millrace.session import get_spark

    spark = get_spark("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf, con = sys.argv[1], views(sys.argv[1])
    for name in sys.argv[2:] or e.queries():
        t = time.time()
        try:
            df, sql = e.queries()[name](spark, sf), e.oracle_sql().get(name)
            if not sql:
                print(name, "rows", df.count(), round(time.time() - t, 1), flush=True)
                continue
            got, want = compare(df, con, sql)
            if got == want:
                print(name, "ok", sum(got.values()), round(time.time() - t, 1), flush=True)
            else:
                print(name, "DIFF", sum(got.values()), sum(want.values()), list((got - want).items())[:2], list((want - got).items())[:2], flush=True)
        except Exception as x:
            print(name, "FAILED", str(x)[:700], flush=True)
