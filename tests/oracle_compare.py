"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: rows (spark/duckdb), schema match, value match.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        return tuple(sorted((_norm(a), _norm(b)) for a, b in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


def compare(spark, sf_dir: str, names=None, verbose=True):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        sdf = qs[name](spark, sf_dir)
        srows = [tuple(r) for r in sdf.collect()]
        scols = sdf.columns
        t1 = time.time()
        res = {"spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
        if name in sql:
            rel = con.sql(sql[name])
            dcols = rel.columns
            drows = rel.fetchall()
            res.update(
                duck_rows=len(drows),
                cols_match=sorted(scols) == sorted(dcols),
                values_match=rows_of(scols, srows) == rows_of(dcols, drows),
            )
            if not res["values_match"] and verbose:
                a, b = rows_of(scols, srows), rows_of(dcols, drows)
                print("  spark-only:", list((a - b).items())[:3])
                print("  duck-only :", list((b - a).items())[:3])
        out[name] = res
        if verbose:
            print(name, res, flush=True)
    return out


if __name__ == "__main__":
    from quarry.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    compare(spark, sf, sys.argv[2:] or None)
