"""Compare every registered Spark query with its DuckDB oracle.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: rows, column names and an order-insensitive value
comparison (floats compared after rounding to 9 decimals).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
          "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT", "date": "DATE",
          "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}


def _same_type(spark_t: str, duck_t: str) -> bool:
    if spark_t.startswith("array<"):
        return duck_t.endswith("[]") and _same_type(spark_t[6:-1], duck_t[:-2])
    return _TYPES.get(spark_t, spark_t.upper()) == duck_t or (spark_t == "timestamp" and duck_t == "TIMESTAMP")


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, sf_dir: str, keys=None, verbose=True):
    import __spark_entry__ as e
    qs, oracles = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in keys or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
            t1 = time.time()
            if k not in oracles:
                results[k] = ("rows-only", len(s_rows))
                if verbose:
                    print(f"{k:28s} rows-only rows={len(s_rows)} spark={t1 - t0:.1f}s", flush=True)
                continue
            rel = con.sql(oracles[k])
            d_cols = rel.columns
            d_rows = rel.fetchall()
            ok_cols = sorted(s_cols) == sorted(d_cols)
            s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
            d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
            type_diff = {c: (s_types[c], d_types.get(c)) for c in s_cols
                         if c in d_types and not _same_type(s_types[c], d_types[c])}
            if type_diff and verbose:
                print(f"   type mismatch {k}: {type_diff}")
            ok_n = len(s_rows) == len(d_rows)
            a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
            ok_v = ok_cols and a == b
            results[k] = ("ok" if ok_v and ok_n else "FAIL", len(s_rows), len(d_rows))
            if verbose:
                print(f"{k:28s} {'ok' if ok_v else 'FAIL':4s} rows={len(s_rows)}/{len(d_rows)} "
                      f"cols={'ok' if ok_cols else (sorted(s_cols), sorted(d_cols))} spark={t1 - t0:.1f}s",
                      flush=True)
                if not ok_v and ok_cols:
                    diff = [x for x in a if x not in set(b)][:3]
                    diff2 = [x for x in b if x not in set(a)][:3]
                    print("   spark-only:", diff, "\n   duck-only: ", diff2)
        except Exception as ex:  # noqa: BLE001
            results[k] = ("ERROR", repr(ex)[:300])
            if verbose:
                print(f"{k:28s} ERROR {repr(ex)[:600]}", flush=True)
    return results


if __name__ == "__main__":
    from biaslens.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = build_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if v[0] in ("FAIL", "ERROR")]
    print("FAILED:", bad)
