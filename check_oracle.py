"""Compare registered queries with their DuckDB oracle (row count, columns, values).

    python check_oracle.py [sf_dir] [key ...]

A verification tool for small scale factors: results of both sides are brought
to this process to be compared, so it is not part of the library.
"""

import hashlib
import json
import math
import sys
import time

import duckdb
import pandas as pd

from depotline.plans.catalog import QUERIES
from depotline.plans.oracle import oracle_sql
from depotline.session import local_session

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 2**53 else repr(float(v))
    if hasattr(v, "item"):
        v = v.item()
        return _norm(v)
    return str(v)


def frame_digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for _, r in df[cols].iterrows())
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, key: str, sf_dir: str, con=None) -> dict:
    con = con or duck(sf_dir)
    sdf = QUERIES[key](spark, sf_dir).toPandas()
    ddf = con.execute(oracle_sql()[key]).df()
    s, d = frame_digest(sdf), frame_digest(ddf)
    out = {"key": key, "rows": (s[0], d[0]), "cols_equal": s[1] == d[1], "hash_equal": s[2] == d[2]}
    if not out["hash_equal"]:
        out["spark_cols"], out["duck_cols"] = s[1], d[1]
        out["spark_head"] = sdf.sort_values(list(sdf.columns)).head(3).to_dict("records")
        out["duck_head"] = ddf.sort_values(list(ddf.columns)).head(3).to_dict("records")
    return out


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or [k for k in QUERIES if k in oracle_sql()]
    spark = local_session(8, 8)
    con = duck(sf_dir)
    bad = 0
    for key in keys:
        t0 = time.time()
        try:
            res = compare(spark, key, sf_dir, con)
        except Exception as exc:  # report and go on
            res = {"key": key, "error": repr(exc)[:800]}
        res["sec"] = round(time.time() - t0, 2)
        ok = res.get("hash_equal") and res.get("cols_equal")
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + json.dumps(res, default=str), flush=True)
    print(f"{len(keys) - bad}/{len(keys)} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
