"""Run registered queries against their SQL twins: ``python tests/check_oracles.py [prefix ...]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from tracelake.runtime import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "∅"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return str(int(v)) if v == int(v) and abs(v) < 2**53 else repr(round(v, 6))
        return f"{v}"

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name: str, sf_dir: str) -> str:
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    got_df = query(spark, sf_dir)
    got = got_df.toPandas()
    if sql is None:
        return f"rows-only {len(got)}"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [r for r in a if r not in in_b][:3]
        only_b = [r for r in b if r not in in_a][:3]
        return f"DIFF {len(a)} vs {len(b)} cols={sorted(got.columns)}\n   spark {only_a}\n   sql   {only_b}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    return f"ok {len(a)}" + (f" dtypes {kinds}" if kinds else "")


if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf)
    wanted = sys.argv[1:]
    for name in entry.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, name, sf)
        except Exception as e:  # report and go on
            verdict = f"ERROR {type(e).__name__} {str(e)[:900]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
