"""Run registered queries and their DuckDB SQL side by side; report mismatches.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
from __future__ import annotations

import json
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

STRICT = bool(os.environ.get("STRICT_FLOATS"))  # compare doubles bit for bit

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        if v.is_integer():
            return str(int(v))
        if STRICT:
            return repr(v)
        return repr(round(v, 6))
    if hasattr(v, "item"):
        return canon(v.item())
    if isinstance(v, (bool,)):
        return str(v)
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(canon(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    a, b = rows(spark_df), rows(sql_df)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"values differ: {str(diff)[:600]}"
    return None


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    if os.environ.get("PLAIN_SESSION"):
        # a session with Spark's defaults only, as an outside caller would build it
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        from petrel.session import get_session
        spark = get_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            report[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:400]}"
            print(name, report[name], flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            report[name] = f"rows-only {len(sdf)}"
        else:
            try:
                ddf = con.execute(sqls[name]).df()
                report[name] = compare(sdf, ddf) or "OK"
            except Exception as e:  # noqa: BLE001
                report[name] = f"SQL ERROR {type(e).__name__}: {str(e)[:400]}"
        print(f"{name}: {report[name]}  ({t1 - t0:.1f}s spark)", flush=True)
    ok = sum(1 for v in report.values() if v == "OK")
    print(json.dumps({"ok": ok, "total": len(report)}))
    return report


if __name__ == "__main__":
    main(sys.argv)
