"""Runs registered queries beside their SQL: python -m tests.compare [sf_dir] [query ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def differences(found: pd.DataFrame, wanted: pd.DataFrame) -> str:
    """Empty when both hold the same rows."""
    if sorted(found.columns) != sorted(wanted.columns):
        return f"columns {sorted(found.columns)} / {sorted(wanted.columns)}"
    if len(found) != len(wanted):
        return f"rows {len(found)} / {len(wanted)}"
    try:
        pd.testing.assert_frame_equal(canonical(found), canonical(wanted), check_dtype=False, rtol=0, atol=2e-9)
    except AssertionError as error:
        return str(error)[:600]
    return ""


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from gavilla.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master=f"local[{os.environ.get('COMPARE_CPUS', '8')}]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            found = query(spark, sf).toPandas()
        except Exception as error:
            print(f"{name}: FAILED {str(error)[:1500]}", flush=True)
            continue
        middle = time.time()
        problem = "no SQL"
        if name in sqls:
            problem = differences(found, con.execute(sqls[name]).df()) or "ok"
        print(f"{name}: {len(found)} rows, spark {middle - start:.1f}s, sql {time.time() - middle:.1f}s, {problem}", flush=True)


if __name__ == "__main__":
    main()
