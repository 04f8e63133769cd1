"""Compare registered queries with their SQL twins: ``python tests/compare.py <sf> [names]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in STAR:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(rows: list, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when names, types, row count and values agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    theirs = normal(cursor.fetchall(), names)
    ours = normal(spark_df.collect(), spark_df.columns)
    out = []
    if sorted(names) != sorted(spark_df.columns):
        out.append(f"columns {sorted(spark_df.columns)} / {sorted(names)}")
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    for c, t in spark_df.dtypes:
        want = same.get(t, t.upper().replace(" ", ""))
        if kinds.get(c, "").upper().replace(" ", "") != want:
            out.append(f"type of {c}: {t} / {kinds.get(c)}")
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} / {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        out.append(f"{len(wrong)} values, first {wrong[0]}")
    return out


if __name__ == "__main__":
    from tallyworks.plans.oracles import ORACLES
    from tallyworks.plans.queries import QUERIES
    from tallyworks.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sys.argv[1]}"
    con = connect(folder)
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            found = differences(QUERIES[name](spark, folder), con, ORACLES[name])
        except Exception as e:
            found = [f"{type(e).__name__} {str(e)[:600]}"]
        print(f"{'ok  ' if not found else 'DIFF'} {name} {time.time() - start:.1f}s", *found, sep="\n     ", flush=True)
