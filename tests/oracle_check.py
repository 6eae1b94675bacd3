"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows. Usage: oracle_check.py [folder] [names...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return canon(a) == canon(b)


def compare(df, con, sql: str) -> tuple[bool, str]:
    names = sorted(df.columns)
    mine = sorted(tuple(canon(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    if sorted(columns) != names:
        return False, f"columns {names} vs {sorted(columns)}"
    order = [columns.index(c) for c in names]
    theirs = sorted(tuple(canon(row[i]) for i in order) for row in cur.fetchall())
    if mine == theirs:
        return True, f"{len(mine)} rows"
    left, right = [t for t in mine if t not in set(theirs)], [t for t in theirs if t not in set(mine)]
    return False, f"rows {len(mine)} vs {len(theirs)}; differing {len(left)}/{len(right)}; {names} e.g. {left[:2]} vs {right[:2]}"


if __name__ == "__main__":
    import __spark_entry__
    from specval.session import get_spark

    QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = get_spark(**{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                         "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "10g"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(folder), 0
    for name in wanted:
        if name not in ORACLES:
            print(f"--   {name}: no SQL")
            continue
        begin = time.time()
        try:
            good, note = compare(QUERIES[name](spark, folder), con, ORACLES[name])
        except Exception as problem:  # report and go on
            good, note = False, f"{type(problem).__name__}: {str(problem)[:400]}"
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name}: {note[:900]} ({time.time() - begin:.1f}s)", flush=True)
    print("failures:", bad)
