"""Compare registered queries with their SQL: python tests/oracle_check.py [sf_dir] [name …]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if isinstance(v, float) and not math.isnan(v):
        return repr(v + 0.0)
    return repr(v)


def differences(df, con, sql):
    """What differs between a Spark result and a SQL result; empty if nothing."""
    rows = df.collect()
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    at = [rel.columns.index(n) for n in names]
    mine = sorted(tuple(normal(r[n]) for n in names) for r in rows)
    theirs = sorted(tuple(normal(r[i]) for i in at) for r in rel.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main():
    from ruleloom.session import build_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, expected = entry.queries(), entry.oracle_sql()
    wrong = 0
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in expected:
                note = differences(df, con, expected[name]) or "ok"
            else:
                note = f"ok, {df.count()} rows only"
        except Exception as e:
            note = f"{type(e).__name__}: {str(e)[:700]}"
        wrong += not note.startswith("ok")
        print(f"{name}: {note} ({time.time() - t:.1f}s)", flush=True)
    print("wrong:", wrong)


if __name__ == "__main__":
    main()
