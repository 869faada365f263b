"""Run every registered query next to its DuckDB oracle: python tests/check_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
       " conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in RAW:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), [tuple(row[i] for i in order) for row in data]


def key(row):
    return tuple((v is None, round(v, 5) if isinstance(v, float) else str(v)) if not isinstance(v, (int, float))
                 else (False, f"{v:025.5f}") for v in row)


def difference(spark_df, con, sql):
    """None if both sides agree (floats to a relative 1e-6), else a short report."""
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    got.sort(key=key)
    want.sort(key=key)
    bad, inexact = [], 0
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if isinstance(a, float) or isinstance(b, float):
                same = a == b or (a is not None and b is not None
                                  and math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1.5e-6))
            else:
                same = a == b
            inexact += same and a != b
            if not same:
                bad.append((g, w))
                break
    if not bad and inexact:
        return f"ok, but {inexact} floats differ in the last digit"
    return None if not bad else f"{len(bad)} rows differ, first: {bad[0]}"[:1500]


def main():
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import new_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, oracles = new_session(), duck(sf_dir), oracle_sql()
    names = sys.argv[2:] or list(queries())
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            result = difference(df, con, oracles[name]) if name in oracles else f"rows only: {len(df.collect())}"
        except Exception as e:
            result = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.2f}s  {'ok' if result is None else result}", flush=True)


if __name__ == "__main__":
    main()
