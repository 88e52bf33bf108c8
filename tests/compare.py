"""Run registered queries beside their comparison SQL.

    python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(0.0 if v == 0 else v)
        if hasattr(v, "asDict"):
            v = v.asDict()
        return repr(v)

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


def spark_result(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql):
    cur = con.execute(sql)
    return canonical([d[0] for d in cur.description], cur.fetchall())


def difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    a, b = set(left[1]), set(right[1])
    return (
        f"rows {len(left[1])} != {len(right[1])}" if len(left[1]) != len(right[1]) else "values"
    ) + f"; only spark {sorted(a - b)[:3]} ({len(a - b)}); only sql {sorted(b - a)[:3]} ({len(b - a)})"


def main() -> None:
    from reelgraph.plans.oracle import SQL
    from reelgraph.plans.queries import QUERIES
    from reelgraph.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        t0 = time.time()
        try:
            got = spark_result(QUERIES[name](spark, sf_dir))
            t1 = time.time()
            if name not in SQL:
                print(f"ROWS  {name} {len(got[1])} rows {t1 - t0:.1f}s", flush=True)
                continue
            diff = difference(got, sql_result(con, SQL[name]))
            print(
                f"{'FAIL' if diff else 'ok'}    {name} {len(got[1])} rows "
                f"{t1 - t0:.1f}s sql {time.time() - t1:.1f}s {diff or ''}",
                flush=True,
            )
            bad += diff is not None
        except Exception as error:
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)


if __name__ == "__main__":
    main()
