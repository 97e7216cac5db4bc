"""Run registered queries against DuckDB on the same tables: ``python -m tests.compare [sf] [names...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return f"{v:.6g}" if v == v else None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(_plain(r[i])) for i in order) for r in rows])


def compare(spark, con, name, query, sql, sf_dir) -> str:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    stats = f"rows={len(got)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return f"FAIL columns {df.columns} / {cols}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        sa, sb = set(a), set(b)
        extra = [str(x)[:600] for x in list(sa - sb)[:2]]
        lack = [str(x)[:600] for x in list(sb - sa)[:2]]
        return f"FAIL {stats} duck_rows={len(b)} only_spark={len(sa - sb)} only_duck={len(sb - sa)}\n   S {extra}\n   D {lack}"
    return f"ok {stats}"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from lexmill.session import build_session

    sf = argv[0] if argv else "0.001"
    names = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                         "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    picked = [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    bad = 0
    for name in picked:
        try:
            if name in oracle:
                line = compare(spark, con, name, queries[name], oracle[name], sf_dir)
            else:
                t0 = time.time()
                line = f"rows-only rows={len(queries[name](spark, sf_dir).collect())} spark={time.time() - t0:.1f}s"
        except Exception as e:  # noqa: BLE001
            line = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += not line.startswith(("ok", "rows-only"))
        print(f"{name}: {line}", flush=True)
    print(f"{len(picked)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
