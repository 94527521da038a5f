"""Run registered queries next to their SQL and report differences: python tests/compare.py [names...]"""

import logging
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from scanloom.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) else round(v, 6))
    return v if isinstance(v, (int, str)) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def compare(spark, con, folder, name):
    t0 = time.time()
    df = entry.queries()[name](spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(got[1]), t1 - t0, 0, None
    rel = con.execute(sql)
    want = table([d[0] for d in rel.description], rel.fetchall())
    t2 = time.time()
    if got == want:
        return "ok", len(got[1]), t1 - t0, t2 - t1, None
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), t1 - t0, t2 - t1, (got[0], want[0])
    a, b = set(got[1]), set(want[1])
    return "DIFF", len(got[1]), t1 - t0, t2 - t1, (len(want[1]), sorted(a - b, key=str)[:3], sorted(b - a, key=str)[:3])


def main():
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    con = connect(folder)
    names = [n for n in entry.queries() if not sys.argv[1:] or any(n == a or n.startswith(a + "_") for a in sys.argv[1:])]
    bad = 0
    for name in names:
        try:
            status, rows, ts, to, detail = compare(spark, con, folder, name)
        except Exception as e:
            status, rows, ts, to, detail = "ERROR", 0, 0, 0, str(e)[:1500]
        bad += status not in ("ok", "rows-only")
        print(f"{status:9} {name:34} rows={rows:<8} spark={ts:.2f}s sql={to:.2f}s", flush=True)
        if detail:
            print("    ", str(detail)[:3000])
    print("queries", len(names), "bad", bad)


if __name__ == "__main__":
    main()
