"""Run queries next to their SQL in DuckDB and compare the rows. Usage: check_queries.py [names or prefixes]."""

import math
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != 0 else "0.0"
    return repr(v)


def key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only n={len(got)} {t1 - t0:.1f}s", True
    cur = con.execute(sql)
    ocols = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    info = f"n={len(got)}/{len(want)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if sorted(cols) != sorted(ocols):
        return f"COLUMNS {sorted(set(cols) ^ set(ocols))} {info}", False
    a, b = key(got, cols), key(want, ocols)
    if a == b:
        return info, True
    sa, sb = set(a), set(b)
    ex = [x for x in a if x not in sb][:2]
    ey = [x for x in b if x not in sa][:2]
    return f"VALUES {info}\n   cols  {sorted(cols)}\n   spark {ex}\n   duck  {ey}", False


def main(argv):
    from tidegauge.session import build_session
    import __spark_entry__ as e

    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    bad = []

    def check(name):
        try:
            msg, ok = compare(spark, con.cursor(), name, qs[name], os_.get(name), sf)
        except Exception as ex:  # noqa: BLE001
            msg, ok = f"ERROR {type(ex).__name__}: {str(ex)[:1200]}", False
        print(("ok   " if ok else "FAIL ") + name, msg, flush=True)
        if not ok:
            bad.append(name)

    with ThreadPoolExecutor(int(os.environ.get("CHECK_THREADS", "5"))) as pool:
        list(pool.map(check, [n for n in qs if not argv or any(n.startswith(a) for a in argv)]))
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
