"""Compare registered queries with their SQL in DuckDB.

usage: python tools/check.py [sf_dir] [name-part ...]
"""

import datetime
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from docloom.catalog import ORACLES, QUERIES  # noqa: E402
from docloom.session import build_session  # noqa: E402
from docloom.sources import SCHEMAS  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else format(v, ".9g")
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return format(float(v), ".9g") if abs(v) < 2**53 else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return "NULL" if v is None else str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in SCHEMAS:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    bad = []
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            t0 = time.time()
            df = fn(spark, base)
            cols, rows = table(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name not in ORACLES:
                print(f"ROWS {name}: {len(rows)} rows {t1 - t0:.1f}s", flush=True)
                continue
            cur = db.execute(ORACLES[name])
            ocols, orows = table([c[0] for c in cur.description], cur.fetchall())
            t2 = time.time()
            if cols != ocols:
                raise AssertionError(f"columns {cols} != {ocols}")
            if rows != orows:
                a, b = set(rows), set(orows)
                raise AssertionError(
                    f"{len(rows)} vs {len(orows)} rows; ours only {sorted(a - b)[:2]}; theirs only {sorted(b - a)[:2]}"
                )
            print(f"OK   {name}: {len(rows)} rows {t1 - t0:.1f}s (sql {t2 - t1:.1f}s)", flush=True)
        except Exception as e:
            bad.append(name)
            print(f"BAD  {name}: {" ".join(str(e)[:900].split())}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
