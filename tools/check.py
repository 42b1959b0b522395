"""Compare registered queries with their SQL on the given tables: check.py SF_DIR [name-prefix ...]."""

import datetime
import decimal
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import duckdb  # noqa: E402

from privatrail.plans import ORACLE, QUERIES  # noqa: E402
from privatrail.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.5f}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session(8, 8, "check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark {type(e).__name__} {str(e)[:700]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        if name not in ORACLE:
            print(f"rows {name}: {len(rows)} rows {t1 - t0:.1f}s (no SQL)", flush=True)
            continue
        try:
            cur = con.execute(ORACLE[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb {str(e)[:700]}", flush=True)
            bad += 1
            continue
        t2 = time.time()
        a, b = canonical(df.columns, rows), canonical(ocols, orows)
        if a == b:
            flag = "ok  " if rows else "EMPTY"
            print(f"{flag} {name}: {len(rows)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s", flush=True)
        else:
            bad += 1
            print(f"DIFF {name}: {len(rows)} vs {len(orows)} rows; columns {a[0]} vs {b[0]}", flush=True)
            sa, sb = set(a[1]), set(b[1])
            for r in list(sorted(sa - sb))[:3]:
                print("   spark", str(r)[:400])
            for r in list(sorted(sb - sa))[:3]:
                print("   sql  ", str(r)[:400])
    print("bad", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
