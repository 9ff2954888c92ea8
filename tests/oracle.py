"""Runs registered queries and their SQL side by side: python -m tests.oracle [prefix ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != int(v) else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of_sql(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(norm(v) for v in r) for r in df.select(*names).collect())


def compare(spark, con, folder: str, name: str, fn, sql: str | None):
    t0 = time.time()
    names, got = rows_of_spark(fn(spark, folder))
    t1 = time.time()
    if sql is None:
        return True, f"rows={sum(got.values())} spark={t1 - t0:.1f}s (no sql)"
    want_names, want = rows_of_sql(con, sql)
    t2 = time.time()
    note = f"rows={sum(got.values())} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s"
    if names != want_names:
        return False, f"{note} columns {names} vs {want_names}"
    if got != want:
        a = list((got - want).items())[:3]
        b = list((want - got).items())[:3]
        return False, f"{note} sqlrows={sum(want.values())}\n   spark only {str(a)[:900]}\n   sql only   {str(b)[:900]}"
    return True, note


def main(argv):
    import __spark_entry__ as entry
    from tests.session import session

    folder = "/root/testdata/sf0.01"
    wanted = []
    for a in argv:
        if a.startswith("/"):
            folder = a
        else:
            wanted.append(a)
    spark = session()
    con = duck(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(("ok  " if ok else "BAD ") + name, note, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
