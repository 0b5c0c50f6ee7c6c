"""Compare registered queries with their SQL: python -m tests.oracle SF_DIR [name…]"""
from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 9))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    rows, cols = df.collect(), df.columns
    if sql is None:
        return len(rows), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    other = cur.fetchall()
    if sorted(cols) != sorted(names):
        return len(rows), f"columns {sorted(cols)} / {sorted(names)}"
    at, bt = [cols.index(c) for c in sorted(cols)], [names.index(c) for c in sorted(cols)]
    a = Counter(tuple(norm(r[i]) for i in at) for r in rows)
    b = Counter(tuple(norm(r[i]) for i in bt) for r in other)
    if a != b:
        return len(rows), f"rows {len(rows)}/{len(other)} only spark {list((a - b).items())[:2]} only sql {list((b - a).items())[:2]}"
    return len(rows), ""


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from docquarry import registry
    from docquarry.session import local_session
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = registry.load()
    sf, names = sys.argv[1], sys.argv[2:]
    con = duck(sf)
    bad = 0
    for name in queries:
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            n, why = compare(spark, con, sf, queries[name], oracles.get(name))
            state = "rows only" if why is None else ("ok" if not why else "DIFF " + why[:1500])
        except Exception as e:
            n, state = -1, "ERROR " + str(e)[:1200]
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:32} {n:7} {time.time() - t:6.1f}s {state}", flush=True)
    print("bad:", bad)
