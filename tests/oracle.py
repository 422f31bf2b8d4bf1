"""Run registered queries and their SQL side by side: python tests/oracle.py sf0.01 [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    import datetime
    import decimal

    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql: str) -> str:
    """Empty when names and values agree, else the first difference."""
    got_names, got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{got_names}: {a} != {b}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from cellsift.session import local_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                problem = "" if n else "no rows"
        except Exception as e:
            lines = [x for x in str(e).splitlines() if x.strip()]
            problem = f"{type(e).__name__}: {' | '.join(lines[:3])[:500]}"
        bad += bool(problem)
        print(f"{'ok ' if not problem else 'BAD'} {name} {time.time() - start:.1f}s {'' if name in sqls else '(no sql)'} {problem}"[:420], flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
