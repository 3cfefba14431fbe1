"""Compare registered queries with their SQL: ``python tools/check.py [sf_dir] [name-part ...]``."""

from __future__ import annotations

import importlib
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), v if isinstance(v, (int, float, str)) else str(v)) for v in row)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def compare(df, con, sql):
    """Problems between a Spark result and the SQL result (empty when equal)."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns spark={sorted(df.columns)} sql={sorted(names)}"], 0, len(rows)
    for c, t in df.dtypes:
        if SAME.get(t) != types[c]:
            problems.append(f"type of {c}: spark {t}, sql {types[c]}")
    order = sorted(names)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(normal(r[i]) for i in at) for r in rows), key=sort_key)
    mine = sorted((tuple(normal(r[c]) for c in order) for r in df.select(*order).collect()), key=sort_key)
    if len(mine) != len(theirs):
        problems.append(f"rows spark={len(mine)} sql={len(theirs)}")
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, columns {order}, e.g. spark={bad[0][0]} sql={bad[0][1]}")
    return problems, len(mine), len(theirs)


def main():
    from skyweave.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    entry = importlib.import_module("__spark_entry__")
    queries, oracle = entry.queries(), entry.oracle_sql()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, fn in queries.items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name not in oracle:
                problems, n, m = [], df.count(), "-"
            else:
                problems, n, m = compare(df, con, oracle[name])
        except Exception as error:  # noqa: BLE001
            problems, n, m = [f"{type(error).__name__}: {str(error)[:600]}"], 0, 0
        failed += bool(problems)
        mark = "FAIL" if problems else "ok"
        print(f"{mark:4} {name:32} {n:>8} {time.time() - start:6.2f}s", *problems, sep="  ", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
