"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf_dir] [name ...]``."""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
# Result types that mean the same on both sides.
SAME = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def differences(spark_df, con, sql: str) -> list[str]:
    """Problems found; an empty list means equal schema and equal rows."""
    result = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in result.description}
    rows_b = result.fetchall()
    ours = dict(spark_df.dtypes)
    if set(ours) != set(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    bad = [f"type of {c}: {ours[c]} / {theirs[c]}" for c in ours if SAME.get(ours[c], ours[c]) != theirs[c]]
    names = sorted(ours)
    at = [list(theirs).index(c) for c in names]
    a = sorted((tuple(r[c] for c in names) for r in spark_df.collect()), key=_key)
    b = sorted((tuple(r[i] for i in at) for r in rows_b), key=_key)
    if len(a) != len(b):
        return [*bad, f"rows {len(a)} != {len(b)}"]
    wrong = [(x, y) for x, y in zip(a, b) if not all(map(_same, x, y))]
    if wrong:
        bad.append(f"{len(wrong)} of {len(a)} rows differ, first: {names}\n   {wrong[0][0]}\n   {wrong[0][1]}")
    return bad


def main() -> int:
    from hourgrid.plans.catalog import QUERIES
    from hourgrid.session import local_session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session(), oracle_connection(sf_dir)
    failed = 0
    for name in args or QUERIES:
        query, began = QUERIES[name], time.time()
        try:
            df = query.spark(spark, sf_dir)
            found = differences(df, con, query.oracle()) if query.sql else []
            note = "" if query.sql and con.execute(f"SELECT count(*) FROM ({query.oracle()})").fetchone()[0] else (
                f"rows only: {df.count()}")
        except Exception as error:  # report and go on with the next query
            found, note = [f"{type(error).__name__}: {str(error)[:400]}"], ""
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name:26s} {time.time() - began:6.2f}s {note}", *found, sep="\n     "
              if found else " ", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
