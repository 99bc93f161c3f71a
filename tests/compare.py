"""Run queries beside their SQL: python tests/compare.py <folder> [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from faultline.sources.views import TABLES  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    """None when both sides agree in columns and in every value."""
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = canonical([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(wrong)} of {len(got[1])} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con, failed = make_session(), duck(folder), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                problem = difference(df, con, sql[name])
                note = "ok" if problem is None else f"FAIL {problem}"
            else:
                note = f"rows {len(df.collect())}"
        except Exception as error:  # report every query, then go on
            note = f"ERROR {str(error)[:600]}"
        failed += note.startswith(("FAIL", "ERROR"))
        print(f"{name:28s} {time.time() - start:7.2f}s  {note}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
