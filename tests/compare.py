"""Runs driver queries next to their SQL in DuckDB and compares the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, Decimal):
        return f"d{value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and a statement, empty if nothing."""
    found = []
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    for name, kind in df.dtypes:
        if kinds[name] in KINDS.values() and kind != kinds[name]:
            found.append(f"type of {name}: {kind} instead of {kinds[name]}")
    actual = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if actual != expected:
        extra, missing = actual - expected, expected - actual
        found.append(
            f"{sum(actual.values())} rows instead of {sum(expected.values())};"
            f" extra {list(extra)[:2]}; missing {list(missing)[:2]} (of {sum(missing.values())})"
        )
    return found


def main() -> int:
    from cropline.session import local_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    spark, con, failed = local_session(8), connect(sf_dir), 0
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                found = differences(df, con, oracles[name])
            else:
                found = [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001 - reported per query
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {name} {time.time() - start:.1f}s {' | '.join(found)}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree at {sf_dir}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
