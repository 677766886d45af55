"""Compare a registered query with its SQL counterpart on DuckDB.

As a script: ``python tests/oracle_check.py FOLDER [name ...]``.
"""

from __future__ import annotations

import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# DuckDB type for each Spark type that queries return.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for source in SOURCES:
        con.execute(f"CREATE VIEW {source} AS SELECT * FROM read_parquet('{folder}/{source}.parquet')")
    return con


def _plain(value):
    return format(value, "f") if isinstance(value, decimal.Decimal) else value


def _sorted(rows, order):
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when columns, types and rows agree, else a short account."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want_types = {c[0]: str(c[1]) for c in result.description}
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    for name, kind in df.dtypes:
        expected = TYPES.get(kind, kind.upper())
        if want_types[name] != expected:
            return f"type of {name}: {kind} / {want_types[name]}"
    order = sorted(df.columns)
    got_rows = _sorted(df.collect(), [df.columns.index(c) for c in order])
    want_rows = _sorted(want, [names.index(c) for c in order])
    if got_rows == want_rows:
        return None
    missing, extra = [r for r in want_rows if r not in set(got_rows)], [r for r in got_rows if r not in set(want_rows)]
    return f"{len(got_rows)} / {len(want_rows)} rows; {order}; only sql {missing[:3]}; only spark {extra[:3]}"


def main(folder: str, names: list[str]) -> int:
    from eventbook.plans.catalog import QUERIES
    from eventbook.plans.oracle import ORACLES
    from eventbook.session import local_session

    spark, con, bad = local_session(8), connect(folder), 0
    for name in names or QUERIES:
        begun = time.time()
        try:
            df = QUERIES[name](spark, folder)
            found = difference(df, con, ORACLES[name]) if name in ORACLES else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001 - a report over all queries
            found = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        if found and name in ORACLES:
            bad += 1
        print(f"{name:45s} {time.time() - begun:6.2f}s {found or 'ok'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
