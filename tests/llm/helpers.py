"""Small tables for the operators' tests."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle_check import difference  # noqa: E402, F401

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table with a column of a clashing name."""
    full = [(*r, *[None] * (4 - len(r)), None) for r in rows]
    return spark.createDataFrame([(*r, 7) for r in full], DOCUMENTS + ", size long")


def connect(**frames):
    """DuckDB with the frames as tables."""
    con = duckdb.connect()
    for name, frame in frames.items():
        table = frame.toArrow()
        con.register(name + "_arrow", table)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return con


def folder_tables(spark, *names):
    return {n: spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in names}
