"""Typed scans and sinks for the booking tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventbook.functions.scalar import parse_clock, parse_money
from eventbook.schema import FLAG, MONEY, TABLES


class BookingTables(Mapping[str, DataFrame]):
    """The ten tables by name.  A table may be given as a function and is then built on first use."""

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._tables = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        value = self._tables[name]
        if not isinstance(value, DataFrame):
            value = self._tables[name] = value()
        return value

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def replace(self, **tables: DataFrame) -> BookingTables:
        """Same tables with some exchanged, for example after a bulk update."""
        return BookingTables({**self._tables, **tables})


def read_tables(spark: SparkSession, folder: str) -> BookingTables:
    """Parquet tables below ``folder``, one folder per table name, with the declared types."""

    def scan(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(TABLES[name].struct).parquet(f"{folder}/{name}")

    return BookingTables({name: scan(name) for name in TABLES})


def write_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "append") -> None:
    """Append (or replace) tables below ``folder``, one folder per table name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def typed_from_text(rows: DataFrame, table: str) -> DataFrame:
    """Convert all-text rows (CSV and the like) to the declared types.

    Money may carry a currency sign, clock times are 12- or 24-hour, flags are 0/1, and the text
    ``null`` is no value.  Columns a feed leaves out stay out, so that defaults still apply.
    """
    converted = []
    for col in TABLES[table].columns:
        if col.name not in rows.columns:
            continue
        raw = F.col(f"`{col.name}`")
        text = F.when(F.lower(F.trim(raw)) != "null", raw)
        if col.clock:
            value = parse_clock(text)
        elif col.type == MONEY:
            value = parse_money(text)
        elif col.type == FLAG:
            value = F.when(F.trim(text).isin("1", "true"), True).when(F.trim(text).isin("0", "false"), False)
        else:
            value = text.try_cast(col.type)
        converted.append(value.alias(col.name))
    return rows.select(*converted)


def read_text_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A headed CSV file or folder as a typed table."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    return typed_from_text(raw, table)
