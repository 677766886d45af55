"""Updates of stored tables that write only the partitions they change.

The four tables that a cancellation touches are stored in partitions: reservations by the month of their date, the
others by ranges of the reservation (or booking) id that they follow, so that what belongs together lies together.
Ranges are as wide as the ids of a table need: sparse ids do not make a partition of a few rows each.
An update first finds the rows that will really change, then reads their partitions alone, and exchanges these.
Files of other partitions keep their names.

Spark stages the new versions in a folder beside the partitions before it exchanges any, and marks are only ever set,
so an update that ended early is repeated.  What follows a reservation is marked before it, because the cascade follows
those that are not cancelled yet; a repeated run finds the same ones until the last step.  The steps before that change
different tables and run side by side.  Executors may be lost at any time.  Only a driver that is lost while it exchanges
a partition can leave this one empty; its new version is then still in the folder beside.  One writer at a time.
"""

from __future__ import annotations

import datetime
import functools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventbook.functions.scalar import week_start
from eventbook.operators.key_bitmaps import BLOCK_BITS, KeyBitmaps
from eventbook.operators.lifecycle import overdue_reservations
from eventbook.schema import TABLES
from eventbook.session import cut_lineage, drop_written, side_by_side, unsorted_writes
from eventbook.sources.tables import BookingTables

PART = "part_"
#: Ids of a range, and the ranges of a table that hold rows; where there would be more, they are made wider.
RANGE = 1_000_000
MOST_RANGES = 256
#: Ids that are sent to every task; the rows that they mark then stay where they are read.  More ids are sent as
#: bitmaps, where they lie close enough for this many blocks.
MOST_SENT = 1_000_000
MOST_BLOCKS = 4_096
#: Partitions that a task has open at once while it writes; it sorts rows only where it meets more.
MOST_OPEN = 64
UNDATED = "none"


def _month(moment: str) -> Column:
    return F.coalesce(F.date_format(F.col(moment), "yyyy-MM"), F.lit(UNDATED))


def _range(key: str, width: int) -> Column:
    return F.coalesce(F.floor(F.col(key) / F.lit(float(width))).cast("string"), F.lit(UNDATED))


def _range_width(rows: DataFrame, key: str) -> int:
    """``RANGE``, doubled until at most ``MOST_RANGES`` ranges hold a key of ``rows``."""
    held = cut_lineage(rows.select(F.floor(F.col(key) / F.lit(float(RANGE))).alias("held")).distinct().dropna())
    times, count = 1, held.count()
    while count > MOST_RANGES:
        times *= 2 ** max(1, math.ceil(math.log2(count / MOST_RANGES)))
        count = held.select(F.floor(F.col("held") / F.lit(float(times)))).distinct().count()
    drop_written(held)
    return RANGE * times


# What each table is stored by: the month of a moment, or ranges of ids.
MONTHS_OF = {"ConferenceReservationDays": "Date"}
RANGES_OF = {
    "WorkshopsReservations": "ReservationDayID",
    "ConferenceDayRegistration": "ReservationDayID",
    "WorkshopRegistration": "WorkshopsReservationID",
}
PARTITIONS = (*MONTHS_OF, *RANGES_OF)


class Marks:
    """Ids that mark rows, in the form in which they meet them: sent as they are, as bitmaps, or by a join."""

    def __init__(self, ids: DataFrame):
        named = ids.select(F.col(ids.columns[0]).alias("_id"))
        self.ids = named.distinct()
        self.few = named.count() <= MOST_SENT
        self.bitmaps = None
        if not self.few:
            block = F.shiftright(F.col("_id").cast("long"), BLOCK_BITS)
            # About so many; the bitmaps count them.
            if named.agg(F.approx_count_distinct(block)).first()[0] <= MOST_BLOCKS:
                bitmaps = KeyBitmaps(named, "_id", MOST_BLOCKS)
                self.bitmaps = bitmaps if bitmaps.sent else None
        #: Whether rows stay where they are read.
        self.sent = self.few or self.bitmaps is not None

    def flag(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` with ``_marked``: whether ``key`` is one of the ids."""
        if self.bitmaps is not None:
            return self.bitmaps.mark(rows, key, "_marked")
        ids = F.broadcast(self.ids) if self.few else self.ids
        joined = rows.join(ids, F.col(key) == F.col("_id"), "left")
        return joined.withColumn("_marked", F.col("_id").isNotNull()).drop("_id")

    def of(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose ``key`` is one of the ids."""
        return self.flag(rows, key).filter("_marked").drop("_marked")


class PartitionedTable:
    """One of these tables below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, table: str):
        self.spark, self.path, self.table = spark, f"{folder}/{table}", table

    def create(self, rows: DataFrame, keys: DataFrame | None = None, placed: bool = False) -> None:
        """Store ``rows``; those of a partition are brought together first, large ones in several files.

        ``placed`` rows come in tasks that follow each other by the key of the ranges, and stay there.

        Where ranges are stored, the keys are read once more for their width: cut the lineage of dear rows first, or
        give ``keys``, rows with the same keys that are cheaper to read.
        """
        if self.table in MONTHS_OF:
            part = _month(MONTHS_OF[self.table])
        else:
            key = RANGES_OF[self.table]
            part = _range(key, _range_width(rows if keys is None else keys, key))
        parted = rows.withColumn(PART, part)
        (parted if placed else self._together(parted)).write.partitionBy(PART).parquet(self.path)

    @staticmethod
    def _together(placed: DataFrame) -> DataFrame:
        """Rows of a partition side by side; adaptive execution puts small partitions into one task and splits large ones."""
        return placed.hint("rebalance", F.col(PART))

    def _scan(self) -> DataFrame:
        names = [c.name for c in TABLES[self.table].columns if not c.secret]
        schema = ", ".join(f"`{n}` {TABLES[self.table].column(n).type.simpleString()}" for n in names)
        return self.spark.read.schema(f"{schema}, {PART} string").parquet(self.path)

    def read(self) -> DataFrame:
        return self._scan().drop(PART)

    def mark(self, column: str, ids: DataFrame | Marks, key: str, where: Column | None = None) -> list[str]:
        """Set ``column`` on the rows whose ``key`` is in ``ids``; returns the partitions that were exchanged.

        Rows that have the mark already change nothing, and a partition without other rows is not written.  ``where`` may
        bound the partitions to be searched.  The list is as long as there are partitions to exchange.
        """
        marks = ids if isinstance(ids, Marks) else Marks(ids)
        unset = ~F.coalesce(F.col(column), F.lit(False))
        scan = self._scan()
        rows = (scan if where is None else scan.filter(where)).filter(unset)
        hit = None
        if not marks.sent:
            # Ids of which no row has use are left out; the others may be few enough to be sent.
            hit = cut_lineage(marks.of(rows.select(key), key).distinct())
            marks = Marks(hit)
        found = marks.of(rows.select(key, PART), key).select(PART).distinct()
        parts = sorted(row[0] for row in found.collect())
        if parts:
            touched = scan.filter(F.col(PART).isin(parts))
            set_ = F.when(F.col("_marked"), True).otherwise(F.col(column))
            new = marks.flag(touched, key).withColumn(column, set_).select(*touched.columns)
            # Rows that meet the ids where they are read are still together.
            new = new if marks.sent else self._together(new)
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        if hit is not None:
            drop_written(hit)
        return parts


def store_tables(
    spark: SparkSession,
    t: Mapping[str, DataFrame],
    folder: str,
    names: Sequence[str] = PARTITIONS,
    keys: Mapping[str, DataFrame] | None = None,
    placed: Sequence[str] = (),
) -> dict[str, PartitionedTable]:
    """Store the tables that cancellations touch, or some of them; ``keys`` as for ``create``, ``placed`` names tables."""
    stored = {name: PartitionedTable(spark, folder, name) for name in names}

    def create(name: str) -> None:
        stored[name].create(t[name], (keys or {}).get(name), name in placed)

    with unsorted_writes(spark, MOST_OPEN):
        side_by_side(spark, *[functools.partial(create, name) for name in names])
    return stored


def cancel_stored(
    stored: Mapping[str, PartitionedTable], ids: DataFrame, where: Column | None = None
) -> dict[str, list[str]]:
    """Cancel the reservations in ``ids`` and what follows them; returns the exchanged partitions of each table.

    The result is that of ``cancel_reservations``.  ``where`` may bound the partitions of reservations that hold ``ids``.
    """
    spark, rows = stored["ConferenceReservationDays"].spark, stored["ConferenceReservationDays"]._scan()
    asked = ids.select("ReservationDayID").distinct()
    not_yet = ~F.coalesce(F.col("Canceled"), F.lit(False))
    if where is not None:
        rows = rows.filter(where)
    # Kept, since the steps below change what it is found from.
    became = cut_lineage(rows.filter(not_yet).join(asked, "ReservationDayID", "left_semi").select("ReservationDayID"))
    marks = Marks(became)

    def mark(table: str, by: DataFrame | Marks = marks, key: str = "ReservationDayID") -> dict[str, list[str]]:
        return {table: stored[table].mark("Canceled", by, key)}

    def mark_bookings() -> dict[str, list[str]]:
        # Read before they change.
        rows = marks.of(stored["WorkshopsReservations"].read(), "ReservationDayID")
        bookings = cut_lineage(rows.select("ReservationID"))
        shops, booked = side_by_side(
            spark,
            lambda: mark("WorkshopRegistration", bookings, "WorkshopsReservationID"),
            lambda: mark("WorkshopsReservations"),
        )
        drop_written(bookings)
        return shops | booked

    with unsorted_writes(spark, MOST_OPEN):
        bookings, seats = side_by_side(spark, mark_bookings, lambda: mark("ConferenceDayRegistration"))
        days = stored["ConferenceReservationDays"].mark("Canceled", marks, "ReservationDayID", where)
    drop_written(became)
    return bookings | seats | {"ConferenceReservationDays": days}


def refresh_overdue_stored(
    stored: Mapping[str, PartitionedTable], clients: DataFrame, as_of: datetime.date
) -> dict[str, list[str]]:
    """Cancel overdue reservations; months that begin after the last overdue week are not opened."""
    bound = F.col(PART) <= F.lit(week_start(as_of).strftime("%Y-%m"))
    rows = stored["ConferenceReservationDays"]._scan().filter(bound).drop(PART)
    t = BookingTables({"ConferenceReservationDays": rows, "Clients": clients})
    return cancel_stored(stored, overdue_reservations(t, as_of), bound)
