"""Bulk updates: cancellation with its cascade, payments, overdue refresh and range booking.

Tables are not changed in place.  Each job returns the full new versions of the tables it touches
and the caller writes them.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.functions.scalar import week_start
from eventbook.operators.reports import open_reservations

Tables = Mapping[str, DataFrame]


def _set_where(df: DataFrame, column: str, ids: DataFrame, key: str) -> DataFrame:
    """``column`` becomes true on the rows whose ``key`` is in ``ids`` (one column)."""
    marks = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    return (
        df.join(marks, F.col(key) == F.col("_id"), "left")
        .withColumn(column, F.when(F.col("_id").isNotNull(), True).otherwise(F.col(column)))
        .select(*df.columns)
    )


def cancel_cascade(t: Tables, cancelled: DataFrame) -> dict[str, DataFrame]:
    """Workshop bookings, their registrations and day registrations of cancelled reservations.

    ``cancelled`` holds the ``ReservationDayID`` of rows that have just become cancelled.
    """
    ids = cancelled.select("ReservationDayID").distinct()
    bookings = t["WorkshopsReservations"].join(ids, "ReservationDayID", "left_semi").select("ReservationID")
    return {
        "WorkshopsReservations": _set_where(t["WorkshopsReservations"], "Canceled", ids, "ReservationDayID"),
        "WorkshopRegistration": _set_where(
            t["WorkshopRegistration"], "Canceled", bookings, "WorkshopsReservationID"
        ),
        "ConferenceDayRegistration": _set_where(
            t["ConferenceDayRegistration"], "Canceled", ids, "ReservationDayID"
        ),
    }


def cancel_reservations(t: Tables, ids: DataFrame) -> dict[str, DataFrame]:
    """Cancel the reservations in ``ids``; the cascade follows those that were not cancelled yet."""
    asked = ids.select("ReservationDayID").distinct()
    reservations = t["ConferenceReservationDays"]
    not_yet = ~F.coalesce(F.col("Canceled"), F.lit(False))
    became = reservations.filter(not_yet).join(asked, "ReservationDayID", "left_semi").select("ReservationDayID")
    return {
        "ConferenceReservationDays": _set_where(reservations, "Canceled", asked, "ReservationDayID"),
        **cancel_cascade(t, became),
    }


def overdue_reservations(t: Tables, as_of: datetime.date) -> DataFrame:
    """Ids of unpaid live reservations booked in an earlier week than ``as_of``.

    Whether a reservation owes for workshops as well does not matter here, so no bookings are read,
    and the week is a bound on the date that the scan can use.
    """
    return open_reservations(t).filter(F.col("Date") < F.lit(week_start(as_of))).select("ReservationDayID").distinct()


def refresh_overdue(t: Tables, as_of: datetime.date) -> dict[str, DataFrame]:
    """Cancel overdue reservations."""
    return cancel_reservations(t, overdue_reservations(t, as_of))


def payment_counts(payments: DataFrame) -> DataFrame:
    """``(ReservationDayID, times)``; a much-paid reservation shrinks to one row before any join."""
    return payments.groupBy("ReservationDayID").agg(F.count(F.lit(1)).alias("times"))


def apply_payments(t: Tables, payments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Mark paid reservations and add every payment to its client's service counter."""
    return apply_payment_counts(t, payment_counts(t["Payments"] if payments is None else payments))


def apply_payment_counts(t: Tables, counts: DataFrame) -> dict[str, DataFrame]:
    """The same for payments already counted per reservation."""
    reservations, clients = t["ConferenceReservationDays"], t["Clients"]
    per_client = (
        counts.join(reservations.select("ReservationDayID", "ClientID"), "ReservationDayID")
        .groupBy("ClientID")
        .agg(F.sum("times").alias("_times"))
    )
    counter = F.col("ServiceCounter") + F.coalesce(F.col("_times"), F.lit(0)).cast("int")
    return {
        "ConferenceReservationDays": _set_where(
            reservations, "Paid", counts.select("ReservationDayID"), "ReservationDayID"
        ),
        "Clients": clients.join(per_client, "ClientID", "left")
        .withColumn("ServiceCounter", counter)
        .select(*clients.columns),
    }


def register_date_range(
    t: Tables,
    requests: DataFrame,
    reservation_date: datetime.date,
    inclusive_end: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """New reservation rows (without ids) for every conference day inside each request's dates.

    The conference id keeps this an equi join; the dates only filter its result, and a conference
    has few days.  A request that ends before it starts books nothing.  Send the rows on through
    ``ingest``, which takes each day by itself; ``book_date_ranges`` ends a request at its first refused day.
    ``keep`` names further columns of the requests, and ``_conference`` and ``_day``, to carry along.
    """
    days = t["ConferenceDays"].select("ConferenceDayID", "ConferenceID", F.col("Date").alias("_day"))
    days = days.withColumn("_conference", F.col("ConferenceID"))
    last = F.col("_day") <= F.col("DateEnd") if inclusive_end else F.col("_day") < F.col("DateEnd")
    return (
        requests.join(days, "ConferenceID")
        .filter((F.col("_day") >= F.col("DateStart")) & last)
        .select(
            F.lit(str(reservation_date)).cast("timestamp_ntz").alias("Date"),
            "ClientID",
            "NormalParticipantQuantity",
            "StudentParticipantQuantity",
            "Paid",
            "Amount",
            "ConferenceDayID",
            *keep,
        )
    )
