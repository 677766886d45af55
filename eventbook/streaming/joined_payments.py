"""Payments and reservations that both arrive as streams, in any order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.operators.lifecycle import apply_payment_counts
from eventbook.streaming.levels import sums_of
from eventbook.streaming.sinks import run_to_end

#: Days after its reservation in which a payment is due, and by which events may be late.
WITHIN, LATE = 60, 30


def paid_events(payments: DataFrame, reservations: DataFrame, late: int = LATE, within: int = WITHIN) -> DataFrame:
    """``PaymentID, ReservationDayID`` of each payment once, as soon as it and its reservation are there.

    A payment waits for its reservation as well as the other way round.  What waits is state: it goes
    when the watermark shows that no partner can come any more, and so do the ids by which repeated
    deliveries are known.  Events that are later than ``late`` days behind the newest ones may be left out.
    Each of the two sides waits as one row: copies of every reservation, to deal the payments of a much-paid
    one to several tasks, would be most of the state, and each payment only meets the one row anyway.
    """
    paid = (
        payments.select("PaymentID", "ReservationDayID", F.col("Date").cast("timestamp").alias("paid_at"))
        .withWatermark("paid_at", f"{late} days")
        .dropDuplicatesWithinWatermark(["PaymentID"])
        .select("PaymentID", F.col("ReservationDayID").alias("paid_for"), "paid_at")
    )
    booked = (
        reservations.select("ReservationDayID", F.col("Date").cast("timestamp").alias("booked_at"))
        .withWatermark("booked_at", f"{late} days")
        .dropDuplicatesWithinWatermark(["ReservationDayID"])
    )
    due = F.expr(f"paid_at >= booked_at AND paid_at <= booked_at + INTERVAL {within} DAYS")
    return paid.join(booked, (F.col("paid_for") == F.col("ReservationDayID")) & due).select("PaymentID", "ReservationDayID")


def stream_joined_payments(
    payments: DataFrame, reservations: DataFrame, t: Mapping[str, DataFrame], folder: str, late: int = LATE, within: int = WITHIN
) -> dict[str, DataFrame]:
    """Run both streams to their end: clients with new counters, reservations with ``Paid`` set.

    Each batch adds its counts per reservation to a table of levels; clients and marks follow by joins with the
    stored tables ``t``.
    """
    counts = sums_of(t["Clients"].sparkSession, f"{folder}/counts", "ReservationDayID", "times")

    def add(events: DataFrame, batch_id: int) -> None:
        counts.add(events.groupBy(F.col("ReservationDayID").cast("long").alias("ReservationDayID")).agg(F.count(F.lit(1)).alias("times")), batch_id)

    run_to_end(paid_events(payments, reservations, late, within).writeStream.foreachBatch(add), f"{folder}/checkpoint")
    return apply_payment_counts(t, counts.read())
