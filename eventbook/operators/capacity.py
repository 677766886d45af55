"""Free places per conference day and per workshop."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.functions.scalar import live


def day_limits(t: Mapping[str, DataFrame]) -> DataFrame:
    """``(ConferenceDayID, Limit)``: a day has the limit of its conference."""
    limits = t["Conferences"].select("ConferenceID", "Limit")
    return t["ConferenceDays"].select("ConferenceDayID", "ConferenceID").join(limits, "ConferenceID").drop("ConferenceID")


def workshop_limits(t: Mapping[str, DataFrame]) -> DataFrame:
    return t["Workshops"].select("WorkshopID", "Limit")


def heads():
    """People booked by one reservation row."""
    return F.col("NormalParticipantQuantity").cast("long") + F.col("StudentParticipantQuantity")


def day_occupancy(reservations: DataFrame) -> DataFrame:
    """``(ConferenceDayID, taken)`` over live reservations; one partial aggregate per task."""
    return (
        reservations.filter(live(F.col("Canceled")))
        .groupBy("ConferenceDayID")
        .agg(F.sum(heads()).alias("taken"))
    )


def workshop_occupancy(bookings: DataFrame) -> DataFrame:
    return bookings.filter(live(F.col("Canceled"))).groupBy("WorkshopID").agg(F.sum("Quantity").alias("taken"))


def _free(limits: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    limit = F.col("Limit").cast("long")
    return limits.join(taken, key, "left").select(key, F.coalesce(limit - F.col("taken"), limit).alias("free_places"))


def _among(df: DataFrame, only: DataFrame | None, key: str) -> DataFrame:
    return df if only is None else df.join(only.select(key), key, "left_semi")


def available_day_places(t: Mapping[str, DataFrame], only: DataFrame | None = None) -> DataFrame:
    """``(ConferenceDayID, free_places)``; an overbooked day is negative.

    ``only`` restricts the days before reservations are summed.
    """
    key = "ConferenceDayID"
    taken = day_occupancy(_among(t["ConferenceReservationDays"], only, key))
    return _free(_among(day_limits(t), only, key), taken, key)


def available_workshop_places(t: Mapping[str, DataFrame], only: DataFrame | None = None) -> DataFrame:
    """``(WorkshopID, free_places)``; an overbooked workshop is negative.

    ``only`` restricts the workshops before bookings are summed.
    """
    key = "WorkshopID"
    taken = workshop_occupancy(_among(t["WorkshopsReservations"], only, key))
    return _free(_among(workshop_limits(t), only, key), taken, key)
