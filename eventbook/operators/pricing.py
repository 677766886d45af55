"""Reservation prices and the two client views over upcoming events."""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventbook.functions.scalar import (
    as_date,
    cut_to_int,
    money,
    price_label,
    round_to_int,
    week_diff,
    within_days,
)
from eventbook.operators.capacity import available_day_places, available_workshop_places

# Fixed values of the price list: students pay this share, and a ticket costs
# (WEEK_STEPS - weeks left) times the base price.
STUDENT_SHARE = Decimal("0.8")
WEEK_STEPS = 4
# Upcoming means today up to and including this many days ahead.
WINDOW_DAYS = 21


def _week_factor(as_of: datetime.date, start: Column) -> Column:
    return F.lit(WEEK_STEPS) - week_diff(as_date(as_of), start)


def reservation_day_cost(t: Mapping[str, DataFrame], as_of: datetime.date) -> DataFrame:
    """``(ReservationDayID, cost, cost_both_scaled)``.

    ``cost`` scales only the student part by the weeks left; ``cost_both_scaled`` scales both.
    """
    prices = t["Conferences"].select(
        "ConferenceID",
        round_to_int(F.col("Price")).cast("long").alias("price"),
        cut_to_int(F.col("Price") * F.lit(STUDENT_SHARE)).cast("long").alias("student_price"),
        _week_factor(as_of, F.col("Start")).alias("factor"),
    )
    day_prices = t["ConferenceDays"].select("ConferenceDayID", "ConferenceID").join(prices, "ConferenceID")
    normal = F.col("NormalParticipantQuantity") * F.col("price")
    student = F.col("StudentParticipantQuantity") * F.col("student_price")
    return (
        t["ConferenceReservationDays"]
        .select("ReservationDayID", "ConferenceDayID", "NormalParticipantQuantity", "StudentParticipantQuantity")
        .join(day_prices, "ConferenceDayID")
        .select(
            "ReservationDayID",
            (normal + student * F.col("factor")).alias("cost"),
            ((normal + student) * F.col("factor")).alias("cost_both_scaled"),
        )
    )


def conferences_with_free_terms(
    t: Mapping[str, DataFrame], as_of: datetime.date, days: int = WINDOW_DAYS, as_written: bool = False
) -> DataFrame:
    """Days of conferences starting soon that still have places, with both ticket prices.

    ``as_written`` looks the free places up under the conference id instead of the day id.
    """
    factor = _week_factor(as_of, F.col("Start"))
    soon = (
        t["Conferences"]
        .filter(within_days(F.col("Start"), as_of, days))
        .select(
            "ConferenceID",
            F.col("Name").alias("conference_name"),
            F.col("Description").alias("description"),
            money(F.col("Price") * F.lit(STUDENT_SHARE) * factor).alias("student_ticket"),
            money(F.col("Price") * factor).alias("normal_ticket"),
        )
    )
    rows = (
        t["ConferenceDays"]
        .select("ConferenceDayID", "ConferenceID", F.col("Date").alias("event_date"), "Location")
        .join(soon, "ConferenceID")
    )
    lookup = "ConferenceID" if as_written else "ConferenceDayID"
    # Only the reservations of these few days are summed.
    asked = rows.select(F.col(lookup).alias("ConferenceDayID"))
    free = available_day_places(t, asked).filter(F.col("free_places") > 0).withColumnRenamed("ConferenceDayID", "free_key")
    return rows.join(free, F.col(lookup) == F.col("free_key")).select(
        "conference_name", "event_date", "free_places", "Location", "description", "student_ticket", "normal_ticket"
    )


def workshops_with_free_terms(
    t: Mapping[str, DataFrame], as_of: datetime.date, days: int = WINDOW_DAYS
) -> DataFrame:
    """Workshops on days coming soon that still have places."""
    soon = (
        t["ConferenceDays"]
        .filter(within_days(F.col("Date"), as_of, days))
        .select("ConferenceDayID", "ConferenceID", F.col("Date").alias("conference_date"), F.col("Location").alias("place"))
        .join(t["Conferences"].select("ConferenceID", F.col("Name").alias("conference_name")), "ConferenceID")
    )
    shops = (
        t["Workshops"]
        .select(
            "WorkshopID",
            "ConferenceDayID",
            F.col("Name").alias("workshop_name"),
            "Limit",
            price_label(F.col("price")).alias("price_label"),
        )
        .join(soon, "ConferenceDayID")
    )
    free = available_workshop_places(t, shops.select("WorkshopID")).filter(F.col("free_places") > 0)
    return shops.join(free, "WorkshopID").select(
        "workshop_name", "conference_name", "conference_date", "place", "free_places", "Limit", "price_label"
    )
