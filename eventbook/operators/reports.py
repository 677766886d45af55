"""Organiser views and keyed reports.

A report computes all keys in one pass.  The optional key arguments are plain filters, which
Catalyst moves to the scans.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.functions.scalar import live, money
from eventbook.operators.capacity import available_workshop_places, heads

Tables = Mapping[str, DataFrame]


def _only(df: DataFrame, **keys: int | None) -> DataFrame:
    for column, value in keys.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def _day_conference(t: Tables) -> DataFrame:
    return t["ConferenceDays"].select("ConferenceDayID", "ConferenceID")


def org_conferences(t: Tables) -> DataFrame:
    """One row per conference day with capacity and head counts (cancelled rows count as heads).

    Live and total figures come out of one aggregate over the reservations.
    """
    per_day = (
        t["ConferenceReservationDays"]
        .groupBy("ConferenceDayID")
        .agg(
            F.sum("StudentParticipantQuantity").alias("s"),
            F.sum("NormalParticipantQuantity").alias("n"),
            F.sum("ConferenceDayID").alias("id_sum"),
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.when(live(F.col("Canceled")), heads())).alias("taken"),
        )
    )
    conferences = t["Conferences"].select(
        "ConferenceID",
        F.col("Name").alias("conference_name"),
        F.col("Start").alias("start_ts"),
        F.col("End").alias("end_ts"),
        F.col("Limit").alias("limit"),
        F.col("Price").alias("base_price"),
        F.col("Description").alias("description"),
    )

    def or_zero(column: str):
        return F.coalesce(F.col(column), F.lit(0).cast("long"))

    return (
        t["ConferenceDays"]
        .select("ConferenceDayID", "ConferenceID", F.col("Date").alias("day"), F.col("Location").alias("place"))
        .join(conferences, "ConferenceID")
        .join(per_day, "ConferenceDayID", "left")
        .select(
            "conference_name",
            "day",
            "start_ts",
            "end_ts",
            "place",
            (F.col("limit").cast("long") - or_zero("taken")).alias("free_places"),
            "limit",
            or_zero("s").alias("students"),
            or_zero("n").alias("normals"),
            or_zero("id_sum").alias("reservation_id_sum"),
            or_zero("rows").alias("reservation_count"),
            "base_price",
            "description",
        )
    )


def org_not_registered(t: Tables) -> DataFrame:
    """Bookings with more heads than named registrations (cancelled registrations count as named)."""
    named = t["ConferenceDayRegistration"].groupBy("ReservationDayID").agg(F.count("ParticipantID").alias("named"))
    names = _day_conference(t).join(
        t["Conferences"].select("ConferenceID", F.col("Name").alias("conference_name")), "ConferenceID"
    )
    return (
        t["ConferenceReservationDays"]
        .select(
            "ReservationDayID",
            "ClientID",
            "ConferenceDayID",
            heads().alias("heads"),
            F.col("Date").alias("reservation_date"),
        )
        .join(named, "ReservationDayID", "left")
        .withColumn("unregistered", F.col("heads") - F.coalesce(F.col("named"), F.lit(0)))
        .filter(F.col("unregistered") > 0)
        .join(t["Clients"].select("ClientID", "Name", "Phone"), "ClientID")
        .join(names, "ConferenceDayID", "left")
        .select("Name", "Phone", "unregistered", "reservation_date", "conference_name")
    )


def org_top_clients(t: Tables, count: int = 100) -> DataFrame:
    """Clients with the highest service counter; ties go to the lower id."""
    return (
        t["Clients"]
        .select("ClientID", "Name", "ServiceCounter")
        .orderBy(F.desc("ServiceCounter"), "ClientID")
        .limit(count)
        .select(F.col("Name").alias("client_name"), F.col("ServiceCounter").alias("service_counter"))
    )


def org_client_payments(t: Tables) -> DataFrame:
    """Booked amounts per client, year and month with subtotals and a grand total.

    Months are summed first, so the rollup multiplies (client, month) rows instead of reservations.
    """
    months = (
        t["ConferenceReservationDays"]
        .groupBy("ClientID", F.year("Date").alias("year"), F.month("Date").alias("month"))
        .agg(F.sum("Amount").alias("amount"))
    )
    totals = months.rollup("ClientID", "year", "month").agg(money(F.sum("amount")).alias("paid_amount"))
    details = t["Clients"].select("ClientID", "Name", "Street", "City", "Country", "Email", "Phone", "isCompany")
    return details.join(totals, "ClientID", "right").select(
        "Name", "year", "month", "paid_amount", "Street", "City", "Country", "Email", "Phone", "isCompany"
    )


def open_reservations(t: Tables) -> DataFrame:
    """Unpaid live reservations with their client's name."""
    clients = t["Clients"].select("ClientID", "Name")
    return (
        t["ConferenceReservationDays"]
        .filter((F.col("Paid") == F.lit(False)) & live(F.col("Canceled")))
        .select("ReservationDayID", "ClientID", "Date", "Amount")
        .join(clients, "ClientID")
    )


def _booking_prices(t: Tables, bookings: DataFrame) -> DataFrame:
    """``(ReservationDayID, extra)``: price of each workshop booking."""
    prices = t["Workshops"].select("WorkshopID", "price")
    return (
        bookings.select("ReservationDayID", "WorkshopID", "Quantity")
        .join(prices, "WorkshopID", "left")
        .select("ReservationDayID", (F.col("Quantity") * F.col("price")).alias("extra"))
    )


def org_client_debts(t: Tables) -> DataFrame:
    """Unpaid live reservations with the amount owed, one row per workshop booking.

    The reservation amount repeats on every row and cancelled bookings are included; see
    ``client_debt_per_reservation`` for the figure per reservation.

    Reservations with and without bookings are taken apart: an inner join can be split where one
    reservation has very many bookings, the many-rowed side of an outer join cannot.
    """
    reservations = open_reservations(t)
    extras = _booking_prices(t, t["WorkshopsReservations"])
    booked = t["WorkshopsReservations"].select("ReservationDayID").distinct()
    with_bookings = reservations.join(extras, "ReservationDayID")
    without = reservations.join(booked, "ReservationDayID", "left_anti").withColumn("extra", F.lit(None))
    return with_bookings.unionByName(without).select(
        "ClientID",
        "Name",
        "ReservationDayID",
        money(F.col("Amount") + F.coalesce(F.col("extra"), F.lit(0))).alias("debt"),
        "Date",
    )


def _debt_sums(t: Tables) -> DataFrame:
    """``(ReservationDayID, debt)``: the rows of ``org_client_debts`` summed per reservation.

    Bookings are summed before the join; the amount counts once per booking, and once without any.
    """
    extras = (
        _booking_prices(t, t["WorkshopsReservations"])
        .groupBy("ReservationDayID")
        .agg(F.sum("extra").alias("extra"), F.count(F.lit(1)).alias("times"))
    )
    return (
        open_reservations(t)
        .join(extras, "ReservationDayID", "left")
        .select(
            "ReservationDayID",
            money(
                F.col("Amount") * F.coalesce(F.col("times"), F.lit(1)) + F.coalesce(F.col("extra"), F.lit(0))
            ).alias("debt"),
        )
    )


def client_debt_per_reservation(t: Tables) -> DataFrame:
    """Unpaid live reservations, one row each: its amount plus its live workshop bookings."""
    extras = (
        _booking_prices(t, t["WorkshopsReservations"].filter(live(F.col("Canceled"))))
        .groupBy("ReservationDayID")
        .agg(F.sum("extra").alias("extra"))
    )
    return (
        open_reservations(t)
        .join(extras, "ReservationDayID", "left")
        .select(
            "ClientID",
            "Name",
            "ReservationDayID",
            money(F.col("Amount") + F.coalesce(F.col("extra"), F.lit(0))).alias("debt"),
            "Date",
        )
    )


def participant_workshops(t: Tables) -> DataFrame:
    """Participants with the workshops they are signed up for."""
    workshops = (
        t["Workshops"]
        .select("WorkshopID", F.col("Name").alias("workshop_name"), "Start", "End", "ConferenceDayID")
        .join(t["ConferenceDays"].select("ConferenceDayID", "Date"), "ConferenceDayID")
    )
    bookings = t["WorkshopsReservations"].select("ReservationID", "WorkshopID")
    return (
        t["WorkshopRegistration"]
        .select("ConferenceRegistrationID", F.col("WorkshopsReservationID").alias("ReservationID"), "Canceled")
        .join(
            t["ConferenceDayRegistration"].select("ConferenceRegistrationID", "ParticipantID"),
            "ConferenceRegistrationID",
        )
        .join(bookings, "ReservationID")
        .join(workshops, "WorkshopID")
        .join(t["Participants"].select("ParticipantID", "ClientId", "Name"), "ParticipantID")
        .select("ClientId", "ParticipantID", "Canceled", "Name", "workshop_name", "Start", "End", "Date")
    )


def participant_conferences(t: Tables, participant_id: int | None = None) -> DataFrame:
    """Distinct conferences each participant is registered for.

    Duplicates go before the conference details are attached, so only ids are shuffled.
    """
    registrations = _only(t["ConferenceDayRegistration"], ParticipantID=participant_id)
    pairs = (
        registrations.select("ParticipantID", "ReservationDayID")
        .join(t["ConferenceReservationDays"].select("ReservationDayID", "ConferenceDayID"), "ReservationDayID")
        .join(_day_conference(t), "ConferenceDayID")
        .select("ParticipantID", "ConferenceID")
        .distinct()
    )
    details = t["Conferences"].select("ConferenceID", "Name", "Start", "End", "Description")
    return pairs.join(details, "ConferenceID").select(
        "ParticipantID", "ConferenceID", "Name", "Start", "End", "Description"
    )


def _conference_amounts(reservations: DataFrame, t: Tables) -> DataFrame:
    """Amount per client and conference.

    Reservations are summed per day first; the join to conferences then sees only those sums.
    """
    return (
        reservations.groupBy("ClientID", "ConferenceDayID")
        .agg(F.sum("Amount").alias("amount"))
        .join(_day_conference(t), "ConferenceDayID")
        .join(t["Conferences"].select("ConferenceID"), "ConferenceID")
        .select("ClientID", "ConferenceID", "amount")
    )


def client_conference_cost(t: Tables, client_id: int | None = None) -> DataFrame:
    """Booked amount per client and conference; ``ConferenceID`` is NULL on the client's total."""
    amounts = _conference_amounts(_only(t["ConferenceReservationDays"], ClientID=client_id), t)
    per_conference = amounts.groupBy("ClientID", "ConferenceID").agg(F.sum("amount").alias("amount"))
    return (
        per_conference.groupingSets(
            [["ClientID", "ConferenceID"], ["ClientID"]], "ClientID", "ConferenceID"
        )
        .agg(money(F.sum("amount")).alias("to_pay"))
        .filter(F.col("to_pay") > 0)
    )


def client_debt_by_participant(t: Tables, participant_id: int | None = None) -> DataFrame:
    """Debt of the reservations a participant is on, 0 where there is none.

    Debts are summed per reservation and registrations counted per (participant, reservation)
    before they meet, so the join never multiplies bookings by registrations.
    """
    seats = (
        _only(t["ConferenceDayRegistration"], ParticipantID=participant_id)
        .filter(live(F.col("Canceled")))
        .groupBy("ParticipantID", "ReservationDayID")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    if participant_id is not None:
        # The reservations of one participant are found first; only their bookings are summed.
        asked = seats.select("ReservationDayID")
        booked = {n: t[n].join(asked, "ReservationDayID", "left_semi") for n in ("ConferenceReservationDays", "WorkshopsReservations")}
        t = {**{n: t[n] for n in ("Clients", "Workshops", "Participants")}, **booked}
    owed = (
        seats.join(_debt_sums(t), "ReservationDayID")
        .groupBy("ParticipantID")
        .agg(F.sum(F.col("debt") * F.col("times")).alias("owed"))
    )
    people = _only(t["Participants"].select("ParticipantID"), ParticipantID=participant_id)
    return people.join(owed, "ParticipantID", "left").select(
        "ParticipantID", money(F.coalesce(F.col("owed"), F.lit(0))).alias("debt")
    )


def money_to_pay(t: Tables, pairs: DataFrame | None = None) -> DataFrame:
    """Unpaid amount per client and conference (cancelled reservations count).

    With ``pairs`` of ``(ClientID, ConferenceID)`` every asked pair is answered, 0 where nothing is
    open; without it the pairs with an unpaid reservation are listed.
    """
    unpaid = t["ConferenceReservationDays"].filter(F.col("Paid") == F.lit(False))
    amounts = (
        _conference_amounts(unpaid, t).groupBy("ClientID", "ConferenceID").agg(F.sum("amount").alias("amount"))
    )
    if pairs is not None:
        amounts = pairs.select("ClientID", "ConferenceID").distinct().join(amounts, ["ClientID", "ConferenceID"], "left")
    return amounts.select("ClientID", "ConferenceID", money(F.coalesce(F.col("amount"), F.lit(0))).alias("to_pay"))


def badge_names(t: Tables, conference_id: int | None = None, day_id: int | None = None) -> DataFrame:
    """Participant names per conference day, one row per registration."""
    days = _only(_day_conference(t), ConferenceID=conference_id, ConferenceDayID=day_id)
    return (
        t["ConferenceDayRegistration"]
        .select("ReservationDayID", "ParticipantID")
        .join(t["ConferenceReservationDays"].select("ReservationDayID", "ConferenceDayID"), "ReservationDayID")
        .join(days, "ConferenceDayID")
        .join(t["Participants"].select("ParticipantID", F.col("Name").alias("participant_name")), "ParticipantID")
        .select("ConferenceID", "ConferenceDayID", "participant_name")
    )


def workshop_participants(t: Tables, workshop_id: int | None = None) -> DataFrame:
    """Participant names per workshop, one row per registration."""
    bookings = _only(t["WorkshopsReservations"], WorkshopID=workshop_id).select("ReservationID", "WorkshopID")
    return (
        t["WorkshopRegistration"]
        .select("ConferenceRegistrationID", F.col("WorkshopsReservationID").alias("ReservationID"))
        .join(bookings, "ReservationID")
        .join(
            t["ConferenceDayRegistration"].select("ConferenceRegistrationID", "ParticipantID"),
            "ConferenceRegistrationID",
        )
        .join(t["Participants"].select("ParticipantID", F.col("Name").alias("name")), "ParticipantID")
        .select("WorkshopID", "name")
    )


def free_workshops(t: Tables, conference_id: int | None = None) -> DataFrame:
    """Workshops with places left, per conference."""
    days = _only(_day_conference(t), ConferenceID=conference_id)
    shops = t["Workshops"].select("WorkshopID", "Name", "ConferenceDayID").join(days, "ConferenceDayID")
    asked = None if conference_id is None else shops.select("WorkshopID")
    free = available_workshop_places(t, asked).filter(F.col("free_places") > 0).select("WorkshopID")
    return shops.join(free, "WorkshopID").select("ConferenceID", F.col("WorkshopID").alias("workshopid"), "Name")
