"""A small booking data set written by hand; the edge cases live here."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from eventbook.schema import TABLES
from eventbook.sources.tables import BookingTables


def moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def frame(spark, table: str, rows: list[dict]):
    """Rows with the declared types; keys not given are NULL, secret columns are left out."""
    columns = [c for c in TABLES[table].columns if not c.secret]
    schema = ", ".join(f"`{c.name}` {c.type.simpleString()}" for c in columns)
    return spark.createDataFrame([tuple(row.get(c.name) for c in columns) for row in rows], schema)


def client(key: int, **more) -> dict:
    return {
        "ClientID": key,
        "Name": f"Client {key}",
        "ServiceCounter": 3,
        "Street": "Main 1",
        "City": "Town",
        "Country": "Land",
        "Email": f"c{key}@mail.test",
        "Phone": "555 123",
        "isCompany": False,
        **more,
    }


def reservation(key: int, day_id: int, normal: int, student: int = 0, **more) -> dict:
    return {
        "ReservationDayID": key,
        "Date": moment("2020-03-02 10:00:00"),
        "ClientID": 1,
        "NormalParticipantQuantity": normal,
        "StudentParticipantQuantity": student,
        "Canceled": False,
        "Paid": False,
        "Amount": Decimal("10.0000"),
        "ConferenceDayID": day_id,
        **more,
    }


def booking(key: int, workshop: int, reservation_id: int, quantity: int, canceled: bool | None = False) -> dict:
    return {
        "ReservationID": key,
        "Canceled": canceled,
        "WorkshopID": workshop,
        "ReservationDayID": reservation_id,
        "Quantity": quantity,
    }


def workshop(key: int, day_id: int, start: int, end: int, limit: int = 10, price: str = "5.0000") -> dict:
    """Start and end in full hours."""
    return {
        "WorkshopID": key,
        "Name": f"Workshop {key}",
        "Limit": limit,
        "Start": start * 3600,
        "End": end * 3600,
        "Location": "Room",
        "price": Decimal(price),
        "ConferenceDayID": day_id,
    }


ROWS: dict[str, list[dict]] = {
    "Clients": [client(1), client(2, Phone=None, Country=None, isCompany=True), client(3, ServiceCounter=7)],
    "Participants": [
        {"ParticipantID": 1, "Name": "Ann", "StudentIndex": None, "ClientId": 1},
        {"ParticipantID": 2, "Name": "Bob", "StudentIndex": Decimal(77), "ClientId": 1},
        {"ParticipantID": 3, "Name": "Cid", "StudentIndex": None, "ClientId": 2},
    ],
    "Conferences": [
        {
            "ConferenceID": 1,
            "Name": "Spring",
            "Start": moment("2020-03-10 08:00:00"),
            "End": moment("2020-03-11 18:00:00"),
            "Limit": 10,
            "Description": None,
            "Price": Decimal("2.5000"),
        },
        {
            "ConferenceID": 2,
            "Name": "Autumn",
            "Start": moment("2020-09-01 09:30:00"),
            "End": moment("2020-09-01 17:00:00"),
            "Limit": 5,
            "Description": "one day",
            "Price": Decimal("3.1250"),
        },
    ],
    "ConferenceDays": [
        {"ConferenceDayID": 11, "Location": "A", "Date": day("2020-03-10"), "Start": 28800, "End": 64800, "ConferenceID": 1},
        {"ConferenceDayID": 12, "Location": "A", "Date": day("2020-03-11"), "Start": 28800, "End": 64800, "ConferenceID": 1},
        {"ConferenceDayID": 21, "Location": "B", "Date": day("2020-09-01"), "Start": 36000, "End": 57600, "ConferenceID": 2},
    ],
    "Workshops": [
        workshop(1, 11, 9, 10),
        workshop(2, 11, 10, 11, price="0.0000"),  # touches workshop 1
        workshop(3, 11, 8, 12, price="7.3350"),  # contains both
        workshop(4, 12, 9, 10),  # same time, other date
        workshop(5, 11, 13, 14),
    ],
    "ConferenceReservationDays": [
        reservation(1, 11, 3, 2),
        reservation(2, 11, 4, 0, Canceled=True, Paid=True),
        reservation(3, 12, 1, 1, ClientID=2, Canceled=None),
        reservation(4, 12, 2, 0, ClientID=2, Paid=True, Amount=Decimal("20.5000")),
        reservation(5, 12, 1, 0, ClientID=3, Date=moment("2020-03-08 00:00:00")),  # a Sunday
    ],
    "Payments": [
        {"PaymentID": 1, "Date": day("2020-03-03"), "ReservationDayID": 1},
        {"PaymentID": 2, "Date": day("2020-03-04"), "ReservationDayID": 1},
        {"PaymentID": 3, "Date": day("2020-03-04"), "ReservationDayID": 4},
    ],
    "WorkshopsReservations": [
        booking(1, 1, 1, 2),
        booking(2, 3, 1, 1),
        booking(3, 2, 1, 3, canceled=True),
        booking(4, 4, 4, 2),
        booking(5, 5, 3, 4, canceled=None),
        booking(6, 2, 1, 3),
    ],
    "ConferenceDayRegistration": [
        {"ConferenceRegistrationID": 1, "ReservationDayID": 1, "ParticipantID": 1, "Canceled": False},
        {"ConferenceRegistrationID": 2, "ReservationDayID": 1, "ParticipantID": 2, "Canceled": True},
        {"ConferenceRegistrationID": 3, "ReservationDayID": 4, "ParticipantID": 1, "Canceled": False},
        {"ConferenceRegistrationID": 4, "ReservationDayID": 1, "ParticipantID": 1, "Canceled": False},
    ],
    "WorkshopRegistration": [
        {"WorkshopRegistrationID": 1, "ConferenceRegistrationID": 1, "WorkshopsReservationID": 1, "Canceled": False},
        {"WorkshopRegistrationID": 2, "ConferenceRegistrationID": 1, "WorkshopsReservationID": 2, "Canceled": False},
        {"WorkshopRegistrationID": 3, "ConferenceRegistrationID": 1, "WorkshopsReservationID": 6, "Canceled": False},
        {"WorkshopRegistrationID": 4, "ConferenceRegistrationID": 3, "WorkshopsReservationID": 4, "Canceled": False},
        {"WorkshopRegistrationID": 5, "ConferenceRegistrationID": 2, "WorkshopsReservationID": 1, "Canceled": False},
        {"WorkshopRegistrationID": 6, "ConferenceRegistrationID": 2, "WorkshopsReservationID": 1, "Canceled": True},
    ],
}


def tables(spark, **changed: list[dict]) -> BookingTables:
    return BookingTables({name: frame(spark, name, changed.get(name, ROWS[name])) for name in TABLES})


def rows(df, *columns: str) -> list[tuple]:
    """Sorted rows, NULLs last."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda row: [(v is None, v) for v in row])
