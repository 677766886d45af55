"""The ten booking tables: types, keys, defaults and value rules, declared once.

Everything that reads or checks a table (typed scans, text loads, constraint checks, bulk
ingest) is driven by these declarations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = T.LongType()
COUNT = T.IntegerType()
CLOCK = T.IntegerType()  # seconds since midnight
MONEY = T.DecimalType(19, 4)
TEXT = T.StringType()
FLAG = T.BooleanType()
MOMENT = T.TimestampNTZType()
DAY = T.DateType()

NO_DEFAULT = object()


@dataclass(frozen=True)
class Col:
    name: str
    type: T.DataType
    required: bool = True
    length: int | None = None
    default: object = NO_DEFAULT
    clock: bool = False  # text form is a clock time such as '8:11 AM'
    secret: bool = False  # accepted and checked when a feed has it, never read by an operator


@dataclass(frozen=True)
class Check:
    """A value rule.  ``broken`` is true for a violation; an unknown (NULL) result passes."""

    rule: str
    text: str
    broken: Callable[[], Column]


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_key: str

    def rule(self, table: str) -> str:
        return f"FK {table}.{self.column}"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Col, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Check, ...] = field(default=())

    @property
    def key(self) -> str:
        return self.columns[0].name

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, True) for c in self.columns])

    def column(self, name: str) -> Col:
        return next(c for c in self.columns if c.name == name)


def _key(name: str) -> Col:
    return Col(name, KEY)


def _not_above_zero(name: str) -> Callable[[], Column]:
    return lambda: F.col(name) <= 0


def _starts_late() -> Column:
    return F.col("Start") >= F.col("End")


_TABLES = (
    Table(
        "Clients",
        (
            _key("ClientID"),
            Col("Name", TEXT, length=255),
            Col("ServiceCounter", COUNT, default=0),
            Col("Street", TEXT, length=255),
            Col("City", TEXT, length=255),
            Col("Country", TEXT, required=False, length=255, default="Polska"),
            Col("Login", TEXT, length=255, secret=True),
            Col("Password", TEXT, length=255, secret=True),
            Col("Email", TEXT, length=255),
            Col("Phone", TEXT, required=False, length=20),
            Col("isCompany", FLAG, required=False, default=False),
        ),
        checks=(
            Check("CHK-1", "ServiceCounter must be above 0", _not_above_zero("ServiceCounter")),
            Check("CHK-2", "Email must contain @", lambda: ~F.contains(F.col("Email"), F.lit("@"))),
            Check("CHK-3", "Phone must not contain letters", lambda: F.col("Phone").rlike("[A-Za-z]")),
        ),
    ),
    Table(
        "Participants",
        (
            _key("ParticipantID"),
            Col("Login", TEXT, length=255, secret=True),
            Col("Password", TEXT, length=255, secret=True),
            Col("Name", TEXT, length=255),
            Col("StudentIndex", T.DecimalType(20, 0), required=False),
            Col("ClientId", KEY),
        ),
        (ForeignKey("ClientId", "Clients", "ClientID"),),
    ),
    Table(
        "Conferences",
        (
            _key("ConferenceID"),
            Col("Name", TEXT, length=255),
            Col("Start", MOMENT),
            Col("End", MOMENT),
            Col("Limit", COUNT),
            Col("Description", TEXT, required=False, length=400),
            Col("Price", MONEY),
        ),
        checks=(
            Check("CHK-4", "Limit must be above 0", _not_above_zero("Limit")),
            Check("CHK-5", "Start must be before End", _starts_late),
        ),
    ),
    Table(
        "ConferenceDays",
        (
            _key("ConferenceDayID"),
            Col("Location", TEXT, length=255),
            Col("Date", DAY),
            Col("Start", CLOCK, clock=True),
            Col("End", CLOCK, clock=True),
            Col("ConferenceID", KEY),
        ),
        (ForeignKey("ConferenceID", "Conferences", "ConferenceID"),),
    ),
    Table(
        "Workshops",
        (
            _key("WorkshopID"),
            Col("Name", TEXT, length=255),
            Col("Limit", COUNT),
            Col("Start", CLOCK, clock=True),
            Col("End", CLOCK, clock=True),
            Col("Description", TEXT, required=False, length=255),
            Col("Location", TEXT, length=50),
            Col("price", MONEY, default=0),
            Col("ConferenceDayID", KEY),
        ),
        (ForeignKey("ConferenceDayID", "ConferenceDays", "ConferenceDayID"),),
        (
            Check("CHK-6", "Limit must be above 0", _not_above_zero("Limit")),
            Check("CHK-7", "Start must be before End", _starts_late),
        ),
    ),
    Table(
        "ConferenceReservationDays",
        (
            _key("ReservationDayID"),
            Col("Date", MOMENT),
            Col("ClientID", KEY),
            Col("NormalParticipantQuantity", COUNT),
            Col("StudentParticipantQuantity", COUNT),
            Col("Canceled", FLAG, required=False, default=False),
            Col("Paid", FLAG, required=False, default=False),
            Col("Amount", MONEY),
            Col("ConferenceDayID", KEY),
        ),
        (
            ForeignKey("ClientID", "Clients", "ClientID"),
            ForeignKey("ConferenceDayID", "ConferenceDays", "ConferenceDayID"),
        ),
    ),
    Table(
        "Payments",
        (_key("PaymentID"), Col("Date", DAY), Col("ReservationDayID", KEY)),
        (ForeignKey("ReservationDayID", "ConferenceReservationDays", "ReservationDayID"),),
    ),
    Table(
        "WorkshopsReservations",
        (
            _key("ReservationID"),
            Col("Canceled", FLAG, required=False, default=False),
            Col("WorkshopID", KEY),
            Col("ReservationDayID", KEY),
            Col("Quantity", COUNT),
        ),
        (
            ForeignKey("WorkshopID", "Workshops", "WorkshopID"),
            ForeignKey("ReservationDayID", "ConferenceReservationDays", "ReservationDayID"),
        ),
    ),
    Table(
        "ConferenceDayRegistration",
        (
            _key("ConferenceRegistrationID"),
            Col("ReservationDayID", KEY),
            Col("ParticipantID", KEY),
            Col("Canceled", FLAG),
        ),
        (
            ForeignKey("ReservationDayID", "ConferenceReservationDays", "ReservationDayID"),
            ForeignKey("ParticipantID", "Participants", "ParticipantID"),
        ),
    ),
    Table(
        "WorkshopRegistration",
        (
            _key("WorkshopRegistrationID"),
            Col("ConferenceRegistrationID", KEY),
            Col("WorkshopsReservationID", KEY),
            Col("Canceled", FLAG),
        ),
        (
            ForeignKey("ConferenceRegistrationID", "ConferenceDayRegistration", "ConferenceRegistrationID"),
            ForeignKey("WorkshopsReservationID", "WorkshopsReservations", "ReservationID"),
        ),
    ),
)

TABLES: dict[str, Table] = {table.name: table for table in _TABLES}

# Codes and texts that callers of the booking rules already know.
CODE_OVERLAP = 52000
CODE_WORKSHOP_FULL = 53000
CODE_DAY_FULL = 52300
CODE_QUOTA = 56000
CODE_DAY_DATE = 56002
CODE_DAY_CLOCK = 56003
CODE_DAY_TAKEN = 56004
TEXT_OVERLAP = (
    "Nie mozna rejestrowac sie na warsztaty ktore trwaja w tym samym czasie ConferenceRegistrationID = "
)
TEXT_WORKSHOP_FULL = "Przekroczony limit osob na warsztaty dla WorkshopID = "
TEXT_DAY_FULL = "Przekroczony limit osob na konferencje ConferenceDayID = "
TEXT_DAY_QUOTA = "Rezerwacja pelna ReservationDayId = "
TEXT_WORKSHOP_QUOTA = "Rezerwacja pelna ReservationID = "
TEXT_DAY_DATE = "Data dnia konferencji nie pokrywa się z konferencja"
TEXT_DAY_CLOCK = "Godzina dnia konferencji nie pokrywa się z konferencja"
TEXT_DAY_TAKEN = "Dzien konferencji juz istnieje"
FREE_LABEL = "darmowa"
