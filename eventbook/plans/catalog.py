"""Every operator as a named query over the star-schema folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventbook.functions.scalar import clock_text, parse_clock
from eventbook.operators import (
    admission,
    capacity,
    conflicts,
    constraints,
    lifecycle,
    pricing,
    reports,
    schedule,
)
from eventbook.operators.event_log import admit_day_log, admit_workshop_log
from eventbook.operators.identity import assign_ids, with_defaults
from eventbook.operators.ingest import ingest
from eventbook.operators.range_booking import book_date_ranges
from eventbook.operators.registrations import admit_workshop_registrations
from eventbook.operators.stored_updates import (
    PARTITIONS,
    Marks,
    PartitionedTable,
    cancel_stored,
    refresh_overdue_stored,
    store_tables,
)
from eventbook.schema import TABLES
from eventbook.session import cut_lineage, drop_written, run_folder, side_by_side
from eventbook.sources.adapter import AS_OF, SourceModel
from eventbook.sources.tables import BookingTables, read_tables, typed_from_text, write_tables
from eventbook.streaming.admission import stream_day_admission, stream_workshop_admission
from eventbook.streaming.joined_payments import stream_joined_payments
from eventbook.streaming.occupancy import stream_occupancy, stream_workshop_occupancy
from eventbook.streaming.payments import stream_payments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WIDE_WINDOW = 400


def _query(name: str) -> Callable[[Callable[[SourceModel], DataFrame]], Callable[[SourceModel], DataFrame]]:
    """Register a function of the derived tables under ``name``."""

    def register(build: Callable[[SourceModel], DataFrame]) -> Callable[[SourceModel], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(SourceModel(spark, folder))
        return build

    return register


# Capacity, prices, client views.
_query("available_day_places")(lambda m: capacity.available_day_places(m.tables))
_query("available_workshop_places")(lambda m: capacity.available_workshop_places(m.tables))
_query("reservation_day_cost")(lambda m: pricing.reservation_day_cost(m.tables, AS_OF))
_query("conferences_with_free_terms")(lambda m: pricing.conferences_with_free_terms(m.tables, AS_OF))
_query("conferences_with_free_terms_wide")(
    lambda m: pricing.conferences_with_free_terms(m.tables, AS_OF, days=WIDE_WINDOW)
)
_query("conferences_with_free_terms_as_written")(
    lambda m: pricing.conferences_with_free_terms(m.tables, AS_OF, days=WIDE_WINDOW, as_written=True)
)
_query("workshops_with_free_terms")(lambda m: pricing.workshops_with_free_terms(m.tables, AS_OF))
_query("workshops_with_free_terms_wide")(
    lambda m: pricing.workshops_with_free_terms(m.tables, AS_OF, days=WIDE_WINDOW)
)

# Organiser views and keyed reports.
for _report in (
    reports.org_conferences,
    reports.org_not_registered,
    reports.org_top_clients,
    reports.org_client_payments,
    reports.org_client_debts,
    reports.client_debt_per_reservation,
    reports.participant_workshops,
    reports.participant_conferences,
    reports.client_conference_cost,
    reports.client_debt_by_participant,
    reports.money_to_pay,
    reports.badge_names,
    reports.workshop_participants,
    reports.free_workshops,
):
    _query(_report.__name__)(lambda m, report=_report: report(m.tables))


# The same for one key, which restricts what is summed.
KEY = 3
_query("free_workshops_of_conference")(lambda m: reports.free_workshops(m.tables, conference_id=KEY))
_query("client_debt_of_participant")(lambda m: reports.client_debt_by_participant(m.tables, participant_id=KEY))


@_query("money_to_pay_all_pairs")
def _money_to_pay_all_pairs(m: SourceModel) -> DataFrame:
    """Each client asks about the conference of its own range booking, open or not."""
    return reports.money_to_pay(m.tables, m.range_requests().select("ClientID", "ConferenceID"))


# Updates.
for _name, _table in (
    ("", "ConferenceReservationDays"),
    ("_wres", "WorkshopsReservations"),
    ("_wreg", "WorkshopRegistration"),
    ("_creg", "ConferenceDayRegistration"),
):
    _query(f"cancel_reservations{_name}")(
        lambda m, table=_table: lifecycle.cancel_reservations(m.tables, m.cancellations())[table]
    )
    _query(f"refresh_overdue{_name}")(lambda m, table=_table: lifecycle.refresh_overdue(m.tables, AS_OF)[table])
    if _name:
        # The cascade on its own: reservations that stand as cancelled take their bookings along.
        _query(f"cancel_cascade{_name}")(
            lambda m, table=_table: lifecycle.cancel_cascade(
                m.tables, m.tables["ConferenceReservationDays"].filter("Canceled").select("ReservationDayID")
            )[table]
        )


def _stored(m: SourceModel) -> dict[str, PartitionedTable]:
    folder, keys = run_folder(m.spark, "partitions"), m.tables["WorkshopsReservations"]
    m.tables = m.tables.replace(WorkshopsReservations=m.bookings_in_tasks())
    first = [name for name in PARTITIONS if name != "WorkshopRegistration"]
    stored, registered = side_by_side(
        m.spark,
        lambda: store_tables(m.spark, m.tables, folder, first, {"WorkshopsReservations": keys}, ["WorkshopsReservations"]),
        lambda: Marks(m.tables["ConferenceDayRegistration"].select("ReservationDayID")),
    )
    # Registrations follow the stored bookings, so that these are grouped once; they are read again for their ranges.
    # Bookings of reservations that nobody is registered for have none, and are left out before they move.
    bookings = stored["WorkshopsReservations"].read()
    followed = registered.of(bookings, "ReservationDayID") if registered.sent else bookings
    m.tables = m.tables.replace(WorkshopsReservations=followed)
    written = cut_lineage(m.tables["WorkshopRegistration"])
    m.tables = m.tables.replace(WorkshopsReservations=bookings, WorkshopRegistration=written)
    stored |= store_tables(m.spark, m.tables, folder, ["WorkshopRegistration"])
    drop_written(written)
    return stored


def _stored_cancellations(m: SourceModel, table: str) -> DataFrame:
    stored = _stored(m)
    cancel_stored(stored, m.cancellations())
    return stored[table].read()


def _stored_refresh(m: SourceModel, table: str) -> DataFrame:
    stored = _stored(m)
    refresh_overdue_stored(stored, m.tables["Clients"], AS_OF)
    return stored[table].read()


# The same in tables stored by partitions, of which only those that change are written.
for _name, _table in (
    ("", "ConferenceReservationDays"),
    ("_wres", "WorkshopsReservations"),
    ("_wreg", "WorkshopRegistration"),
    ("_creg", "ConferenceDayRegistration"),
):
    _query(f"cancel_stored{_name}")(lambda m, table=_table: _stored_cancellations(m, table))
    _query(f"refresh_overdue_stored{_name}")(lambda m, table=_table: _stored_refresh(m, table))
_query("apply_payments_reservations")(lambda m: lifecycle.apply_payments(m.tables)["ConferenceReservationDays"])
_query("apply_payments_clients")(lambda m: lifecycle.apply_payments(m.tables)["Clients"])
_query("register_date_range")(lambda m: lifecycle.register_date_range(m.tables, m.range_requests(), AS_OF))
_query("register_date_range_exclusive")(
    lambda m: lifecycle.register_date_range(m.tables, m.range_requests(), AS_OF, inclusive_end=False)
)


# Rules on arriving rows.
def _code(df: DataFrame, *keys: str) -> DataFrame:
    """Keys and reason code of every row, 0 where accepted."""
    return df.select(*keys, F.coalesce(F.col("code"), F.lit(0)).alias("code"))


@_query("workshop_conflicts")
def _workshop_conflicts(m: SourceModel) -> DataFrame:
    return conflicts.workshop_conflicts(m.tables).drop("message")


@_query("admit_non_overlapping")
def _admit_non_overlapping(m: SourceModel) -> DataFrame:
    return conflicts.admit_non_overlapping(m.tables).select("WorkshopRegistrationID", "admitted")


@_query("admit_workshop_registrations")
def _admit_workshop_registrations(m: SourceModel) -> DataFrame:
    out = admit_workshop_registrations(m.tables, m.tables["WorkshopRegistration"])
    return _code(out, "WorkshopRegistrationID")


@_query("admit_workshop_reservations")
def _admit_workshop_reservations(m: SourceModel) -> DataFrame:
    out = admission.admit_workshop_reservations(m.tables, m.tables["WorkshopsReservations"])
    return _code(out, "ReservationID", "WorkshopID")


@_query("admit_day_reservations")
def _admit_day_reservations(m: SourceModel) -> DataFrame:
    out = admission.admit_day_reservations(m.tables, m.tables["ConferenceReservationDays"], stored=True)
    return _code(out, "ReservationDayID", "ConferenceDayID")


@_query("admit_day_reservations_onto_existing")
def _admit_day_reservations_onto_existing(m: SourceModel) -> DataFrame:
    """Reservations of the first half of the customers stand; the others arrive as new rows."""
    rows = m.tables["ConferenceReservationDays"]
    half = m.customer_count // 2
    out = admission.admit_day_reservations(
        m.tables, rows.filter(F.col("ClientID") >= half), rows.filter(F.col("ClientID") < half), stored=True
    )
    return _code(out, "ReservationDayID", "ConferenceDayID")


@_query("day_registration_quota")
def _day_registration_quota(m: SourceModel) -> DataFrame:
    out = admission.day_registration_quota(m.tables, m.tables["ConferenceDayRegistration"], stored=True)
    return _code(out, "ConferenceRegistrationID", "ReservationDayID")


@_query("workshop_registration_quota")
def _workshop_registration_quota(m: SourceModel) -> DataFrame:
    out = admission.workshop_registration_quota(m.tables, m.tables["WorkshopRegistration"])
    return _code(out, "WorkshopRegistrationID", "WorkshopsReservationID")


@_query("validate_conference_days")
def _validate_conference_days(m: SourceModel) -> DataFrame:
    return _code(schedule.validate_conference_days(m.tables, m.day_feed()), "ConferenceDayID")


@_query("validate_conference_days_per_conference")
def _validate_conference_days_per_conference(m: SourceModel) -> DataFrame:
    return _code(schedule.validate_conference_days(m.tables, m.day_feed(), scope="conference"), "ConferenceDayID")


# Constraint checks over tables damaged at fixed key steps.
def _damaged(m: SourceModel) -> BookingTables:
    return BookingTables({name: (lambda name=name: m.damaged(name)) for name in TABLES})


_query("violations_checks")(lambda m: constraints.violations(m.tables, kinds=("CHK",)))
_query("violations_not_null")(lambda m: constraints.violations(_damaged(m), kinds=("NN",)))
_query("violations_length")(lambda m: constraints.violations(_damaged(m), kinds=("LEN",)))
_query("violations_fk")(lambda m: constraints.violations(_damaged(m), kinds=("FK",), parents=m.tables))
_query("violations_fk_bitmaps")(
    lambda m: constraints.violations(_damaged(m), kinds=("FK",), parents=m.tables, bitmaps=True)
)


def _unruly(m: SourceModel, kind: str) -> DataFrame:
    tables = BookingTables({name: (lambda name=name: m.unruly(name, kind)) for name in TABLES})
    return constraints.violations(tables, kinds=(kind,))


for _kind in ("CHK", "NN", "LEN", "PK"):
    # Each rule of the kind is broken by some row of every table that has it.
    _query(f"violations_of_every_{_kind.lower()}")(lambda m, kind=_kind: _unruly(m, kind))


@_query("available_day_places_unknown_flags")
def _available_day_places_unknown_flags(m: SourceModel) -> DataFrame:
    """Free places where it is not known of every fifth reservation whether it is cancelled."""
    rows = m.tables["ConferenceReservationDays"]
    unknown = rows.withColumn("Canceled", F.when(F.col("ReservationDayID") % 5 == 0, None).otherwise(F.col("Canceled")))
    return capacity.available_day_places(m.tables.replace(ConferenceReservationDays=unknown))


def _line_keys(m: SourceModel) -> DataFrame:
    """Line items keyed by order and line number, which is not unique, as workshop bookings."""
    return m.scan("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ReservationID"))


_query("violations_pk")(lambda m: constraints.key_violations(_line_keys(m), "WorkshopsReservations"))
_query("violations_pk_bitmaps")(
    lambda m: constraints.key_violations(_line_keys(m), "WorkshopsReservations", bitmaps=True)
)


# Bulk ingest: what arrives, with its new id, rule and code.
def _outcome(result, *columns: str) -> DataFrame:
    none = F.lit("")
    return result.checked.select(
        *columns, F.coalesce(F.col("rule"), none).alias("rule"), F.coalesce(F.col("code"), F.lit(0)).alias("code")
    )


def _sign_in(key) -> list:
    """The columns for signing in, which every feed of people has to bring."""
    name = F.concat(F.lit("user"), key.cast("string"))
    return [name.alias("Login"), F.sha2(name, 256).alias("Password")]


@_query("ingest_clients")
def _ingest_clients(m: SourceModel) -> DataFrame:
    """Odd customers arrive, even ones exist; companies' feed rows state no counter above 0."""
    clients = m.tables["Clients"]
    feed = clients.filter(F.col("ClientID") % 2 == 1).select(
        F.col("ClientID").alias("feed_key"),
        "Name",
        F.when(F.col("isCompany"), F.lit(0)).otherwise(F.col("ServiceCounter")).alias("ServiceCounter"),
        "Street",
        "City",
        "Email",
        "Phone",
        "isCompany",
        *_sign_in(F.col("ClientID")),
    )
    t = m.tables.replace(Clients=clients.filter(F.col("ClientID") % 2 == 0))
    return _outcome(
        ingest(t, "Clients", feed, order_by=["feed_key"]), "ClientID", "Name", "Country", "isCompany", "ServiceCounter"
    )


@_query("ingest_participants")
def _ingest_participants(m: SourceModel) -> DataFrame:
    people = m.damaged("Participants")
    t = m.tables.replace(Participants=m.tables["Participants"].filter("ParticipantID % 2 = 0"))
    feed = people.filter("ParticipantID % 2 = 1").select("Name", "StudentIndex", "ClientId", *_sign_in(F.col("ParticipantID")))
    return _outcome(ingest(t, "Participants", feed, order_by=["StudentIndex"]), "ParticipantID", "StudentIndex", "ClientId")


@_query("ingest_conferences")
def _ingest_conferences(m: SourceModel) -> DataFrame:
    """Conferences arrive in order of start and name, some ending when they start, some without room."""
    feed = m.damaged("Conferences")
    key = F.col("ConferenceID")
    feed = feed.withColumn("End", F.when(key % 13 == 0, F.col("Start")).otherwise(F.col("End"))).withColumn(
        "Limit", F.when(key % 17 == 0, 0).otherwise(F.col("Limit"))
    )
    return _outcome(
        ingest(m.tables, "Conferences", feed.withColumnRenamed("ConferenceID", "feed_key"), order_by=["Start", "feed_key"]),
        "ConferenceID",
        "Start",
        "Price",
    )


@_query("ingest_conference_days")
def _ingest_conference_days(m: SourceModel) -> DataFrame:
    """The day feed arrives while every third conference already has its days."""
    days = m.tables["ConferenceDays"]
    t = m.tables.replace(ConferenceDays=days.filter("ConferenceID % 3 = 0"))
    feed = m.day_feed().filter("ConferenceID % 3 <> 0").withColumnRenamed("ConferenceDayID", "feed_key")
    return _outcome(
        ingest(t, "ConferenceDays", feed, order_by=["feed_key"]), "ConferenceDayID", "ConferenceID", "Date"
    )


@_query("ingest_workshops")
def _ingest_workshops(m: SourceModel) -> DataFrame:
    """Workshops arrive without a price; some are placed on days that do not exist."""
    feed = m.damaged("Workshops").drop("price").withColumnRenamed("WorkshopID", "feed_key")
    return _outcome(
        ingest(m.tables, "Workshops", feed, order_by=["feed_key"]), "WorkshopID", "ConferenceDayID", "price"
    )


@_query("ingest_day_reservations")
def _ingest_day_reservations(m: SourceModel) -> DataFrame:
    """Reservations of odd clients arrive in date order onto those of even clients."""
    rows = m.tables["ConferenceReservationDays"]
    t = m.tables.replace(ConferenceReservationDays=rows.filter("ClientID % 2 = 0"))
    feed = (
        m.damaged("ConferenceReservationDays")
        .filter("ClientID % 2 <> 0")
        .drop("Canceled")
        .withColumnRenamed("ReservationDayID", "feed_key")
    )
    return _outcome(
        ingest(t, "ConferenceReservationDays", feed, order_by=["Date", "feed_key"]),
        "ReservationDayID",
        "ClientID",
        "ConferenceDayID",
        "Canceled",
    )


@_query("ingest_workshop_reservations")
def _ingest_workshop_reservations(m: SourceModel) -> DataFrame:
    """Bookings with ids of their own arrive onto those of every fourth order."""
    rows = m.tables["WorkshopsReservations"]
    t = m.tables.replace(WorkshopsReservations=rows.filter("ReservationDayID % 4 = 0"))
    return _outcome(
        ingest(t, "WorkshopsReservations", m.damaged("WorkshopsReservations")), "ReservationID", "WorkshopID"
    )


@_query("ingest_payments")
def _ingest_payments(m: SourceModel) -> DataFrame:
    payments = m.damaged("Payments").withColumnRenamed("PaymentID", "feed_key")
    return _outcome(
        ingest(m.tables, "Payments", payments, order_by=["Date", "feed_key"]), "PaymentID", "Date", "ReservationDayID"
    )


def _ingested_payments(m: SourceModel):
    payments = m.damaged("Payments").withColumnRenamed("PaymentID", "feed_key")
    return ingest(m.tables, "Payments", payments, order_by=["Date", "feed_key"]).changed


_query("ingest_payments_clients")(lambda m: _ingested_payments(m)["Clients"].select("ClientID", "ServiceCounter"))
_query("ingest_payments_reservations")(
    lambda m: _ingested_payments(m)["ConferenceReservationDays"].select("ReservationDayID", "Paid")
)


@_query("ingest_day_registrations")
def _ingest_day_registrations(m: SourceModel) -> DataFrame:
    """Registrations of odd participants arrive onto those of even participants."""
    rows = m.tables["ConferenceDayRegistration"]
    t = m.tables.replace(ConferenceDayRegistration=rows.filter("ParticipantID % 2 = 0"))
    feed = (
        m.damaged("ConferenceDayRegistration")
        .filter("ParticipantID % 2 <> 0")
        .withColumnRenamed("ConferenceRegistrationID", "feed_key")
    )
    return _outcome(
        ingest(t, "ConferenceDayRegistration", feed, order_by=["feed_key"]),
        "ConferenceRegistrationID",
        "ReservationDayID",
        "ParticipantID",
    )


@_query("ingest_workshop_registrations")
def _ingest_workshop_registrations(m: SourceModel) -> DataFrame:
    """New registrations under both rules, while those of every fifth day registration stand."""
    rows = m.tables["WorkshopRegistration"]
    t = m.tables.replace(WorkshopRegistration=rows.filter("ConferenceRegistrationID % 5 = 0"))
    feed = rows.filter("ConferenceRegistrationID % 5 <> 0")
    return _outcome(ingest(t, "WorkshopRegistration", feed), "WorkshopRegistrationID")


@_query("register_date_range_booked")
def _register_date_range_booked(m: SourceModel) -> DataFrame:
    """Range bookings sent on through ingest onto the stored reservations."""
    new = lifecycle.register_date_range(m.tables, m.range_requests(), AS_OF)
    out = ingest(m.tables, "ConferenceReservationDays", new, order_by=["ClientID", "ConferenceDayID"])
    return _outcome(out, "ReservationDayID", "ClientID", "ConferenceDayID")


def _crowded_requests(m: SourceModel) -> DataFrame:
    """Range bookings of whole groups that begin before, on and after the first day of their conference."""
    key = F.col("ClientID")
    return m.range_requests().withColumns(
        {
            "DateStart": F.date_add("DateStart", (F.lit(1) + key % 5 % 3).cast("int")),
            "DateEnd": F.date_add("DateStart", (F.lit(3) + key % 2).cast("int")),
            "NormalParticipantQuantity": (F.lit(10) + key % 37).cast("int"),
            "StudentParticipantQuantity": (key % 11).cast("int"),
        }
    )


@_query("book_date_ranges")
def _book_date_ranges(m: SourceModel) -> DataFrame:
    """Range bookings that end at their first refused day, onto the stored reservations."""
    out = book_date_ranges(m.tables, _crowded_requests(m), AS_OF, order_by=["ClientID"])
    return _outcome(out, "ReservationDayID", "ClientID", "ConferenceDayID")


def _cancellation_log(m: SourceModel) -> tuple[DataFrame, DataFrame]:
    """All reservations by their ids, and cancellations of every third one up to 900 reservations later."""
    key = F.col("ReservationDayID")
    rows = m.tables["ConferenceReservationDays"].withColumn("moment", 2 * key)
    return rows, rows.filter(key % 3 == 0).select("ReservationDayID", (2 * (key + 1 + (key * 7) % 900) + 1).alias("moment"))


@_query("admit_day_log")
def _admit_day_log(m: SourceModel) -> DataFrame:
    """Day reservations in order, with cancellations in between that give places back."""
    out = admit_day_log(m.tables, *_cancellation_log(m), at="moment")
    return out.select("ReservationDayID", "ConferenceDayID", "admitted")


@_query("admit_workshop_log")
def _admit_workshop_log(m: SourceModel) -> DataFrame:
    """Workshop bookings in order; a seventh of them is cancelled later."""
    key = F.col("ReservationID")
    rows = m.tables["WorkshopsReservations"].withColumn("moment", 2 * key)
    ends = rows.filter(key % 7 == 0).select("ReservationID", (2 * key + 100_000 * (key % 5000) + 1).alias("moment"))
    return admit_workshop_log(m.tables, rows, ends, at="moment").select("ReservationID", "WorkshopID", "admitted")


@_query("assign_ids")
def _assign_ids(m: SourceModel) -> DataFrame:
    """Orders numbered by date and key after the highest customer key."""
    feed = m.scan("orders").select("o_orderdate", "o_orderkey")
    existing = m.scan("customer").select(F.col("c_custkey").alias("new_id"))
    return assign_ids(feed, existing, "new_id", ["o_orderdate", "o_orderkey"]).select("new_id", "o_orderkey")


@_query("column_defaults")
def _column_defaults(m: SourceModel) -> DataFrame:
    """Clients without the columns that have defaults, and with a stated NULL that must stay."""
    feed = m.tables["Clients"].select("ClientID", "Name", "Street", "City", "Email", "Phone")
    return with_defaults(feed, "Clients").select("ClientID", "ServiceCounter", "Country", "Phone", "isCompany")


# Text loads and typed storage.
@_query("typed_from_text")
def _typed_from_text(m: SourceModel) -> DataFrame:
    """Workshops written out as text (12-hour clock, currency sign, 0/1) and read back."""

    def clock(column: str):
        hour = F.floor(F.col(column) / 3600).cast("int")
        shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
        rest = F.substring(clock_text(F.col(column)), 3, 3)
        return F.concat(shown, rest, F.when(hour < 12, F.lit(" AM")).otherwise(F.lit(" PM")))

    text = m.tables["Workshops"].select(
        F.col("WorkshopID").cast("string").alias("WorkshopID"),
        "Name",
        F.col("Limit").cast("string").alias("Limit"),
        clock("Start").alias("Start"),
        clock("End").alias("End"),
        F.coalesce("Description", F.lit("null")).alias("Description"),
        "Location",
        F.concat(F.lit("$"), F.col("price").cast("decimal(19,2)").cast("string")).alias("price"),
        F.col("ConferenceDayID").cast("string").alias("ConferenceDayID"),
    )
    return typed_from_text(text, "Workshops")


@_query("parse_clock_orders")
def _parse_clock_orders(m: SourceModel) -> DataFrame:
    """Clock texts of many shapes, one per order, including ones that are no time."""
    key = F.col("o_orderkey")
    hour, minute = (key % 26).cast("string"), F.lpad((key % 61).cast("string"), 2, "0")
    suffix = F.when(key % 3 == 0, F.lit(" AM")).when(key % 3 == 1, F.lit(" pm")).otherwise(F.lit(""))
    text = F.concat(hour, F.lit(":"), minute, suffix)
    return m.scan("orders").select("o_orderkey", F.coalesce(parse_clock(text), F.lit(-1)).alias("seconds"))


@_query("stored_tables")
def _stored_tables(m: SourceModel) -> DataFrame:
    """Reservations appended to storage in two parts and scanned back with declared types."""
    folder = run_folder(m.spark, "stored")
    rows = m.tables["ConferenceReservationDays"]
    for part in ("Paid", "not Paid"):
        write_tables({"ConferenceReservationDays": rows.filter(part)}, folder)
    return read_tables(m.spark, folder)["ConferenceReservationDays"]


# Streams, run to the end of what is available: all at once, and again in parts, of which each arrives after the
# stream has stopped and is taken up from the checkpoint.
BATCHES, ARRIVAL_ROWS, FILE_ROWS = 3, 5_000_000, 500_000
Arriving = Callable[[str], SourceModel]
KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def _arrivals(m: SourceModel, source: str) -> list[DataFrame]:
    """The source's rows in parts that follow each other in key order; their number grows with the table.  Rows
    without a key come last."""
    rows, key = m.scan(source), F.col(KEYS[source])
    n = max(BATCHES, -(-rows.count() // ARRIVAL_ROWS))
    edges = sorted(set(rows.approxQuantile(KEYS[source], [k / n for k in range(1, n)], 0.1 / n)))
    bounds = zip([None, *edges], [*edges, None], strict=True)
    parts = [(F.lit(True) if low is None else key > low) & (F.lit(True) if high is None else key <= high) for low, high in bounds]
    parts[-1] = parts[-1] | key.isNull() if len(parts) > 1 else F.lit(True)
    return [rows.filter(part) for part in parts]


def _streams(name: str, source: str):
    """Register a query of (tables, arriving tables, folder) for both ways of arriving."""

    def register(build: Callable[[SourceModel, Arriving, str], DataFrame]) -> None:
        def at_once(m: SourceModel) -> DataFrame:
            return build(m, lambda of: SourceModel(m.spark, m.folder, streaming=(of,)), run_folder(m.spark, name))

        def in_parts(m: SourceModel) -> DataFrame:
            folder, landing = run_folder(m.spark, name), run_folder(m.spark, "arrivals")
            for part in _arrivals(m, source):
                by_key = part.repartitionByRange(F.col(KEYS[source]).asc_nulls_last())
                by_key.write.option("maxRecordsPerFile", FILE_ROWS).mode("append").parquet(landing)
                out = build(m, lambda of: SourceModel(m.spark, m.folder, arrivals={of: landing}), folder)
            return out

        _query(name)(at_once)
        _query(f"{name}_batches")(in_parts)

    return register


@_streams("stream_occupancy", "orders")
def _stream_occupancy(m: SourceModel, arriving: Arriving, folder: str) -> DataFrame:
    rows = arriving("orders").tables["ConferenceReservationDays"]
    return stream_occupancy(rows, capacity.day_limits(m.tables), folder)


@_streams("stream_admission", "orders")
def _stream_admission(m: SourceModel, arriving: Arriving, folder: str) -> DataFrame:
    rows = arriving("orders").tables["ConferenceReservationDays"]
    out = stream_day_admission(rows, capacity.day_limits(m.tables), folder)
    return out.select("ReservationDayID", "ConferenceDayID", "admitted")


@_streams("stream_workshop_occupancy", "lineitem")
def _stream_workshop_occupancy(m: SourceModel, arriving: Arriving, folder: str) -> DataFrame:
    """Line items arrive as bookings of their own, one per line."""
    rows = _line_bookings(arriving("lineitem").scan("lineitem"))
    return stream_workshop_occupancy(rows, capacity.workshop_limits(m.tables), folder)


@_streams("stream_workshop_admission", "orders")
def _stream_workshop_admission(m: SourceModel, arriving: Arriving, folder: str) -> DataFrame:
    rows = arriving("orders").tables["ConferenceReservationDays"].select(
        F.col("ReservationDayID").alias("ReservationID"),
        "Canceled",
        (F.col("ReservationDayID") % m.scan("part").count()).alias("WorkshopID"),
        "ReservationDayID",
        (F.col("ReservationDayID") % 97).cast("int").alias("Quantity"),
    )
    out = stream_workshop_admission(rows, capacity.workshop_limits(m.tables), folder)
    return out.select("ReservationID", "WorkshopID", "admitted")


def _line_bookings(lines: DataFrame) -> DataFrame:
    return lines.select(
        (F.col("l_returnflag") == "R").alias("Canceled"),
        F.col("l_partkey").alias("WorkshopID"),
        F.col("l_quantity").cast("int").alias("Quantity"),
    )


def _streamed_payments(m: SourceModel, arriving: Arriving, folder: str, table: str) -> DataFrame:
    return stream_payments(arriving("orders").tables["Payments"], m.tables, folder)[table]


_streams("stream_payments", "orders")(lambda m, a, f: _streamed_payments(m, a, f, "Clients").select("ClientID", "ServiceCounter"))
_streams("stream_paid_reservations", "orders")(
    lambda m, a, f: _streamed_payments(m, a, f, "ConferenceReservationDays").select("ReservationDayID", "Paid")
)


@_query("stream_joined_payments")
def _stream_joined_payments(m: SourceModel) -> DataFrame:
    """Payments and reservations as two streams; the last payments come first, and each part of them twice."""
    folder, paid, booked = run_folder(m.spark, "joined"), run_folder(m.spark, "paid"), run_folder(m.spark, "booked")
    parts = _arrivals(m, "orders")
    for first, last in zip(parts, reversed(parts), strict=True):
        first.write.mode("append").parquet(booked)
        last.unionByName(last).write.mode("append").parquet(paid)
        payments = SourceModel(m.spark, m.folder, arrivals={"orders": paid}).tables["Payments"]
        reservations = SourceModel(m.spark, m.folder, arrivals={"orders": booked}).tables["ConferenceReservationDays"]
        # Orders of all years come in every part.
        out = stream_joined_payments(payments, reservations, m.tables, folder, late=10_000)
    return out["Clients"].select("ClientID", "ServiceCounter")
