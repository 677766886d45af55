from decimal import Decimal

import pytest
from fixture import booking, client, frame, moment, rows, tables
from pyspark.sql import functions as F

from eventbook.operators import constraints, identity
from eventbook.operators.identity import assign_ids, with_defaults
from eventbook.operators.ingest import ingest
from eventbook.session import cut_lineage


def test_ids_are_dense_and_ordered(spark):
    feed = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("t").alias("y"))
    existing = spark.createDataFrame([(40,), (7,)], "n long")
    out = [tuple(r) for r in assign_ids(feed, existing, "n", ["x"]).select("x", "n").orderBy("n").collect()]
    assert out == [(i, 41 + i) for i in range(5000)]
    empty = assign_ids(feed.limit(3), existing.filter("n < 0"), "n", ["x"])
    assert sorted(r.n for r in empty.collect()) == [1, 2, 3]


def test_defaults_only_for_absent_columns(spark):
    feed = frame(spark, "Clients", [client(1, Country=None)])
    assert with_defaults(feed, "Clients").first().Country is None
    row = with_defaults(feed.drop("Country", "ServiceCounter", "isCompany"), "Clients").first()
    assert (row.Country, row.ServiceCounter, row.isCompany) == ("Polska", 0, False)


def test_clients(spark):
    t = tables(spark)
    feed = frame(spark, "Clients", [client(i, Email="x" if i == 2 else "a@b") for i in (1, 2, 3)]).withColumnRenamed(
        "ClientID", "line"
    )
    # A feed of people without the columns for signing in is refused.
    refused = ingest(t, "Clients", feed, order_by=["line"]).rejected
    assert {r.rule for r in refused.collect()} == {"NN Clients.Login"} and refused.count() == 3
    feed = feed.withColumns({"Login": F.lit("user"), "Password": F.lit("p")})
    result = ingest(t, "Clients", feed, order_by=["line"])
    assert rows(result.accepted, "ClientID") == [(4,), (6,)]
    assert rows(result.rejected, "ClientID", "rule", "code") == [(5, "CHK-2", None)]
    assert set(result.accepted.columns) == {*t["Clients"].columns, "Login", "Password"}
    # The default counter breaks its own rule, unless another one is asked for.
    bare = feed.drop("ServiceCounter")
    assert ingest(t, "Clients", bare, order_by=["line"]).accepted.isEmpty()
    assert ingest(t, "Clients", bare, order_by=["line"], start_counter=1).accepted.count() == 2


def test_secret_columns_are_checked_when_present(spark):
    t = tables(spark)
    feed = frame(spark, "Clients", [client(1), client(2)]).drop("ClientID")
    feed = feed.withColumn("Login", F.when(F.col("Email") == "c1@mail.test", "one")).withColumn("Password", F.lit("p"))
    result = ingest(t, "Clients", feed, order_by=["Email"])
    assert rows(result.rejected, "rule") == [("NN Clients.Login",)]


def test_rows_that_break_other_rules_use_no_capacity(spark):
    t = tables(spark)

    def new(client_id, normal, line, **more):
        return (line, moment("2020-03-05 00:00:00"), client_id, normal, 0, False, Decimal(1), more.get("day", 21))

    feed = spark.createDataFrame(
        [new(99, 5, 1), new(1, -3, 2), new(1, 4, 3), new(1, 2, 4), new(1, 1, 5), new(1, 1, 6, day=77)],
        "line int, Date timestamp_ntz, ClientID long, NormalParticipantQuantity int, StudentParticipantQuantity int, "
        "Paid boolean, Amount decimal(19,4), ConferenceDayID long",
    )
    result = ingest(t, "ConferenceReservationDays", feed, order_by=["line"])
    assert rows(result.checked, "ReservationDayID", "rule", "code") == [
        (6, "FK ConferenceReservationDays.ClientID", None),
        (7, "QTY ConferenceReservationDays.NormalParticipantQuantity", None),
        (8, None, None),
        (9, "TRG-5", 52300),
        (10, None, None),
        (11, "FK ConferenceReservationDays.ConferenceDayID", None),
    ]


def test_own_ids_must_be_new(spark):
    t = tables(spark)
    feed = frame(spark, "WorkshopsReservations", [booking(6, 1, 1, 1), booking(7, 1, 1, 1), booking(8, 1, 1, 1), booking(8, 2, 1, 1)])
    result = ingest(t, "WorkshopsReservations", feed)
    assert rows(result.accepted, "ReservationID") == [(7,)]
    assert {r.rule for r in result.rejected.collect()} == {"PK WorkshopsReservations.ReservationID"}


def test_order_is_needed_for_numbering(spark):
    with pytest.raises(ValueError):
        ingest(tables(spark), "Clients", frame(spark, "Clients", [client(1)]).drop("ClientID"))


def test_doubled_parents_do_not_double_rows(spark):
    t = tables(spark)
    twice = {name: t[name].unionByName(t[name]) for name in ("Clients", "ConferenceDays", "ConferenceReservationDays")}
    t = t.replace(**twice)
    feed = spark.createDataFrame(
        [(moment("2020-03-05 00:00:00"), c, 1, 0, False, Decimal(1), d) for c, d in ((1, 21), (99, 21), (1, 77))],
        "Date timestamp_ntz, ClientID long, NormalParticipantQuantity int, StudentParticipantQuantity int, "
        "Paid boolean, Amount decimal(19,4), ConferenceDayID long",
    )
    result = ingest(t, "ConferenceReservationDays", feed, order_by=["ClientID", "ConferenceDayID"])
    assert result.checked.count() == 3
    assert result.accepted.count() + result.rejected.count() == 3
    bad = t["ConferenceReservationDays"].limit(1).withColumn("ClientID", F.lit(99).cast("long"))
    assert constraints.violations(t.replace(ConferenceReservationDays=bad), kinds=("FK",), tables=("ConferenceReservationDays",)).count() == 1


def test_payments_change_reservations_and_clients(spark):
    t = tables(spark)
    unpaid = t["ConferenceReservationDays"].filter("NOT Paid").first()
    feed = spark.createDataFrame(
        [(moment("2020-03-05 00:00:00").date(), unpaid.ReservationDayID), (moment("2020-03-06 00:00:00").date(), 12345)],
        "Date date, ReservationDayID long",
    )
    result = ingest(t, "Payments", feed, order_by=["Date"])
    assert result.accepted.count() == 1
    paid = result.changed["ConferenceReservationDays"].filter(F.col("ReservationDayID") == unpaid.ReservationDayID).first()
    assert paid.Paid
    before = {r.ClientID: r.ServiceCounter for r in t["Clients"].collect()}
    after = {r.ClientID: r.ServiceCounter for r in result.changed["Clients"].collect()}
    assert after == before | {unpaid.ClientID: before[unpaid.ClientID] + 1}


def test_equal_rows_spread_over_ranges(spark, monkeypatch):
    written = []

    def kept(df):
        written.append(cut_lineage(df))
        return written[-1]

    monkeypatch.setattr(identity, "cut_lineage", kept)
    feed = spark.range(40_000).select(F.lit(1).alias("x")).unionByName(spark.range(100).select(F.col("id").cast("int").alias("x")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = assign_ids(feed, None, "n", ["x"])
        assert out.agg(F.count_distinct("n"), F.max("n")).first()[:2] == (40_100, 40_100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in written[-1].groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 20_000
