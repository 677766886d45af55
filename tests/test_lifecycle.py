from decimal import Decimal

from fixture import day, rows, tables

from eventbook.operators import lifecycle

AS_OF = day("2020-03-14")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "ReservationDayID long")


def cancelled(df):
    return [r[0] for r in rows(df.filter("Canceled"), df.columns[0])]


def test_cancel_cascades_to_all_bookings(spark):
    out = lifecycle.cancel_reservations(tables(spark), ids(spark, 1, 1))
    assert cancelled(out["ConferenceReservationDays"]) == [1, 2]
    assert cancelled(out["WorkshopsReservations"]) == [1, 2, 3, 6]
    assert cancelled(out["WorkshopRegistration"]) == [1, 2, 3, 5, 6]
    assert cancelled(out["ConferenceDayRegistration"]) == [1, 2, 4]


def test_cascade_only_follows_fresh_cancellations(spark):
    t = tables(spark)
    once = t.replace(**lifecycle.cancel_reservations(t, ids(spark, 1, 3)))
    twice = lifecycle.cancel_reservations(once, ids(spark, 1, 2, 3))
    for name, df in twice.items():
        assert rows(df) == rows(once[name])
    # An unknown flag counts as not cancelled before.
    assert 5 in cancelled(once["WorkshopsReservations"])


def test_overdue_means_an_earlier_week(spark):
    t = tables(spark)
    # Reservation 5 was made on Sunday the 8th, the first day of the week of the 14th.
    assert rows(lifecycle.overdue_reservations(t, AS_OF)) == [(1,)]
    assert rows(lifecycle.overdue_reservations(t, day("2020-03-15"))) == [(1,), (5,)]
    out = lifecycle.refresh_overdue(t, AS_OF)
    assert cancelled(out["ConferenceReservationDays"]) == [1, 2]


def test_payments_count_each_time(spark):
    t = tables(spark)
    out = lifecycle.apply_payments(t)
    assert rows(out["ConferenceReservationDays"].filter("Paid"), "ReservationDayID") == [(1,), (2,), (4,)]
    assert rows(out["Clients"], "ClientID", "ServiceCounter") == [(1, 5), (2, 4), (3, 7)]
    assert out["Clients"].columns == t["Clients"].columns


def test_range_booking(spark):
    t = tables(spark)
    requests = spark.createDataFrame(
        [
            (1, day("2020-03-10"), day("2020-03-11"), 1, 2, 0, False, Decimal(5)),
            (1, day("2020-03-11"), day("2020-03-10"), 2, 2, 0, False, Decimal(5)),  # ends before it starts
            (2, day("2020-01-01"), day("2020-12-31"), 3, 1, 1, True, Decimal(6)),
        ],
        "ConferenceID long, DateStart date, DateEnd date, ClientID long, NormalParticipantQuantity int, "
        "StudentParticipantQuantity int, Paid boolean, Amount decimal(19,4)",
    )
    closed = lifecycle.register_date_range(t, requests, AS_OF)
    assert rows(closed, "ClientID", "ConferenceDayID") == [(1, 11), (1, 12), (3, 21)]
    half_open = lifecycle.register_date_range(t, requests, AS_OF, inclusive_end=False)
    assert rows(half_open, "ClientID", "ConferenceDayID") == [(1, 11), (3, 21)]
