import datetime as dt
from decimal import Decimal

from fixture import ROWS, day, reservation, rows, tables

from eventbook.operators import capacity, pricing, reports

AS_OF = day("2020-03-01")  # a Sunday


def test_free_places(spark):
    t = tables(spark)
    # Cancelled and unknown rows use nothing.
    assert rows(capacity.available_day_places(t)) == [(11, 5), (12, 7), (21, 5)]
    assert rows(capacity.available_workshop_places(t)) == [(1, 8), (2, 7), (3, 9), (4, 8), (5, 10)]


def test_overbooked_day_is_negative(spark):
    t = tables(spark, ConferenceReservationDays=[reservation(1, 21, 9)])
    assert (21, -4) in rows(capacity.available_day_places(t))


def test_reservation_cost_rounds_and_cuts(spark):
    # Price 2.5: normal rounds to 3, student 2.0 stays 2; one Sunday until the conference starts.
    costs = {r.ReservationDayID: (r.cost, r.cost_both_scaled) for r in pricing.reservation_day_cost(tables(spark), AS_OF).collect()}
    assert costs[1] == (3 * 3 + 2 * 2 * 3, (3 * 3 + 2 * 2) * 3)
    # After the start the factor grows past four.
    late = {r.ReservationDayID: r.cost for r in pricing.reservation_day_cost(tables(spark), day("2020-03-22")).collect()}
    assert late[1] == 3 * 3 + 2 * 2 * (4 + 2)


def test_upcoming_conferences(spark):
    t = tables(spark)
    got = rows(pricing.conferences_with_free_terms(t, AS_OF))
    assert [(r[0], r[1], r[2]) for r in got] == [("Spring", day("2020-03-10"), 5), ("Spring", day("2020-03-11"), 7)]
    assert got[0][5:] == (Decimal("6.0000"), Decimal("7.5000"))
    assert len(rows(pricing.conferences_with_free_terms(t, day("2020-02-18")))) == 2  # 21 days ahead
    assert rows(pricing.conferences_with_free_terms(t, day("2020-02-17"))) == []  # 22 days ahead
    assert rows(pricing.conferences_with_free_terms(t, day("2020-03-11"))) == []  # started yesterday


def test_as_written_uses_the_conference_id(spark):
    # No day carries id 1 or 2, so nothing is found.
    assert rows(pricing.conferences_with_free_terms(tables(spark), AS_OF, as_written=True)) == []


def test_upcoming_workshops(spark):
    got = {r.workshop_name: r.price_label for r in pricing.workshops_with_free_terms(tables(spark), AS_OF).collect()}
    assert got == {"Workshop 1": "5.00", "Workshop 2": "darmowa", "Workshop 3": "7.34", "Workshop 4": "5.00", "Workshop 5": "5.00"}


def test_org_conferences_counts_cancelled_heads(spark):
    got = {r.day: r for r in reports.org_conferences(tables(spark)).collect()}
    first = got[day("2020-03-10")]
    assert (first.free_places, first.students, first.normals) == (5, 2, 7)
    assert (first.reservation_id_sum, first.reservation_count) == (22, 2)
    empty = got[day("2020-09-01")]
    assert (empty.free_places, empty.students, empty.reservation_id_sum, empty.reservation_count) == (5, 0, 0, 0)


def test_not_registered(spark):
    got = [(r.Name, r.unregistered) for r in reports.org_not_registered(tables(spark)).collect()]
    # Reservation 1 has 5 heads and 3 registrations; 2, 3 and 5 have none; 4 lacks one.
    assert sorted(got) == [("Client 1", 2), ("Client 1", 4), ("Client 2", 1), ("Client 2", 2), ("Client 3", 1)]


def test_top_clients_break_ties_by_id(spark):
    assert [tuple(r) for r in reports.org_top_clients(tables(spark), 2).collect()] == [("Client 3", 7), ("Client 1", 3)]


def test_payment_rollup(spark):
    out = reports.org_client_payments(tables(spark))
    assert out.count() == 3 * 3 + 1
    total = out.filter("Name IS NULL").collect()
    assert [r.paid_amount for r in total] == [Decimal("60.5000")]
    client = out.filter("Name = 'Client 2' AND year IS NULL").first()
    assert client.paid_amount == Decimal("30.5000") and client.isCompany is True


def test_debts(spark):
    t = tables(spark)
    # Reservation 1 repeats per workshop booking, cancelled ones too; 3 has an unknown flag.
    assert rows(reports.org_client_debts(t), "ReservationDayID", "debt") == [
        (1, Decimal("10.0000")),
        (1, Decimal("10.0000")),
        (1, Decimal("17.3350")),
        (1, Decimal("20.0000")),
        (5, Decimal("10.0000")),
    ]
    assert rows(reports.client_debt_per_reservation(t), "ReservationDayID", "debt") == [
        (1, Decimal("27.3350")),
        (5, Decimal("10.0000")),
    ]
    # Participant 1 sits twice on reservation 1; participant 2's seat is cancelled.
    assert rows(reports.client_debt_by_participant(t)) == [
        (1, Decimal("114.6700")),
        (2, Decimal("0.0000")),
        (3, Decimal("0.0000")),
    ]
    assert rows(reports.client_debt_by_participant(t, 3)) == [(3, Decimal("0.0000"))]


def test_money_to_pay(spark):
    t = tables(spark)
    assert rows(reports.money_to_pay(t)) == [
        (1, 1, Decimal("10.0000")),
        (2, 1, Decimal("10.0000")),
        (3, 1, Decimal("10.0000")),
    ]
    pairs = spark.createDataFrame([(1, 2), (3, 1), (3, 1)], "ClientID long, ConferenceID long")
    assert rows(reports.money_to_pay(t, pairs)) == [(1, 2, Decimal("0.0000")), (3, 1, Decimal("10.0000"))]


def test_conference_cost_has_totals(spark):
    assert rows(reports.client_conference_cost(tables(spark), client_id=2)) == [
        (2, 1, Decimal("30.5000")),
        (2, None, Decimal("30.5000")),
    ]


def test_conference_cost_leaves_out_zero(spark):
    t = tables(spark, ConferenceReservationDays=[reservation(1, 11, 1, Amount=Decimal("0.0000"))])
    assert rows(reports.client_conference_cost(t)) == []


def test_lists(spark):
    t = tables(spark)
    assert rows(reports.badge_names(t, conference_id=1, day_id=11)) == [(1, 11, "Ann"), (1, 11, "Ann"), (1, 11, "Bob")]
    assert rows(reports.workshop_participants(t, 1)) == [(1, "Ann"), (1, "Bob"), (1, "Bob")]
    assert rows(reports.free_workshops(t, 1), "workshopid") == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(reports.participant_conferences(t, 1), "ParticipantID", "ConferenceID") == [(1, 1)]
    assert reports.participant_workshops(t).count() == len(ROWS["WorkshopRegistration"])
    assert dt.date(2020, 3, 11) in {r.Date for r in reports.participant_workshops(t).collect()}
