import datetime
import random

import pytest
from fixture import rows, tables
from pyspark.sql import functions as F

from eventbook.operators import range_booking
from eventbook.operators.range_booking import book_date_ranges, first_refusals

FIRST = datetime.date(2030, 1, 1)
ON = datetime.date(2029, 6, 1)


def by_hand(asks, free):
    """Booked and refused (request, day) pairs, request by request."""
    free, booked, refused = dict(free), [], []
    for request in sorted({a[0] for a in asks}):
        for _, _, day, key, q in sorted((a for a in asks if a[0] == request), key=lambda a: (a[2], a[3])):
            if q > free[key]:
                refused.append((request, key))
                break
            free[key] -= q
            booked.append((request, key))
    return sorted(booked), sorted(refused)


def outcome(spark, asks, free):
    a = spark.createDataFrame(asks, "_request long, _conference long, _day date, ConferenceDayID long, _q long")
    found = first_refusals(a, spark.createDataFrame(sorted(free.items()), "ConferenceDayID long, free long"))
    ends = {r: (d, i) for r, d, i in rows(found)}
    booked = [(a[0], a[3]) for a in asks if a[0] not in ends or (a[2], a[3]) < ends[a[0]]]
    return sorted(booked), sorted((r, i) for r, (_, i) in ends.items())


@pytest.mark.parametrize("seed", range(4))
def test_random_chains(spark, seed):
    rng = random.Random(seed)
    days = {c: [c * 100 + i for i in range(rng.randrange(1, 7))] for c in range(5)}
    free = {d: rng.choice([-2, 0, 5, 30, 200]) for ds in days.values() for d in ds}
    asks = []
    for request in rng.sample(range(1000), 150):
        c = rng.choice([0, 0, 0, 1, 2, 3, 4])  # one conference has a third of all requests and more
        begin = rng.randrange(len(days[c]))
        for i in range(begin, rng.randrange(begin, len(days[c])) + 1):
            asks.append((request, c, FIRST + datetime.timedelta(i), days[c][i], 0))
    sizes = {a[0]: rng.choice([0, 1, 1, 2, 5, 9]) for a in asks}
    asks = [(*a[:4], sizes[a[0]]) for a in asks]
    assert outcome(spark, asks, free) == by_hand(asks, free)


def test_a_refusal_leaves_places_to_others(spark):
    asks = [(r, 1, FIRST + datetime.timedelta(i), 10 + i, q) for r, first, last, q in [(1, 0, 1, 4), (2, 0, 2, 4), (3, 2, 2, 3), (4, 0, 0, 2)] for i in range(first, last + 1)]
    free = {10: 10, 11: 5, 12: 3}
    want = ([(1, 10), (1, 11), (2, 10), (3, 12), (4, 10)], [(2, 11)])
    assert by_hand(asks, free) == want and outcome(spark, asks, free) == want


def test_turns_do_not_follow_the_requests(spark, monkeypatch):
    # 600 requests that all hang on each other through two crowded days: two turns.
    calls = []
    admit = range_booking.admit
    monkeypatch.setattr(range_booking, "admit", lambda *a, **b: calls.append(1) or admit(*a, **b))
    asks = [(r, 1, FIRST + datetime.timedelta(i), 10 + i, 1 + r % 3) for r in range(600) for i in range(r % 3, 3)]
    free = {10: 10_000, 11: 300, 12: 250}
    assert outcome(spark, asks, free) == by_hand(asks, free)
    assert len(calls) == 2


def test_requests_through_all_rules(spark):
    t = tables(spark)
    requests = spark.createDataFrame(
        [
            (1, 1, "2020-03-09", "2020-03-12", 1, 3, 0), (2, 1, "2020-03-10", "2020-03-10", 99, 1, 0), (3, 1, "2020-03-11", "2020-03-01", 1, 1, 0),
            (4, 1, "2020-03-10", "2020-03-11", 1, -1, 0), (5, 1, "2020-03-10", "2020-03-11", 2, 500, 0), (6, 2, "2020-08-01", "2020-12-01", 2, 1, 1), (7, 77, "2020-08-01", "2020-12-01", 2, 1, 1),
        ],
        "line int, ConferenceID int, s string, e string, ClientID int, NormalParticipantQuantity int, StudentParticipantQuantity int",
    )
    requests = requests.select(
        "line", "ConferenceID", F.to_date("s").alias("DateStart"), F.to_date("e").alias("DateEnd"), "ClientID", "NormalParticipantQuantity", "StudentParticipantQuantity",
        F.lit(False).alias("Paid"), F.lit(5).cast("decimal(19,4)").alias("Amount"),
    )
    out = book_date_ranges(t, requests, ON, ["line"])
    highest = t["ConferenceReservationDays"].agg(F.max("ReservationDayID")).first()[0]
    got = [(r.ReservationDayID - highest, r.ClientID, r.ConferenceDayID, r.rule) for r in out.checked.orderBy("ReservationDayID").collect()]
    assert [g[0] for g in got] == list(range(1, len(got) + 1))
    assert [g[1:3] for g in got] == [(1, 11), (1, 12), (99, 11), (1, 11), (2, 11), (2, 21)]
    assert got[0][3] is None and got[2][3].startswith("FK") and got[3][3].startswith("QTY") and got[4][3] == "TRG-5"
    assert set(out.accepted.columns) == set(t["ConferenceReservationDays"].columns)
    assert book_date_ranges(t, requests.limit(0), ON, ["line"]).checked.count() == 0
