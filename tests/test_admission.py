import random

import pytest
from fixture import booking, frame, reservation, rows, tables
from pyspark.sql import functions as F

from eventbook.operators import admission


def greedy(asked, free):
    """asked: (key, id, qty or None); the rule as a plain loop."""
    left, out = dict(free), {}
    for key, row_id, qty in sorted(asked, key=lambda r: (r[1])):
        ok = qty is None or key not in left or left[key] is None or left[key] - qty >= 0
        out[row_id] = ok
        if ok and qty and left.get(key) is not None:
            left[key] -= qty
    return out


def check(spark, asked, free, **tuning):
    df = spark.createDataFrame(asked, "key long, id long, qty long")
    places = spark.createDataFrame(list(free.items()), "key long, free long")
    got = {r.id: r.admitted for r in admission.admit(df, places, "key", "id", F.col("qty"), **tuning).collect()}
    assert got == greedy(asked, free)
    return got


@pytest.mark.parametrize(
    "tuning", [{}, {"rows_per_block": 3, "salts": 2}, {"rows_per_block": 1, "max_blocks": 5, "salts": 1}]
)
def test_matches_plain_loop_with_one_huge_key(spark, tuning):
    rng = random.Random(11)
    ids = rng.sample(range(100000), 1500)
    # Key 0 holds more than a third of all rows.
    asked = [(0 if rng.random() < 0.4 else rng.randrange(1, 60), i, rng.choice([0, 1, 1, 2, 3, 5, 8, 13, 40, None])) for i in ids]
    free = {k: rng.choice([-5, 0, 1, 7, 30, 80, 10000]) for k in range(0, 50)} | {0: 333, 50: None}
    check(spark, asked, free, **tuning)


def test_big_rejected_row_does_not_block_small_one(spark):
    got = check(spark, [(1, 1, 4), (1, 2, 9), (1, 3, 5), (1, 4, 1), (1, 5, 1)], {1: 10})
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_nothing_crowded(spark):
    assert all(check(spark, [(1, 1, 2), (2, 2, None), (None, 3, 5)], {1: 2}).values())


@pytest.mark.parametrize("rows_per_block", [1000, 20, 4])
def test_more_keys_than_the_broadcast_bound(spark, monkeypatch, rows_per_block):
    # All keys small; some large; too many large ones to broadcast.
    monkeypatch.setattr(admission, "BROADCAST_KEYS", 12)
    rng = random.Random(3)
    asked = [(rng.randrange(20), i, rng.randrange(1, 9)) for i in range(400)]
    check(spark, asked, {k: rng.randrange(40) for k in range(20)}, rows_per_block=rows_per_block)


def test_day_reservations_against_existing_ones(spark):
    t = tables(spark)
    new = frame(
        spark,
        "ConferenceReservationDays",
        [
            reservation(10, 11, 6),  # 5 of 10 are taken by reservation 1
            reservation(11, 11, 2, 2),
            reservation(12, 11, 1),
            reservation(13, 11, 1),
            reservation(14, 11, 50, Canceled=True),
            reservation(15, 21, 5),
            reservation(16, 21, 1, Canceled=None),
        ],
    )
    out = admission.admit_day_reservations(t, new, t["ConferenceReservationDays"])
    codes = {r.ReservationDayID: r.code for r in out.collect()}
    assert codes == {10: 52300, 11: None, 12: None, 13: 52300, 14: None, 15: None, 16: None}
    text = out.filter("ReservationDayID = 10").first().message
    assert text == "Przekroczony limit osob na konferencje ConferenceDayID = 11"


def test_cancelled_row_on_an_overbooked_day_is_refused(spark):
    t = tables(spark)
    full = frame(spark, "ConferenceReservationDays", [reservation(1, 21, 9)])
    new = frame(spark, "ConferenceReservationDays", [reservation(2, 21, 1, Canceled=True)])
    assert not admission.admit_day_reservations(t, new, full).first().admitted


def test_cancelled_workshop_booking_always_passes(spark):
    t = tables(spark)
    full = frame(spark, "WorkshopsReservations", [booking(1, 1, 1, 99)])
    new = frame(spark, "WorkshopsReservations", [booking(2, 1, 1, 1, canceled=True), booking(3, 1, 1, 0)])
    out = admission.admit_workshop_reservations(t, new, full)
    assert rows(out, "ReservationID", "code") == [(2, None), (3, 53000)]


def test_quotas_count_cancelled_registrations(spark):
    t = tables(spark)
    new = frame(
        spark,
        "ConferenceDayRegistration",
        [
            {"ConferenceRegistrationID": i, "ReservationDayID": 5, "ParticipantID": 1, "Canceled": i == 10}
            for i in (10, 11)
        ],
    )
    out = admission.day_registration_quota(t, new, t["ConferenceDayRegistration"])
    assert rows(out, "ConferenceRegistrationID", "code") == [(10, None), (11, 56000)]
    more = frame(
        spark,
        "WorkshopRegistration",
        [{"WorkshopRegistrationID": 9, "ConferenceRegistrationID": 1, "WorkshopsReservationID": 2, "Canceled": False}],
    )
    out = admission.workshop_registration_quota(t, more, t["WorkshopRegistration"])
    assert rows(out, "code", "message") == [(56000, "Rezerwacja pelna ReservationID = 2")]


def test_one_far_id_does_not_make_one_block_of_the_rest(spark):
    """Serial ids followed by one of another generator: the crossing block is cut until it is small."""
    asked = spark.range(20_000).selectExpr("0L AS k", "id AS i", "1L AS q").unionByName(
        spark.createDataFrame([(0, 10**15, 1)], "k long, i long, q long")
    )
    free = spark.createDataFrame([(0, 11_111)], "k long, free long")
    large = admission._crowded(asked, free, 500, 1 << 12)
    crossing = admission._crossings(asked, large, 500, 1 << 12).first()
    assert crossing["start"] <= 11_111 <= crossing["stop"] and crossing["before"] == crossing["start"]
    assert crossing["stop"] - crossing["start"] < 500
    out = admission.admit(asked, free, "k", "i", F.col("q"), rows_per_block=500)
    assert out.filter("admitted").count() == 11_111
    assert out.filter("NOT admitted").agg(F.min("i")).first()[0] == 11_111


def test_negative_quantity_is_an_error(spark):
    asked = spark.createDataFrame([(1, 1, 5), (1, 2, -3)], "key long, id long, qty long")
    free = spark.createDataFrame([(1, 4)], "key long, free long")
    with pytest.raises(Exception, match="negative quantity"):
        admission.admit(asked, free, "key", "id", F.col("qty")).collect()
