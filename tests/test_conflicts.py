import random

import pytest
from fixture import booking, day, frame, rows, tables, workshop

from eventbook.operators import registrations
from eventbook.operators.components import connected_components
from eventbook.operators.conflicts import admit_non_overlapping, workshop_conflicts
from eventbook.operators.registrations import admit_workshop_registrations
from eventbook.schema import CODE_OVERLAP


def random_tables(spark, seed, people=12, registrations=260, quota=(1, 9)):
    rng = random.Random(seed)
    days = [
        {"ConferenceDayID": d, "Location": "A", "Date": day(f"2020-03-1{d % 3}"), "Start": 0, "End": 86399, "ConferenceID": 1}
        for d in range(5)
    ]
    shops = []
    for w in range(25):
        start = rng.randrange(6, 20)
        shops.append(workshop(w, rng.randrange(5), start, start + rng.randrange(1, 5)))
    bookings = [booking(b, rng.randrange(25), 1, rng.randint(*quota)) for b in range(40)]
    # Person 0 holds more than a third of the registrations, and so does booking 0.
    seats = [
        {
            "ConferenceRegistrationID": c,
            "ReservationDayID": 1,
            "ParticipantID": 0 if rng.random() < 0.4 else rng.randrange(1, people),
            "Canceled": False,
        }
        for c in range(80)
    ]
    ids = rng.sample(range(10000), registrations)
    signed = [
        {
            "WorkshopRegistrationID": i,
            "ConferenceRegistrationID": rng.randrange(80),
            "WorkshopsReservationID": 0 if rng.random() < 0.35 else rng.randrange(40),
            "Canceled": rng.random() < 0.1,
        }
        for i in ids
    ]
    t = tables(
        spark,
        ConferenceDays=days,
        Workshops=shops,
        WorkshopsReservations=bookings,
        ConferenceDayRegistration=seats,
        WorkshopRegistration=signed,
    )
    shop = {w["WorkshopID"]: w for w in shops}
    dates = {d["ConferenceDayID"]: d["Date"] for d in days}
    person = {c["ConferenceRegistrationID"]: c["ParticipantID"] for c in seats}
    plain = []
    for r in sorted(signed, key=lambda r: r["WorkshopRegistrationID"]):
        b = bookings[r["WorkshopsReservationID"]]
        w = shop[b["WorkshopID"]]
        place = (person[r["ConferenceRegistrationID"]], dates[w["ConferenceDayID"]])
        plain.append((r["WorkshopRegistrationID"], place, w["Start"], w["End"], r["Canceled"], b))
    return t, plain


def overlaps(a, b):
    return a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]


def test_conflicts_match_all_pairs(spark):
    for seed in (1, 2):
        t, plain = random_tables(spark, seed)
        live = [r for r in plain if not r[4]]
        want = []
        for i, row in enumerate(live):
            earlier = [o[0] for o in live[:i] if overlaps(o, row)]
            if earlier:
                want.append((row[0], earlier[0]))
        assert rows(workshop_conflicts(t), "WorkshopRegistrationID", "conflicts_with") == sorted(want)


def test_greedy_matches_loop(spark):
    t, plain = random_tables(spark, 5)
    kept, want = [], []
    for row in plain:
        ok = row[4] or not any(overlaps(o, row) for o in kept)
        if ok and not row[4]:
            kept.append(row)
        want.append((row[0], ok))
    assert rows(admit_non_overlapping(t), "WorkshopRegistrationID", "admitted") == sorted(want)


def joint_loop(plain, standing=()):
    taken, held, out = {}, [], {}
    for row in standing:
        taken[row[5]["ReservationID"]] = taken.get(row[5]["ReservationID"], 0) + 1
        if not row[4]:
            held.append(row)
    for row in plain:
        booked = row[5]["ReservationID"]
        if not row[4] and any(overlaps(o, row) for o in held):
            out[row[0]] = 52000
        elif taken.get(booked, 0) + 1 > row[5]["Quantity"]:
            out[row[0]] = 56000
        else:
            out[row[0]] = None
            taken[booked] = taken.get(booked, 0) + 1
            if not row[4]:
                held.append(row)
    return out


def test_both_registration_rules_together_match_loop(spark):
    t, plain = random_tables(spark, 8, quota=(1, 6))
    out = admit_workshop_registrations(t, t["WorkshopRegistration"])
    want = joint_loop(plain)
    assert {r.WorkshopRegistrationID: r.code for r in out.collect()} == want
    assert set(want.values()) == {None, 52000, 56000}


def test_both_registration_rules_onto_existing_rows(spark):
    t, plain = random_tables(spark, 9, quota=(2, 8))
    cut = plain[len(plain) // 3][0]
    all_rows = t["WorkshopRegistration"]
    out = admit_workshop_registrations(
        t, all_rows.filter(f"WorkshopRegistrationID >= {cut}"), all_rows.filter(f"WorkshopRegistrationID < {cut}")
    )
    want = joint_loop([r for r in plain if r[0] >= cut], [r for r in plain if r[0] < cut])
    assert {r.WorkshopRegistrationID: r.code for r in out.collect()} == want


def test_touching_containing_and_other_dates(spark):
    t = tables(spark)
    # 2 (8-12) hits 1 (9-10); 3 (10-11) touches 1; 4 is on another date; 6 is cancelled.
    assert rows(workshop_conflicts(t), "WorkshopRegistrationID", "conflicts_with") == [(2, 1), (3, 1)]


def test_existing_registrations_block(spark):
    t = tables(spark)
    new = frame(
        spark,
        "WorkshopRegistration",
        [
            {"WorkshopRegistrationID": 20, "ConferenceRegistrationID": 4, "WorkshopsReservationID": 2, "Canceled": False},
            {"WorkshopRegistrationID": 21, "ConferenceRegistrationID": 4, "WorkshopsReservationID": 5, "Canceled": False},
        ],
    )
    out = admit_non_overlapping(t, new, t["WorkshopRegistration"])
    assert rows(out, "WorkshopRegistrationID", "admitted") == [(20, False), (21, True)]


def chain_tables(spark, links):
    """Participants of whom each holds two overlapping workshops, the second the next one's only seat."""
    n = links + 1
    t = dict(tables(spark))
    t["Workshops"] = frame(spark, "Workshops", [workshop(100 + k, 11, 9, 10) for k in range(n + 1)])
    t["WorkshopsReservations"] = frame(spark, "WorkshopsReservations", [booking(100 + k, 100 + k, 1, 1) for k in range(n + 1)])
    t["ConferenceDayRegistration"] = frame(
        spark, "ConferenceDayRegistration",
        [{"ConferenceRegistrationID": 1000 + k, "ReservationDayID": 1, "ParticipantID": 5000 + k, "Canceled": False} for k in range(n)],
    )
    new = [
        {"WorkshopRegistrationID": 2 * k + j, "ConferenceRegistrationID": 1000 + k, "WorkshopsReservationID": 100 + k + j, "Canceled": False}
        for k in range(n)
        for j in (0, 1)
    ]
    return t, frame(spark, "WorkshopRegistration", new)


def test_a_chain_through_500_participants_takes_few_rounds(spark, monkeypatch):
    t, new = chain_tables(spark, 500)
    calls = []
    one = registrations._round
    monkeypatch.setattr(registrations, "_round", lambda *a: calls.append(1) or one(*a))
    out = registrations.admit_workshop_registrations(t, new)
    # Every participant keeps the first workshop, and the second one's seat goes to the next.
    got = {r["WorkshopRegistrationID"]: r["code"] for r in out.collect()}
    assert got == {i: None if i % 2 == 0 else CODE_OVERLAP for i in got} and len(got) == 1002
    assert len(calls) < 20


def test_components_give_what_rounds_give(spark):
    t, _ = random_tables(spark, 1, registrations=120, quota=(1, 3))
    every = t["WorkshopRegistration"]
    old, new = every.filter("WorkshopRegistrationID % 7 = 0"), every.filter("WorkshopRegistrationID % 7 <> 0")

    def codes(**tuning):
        return rows(admit_workshop_registrations(t, new, old, **tuning), "WorkshopRegistrationID", "code")

    want = codes(rounds=1000)
    assert codes(rounds=1) == want and codes(rounds=1, component_rows=8) == want


def test_components(spark):
    rng = random.Random(9)
    names = rng.sample(range(10**9), 400)
    edges = [(names[k], names[k + 1]) for k in range(299)] + [(names[k], names[k - rng.randrange(1, 4)]) for k in range(310, 400)] + [(names[300], names[300])]
    found = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    def top(x):  # noqa: E306
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    assert found == {x: top(x) for x in up}
