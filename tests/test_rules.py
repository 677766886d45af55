from decimal import Decimal

from fixture import ROWS, client, day, frame, moment, rows, tables, workshop

from eventbook.operators.constraints import violations
from eventbook.operators.schedule import validate_conference_days


def test_clean_tables_pass(spark):
    assert rows(violations(tables(spark))) == []


def test_value_rules(spark):
    t = tables(
        spark,
        Clients=[
            client(1, ServiceCounter=0, Email="nobody", Phone="12a"),
            client(2, Phone=None),
            client(3, ServiceCounter=None, Name=None),
            client(4, Name="x" * 256),
        ],
        Conferences=[{**ROWS["Conferences"][0], "Limit": 0, "End": moment("2020-03-10 08:00:00")}, ROWS["Conferences"][1]],
        Workshops=[workshop(1, 11, 9, 9, limit=-1), {**workshop(2, 11, 9, 10), "Location": "y" * 51}],
    )
    got = rows(violations(t, kinds=("NN", "LEN", "CHK"), tables=("Clients", "Conferences", "Workshops")), "rule", "key")
    assert got == sorted(
        [
            ("CHK-1", 1),
            ("CHK-2", 1),
            ("CHK-3", 1),
            ("NN Clients.Name", 3),
            ("NN Clients.ServiceCounter", 3),
            ("LEN Clients.Name", 4),
            ("CHK-4", 1),
            ("CHK-5", 1),
            ("CHK-6", 1),
            ("CHK-7", 1),
            ("LEN Workshops.Location", 2),
        ]
    )


def test_keys_and_references(spark):
    days = [*ROWS["ConferenceDays"], {**ROWS["ConferenceDays"][0], "ConferenceID": 9}]
    seats = [
        *ROWS["ConferenceDayRegistration"],
        {"ConferenceRegistrationID": 9, "ReservationDayID": 99, "ParticipantID": 98, "Canceled": False},
        {"ConferenceRegistrationID": 10, "ReservationDayID": None, "ParticipantID": 1, "Canceled": False},
    ]
    t = tables(spark, ConferenceDays=days, ConferenceDayRegistration=seats)
    got = rows(
        violations(t, kinds=("PK", "FK"), tables=("ConferenceDays", "ConferenceDayRegistration")), "rule", "key", "message"
    )
    assert got == [
        ("FK ConferenceDayRegistration.ParticipantID", 9, "no Participants row 98"),
        ("FK ConferenceDayRegistration.ReservationDayID", 9, "no ConferenceReservationDays row 99"),
        ("FK ConferenceDays.ConferenceID", 11, "no Conferences row 9"),
        ("PK ConferenceDays.ConferenceDayID", 11, "key occurs 2 times"),
    ]


def new_day(key, date, start=8, end=18, conference=1):
    return {
        "ConferenceDayID": key,
        "Location": "A",
        "Date": day(date),
        "Start": start * 3600,
        "End": end * 3600,
        "ConferenceID": conference,
    }


def codes(out):
    return rows(out, "ConferenceDayID", "code")


def test_conference_day_rules(spark):
    t = tables(spark)
    new = frame(
        spark,
        "ConferenceDays",
        [
            new_day(30, "2020-03-09"),
            new_day(31, "2020-03-10", start=7),
            new_day(32, "2020-03-10", start=17, end=9),  # ends before it starts: no rule against it
            new_day(33, "2020-03-10"),
            new_day(34, "2020-09-01", start=9, conference=2),  # opens before 9:30
            new_day(35, "2020-09-01", start=10, end=17, conference=2),
        ],
    )
    out = validate_conference_days(t, new)
    assert codes(out) == [(30, 56002), (31, 56003), (32, None), (33, 56004), (34, 56003), (35, None)]
    messages = {r.ConferenceDayID: r.message for r in out.collect()}
    assert messages[30].endswith(": DayDate: 2020-03-09 ConfStartDate: 2020-03-10 ConfEndDate: 2020-03-11")
    assert ": DayStartTime: 09:00:00 ConfStartTime: 09:30:00" in messages[34]


def test_dates_taken_before(spark):
    t = tables(spark)
    twin = {**ROWS["Conferences"][0], "ConferenceID": 3, "Price": Decimal("1.0000")}
    t = t.replace(Conferences=frame(spark, "Conferences", [*ROWS["Conferences"], twin]))
    new = frame(spark, "ConferenceDays", [new_day(40, "2020-03-10", conference=3), new_day(41, "2020-03-10")])
    assert codes(validate_conference_days(t, new, t["ConferenceDays"])) == [(40, 56004), (41, 56004)]
    per_conference = validate_conference_days(t, new, t["ConferenceDays"], scope="conference")
    assert codes(per_conference) == [(40, None), (41, 56004)]
