import random

from fixture import day, frame, moment, reservation, rows, tables

from eventbook.operators import capacity, lifecycle
from eventbook.session import run_folder
from eventbook.streaming.admission import stream_day_admission
from eventbook.streaming.joined_payments import paid_events, stream_joined_payments
from eventbook.streaming.occupancy import stream_occupancy
from eventbook.streaming.payments import stream_payments


def arrivals(spark, df, parts, one_per_batch=True):
    """``df`` as a file stream with one file, and one micro-batch, per part."""
    folder = run_folder(spark, "arrivals")
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(folder)
    reader = spark.readStream.schema(df.schema)
    return folder, (reader.option("maxFilesPerTrigger", 1) if one_per_batch else reader).parquet(folder)


def test_occupancy_over_several_batches(spark):
    t = tables(spark)
    source = t["ConferenceReservationDays"]
    _, stream = arrivals(spark, source, ["ReservationDayID <= 2", "ReservationDayID in (3, 4)", "ReservationDayID > 4"])
    out = stream_occupancy(stream, capacity.day_limits(t), run_folder(spark, "occupancy"))
    assert rows(out, "ConferenceDayID", "free_places") == rows(capacity.available_day_places(t))


def test_nothing_arrived(spark):
    t = tables(spark)
    _, stream = arrivals(spark, t["ConferenceReservationDays"], ["false"])
    out = stream_occupancy(stream, capacity.day_limits(t), run_folder(spark, "occupancy"))
    assert rows(out, "ConferenceDayID", "taken") == [(11, 0), (12, 0), (21, 0)]


def test_admission_carries_over_between_batches_and_restarts(spark):
    t = tables(spark)
    rng = random.Random(4)
    parts = [[reservation(i, rng.choice([11, 11, 12, 21]), rng.randrange(4)) for i in rng.sample(range(b, 300, 4), 6)] for b in range(4)]
    limits = {11: 10, 12: 10, 21: 5}
    used, want = dict.fromkeys(limits, 0), []
    for part in parts:
        for r in sorted(part, key=lambda r: r["ReservationDayID"]):
            key, asked = r["ConferenceDayID"], r["NormalParticipantQuantity"]
            ok = used[key] + asked <= limits[key]
            used[key] += asked * ok
            want.append((r["ReservationDayID"], ok))
    frames = [frame(spark, "ConferenceReservationDays", part) for part in parts]
    source, folder = run_folder(spark, "arrivals"), run_folder(spark, "admission")
    for number, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(source)
        if number in (1, 3):  # two runs; each takes up where the last one stopped
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
            out = stream_day_admission(stream, capacity.day_limits(t), folder)
    assert {b for (b,) in rows(out, "batch_id")} == {0, 1, 2, 3}
    assert rows(out, "ReservationDayID", "admitted") == sorted(want)
    assert not all(ok for _, ok in want)


def test_payments(spark):
    t = tables(spark)
    _, stream = arrivals(spark, t["Payments"], ["PaymentID = 1", "PaymentID > 1"])
    for name, df in stream_payments(stream, t, run_folder(spark, "payments")).items():
        assert rows(df) == rows(lifecycle.apply_payments(t)[name])


def test_payments_and_reservations_in_any_order(spark):
    t = tables(spark)
    want = {name: rows(df) for name, df in lifecycle.apply_payments(t).items()}
    pay, res = t["Payments"], t["ConferenceReservationDays"]
    orders = [[("p", "true"), ("r", "true")], [("r", "ReservationDayID > 2"), ("p", "PaymentID > 1"), ("p", "PaymentID < 3"), ("r", "ReservationDayID < 4")], [("r", "true"), ("p", "PaymentID = 2"), ("p", "true")]]
    for arriving in orders:
        folder, paid, booked = (run_folder(spark, n) for n in ("joined", "paid", "booked"))
        for df, place in ((pay, paid), (res, booked)):
            df.limit(0).write.parquet(place)
        for kind, part in arriving:  # a run for each arrival; payments that come twice count once
            df, place = (pay, paid) if kind == "p" else (res, booked)
            df.filter(part).coalesce(1).write.mode("append").parquet(place)
            streams = [spark.readStream.schema(d.schema).parquet(f) for d, f in ((pay, paid), (res, booked))]
            out = stream_joined_payments(*streams, t, folder, late=1000)
        assert {name: rows(df) for name, df in out.items()} == want


def test_what_waits_expires(spark):
    t = tables(spark)
    pay, res = (t[n].limit(0).drop() for n in ("Payments", "ConferenceReservationDays"))
    folder, paid, booked = (run_folder(spark, n) for n in ("expiry", "paid", "booked"))
    sizes = []
    for k in range(6):  # every arrival is a year later; nothing is ever paid for
        when = day(f"{2020 + k}-05-01")
        frame(spark, "Payments", [{"PaymentID": 10 * k + i, "Date": when, "ReservationDayID": 900 + i} for i in range(5)]).write.mode("append").parquet(paid)
        frame(spark, "ConferenceReservationDays", [reservation(100 * k + i, 11, 1, Date=moment(f"{2020 + k}-05-01 00:00:00")) for i in range(5)]).write.mode("append").parquet(booked)
        streams = [spark.readStream.schema(d.schema).parquet(f) for d, f in ((pay, paid), (res, booked))]
        query = paid_events(*streams).writeStream.format("noop").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(sum(s["numRowsTotal"] for p in query.recentProgress[-1:] for s in p["stateOperators"]))
    # State does not grow with what has ever arrived: the last years' rows at most.
    assert sizes[-1] <= sizes[1] and max(sizes) <= 3 * sizes[0]


def test_each_row_waits_once(spark):
    t = tables(spark)
    pay, res = (t[n].limit(0) for n in ("Payments", "ConferenceReservationDays"))
    folder, paid, booked = (run_folder(spark, n) for n in ("waiting", "paid", "booked"))
    frame(spark, "Payments", [{"PaymentID": i, "Date": day("2020-05-02"), "ReservationDayID": 900 + i} for i in range(5)]).write.parquet(paid)
    frame(spark, "ConferenceReservationDays", [reservation(i, 11, 1, Date=moment("2020-05-01 00:00:00")) for i in range(5)]).write.parquet(booked)
    streams = [spark.readStream.schema(d.schema).parquet(f) for d, f in ((pay, paid), (res, booked))]
    query = paid_events(*streams).writeStream.format("noop").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    # Ten rows that wait and the ten ids by which repeated deliveries are known.
    assert max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress) == 20
