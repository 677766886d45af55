"""Workshop registrations under both of their rules at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventbook.operators.admission import ROWS_PER_BLOCK, admit
from eventbook.operators.components import connected_components
from eventbook.operators.conflicts import registration_times
from eventbook.schema import CODE_OVERLAP, CODE_QUOTA, TEXT_OVERLAP, TEXT_WORKSHOP_QUOTA
from eventbook.session import cut_lineage, drop_written

_ID = "WorkshopRegistrationID"
_BOOKING = "WorkshopsReservationID"
_PLACE = ["ParticipantID", "Date"]
_SLOT = [*_PLACE, "Start", "End"]
#: Rounds before what is left is cut into components, and rows of a component that one task replays.
ROUNDS, COMPONENT_ROWS = 2, 100_000
#: Kinds of what a replay goes over.
_SEAT_TAKEN, _SLOT_HELD, _ASKS = 0, 1, 2
_EVENTS = "comp long, id long, kind int, booking long, free long, person long, day date, start int, stop int"


def admit_workshop_registrations(
    t: Mapping[str, DataFrame],
    new: DataFrame,
    existing: DataFrame | None = None,
    rounds: int = ROUNDS,
    component_rows: int = COMPONENT_ROWS,
) -> DataFrame:
    """``new`` with ``trigger``, ``code`` and ``message``, NULL on accepted rows.

    In id order a registration is accepted when its booking has a seat left and no accepted earlier
    registration of the participant overlaps it; a refused one takes no seat and blocks no time.  The
    two rules feed each other, so the answer is reached in rounds over all undecided rows at once:

    * a seat is sure for the first rows of a booking, as many as it has seats, even if all are accepted;
      a booking is full once accepted rows alone fill it;
    * each participant's day is then replayed in id order as far as seats are known, so that a chain of
      overlaps costs one round however long it is; only seats that hang on other participants wait.

    The lowest undecided id is always decided, so the rounds end, but a chain that goes from one participant
    to the next through scarce bookings loses one link a round.  What ``rounds`` leave is therefore cut into
    components, rows that hang together through a booking or a participant's day.  A component of at most
    ``component_rows`` rows is replayed in id order by one task; only larger ones go on in rounds, and may have
    fallen apart when they are looked at again.  A round reads and writes the undecided rows, the accepted rows
    of their bookings and one row for each accepted time of their participants.  Existing rows are treated
    as accepted and earlier.
    """
    times = registration_times(t, new).select(_ID, *_SLOT)
    quotas = t["WorkshopsReservations"].select(F.col("ReservationID").alias(_BOOKING), F.col("Quantity").alias("free"))
    quotas = quotas.dropDuplicates([_BOOKING])
    held = None
    if existing is not None:
        counts = existing.groupBy(_BOOKING).agg(F.count(F.lit(1)).alias("taken"))
        quotas = quotas.join(counts, _BOOKING, "left").select(
            _BOOKING, (F.col("free") - F.coalesce(F.col("taken"), F.lit(0))).alias("free")
        )
        before = F.lit(-1).cast("long")
        held = registration_times(t, existing).select(*_SLOT).distinct().withColumn("first", before)
    undecided = cut_lineage(new.select(_ID, _BOOKING).join(times, _ID, "left").join(quotas, _BOOKING, "left"))
    accepted = undecided.select(_ID, _BOOKING).limit(0)
    held = cut_lineage(held if held is not None else undecided.select(*_SLOT, F.col(_ID).alias("first")).limit(0))
    decided, number = [], 0
    while not undecided.isEmpty():
        if number == rounds:
            number, rounds = 0, 2 * rounds
            settled, undecided = _replayed_components(undecided, accepted, held, component_rows)
            decided.append(settled)
            continue
        number += 1
        rows = cut_lineage(_round(undecided, accepted, held))
        decided.append(rows.filter(F.col("code").isNotNull()).select(_ID, "code"))
        last = (undecided, accepted, held)
        undecided = cut_lineage(rows.filter(F.col("code").isNull()).drop("code"))
        fresh = rows.filter(F.col("code") == 0)
        open_bookings = undecided.select(_BOOKING).distinct()
        accepted = cut_lineage(
            accepted.unionByName(fresh.select(_ID, _BOOKING)).join(open_bookings, _BOOKING, "left_semi")
        )
        slots = held.unionByName(fresh.filter(F.col("Date").isNotNull()).select(*_SLOT, F.col(_ID).alias("first")))
        open_days = undecided.select(*_PLACE).distinct()
        held = cut_lineage(slots.join(open_days, _PLACE, "left_semi").groupBy(*_SLOT).agg(F.min("first").alias("first")))
        for table in last:
            drop_written(table)

    none = new.select(_ID, F.lit(None).cast("int").alias("code")).limit(0)
    verdict = reduce(DataFrame.unionByName, decided, none).select(_ID, F.when(F.col("code") != 0, F.col("code")).alias("code"))
    overlap = F.col("code") == CODE_OVERLAP
    return (
        new.join(verdict, _ID)
        .withColumn("trigger", F.when(overlap, F.lit("TRG-2")).when(F.col("code").isNotNull(), F.lit("TRG-7")))
        .withColumn(
            "message",
            F.when(overlap, F.concat(F.lit(TEXT_OVERLAP), F.col("ConferenceRegistrationID").cast("string"))).when(
                F.col("code").isNotNull(), F.concat(F.lit(TEXT_WORKSHOP_QUOTA), F.col(_BOOKING).cast("string"))
            ),
        )
    )


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, code`` of the undecided rows of whole components, which come one after the other in id order."""
    comp, seats, times = None, {}, {}
    for batch in batches:
        ids, codes = [], []
        for name, id_, kind, booking, free, person, day, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != comp:
                comp, seats, times = name, {}, {}
            code = 0
            if kind == _ASKS:
                taken = times.get((person, day), ())
                if day is not None and any(s <= stop and start <= e for s, e in taken):
                    code = CODE_OVERLAP
                elif free is not None and seats.get(booking, 0) >= free:
                    code = CODE_QUOTA
                ids.append(id_)
                codes.append(code)
            if code == 0 and kind != _SLOT_HELD:
                seats[booking] = seats.get(booking, 0) + 1
            if code == 0 and kind != _SEAT_TAKEN and day is not None:
                times.setdefault((person, day), []).append((start, stop))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.int32())], [_ID, "code"])


def _replayed_components(undecided: DataFrame, accepted: DataFrame, held: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Codes of the rows of small components, and the undecided rows of the others.

    A replay goes over a component's rows together with what has been decided around them: accepted rows
    take a seat, and accepted times stand, from their id on.
    """
    booking = F.coalesce(F.xxhash64(F.lit("booking"), F.col(_BOOKING)), F.lit(0))
    place = F.when(F.col("Date").isNotNull(), F.xxhash64(F.lit("place"), *_PLACE)).otherwise(booking)
    # Two nodes of one hash only make a component larger.
    comps = connected_components(undecided.select(booking.alias("a"), place.alias("b")))
    comps = cut_lineage(comps.select(F.col("node").alias("_node"), F.col("comp").alias("comp")))
    none = {"booking": "long", "free": "long", "person": "long", "day": "date", "start": "int", "stop": "int"}
    empty = lambda *names: [F.lit(None).cast(none[n]).alias(n) for n in names]
    names = [x.split()[0] for x in _EVENTS.split(", ")]
    asks = undecided.withColumn("_of", booking).join(comps, F.col("_of") == F.col("_node")).select(
        "comp", F.col(_ID).cast("long").alias("id"), F.lit(_ASKS).alias("kind"), F.col(_BOOKING).cast("long").alias("booking"), F.col("free").cast("long").alias("free"),
        F.col("ParticipantID").cast("long").alias("person"), F.col("Date").alias("day"), F.col("Start").cast("int").alias("start"), F.col("End").cast("int").alias("stop"),
    )
    seats = accepted.withColumn("_of", booking).join(comps, F.col("_of") == F.col("_node")).select(
        "comp", F.col(_ID).cast("long").alias("id"), F.lit(_SEAT_TAKEN).alias("kind"), F.col(_BOOKING).cast("long").alias("booking"), *empty("free", "person", "day", "start", "stop")
    )
    slots = held.withColumn("_of", F.xxhash64(F.lit("place"), *_PLACE)).join(comps, F.col("_of") == F.col("_node")).select(
        "comp", F.col("first").cast("long").alias("id"), F.lit(_SLOT_HELD).alias("kind"), *empty("booking", "free"),
        F.col("ParticipantID").cast("long").alias("person"), F.col("Date").alias("day"), F.col("Start").cast("int").alias("start"), F.col("End").cast("int").alias("stop"),
    )
    events = cut_lineage(asks.unionByName(seats).unionByName(slots).select(*names))
    sizes = events.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(sizes.filter(F.col("n") > most).select("comp"))
    small = events.join(large, "comp", "left_anti").repartition("comp").sortWithinPartitions("comp", "id", "kind")
    settled = cut_lineage(small.mapInArrow(_replay, f"{_ID} long, code int"))
    return settled, cut_lineage(undecided.join(settled.select(_ID), _ID, "left_anti"))


def _seats(undecided: DataFrame, accepted: DataFrame) -> DataFrame:
    """``undecided`` with ``sure`` (a seat whatever happens before it) and ``full`` (none any more)."""
    taken = accepted.groupBy(_BOOKING).agg(F.count(F.lit(1)).alias("n"), F.max(_ID).alias("last"))
    waiting = undecided.groupBy(_BOOKING, "free").agg(F.count(F.lit(1)).alias("open"))
    n = F.coalesce(F.col("n"), F.lit(0))
    bookings = waiting.join(taken, _BOOKING, "left").select(
        F.col(_BOOKING).alias("_booking"),
        (F.col("free").isNull() | (n + F.col("open") <= F.col("free"))).alias("roomy"),
        F.when(n >= F.col("free"), F.coalesce("last", F.lit(-1))).alias("full_after"),
        F.col("free").alias("_free"),
        (n + F.col("open")).alias("standing"),
    )
    bookings = cut_lineage(bookings)
    rows = undecided.join(bookings, F.col(_BOOKING).eqNullSafe(F.col("_booking")))
    # Where not all fit, the first standing rows have a seat.  A booking that one task can hold is
    # numbered; of a larger one the first rows are found by an admission of one place each.
    large = F.col("standing") > ROWS_PER_BLOCK
    tight = bookings.filter(~F.col("roomy")).select(F.col("_booking").alias(_BOOKING), F.col("_free").alias("free"), "standing")
    asks = undecided.select(_ID, _BOOKING).withColumn("asks", F.lit(True)).unionByName(accepted.withColumn("asks", F.lit(False)))
    standing = asks.join(tight, _BOOKING)
    by_id = Window.partitionBy(_BOOKING).orderBy(_ID)
    ranked = standing.filter(~large).withColumn("admitted", F.row_number().over(by_id) <= F.col("free")).select(_ID, "asks", "admitted")
    if not tight.filter(large).isEmpty():
        many = admit(standing.filter(large).select(_ID, _BOOKING, "asks"), tight.filter(large).select(_BOOKING, "free"), _BOOKING, _ID, F.lit(1))
        ranked = ranked.unionByName(many.select(_ID, "asks", "admitted"))
    seated = ranked.filter(F.col("asks") & F.col("admitted")).select(F.col(_ID).alias("_seated"))
    full = F.coalesce(F.col("full_after") < F.col(_ID), F.lit(False))
    return rows.join(seated, F.col(_ID) == F.col("_seated"), "left").select(
        *undecided.columns, (F.col("roomy") | F.col("_seated").isNotNull()).alias("sure"), full.alias("full")
    )


def _round(undecided: DataFrame, accepted: DataFrame, held: DataFrame) -> DataFrame:
    """``undecided`` with ``code``: 0 accepted, else refused, NULL where it has to wait."""
    rows = cut_lineage(_seats(undecided, accepted))
    timed = rows.filter(F.col("Date").isNotNull() & ~F.col("full"))
    # Of one time of a participant only the first row with a sure seat and the first without matter.
    firsts = timed.groupBy(*_SLOT).agg(
        F.min(F.when(F.col("sure"), F.col(_ID))).alias("sure_id"), F.min(F.when(~F.col("sure"), F.col(_ID))).alias("open_id")
    )
    kinds = F.array(
        F.struct(F.col("sure_id").alias("id"), F.lit(True).alias("sure")),
        F.struct(F.col("open_id").alias("id"), F.lit(False).alias("sure")),
    )
    queue = firsts.select(*_SLOT, F.explode(kinds).alias("k")).filter(F.col("k.id").isNotNull())
    item = F.struct(F.col("k.id").alias("id"), F.col("k.sure").alias("sure"), F.col("Start").alias("s"), F.col("End").alias("e"))
    queues = queue.groupBy(*_PLACE).agg(F.collect_list(item).alias("queue"))
    stands = held.groupBy(*_PLACE).agg(
        F.collect_list(F.struct(F.col("first").alias("id"), F.lit(True).alias("sure"), F.col("Start").alias("s"), F.col("End").alias("e"))).alias("stands")
    )
    nothing = F.expr("cast(array() as array<struct<id:bigint,sure:boolean,s:int,e:int>>)")

    def meets(a, b):
        return (a["s"] <= b["e"]) & (b["s"] <= a["e"])

    # State: rows that stand (accepted, or maybe accepted where ``sure`` is false), ids ascending.
    def replay(done, row):
        before = lambda x: meets(x, row) & (x["id"] < row["id"])
        maybe = F.exists(done, lambda x: before(x) & ~x["sure"])
        kept = F.struct(row["id"].alias("id"), (row["sure"] & ~maybe).alias("sure"), row["s"].alias("s"), row["e"].alias("e"))
        return F.when(F.exists(done, lambda x: before(x) & x["sure"]), done).otherwise(F.array_append(done, kept))

    state = F.aggregate(F.array_sort(F.coalesce("queue", nothing)), F.coalesce("stands", nothing), replay)
    days = queues.join(stands, _PLACE, "full").select(*_PLACE, state.alias("state"))
    asked = rows.filter(F.col("Date").isNotNull()).select(*_SLOT).distinct()

    def first(sure: bool):
        of = F.filter("state", lambda x: (x["sure"] == F.lit(sure)) & (x["s"] <= F.col("End")) & (F.col("Start") <= x["e"]))
        return F.array_min(F.transform(of, lambda x: x["id"]))

    hits = asked.join(days, _PLACE).select(*_SLOT, first(True).alias("blocked_by"), first(False).alias("maybe_by"))
    blocked = F.coalesce(F.col("blocked_by") < F.col(_ID), F.lit(False))
    maybe = F.coalesce(F.col("maybe_by") < F.col(_ID), F.lit(False))
    verdict = (
        F.when(blocked, F.lit(CODE_OVERLAP))
        .when(F.col("full") & ~maybe, F.lit(CODE_QUOTA))
        .when(F.col("sure") & ~maybe, F.lit(0))
    )
    return rows.join(hits, _SLOT, "left").withColumn("code", verdict).select(*undecided.columns, "code")
