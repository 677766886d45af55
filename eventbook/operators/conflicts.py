"""Overlapping workshops of one participant on one date.

Two workshops overlap when they share an instant, touching included.  They then share the start of
one of them, so it is enough to compare at start times: an interval covers those start times of the
participant's own workshops on that date that lie inside it, and the earliest registration is kept per
(participant, date, start time).  No pair of registrations is ever formed, and every step is an aggregate
with partial sums, so one busy participant costs no more than the square of its own different workshop
times of the date, whatever other conferences do on that day.

Workshop times obey ``Start <= End`` (a table rule).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.functions.scalar import live
from eventbook.schema import CODE_OVERLAP, TEXT_OVERLAP
from eventbook.session import cut_lineage

_PLACE = ["ParticipantID", "Date"]
_SLOT = ["Start", "End"]


def _timetable(t: Mapping[str, DataFrame]) -> DataFrame:
    """``(WorkshopID, Date, Start, End)``."""
    return (
        t["Workshops"]
        .select("WorkshopID", "ConferenceDayID", *_SLOT)
        .join(t["ConferenceDays"].select("ConferenceDayID", "Date"), "ConferenceDayID")
        .select("WorkshopID", "Date", *_SLOT)
    )


def registration_times(t: Mapping[str, DataFrame], registrations: DataFrame) -> DataFrame:
    """Live workshop registrations with participant, date and time."""
    return (
        registrations.filter(live(F.col("Canceled")))
        .select(
            "WorkshopRegistrationID",
            "ConferenceRegistrationID",
            F.col("WorkshopsReservationID").alias("ReservationID"),
        )
        .join(
            t["ConferenceDayRegistration"].select("ConferenceRegistrationID", "ParticipantID"),
            "ConferenceRegistrationID",
        )
        .join(t["WorkshopsReservations"].select("ReservationID", "WorkshopID"), "ReservationID")
        .join(_timetable(t), "WorkshopID")
        .select("WorkshopRegistrationID", "ConferenceRegistrationID", *_PLACE, *_SLOT)
    )


def at_own_starts(slots: DataFrame) -> DataFrame:
    """``slots`` (participant, date, start, end and more) at each ``point`` that they cover: the start
    times which the participant has on the date.  Rows are different times, not registrations."""
    starts = slots.groupBy(*_PLACE).agg(F.collect_set("Start").alias("_starts"))
    covered = F.filter("_starts", lambda p: (p >= F.col("Start")) & (p <= F.col("End")))
    return slots.join(starts, _PLACE).withColumn("point", F.explode(covered)).drop("_starts")


def earliest_overlap(times: DataFrame) -> DataFrame:
    """``(participant, date, start, end, earliest)``: lowest id in ``times`` that overlaps that time."""
    first = times.groupBy(*_PLACE, *_SLOT).agg(F.min("WorkshopRegistrationID").alias("first_id"))
    spread = at_own_starts(first)
    at_point = spread.groupBy(*_PLACE, "point").agg(F.min("first_id").alias("earliest"))
    return (
        spread.join(at_point, [*_PLACE, "point"])
        .groupBy(*_PLACE, *_SLOT)
        .agg(F.min("earliest").alias("earliest"))
    )


def workshop_conflicts(t: Mapping[str, DataFrame], registrations: DataFrame | None = None) -> DataFrame:
    """Live registrations that overlap an earlier one of the same participant, with the earliest such id."""
    times = cut_lineage(registration_times(t, t["WorkshopRegistration"] if registrations is None else registrations))
    return (
        times.join(earliest_overlap(times), [*_PLACE, *_SLOT])
        .filter(F.col("earliest") < F.col("WorkshopRegistrationID"))
        .select(
            "WorkshopRegistrationID",
            "ParticipantID",
            "Date",
            F.col("earliest").alias("conflicts_with"),
            F.lit(CODE_OVERLAP).alias("code"),
            F.concat(F.lit(TEXT_OVERLAP), F.col("ConferenceRegistrationID").cast("string")).alias("message"),
        )
    )


def admit_non_overlapping(
    t: Mapping[str, DataFrame], registrations: DataFrame | None = None, existing: DataFrame | None = None
) -> DataFrame:
    """Registrations in id order with a boolean ``admitted``: no overlap with an admitted earlier one.

    Of several registrations for the same time only the earliest can be admitted, so the replay per
    (participant, date) runs over different workshop times only.  ``existing`` rows stand as admitted.
    Cancelled registrations pass.
    """
    rows = t["WorkshopRegistration"] if registrations is None else registrations
    times = cut_lineage(registration_times(t, rows))
    first = times.groupBy(*_PLACE, *_SLOT).agg(F.min("WorkshopRegistrationID").alias("id"))
    slot = F.struct("id", F.col("Start").alias("s"), F.col("End").alias("e"))
    queues = first.groupBy(*_PLACE).agg(F.collect_list(slot).alias("queue"))
    if existing is None:
        queues = queues.withColumn("held", F.expr("cast(array() as array<struct<id:bigint,s:int,e:int>>)"))
    else:
        held = (
            registration_times(t, existing)
            .groupBy(*_PLACE, *_SLOT)
            .agg(F.min("WorkshopRegistrationID").alias("id"))
            .groupBy(*_PLACE)
            .agg(F.collect_list(slot).alias("held"))
        )
        queues = queues.join(held, _PLACE, "left").withColumn(
            "held", F.coalesce("held", F.expr("cast(array() as array<struct<id:bigint,s:int,e:int>>)"))
        )
    kept = F.aggregate(
        F.array_sort("queue"),
        F.col("held"),
        lambda done, row: F.when(
            F.exists(done, lambda other: (other["s"] <= row["e"]) & (row["s"] <= other["e"])), done
        ).otherwise(F.array_append(done, row)),
    )
    winners = queues.select(F.explode(kept).alias("w")).select(F.col("w.id").alias("WorkshopRegistrationID"))
    losers = times.join(winners, "WorkshopRegistrationID", "left_anti").select(
        F.col("WorkshopRegistrationID").alias("_lost")
    )
    return (
        rows.join(losers, F.col("WorkshopRegistrationID") == F.col("_lost"), "left")
        .withColumn("admitted", F.col("_lost").isNull())
        .drop("_lost")
    )
