"""Rules for new conference days."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.functions.scalar import as_date, clock_of, clock_text
from eventbook.schema import (
    CODE_DAY_CLOCK,
    CODE_DAY_DATE,
    CODE_DAY_TAKEN,
    TEXT_DAY_CLOCK,
    TEXT_DAY_DATE,
    TEXT_DAY_TAKEN,
)


def validate_conference_days(
    t: Mapping[str, DataFrame], new: DataFrame, existing: DataFrame | None = None, scope: str = "global"
) -> DataFrame:
    """``new`` with ``code`` and ``message``, both NULL on accepted days.

    A day must lie inside its conference by date and by clock time, and its date must be new: over
    all conferences, or with ``scope='conference'`` within its own.  The first broken rule counts,
    and a day refused for another reason does not occupy its date.
    """
    if scope not in ("global", "conference"):
        raise ValueError(f"unknown scope {scope!r}")
    bounds = t["Conferences"].select(
        "ConferenceID",
        as_date(F.col("Start")).alias("c_first"),
        as_date(F.col("End")).alias("c_last"),
        clock_of(F.col("Start")).alias("c_open"),
        clock_of(F.col("End")).alias("c_close"),
    )
    wrong_date = (F.col("Date") < F.col("c_first")) | (F.col("Date") > F.col("c_last"))
    wrong_clock = (F.col("Start") < F.col("c_open")) | (F.col("End") > F.col("c_close"))
    checked = new.join(bounds, "ConferenceID", "left").withColumn(
        "code", F.when(wrong_date, F.lit(CODE_DAY_DATE)).when(wrong_clock, F.lit(CODE_DAY_CLOCK))
    )

    place = ["Date"] if scope == "global" else ["Date", "ConferenceID"]
    holders = checked.filter(F.col("code").isNull()).select(*place, "ConferenceDayID")
    if existing is not None:
        holders = holders.unionByName(existing.select(*place, F.lit(None).cast("long").alias("ConferenceDayID")))
    # The lowest id holds the date, unless the date was taken before.
    holders = holders.groupBy(*place).agg(
        F.min("ConferenceDayID").alias("holder"),
        F.max(F.col("ConferenceDayID").isNull()).alias("before"),
    )
    taken = F.col("before") | (F.col("ConferenceDayID") > F.col("holder"))
    code = F.when(F.col("code").isNotNull(), F.col("code")).when(taken, F.lit(CODE_DAY_TAKEN))

    def part(label: str, column: str, clock: bool = False):
        value = F.col(column)
        return F.concat(F.lit(label), clock_text(value) if clock else value.cast("string"))

    message = (
        F.when(
            F.col("code") == CODE_DAY_DATE,
            F.concat(
                F.lit(TEXT_DAY_DATE),
                part(": DayDate: ", "Date"),
                part(" ConfStartDate: ", "c_first"),
                part(" ConfEndDate: ", "c_last"),
            ),
        )
        .when(
            F.col("code") == CODE_DAY_CLOCK,
            F.concat(
                F.lit(TEXT_DAY_CLOCK),
                part(": DayStartTime: ", "Start", True),
                part(" ConfStartTime: ", "c_open", True),
                part(" DayEndTime: ", "End", True),
                part(" ConfEnd: ", "c_close", True),
            ),
        )
        .when(F.col("code") == CODE_DAY_TAKEN, F.lit(TEXT_DAY_TAKEN))
    )
    return (
        checked.join(holders, place, "left")
        .withColumn("code", code)
        .withColumn("message", message)
        .select(*new.columns, "code", "message")
    )
