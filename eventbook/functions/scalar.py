"""Scalar helpers, all built from native column expressions (no UDF anywhere)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventbook.schema import FREE_LABEL

_CLOCK = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?\s*$"


def as_date(value: datetime.date | str | Column) -> Column:
    """A date column from a literal or a column; the clock part of a timestamp is dropped."""
    if isinstance(value, Column):
        return F.to_date(value)
    return F.lit(str(value)[:10]).cast("date")


def week_number(day: Column) -> Column:
    """Index of the Sunday-to-Saturday week; day 0 of the Unix calendar was a Thursday."""
    return F.floor((F.unix_date(as_date(day)) + F.lit(4)) / F.lit(7)).cast("int")


def week_diff(start: Column, end: Column) -> Column:
    """Sunday boundaries crossed on the way from ``start`` to ``end``."""
    return week_number(end) - week_number(start)


def week_start(day: datetime.date) -> datetime.date:
    """The Sunday that begins the week of ``day``."""
    return day - datetime.timedelta(days=(day.weekday() + 1) % 7)


def within_days(moment: Column, first: datetime.date, days: int) -> Column:
    """``moment`` lies on ``first`` or one of the ``days`` days after it.

    Said as bounds on the bare column, for dates and timestamps alike, so that scans can use it.
    """
    return (moment >= F.lit(first)) & (moment < F.lit(first + datetime.timedelta(days=days + 1)))


def money(value: Column) -> Column:
    return value.cast("decimal(19,4)")


def round_to_int(value: Column) -> Column:
    """Money to integer: halves go up."""
    return F.round(value, 0).cast("int")


def cut_to_int(value: Column) -> Column:
    """Decimal to integer: the fraction is dropped."""
    return value.cast("int")


def parse_money(text: Column) -> Column:
    """Amount from text with a currency sign or thousands commas; NULL when it is no number."""
    return F.regexp_replace(text, "[^0-9.-]", "").try_cast("decimal(19,4)")


def parse_clock(text: Column) -> Column:
    """Seconds since midnight from '8:11 AM', '00:30 AM', '17:05' or '17:05:30'; else NULL."""
    hour = F.regexp_extract(text, _CLOCK, 1).try_cast("int")
    minute = F.regexp_extract(text, _CLOCK, 2).try_cast("int")
    second = F.coalesce(F.regexp_extract(text, _CLOCK, 3).try_cast("int"), F.lit(0))
    half = F.upper(F.regexp_extract(text, _CLOCK, 4))
    hour24 = (
        F.when(half == "", F.when(hour < 24, hour))
        .when(hour <= 12, hour % 12 + F.when(half == "PM", 12).otherwise(0))
    )
    return F.when((minute < 60) & (second < 60), hour24 * 3600 + minute * 60 + second)


def clock_of(moment: Column) -> Column:
    """Clock time of a timestamp in seconds since midnight."""
    return F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment).cast("int")


def clock_text(seconds: Column) -> Column:
    """Seconds since midnight as 'HH:MM:SS'."""
    return F.concat_ws(
        ":",
        *[
            F.lpad(part.cast("string"), 2, "0")
            for part in (
                F.floor(seconds / 3600).cast("int"),
                F.floor(seconds / 60).cast("int") % 60,
                seconds % 60,
            )
        ],
    )


def price_label(price: Column) -> Column:
    """Price as text with two decimals; a free item gets its label."""
    return F.when(price == 0, F.lit(FREE_LABEL)).otherwise(price.cast("decimal(19,2)").cast("string"))


def live(canceled: Column) -> Column:
    """Not cancelled; an unknown flag does not count as live."""
    return canceled == F.lit(False)
