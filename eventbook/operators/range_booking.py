"""Range bookings as the procedure runs them: request by request, each day by day, up to the first refusal.

A request asks for every day of a conference inside its dates, the earliest first.  A refused day ends the
request: days booked before stay booked, later days are not asked for, and so leave places to others.  A day
therefore hangs on the earlier days of its conference, but never on later ones, and on each day the requests
still asking come in their own order.  So days are settled one after the other, each for all requests and all
conferences at once by the admission under a capacity, which splits hot days.

A day on which all that could be asked for fits refuses nobody and needs no turn.  There are as many turns as
the conference with most crowded days has such days; the number of requests does not matter.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventbook.operators.admission import admit
from eventbook.operators.capacity import available_day_places, day_limits, heads
from eventbook.operators.identity import assign_ids
from eventbook.operators.ingest import Ingested, references_checked, row_checked
from eventbook.operators.lifecycle import register_date_range
from eventbook.schema import CODE_DAY_FULL, TABLES, TEXT_DAY_FULL
from eventbook.session import cut_lineage

TABLE = "ConferenceReservationDays"


def _turns(asks: DataFrame, free: DataFrame) -> DataFrame:
    """``ConferenceDayID, free, turn`` of the days on which not all fits; turns follow each conference's days."""
    wanted = asks.groupBy("_conference", "_day", "ConferenceDayID").agg(F.sum("_q").alias("total"))
    crowded = wanted.join(free, "ConferenceDayID").filter(F.col("total") > F.col("free"))
    in_order = Window.partitionBy("_conference").orderBy("_day", "ConferenceDayID")
    return cut_lineage(crowded.select("ConferenceDayID", "free", F.row_number().over(in_order).alias("turn")))


def first_refusals(asks: DataFrame, free: DataFrame) -> DataFrame:
    """``_request, _refused, _refused_id``: date and id of the day that ends a request.

    ``asks``: ``_request, _conference, _day, ConferenceDayID, _q``, one row for each day that a request would ask for.
    """
    turns = _turns(asks, free)
    refused = cut_lineage(asks.select("_request", F.col("_day").alias("_refused"), F.col("ConferenceDayID").alias("_refused_id")).limit(0))
    for turn in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
        now = turns.filter(F.col("turn") == turn).select("ConferenceDayID", "free")
        asking = asks.join(now.select("ConferenceDayID"), "ConferenceDayID", "left_semi").join(refused, "_request", "left_anti")
        answered = admit(asking, now, "ConferenceDayID", "_request", F.col("_q"))
        fresh = answered.filter(~F.col("admitted")).select("_request", F.col("_day").alias("_refused"), F.col("ConferenceDayID").alias("_refused_id"))
        refused = cut_lineage(refused.unionByName(fresh))
    return refused


def book_date_ranges(
    t: Mapping[str, DataFrame],
    requests: DataFrame,
    reservation_date: datetime.date,
    order_by: list[str],
    inclusive_end: bool = True,
) -> Ingested:
    """Reservations for requests taken in ``order_by`` order, each ended by its first refused day.

    ``checked`` has the rows that were asked for: the booked ones and, for each ended request, the one
    that was refused, by the day's limit or by a row rule or reference (which all days of a request break alike).
    Ids are dense over these rows, by request and day.  A request for no day has no row.
    """
    numbered = assign_ids(requests, None, "_request", order_by)
    rows = register_date_range(t, numbered, reservation_date, inclusive_end, keep=("_request", "_conference", "_day"))
    checked = cut_lineage(references_checked(row_checked(rows.withColumn("Canceled", F.lit(False)), TABLE), TABLE, t))
    sound = checked.filter(F.col("rule").isNull())
    asks = sound.select("_request", "_conference", "_day", "ConferenceDayID", heads().alias("_q"))
    places = available_day_places(t).select("ConferenceDayID", F.col("free_places").alias("free"))
    free = day_limits(t).select("ConferenceDayID").distinct().join(places.dropDuplicates(["ConferenceDayID"]), "ConferenceDayID")
    refused = first_refusals(asks, free)

    later = (F.col("_day") > F.col("_refused")) | ((F.col("_day") == F.col("_refused")) & (F.col("ConferenceDayID") > F.col("_refused_id")))
    full = F.col("ConferenceDayID") == F.col("_refused_id")
    asked = sound.join(refused, "_request", "left").filter(F.col("_refused").isNull() | ~later)
    asked = asked.select(
        *checked.drop("rule", "message").columns,
        F.when(full, F.lit("TRG-5")).alias("rule"),
        F.when(full, F.lit(CODE_DAY_FULL)).alias("code"),
        F.when(full, F.concat(F.lit(TEXT_DAY_FULL), F.col("ConferenceDayID").cast("string"))).alias("message"),
    )
    # Of a request that breaks a rule its first day is asked for and refused.
    first = Window.partitionBy("_request").orderBy("_day", "ConferenceDayID")
    broken = checked.filter(F.col("rule").isNotNull()).withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    every = asked.unionByName(broken.withColumn("code", F.lit(None).cast("int")))
    spec = TABLES[TABLE]
    out = assign_ids(every, t[TABLE], spec.key, ["_request", "_day", "ConferenceDayID"])
    columns = [F.col(c.name).cast(c.type).alias(c.name) for c in spec.columns]
    return Ingested(out.select(*columns, "rule", "code", "message"))
