"""First-come admission over a log in which cancellations give places back.

``admit`` rests on places that only get fewer.  Here a row may be cancelled by a later event, which frees
its places if it was admitted, so that later rows fit again.  A log is still cut into segments of a key, which
are replayed side by side, whatever the size of the key:

* a segment needs two things from the segments before it: the places used when it begins, and which of the rows
  that it cancels were admitted there;
* both are guessed at first, and taken from the last replay from then on.  Only segments for which something
  has changed are replayed again, until nothing changes.

After r turns the first r segments of every key are right, so the turns end, and what stands then is what a
replay from the beginning would give, since each segment follows from those before it.  A crowded key forgets
quickly: soon after a segment begins its places are taken up, whatever was free at its start, and so the guess of a
full key is right for nearly all segments and the turns are few.

Keys in which everything fits are not replayed, and keys without cancellations go through ``admit``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventbook.operators.admission import admit
from eventbook.operators.capacity import day_limits, heads, workshop_limits
from eventbook.operators.identity import assign_ids
from eventbook.session import cut_lineage, drop_written

#: Events of a segment at most: the fold's state is an array of a segment's admitted rows.
SEGMENT = 1024


def _events(rows: DataFrame, cancellations: DataFrame) -> DataFrame:
    """``k, at, q, ref``: rows (``ref`` NULL) and the first cancellation behind each (``ref``: the row's ``at``)."""
    ends = rows.join(cancellations, "i").filter(F.col("ends") >= F.col("at")).groupBy("k", "at", "q").agg(F.min("ends").alias("ends"))
    return rows.select("k", "at", "q", F.lit(None).cast("long").alias("ref")).unionByName(
        ends.select("k", F.col("ends").alias("at"), "q", F.col("at").alias("ref"))
    )


def _segments(events: DataFrame, free: DataFrame, size: int) -> DataFrame:
    """``k, b, free, items``: a key's events in order, cut into segments; ``before`` is the sum of the
    quantities of earlier segments.  Segments come from the order of the whole log, so that a hot key has many."""
    # At one moment a row comes before a cancellation.
    numbered = assign_ids(events.withColumn("is_end", F.col("ref").isNotNull()), None, "n", ["k", "at", "is_end"])
    item = F.struct("n", "at", "q", "ref")
    parts = numbered.groupBy("k", F.expr(f"(n - 1) div {size}").alias("b")).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.sum(F.when(F.col("ref").isNull(), F.col("q")).otherwise(0)).alias("asked"), F.min(F.when(F.col("ref").isNull(), F.col("at"))).alias("first")
    )
    return parts.join(free, "k")


def _replayed(segments: DataFrame) -> DataFrame:
    """``k, b, admitted, net``: the ``at`` of the admitted rows, and the places used and freed."""
    none = F.expr("cast(array() as array<bigint>)")

    def step(state: Column, x: Column) -> Column:
        fits = x["q"] <= F.col("free") - state["used"]
        taken = F.struct((state["used"] + x["q"]).alias("used"), F.array_append(state["admitted"], x["at"]).alias("admitted"))
        freed = F.struct((state["used"] - x["q"]).alias("used"), state["admitted"].alias("admitted"))
        was = F.array_contains(state["admitted"], x["ref"]) | F.array_contains("refs", x["ref"])
        return F.when(x["ref"].isNull() & fits, taken).when(x["ref"].isNotNull() & F.coalesce(was, F.lit(False)), freed).otherwise(state)

    start = F.struct(F.col("start").alias("used"), none.alias("admitted"))
    done = segments.withColumn("end", F.aggregate("items", start, step))
    return done.select("k", "b", F.col("end.admitted").alias("admitted"), (F.col("end.used") - F.col("start")).alias("net"))


def _settled(segments: DataFrame) -> DataFrame:
    """``k, at`` of the rows admitted once nothing changes any more."""
    segments = cut_lineage(segments)
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # Cancellations of rows in earlier segments: (k, b) asks for (k, of).
    cancels = segments.select("k", "b", F.explode("items").alias("x")).filter(F.col("x.ref").isNotNull())
    held = segments.select("k", "b", F.explode("items").alias("x")).filter(F.col("x.ref").isNull())
    across = cancels.select("k", "b", F.col("x.ref").alias("of")).join(
        held.select(F.col("k").alias("k_"), F.col("b").alias("home"), F.col("x.at").alias("at_")), (F.col("k") == F.col("k_")) & (F.col("of") == F.col("at_"))
    )
    across = cut_lineage(across.filter(F.col("home") < F.col("b")).select("k", "b", "of", "home"))
    nothing = F.expr("cast(array() as array<bigint>)")
    full = F.least(F.greatest("free", F.lit(0)), F.coalesce(F.sum("asked").over(earlier), F.lit(0)))
    inputs = cut_lineage(segments.select("k", "b", full.cast("long").alias("start"), nothing.alias("refs")))
    results = cut_lineage(_replayed(segments.join(inputs, ["k", "b"])))
    while True:
        starts = results.select("k", "b", F.coalesce(F.sum("net").over(earlier), F.lit(0)).cast("long").alias("start"))
        wanted = results.select(F.col("k").alias("k_"), F.col("b").alias("b_"), F.explode("admitted").alias("at_"))
        known = across.join(wanted, (F.col("k") == F.col("k_")) & (F.col("of") == F.col("at_")) & (F.col("home") == F.col("b_")), "left_semi")
        refs = known.groupBy("k", "b").agg(F.array_sort(F.collect_list("of")).alias("refs"))
        now = cut_lineage(starts.join(refs, ["k", "b"], "left").select("k", "b", "start", F.coalesce("refs", nothing).alias("refs")))
        changed = cut_lineage(now.join(inputs, ["k", "b", "start", "refs"], "left_anti"))
        if changed.isEmpty():
            return results.select("k", F.explode("admitted").alias("at"))
        again = _replayed(segments.join(changed, ["k", "b"]))
        last = (inputs, results)
        results = cut_lineage(results.join(changed.select("k", "b"), ["k", "b"], "left_anti").unionByName(again))
        inputs = now
        for table in last:
            drop_written(table)


def admit_log(
    rows: DataFrame, cancellations: DataFrame, free: DataFrame, key: str, row_id: str, at: str, quantity: Column, segment: int = SEGMENT
) -> DataFrame:
    """``rows`` with a boolean ``admitted``.

    ``rows`` come in the order of ``at``, a number that no two of them share; ``cancellations`` are ``(row_id, at)``
    in the same count.  A cancellation frees the places of a row that was admitted before it; one of a
    refused row, one before its row and a second one change nothing.  At one moment rows come first.
    ``free`` is ``(key, free)``; keys without an entry are not limited.  A NULL quantity marks a row the rule does
    not look at; a negative one is an error.
    """
    amount = quantity.cast("long")
    refused = F.raise_error(F.concat(F.lit(f"negative quantity in the row of {row_id} "), F.col(row_id).cast("string")))
    asked = rows.select(
        F.col(key).cast("long").alias("k"), F.col(row_id).cast("long").alias("i"), F.col(at).cast("long").alias("at"),
        F.when(amount < 0, refused.cast("long")).otherwise(amount).alias("q"),
    ).filter(F.col("k").isNotNull() & F.col("at").isNotNull() & F.col("q").isNotNull())
    asked = cut_lineage(asked)
    places = free.select(F.col(key).cast("long").alias("k"), F.col("free").cast("long").alias("free")).filter("free IS NOT NULL")
    totals = asked.groupBy("k").agg(F.sum("q").alias("total")).join(places, "k")
    crowded = cut_lineage(totals.filter(F.col("total") > F.col("free")).select("k", "free"))
    tight = asked.join(crowded.select("k"), "k", "left_semi")
    ends = cancellations.select(F.col(row_id).cast("long").alias("i"), F.col(at).cast("long").alias("ends")).filter("i IS NOT NULL AND ends IS NOT NULL")
    events = cut_lineage(_events(tight, ends))
    freed = cut_lineage(events.filter(F.col("ref").isNotNull()).select("k").distinct())
    with_ends, without = crowded.join(freed, "k", "left_semi"), crowded.join(freed, "k", "left_anti")

    simple = admit(tight.join(without.select("k"), "k", "left_semi"), without, "k", "at", F.col("q")).filter("admitted").select("k", "at")
    fits = _settled(_segments(events.join(freed, "k", "left_semi"), with_ends, segment)).unionByName(simple)
    fits = fits.select(F.col("k").alias("_k"), F.col("at").alias("_at"))
    limited = crowded.select(F.col("k").alias("_crowded"))
    place = (F.col(key).cast("long") == F.col("_k")) & (F.col(at).cast("long") == F.col("_at"))
    admitted = F.col("_crowded").isNull() | F.col(at).isNull() | amount.isNull() | F.col("_k").isNotNull()
    return (
        rows.join(limited, F.col(key).cast("long") == F.col("_crowded"), "left")
        .join(fits, place, "left")
        .withColumn("admitted", admitted)
        .drop("_k", "_at", "_crowded")
    )


def admit_day_log(t: Mapping[str, DataFrame], reservations: DataFrame, cancellations: DataFrame, at: str, **tuning) -> DataFrame:
    """Day reservations against the conference limit, with cancellations ``(ReservationDayID, at)`` in between."""
    free = day_limits(t).select("ConferenceDayID", F.col("Limit").cast("long").alias("free"))
    return admit_log(reservations, cancellations, free, "ConferenceDayID", "ReservationDayID", at, heads(), **tuning)


def admit_workshop_log(t: Mapping[str, DataFrame], bookings: DataFrame, cancellations: DataFrame, at: str, **tuning) -> DataFrame:
    """Workshop bookings against the workshop limit, with cancellations ``(ReservationID, at)`` in between."""
    free = workshop_limits(t).select("WorkshopID", F.col("Limit").cast("long").alias("free"))
    return admit_log(bookings, cancellations, free, "WorkshopID", "ReservationID", at, F.col("Quantity"), **tuning)
