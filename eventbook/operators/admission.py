"""First-come admission under a capacity per key, for any key size.

Rows are taken in id order; a row is admitted when its quantity still fits, and a row that does
not fit uses nothing.  A running sum alone is not enough: a large rejected row must not block a
later small one.  Nor may one task replay a whole key, since one key can hold a third of all rows.
Three facts keep the exact answer cheap, because free places never grow while rows are taken:

1. A key whose total fits admits everything.
2. Up to the first row that does not fit, the answer is the running sum.  That place is found by
   summing blocks of ids and then walking only the block in which the limit is crossed.  Ids may be
   clustered: a crossing block that still holds many rows is cut into blocks again.
3. Behind it, fewer places are left than that one row asked for.  Among rows of equal quantity the
   admitted ones are always the earliest, so of quantity ``q`` only the first ``left div q`` rows
   can still be admitted.  The final replay sees only those, at most ``left * (1 + ln left)`` rows.

The outcome per key is a cut-off id and a short list of ids behind it, which is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventbook.functions.scalar import live
from eventbook.operators.capacity import (
    day_limits,
    day_occupancy,
    heads,
    workshop_limits,
    workshop_occupancy,
)
from eventbook.schema import (
    CODE_DAY_FULL,
    CODE_QUOTA,
    CODE_WORKSHOP_FULL,
    TEXT_DAY_FULL,
    TEXT_DAY_QUOTA,
    TEXT_WORKSHOP_FULL,
    TEXT_WORKSHOP_QUOTA,
)
from eventbook.session import cut_lineage

ROWS_PER_BLOCK = 1 << 16
MAX_BLOCKS = 1 << 12
FEWEST_BLOCKS = 64
SALTS = 32
BROADCAST_KEYS = 500_000  # at most one row of six numbers per key: some 50 MB in memory


def _crowded(rows: DataFrame, free: DataFrame, rows_per_block: int, max_blocks: int) -> DataFrame:
    """Keys asking for more than they have: range of ids, number of blocks, id width of one block."""
    blocks = F.expr(f"least({max_blocks}, 1 + (n - 1) div {rows_per_block})")
    return (
        rows.groupBy("k")
        .agg(
            F.sum("q").alias("total"),
            F.count(F.lit(1)).alias("n"),
            F.min("i").alias("lo"),
            F.max("i").alias("hi"),
        )
        .join(free, "k")
        .filter(F.col("total") > F.col("free"))
        .withColumn("blocks", blocks)
        .selectExpr("k", "free", "lo", "hi", "blocks", "1 + (hi - lo) div blocks AS width")
    )


def _bounded(df: DataFrame, count: int) -> DataFrame:
    """``df`` marked for broadcast if its known row count allows it."""
    return F.broadcast(df) if count <= BROADCAST_KEYS else df


def _meet(rows: DataFrame, per_key: DataFrame, keys: int, large_keys: int) -> DataFrame:
    """Rows with what is known of their key.

    A few keys are broadcast.  Of many, those with so many rows that one task should not hold them
    are; the others are small, and an ordinary join has no large group.
    """
    if keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(per_key), "k")
    large, small = per_key.filter("blocks > 1"), per_key.filter("blocks = 1")
    return rows.join(_bounded(large, large_keys), "k").unionByName(rows.join(small, "k"))


def _crossings(rows: DataFrame, large: DataFrame, rows_per_block: int, max_blocks: int) -> DataFrame:
    """Per key the block of ids (``start`` to ``stop``) in which the limit is passed, and the sum before it.

    Blocks are equal widths of the id range.  Where the ids are clustered one block can hold most of a
    key, so the step is repeated inside crossing blocks of more than ``rows_per_block`` rows.  Each turn
    divides a block's width by ``FEWEST_BLOCKS`` at least, hence there are few.
    """
    running = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = ["k", "free", "lo", "blocks"]
    open_ = large.selectExpr(*key, "lo AS start", "hi AS stop", "cast(0 AS bigint) AS before", "blocks AS parts", "width")
    done = []
    while True:
        inside = rows.join(open_, "k").filter("i BETWEEN start AND stop")
        found = (
            inside.groupBy(*key, "start", "stop", "before", "parts", "width", F.expr("(i - start) div width").alias("b"))
            .agg(F.sum("q").alias("s"), F.count(F.lit(1)).alias("n"))
            .withColumn("run", F.col("before") + F.sum("s").over(running))
            .filter(F.col("run") > F.col("free"))
            .groupBy(*key, "start", "stop", "width")
            .agg(F.min(F.struct("b", (F.col("run") - F.col("s")).alias("before"), "n")).alias("c"))
            .withColumn("at", F.expr("start + c.b * width"))
            .selectExpr(*key, "at AS start", "least(stop, at + width - 1) AS stop", "c.before AS before", "c.n AS n", "width")
        )
        found = cut_lineage(found)
        wide = (F.col("n") > rows_per_block) & (F.col("stop") > F.col("start"))
        done.append(found.filter(~wide))
        parts = f"least({max_blocks}, greatest({FEWEST_BLOCKS}, 1 + (n - 1) div {rows_per_block}))"
        open_ = found.filter(wide).withColumn("parts", F.expr(parts)).withColumn("width", F.expr("1 + (stop - start) div parts"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done).select(*key, "start", "stop", "before")


def _cuts(rows: DataFrame, crossings: DataFrame, keys: int, large_keys: int) -> DataFrame:
    """``(k, free, lo, blocks, cut, left)``: ids up to ``cut`` fit, ``left`` places remain after it."""
    running = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _meet(rows, crossings, keys, large_keys)
        .filter("i BETWEEN start AND stop")
        .withColumn("run", F.col("before") + F.sum("q").over(running))
        .groupBy("k", "free", "lo", "blocks", "start", "before")
        .agg(F.max(F.when(F.col("run") <= F.col("free"), F.struct("run", "i"))).alias("last"))
        .select(
            "k",
            "free",
            "lo",
            "blocks",
            # With no row of the block admitted the cut lies at the end of the block before.
            F.coalesce(F.col("last.i"), F.col("start") - 1).alias("cut"),
            (F.col("free") - F.coalesce(F.col("last.run"), F.col("before"))).alias("left"),
        )
    )


def _outcomes(rows: DataFrame, cuts: DataFrame, keys: int, large_keys: int, salts: int) -> DataFrame:
    """``(k, free, cut, left, late)``: ``late`` lists the ids admitted behind the cut."""
    late = (F.col("i") > F.col("cut")) & (F.col("q") > 0) & (F.col("q") <= F.col("left"))
    tail = (
        _meet(rows, cuts, keys, large_keys)
        .withColumn("late", late)
        # The lowest id of each key stays as a witness, so that no key is lost.
        .filter(F.col("late") | (F.col("i") == F.col("lo")))
        .withColumn("most", F.when(F.col("late"), F.expr("left div q")).otherwise(1))
        # A key of more blocks is dealt to more tasks.
        .withColumn("salt", F.expr(f"pmod(hash(i), cast(greatest({salts}, blocks) AS int))"))
    )
    # Earliest rows per quantity: where keys are large within each salt first, then among the survivors.
    stages = [["k", "late", "q", "salt"], ["k", "late", "q"]]
    for columns in stages if large_keys else stages[1:]:
        tail = tail.withColumn("rank", F.row_number().over(Window.partitionBy(*columns).orderBy("i"))).filter(
            F.col("rank") <= F.col("most")
        )
    nothing = F.expr("cast(array() as array<bigint>)")
    replay = F.aggregate(
        F.array_sort("queue"),
        F.struct(F.col("left").alias("left"), nothing.alias("ids")),
        lambda state, row: F.when(
            row["q"] <= state["left"],
            F.struct((state["left"] - row["q"]).alias("left"), F.array_append(state["ids"], row["i"]).alias("ids")),
        ).otherwise(state),
        lambda state: state["ids"],
    )
    return (
        tail.groupBy("k", "free", "cut", "left")
        .agg(F.collect_list(F.when(F.col("late"), F.struct("i", "q"))).alias("queue"))
        .select("k", "free", "cut", "left", replay.alias("late"))
    )


def admit(
    rows: DataFrame,
    free: DataFrame,
    key: str,
    row_id: str,
    quantity: Column,
    rows_per_block: int = ROWS_PER_BLOCK,
    max_blocks: int = MAX_BLOCKS,
    salts: int = SALTS,
    stored: bool = False,
) -> DataFrame:
    """``rows`` with a boolean ``admitted``.

    ``free`` is ``(key, free)``; keys without an entry are not limited.  A NULL quantity marks a row
    the rule does not look at: it is admitted and uses nothing.  A negative quantity is an error: it
    would give places back, and the running sums rest on places that only get fewer.

    The rows are read in five passes (totals, blocks, crossing block, tail, answer).  Key, id and
    quantity are written once for the first four; ``stored`` says that ``rows`` are hardly more than a
    scan, which can as well be repeated.  What the rows meet is at most one row per crowded key.  The
    crowded keys are written and counted first, and broadcast up to ``BROADCAST_KEYS``, so that the
    passes do not move the rows to meet them.  The outcomes are written as well: the answer is one
    join with a table of known size.
    """
    amount = quantity.cast("long")
    refused = F.raise_error(F.concat(F.lit(f"negative quantity in the row of {row_id} "), F.col(row_id).cast("string")))
    asked = rows.select(
        F.col(key).cast("long").alias("k"),
        F.col(row_id).cast("long").alias("i"),
        F.when(amount < 0, refused.cast("long")).otherwise(amount).alias("q"),
    ).filter(F.col("k").isNotNull() & F.col("i").isNotNull() & F.col("q").isNotNull())
    places = free.select(F.col(key).cast("long").alias("k"), F.col("free").cast("long").alias("free")).filter(
        F.col("free").isNotNull()
    )
    if not stored:
        asked = cut_lineage(asked)
    crowded = cut_lineage(_crowded(asked, places, rows_per_block, max_blocks))
    keys, large_keys = crowded.agg(F.count(F.lit(1)), F.count_if(F.col("blocks") > 1)).first()
    if keys == 0:
        return rows.withColumn("admitted", F.lit(True))
    # A key of one block crosses its limit in that block; the pass over blocks is for larger ones.
    no = F.lit(0).cast("long")
    small = crowded.filter("blocks = 1")
    crossings = small.select("k", "free", "lo", "blocks", F.col("lo").alias("start"), F.col("hi").alias("stop"), no.alias("before"))
    if large_keys:
        large = _bounded(crowded.filter("blocks > 1"), large_keys)
        crossings = crossings.unionByName(_crossings(asked, large, rows_per_block, max_blocks))
    cuts = _cuts(asked, crossings, keys, large_keys)
    outcomes = cut_lineage(
        _outcomes(asked, cuts, keys, large_keys, salts).toDF("_k", "_free", "_cut", "_left", "_late")
    )
    admitted = (
        F.col("_k").isNull()
        | amount.isNull()
        | (F.col(row_id) <= F.col("_cut"))
        | ((amount == 0) & (F.col("_free") >= 0))
        # A row that asks for more than was left is in no list and need not be looked up.
        | ((amount <= F.col("_left")) & F.coalesce(F.array_contains("_late", F.col(row_id).cast("long")), F.lit(False)))
    )
    return (
        rows.join(outcomes, F.col(key).cast("long") == F.col("_k"), "left")
        .withColumn("admitted", admitted)
        .drop("_k", "_free", "_cut", "_left", "_late")
    )


def _remaining(limits: DataFrame, taken: DataFrame | None, key: str) -> DataFrame:
    if taken is None:
        return limits.select(key, F.col("Limit").cast("long").alias("free"))
    return limits.join(taken, key, "left").select(
        key, (F.col("Limit").cast("long") - F.coalesce(F.col("taken"), F.lit(0))).alias("free")
    )


def _answer(rows: DataFrame, key: str, code: int, text: str) -> DataFrame:
    """Add ``code`` and ``message`` to the rows that were not admitted."""
    refused = ~F.col("admitted")
    return rows.withColumn("code", F.when(refused, F.lit(code))).withColumn(
        "message", F.when(refused, F.concat(F.lit(text), F.col(key).cast("string")))
    )


def admit_workshop_reservations(
    t: Mapping[str, DataFrame], new: DataFrame, existing: DataFrame | None = None, **tuning
) -> DataFrame:
    """Workshop bookings in id order against the workshop limit; cancelled rows always pass."""
    taken = None if existing is None else workshop_occupancy(existing)
    asked = F.when(live(F.col("Canceled")), F.col("Quantity"))
    rows = admit(
        new, _remaining(workshop_limits(t), taken, "WorkshopID"), "WorkshopID", "ReservationID", asked, **tuning
    )
    return _answer(rows, "WorkshopID", CODE_WORKSHOP_FULL, TEXT_WORKSHOP_FULL)


def admit_day_reservations(
    t: Mapping[str, DataFrame], new: DataFrame, existing: DataFrame | None = None, **tuning
) -> DataFrame:
    """Day reservations in id order against the conference limit.

    A cancelled row uses nothing, but like any other it is refused on a day already overbooked.
    """
    taken = None if existing is None else day_occupancy(existing)
    asked = F.when(live(F.col("Canceled")), heads()).otherwise(F.lit(0))
    rows = admit(
        new, _remaining(day_limits(t), taken, "ConferenceDayID"), "ConferenceDayID", "ReservationDayID", asked, **tuning
    )
    return _answer(rows, "ConferenceDayID", CODE_DAY_FULL, TEXT_DAY_FULL)


def _counted(existing: DataFrame, key: str) -> DataFrame:
    return existing.groupBy(key).agg(F.count(F.lit(1)).alias("taken"))


def day_registration_quota(
    t: Mapping[str, DataFrame], new: DataFrame, existing: DataFrame | None = None, **tuning
) -> DataFrame:
    """Day registrations in id order against the booked heads; cancelled registrations count."""
    key = "ReservationDayID"
    limits = t["ConferenceReservationDays"].select(key, heads().alias("Limit"))
    taken = None if existing is None else _counted(existing, key)
    rows = admit(new, _remaining(limits, taken, key), key, "ConferenceRegistrationID", F.lit(1), **tuning)
    return _answer(rows, key, CODE_QUOTA, TEXT_DAY_QUOTA)


def workshop_registration_quota(
    t: Mapping[str, DataFrame], new: DataFrame, existing: DataFrame | None = None, **tuning
) -> DataFrame:
    """Workshop registrations in id order against the booked quantity; cancelled ones count."""
    key = "WorkshopsReservationID"
    limits = t["WorkshopsReservations"].select(F.col("ReservationID").alias(key), F.col("Quantity").alias("Limit"))
    taken = None if existing is None else _counted(existing, key)
    rows = admit(new, _remaining(limits, taken, key), key, "WorkshopRegistrationID", F.lit(1), **tuning)
    return _answer(rows, key, CODE_QUOTA, TEXT_WORKSHOP_QUOTA)
