"""Occupancy of conference days and workshops kept up to date from arriving bookings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.operators.capacity import day_occupancy, workshop_occupancy
from eventbook.streaming.levels import newest_of
from eventbook.streaming.sinks import run_to_end


def _stream_taken(
    stream: DataFrame, occupancy: Callable[[DataFrame], DataFrame], key: str, limits: DataFrame, folder: str
) -> DataFrame:
    table = newest_of(limits.sparkSession, f"{folder}/taken", key, "taken")

    def upsert(changed: DataFrame, batch_id: int) -> None:
        table.add(changed.withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    run_to_end(occupancy(stream).writeStream.outputMode("update").foreachBatch(upsert), f"{folder}/checkpoint")
    limit, used = F.col("Limit").cast("long"), F.coalesce(F.col("taken"), F.lit(0))
    return limits.join(table.read(), key, "left").select(key, used.alias("taken"), (limit - used).alias("free_places"))


def stream_occupancy(reservations: DataFrame, limits: DataFrame, folder: str) -> DataFrame:
    """Run a stream of day reservations to its end: ``(ConferenceDayID, taken, free_places)``.

    The sums per day are the state of the stream, one number per day; a task sends one partial sum per day and batch.
    A batch gives out the days it has changed, which replace what earlier batches gave out.
    """
    return _stream_taken(reservations, day_occupancy, "ConferenceDayID", limits, folder)


def stream_workshop_occupancy(bookings: DataFrame, limits: DataFrame, folder: str) -> DataFrame:
    """The same for a stream of workshop bookings: ``(WorkshopID, taken, free_places)``."""
    return _stream_taken(bookings, workshop_occupancy, "WorkshopID", limits, folder)
