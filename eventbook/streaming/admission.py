"""Capacity admission over a stream of bookings.

A keyed state function would see all new rows of a key in one task.  Here every micro-batch goes
through the batch operator, which splits large keys, and what carries over between batches is one
number per key: the places used so far.  A batch writes those of its own keys only, as additions to a table
of levels, and reads the places of its own keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventbook.functions.scalar import live
from eventbook.operators.admission import admit
from eventbook.operators.capacity import heads
from eventbook.streaming.levels import sums_of
from eventbook.streaming.sinks import batch_folder, read_batches, run_to_end, write_batch


def _stream_admission(
    stream: DataFrame, limits: DataFrame, key: str, row_id: str, asked: Callable[[], Column], folder: str
) -> DataFrame:
    spark: SparkSession = limits.sparkSession
    landed, decided = f"{folder}/landed", f"{folder}/decided"
    used = sums_of(spark, f"{folder}/used", key, "used")

    def take(batch: DataFrame, batch_id: int) -> None:
        # The operator reads its rows several times: read them back from the landed copy, in the
        # outer session, where adaptive execution may split hot keys.
        write_batch(batch, landed, batch_id)
        rows = spark.read.schema(batch.schema).parquet(batch_folder(landed, batch_id))
        asked_for = rows.select(key).distinct()
        places = limits.select(key, F.col("Limit").cast("long").alias("free")).join(asked_for, key, "left_semi")
        before = used.read(batch_id - 1).join(asked_for, key, "left_semi")
        places = places.join(before, key, "left").select(key, (F.col("free") - F.coalesce(F.col("used"), F.lit(0))).alias("free"))
        write_batch(admit(rows, places, key, row_id, asked(), stored=True), decided, batch_id)
        answered = spark.read.schema(decided_schema).parquet(batch_folder(decided, batch_id))
        took = answered.filter("admitted").select(F.col(key).cast("long").alias(key), asked().cast("long").alias("used"))
        used.add(took.groupBy(key).agg(F.sum("used").alias("used")).filter("used > 0"), batch_id)

    decided_schema = T.StructType([*stream.schema.fields, T.StructField("admitted", T.BooleanType())])
    run_to_end(stream.writeStream.foreachBatch(take), f"{folder}/checkpoint")
    return read_batches(spark, decided, decided_schema)


def stream_day_admission(stream: DataFrame, limits: DataFrame, folder: str) -> DataFrame:
    """Day reservations with ``admitted`` and ``batch_id``; batches in arrival order, ids within them."""
    return _stream_admission(
        stream,
        limits,
        "ConferenceDayID",
        "ReservationDayID",
        lambda: F.when(live(F.col("Canceled")), heads()).otherwise(F.lit(0)),
        folder,
    )


def stream_workshop_admission(stream: DataFrame, limits: DataFrame, folder: str) -> DataFrame:
    """Workshop bookings with ``admitted`` and ``batch_id``; cancelled rows always pass."""
    return _stream_admission(
        stream,
        limits,
        "WorkshopID",
        "ReservationID",
        lambda: F.when(live(F.col("Canceled")), F.col("Quantity")),
        folder,
    )
