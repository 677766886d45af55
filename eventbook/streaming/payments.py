"""Payments applied as they arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from eventbook.operators.lifecycle import apply_payment_counts, payment_counts
from eventbook.streaming.levels import sums_of
from eventbook.streaming.sinks import run_to_end


def stream_payments(payments: DataFrame, t: Mapping[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Run a stream of payments to its end: clients with new counters, reservations with ``Paid`` set.

    Every batch is counted per reservation on its own, so no state is kept for reservations ever paid,
    and a task sends one partial count for a much-paid one.  The batches' counts are added in a table of levels;
    clients and paid marks follow from them by joins with the stored tables.
    """
    counts = sums_of(t["Clients"].sparkSession, f"{folder}/counts", "ReservationDayID", "times")
    writer = payments.writeStream.foreachBatch(lambda df, batch_id: counts.add(payment_counts(df), batch_id))
    run_to_end(writer, f"{folder}/checkpoint")
    return apply_payment_counts(t, counts.read())
