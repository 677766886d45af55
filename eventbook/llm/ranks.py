"""Numbers within a key without sorting or gathering the rows of a key.

A task numbers its own rows of each key as it writes them; a sum over the tasks, one row for each task
and key, gives every task the number at which its rows of a key begin.  The rows are written before
they are numbered further, so a task that runs again cannot change a number that was used.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventbook.session import cut_lineage

NUMBERED = "task_ long, nth_ long"


def number_in_task(keys: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """Running number of each row among the rows of its key in this task."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(keys)])
    begun = np.array([seen[int(k)] for k in ordered[starts]], np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(starts - begun, sizes)
    for k, n in zip(ordered[starts], sizes, strict=True):
        seen[int(k)] += int(n)
    return out


def numbering(inner: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], key: str):
    """A task that adds its own number and the running number within ``key`` to what ``inner`` yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in inner(batches):
            nth = number_in_task(batch.column(key).to_numpy(zero_copy_only=False), seen)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(nth), task)), pa.array(nth)],
                names=[*batch.schema.names, "task_", "nth_"],
            )

    return run


def ranked(df: DataFrame, inner, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``inner`` over ``df`` with ``rank_`` from 0 within the integer ``key``, and rows per key."""
    written = cut_lineage(df.mapInArrow(numbering(inner, key), f"{schema}, {NUMBERED}"))
    parts = written.groupBy(key, "task_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy(key).orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut_lineage(parts.withColumn("begin_", F.coalesce(F.sum("n_").over(before), F.lit(0))))
    rows = written.join(begins.drop("n_"), [key, "task_"]).withColumn("rank_", F.col("begin_") + F.col("nth_"))
    return rows.drop("begin_"), begins.groupBy(key).agg(F.sum("n_").alias("n_"))
