"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventbook.session import cut_lineage

#: White space between words: space and the characters 9 to 13.  Fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one step of a Python task holds at a time (one longer text is a step alone).
STEP_BYTES = 4 << 20
#: Partition numbers of ``monotonically_increasing_id`` stand above these bits.
SHIFT = 33


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was started from."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 1 modulo 3."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 3 == 1


def portion(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone; for bounded samples."""
    return (F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(""))).bitwiseAND((1 << 40) - 1)) / float(1 << 40)


def steps(batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a step holds at most ``limit`` bytes of the text column and ``rows`` rows, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > limit or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def numbered(rows: DataFrame, order: list[Column], kept: list[str]) -> DataFrame:
    """``kept`` with ``place_`` (from 0) of each row in the order of the whole table; a range
    partitioning and offsets, so that no task sorts more than its range."""
    rows = cut_lineage(rows.withColumn("nth_", F.monotonically_increasing_id()))
    order = [*order, F.col("nth_")]
    kept_ = [F.col(f"`{c}`") for c in kept]
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept_, F.monotonically_increasing_id().alias("in_part_")))
    part = F.shiftright("in_part_", SHIFT)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition.
    starts = placed.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    starts = starts.select("part_", (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.shiftleft("part_", SHIFT)).alias("start_"))
    return placed.withColumn("part_", part).join(starts, "part_").select(*kept_, (F.col("in_part_") + F.col("start_")).alias("place_"))
