"""Dense ids for bulk loads and defaults for columns a feed leaves out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventbook.schema import NO_DEFAULT, TABLES
from eventbook.session import cut_lineage

_PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition number above this bit


def assign_ids(new: DataFrame, existing: DataFrame | None, id_col: str, order_by: list[str]) -> DataFrame:
    """``new`` with ids following the highest existing one, dense and in ``order_by`` order.

    Rows are range-partitioned and sorted; a row's id is the number of rows in the partitions
    before its own plus its position.  The rows are written first with a number of their own, which
    orders equal rows: they are interchangeable, and a third of all rows may be equal.  The numbered
    rows are written to the shared folder before partitions are counted: a range partitioning is
    drawn from a sample, so it must not be evaluated a second time.
    """
    highest = None if existing is None else existing.agg(F.max(id_col)).first()[0]
    rows = cut_lineage(new.withColumn("_nth", F.monotonically_increasing_id()))
    # Rows that tie are ordered by their content, equal ones by their number.
    order = [*order_by, F.xxhash64(*new.columns), "_nth"]
    placed = cut_lineage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .select(
            *new.columns,
            F.shiftright("_place", _PARTITION_SHIFT).cast("int").alias("_part"),
            F.col("_place").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1)).alias("_pos"),
        )
    )
    # One row per partition, so this window and the broadcast are bounded by the partition count.
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    )
    first = F.lit((highest or 0) + 1).cast("long")
    return placed.join(F.broadcast(starts), "_part").select(
        (first + F.col("_start") + F.col("_pos")).alias(id_col), *new.columns
    )


def with_defaults(
    new: DataFrame, table: str, overrides: Mapping[str, object] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Typed columns of ``table`` in order; absent ones get their default, else NULL.

    A NULL that the feed states stays NULL.  An absent id column stays absent.  ``keep`` names
    further feed columns to carry along.
    """
    spec = TABLES[table]
    values = dict(overrides or {})
    out = []
    for col in spec.columns:
        if col.name in new.columns:
            out.append(F.col(col.name).cast(col.type).alias(col.name))
        elif col.name == spec.key:
            continue
        else:
            value = values.get(col.name, None if col.default is NO_DEFAULT else col.default)
            out.append(F.lit(value).cast(col.type).alias(col.name))
    return new.select(*out, *keep)
