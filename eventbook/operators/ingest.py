"""Bulk append: defaults, ids, every rule of the table, then accepted and rejected rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.operators.admission import (
    admit_day_reservations,
    admit_workshop_reservations,
    day_registration_quota,
)
from eventbook.operators.constraints import row_rules
from eventbook.operators.identity import assign_ids, with_defaults
from eventbook.operators.lifecycle import apply_payments
from eventbook.operators.registrations import admit_workshop_registrations
from eventbook.operators.schedule import validate_conference_days
from eventbook.schema import TABLES
from eventbook.session import cut_lineage

# Head counts and quantities below zero would give places back on admission.
_NOT_NEGATIVE = {
    "ConferenceReservationDays": ("NormalParticipantQuantity", "StudentParticipantQuantity"),
    "WorkshopsReservations": ("Quantity",),
}


@dataclass(frozen=True)
class Ingested:
    """``checked`` has every input row once, with ``rule``, ``code`` and ``message`` (NULL = accepted).

    ``changed`` holds new versions of other tables that the accepted rows change: payments mark their
    reservation as paid and raise their client's counter.
    """

    checked: DataFrame
    changed: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def accepted(self) -> DataFrame:
        return self.checked.filter(F.col("rule").isNull()).drop("rule", "code", "message")

    @property
    def rejected(self) -> DataFrame:
        return self.checked.filter(F.col("rule").isNotNull())


def row_checked(rows: DataFrame, table: str) -> DataFrame:
    """First broken row rule, in one projection."""
    rules = row_rules(table, rows.columns)
    rules += [
        (f"QTY {table}.{name}", F.col(name) < 0, f"{name} must not be negative")
        for name in _NOT_NEGATIVE.get(table, ())
    ]
    hits = [
        F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(text).alias("message")))
        for rule, broken, text in rules
    ]
    return rows.withColumn("_hit", F.coalesce(*hits)).select(
        *rows.columns, F.col("_hit.rule").alias("rule"), F.col("_hit.message").alias("message")
    )


def references_checked(rows: DataFrame, table: str, t: Mapping[str, DataFrame]) -> DataFrame:
    columns = rows.columns
    for fk in TABLES[table].foreign_keys:
        # A parent key may occur twice; every feed row stays one row.
        parents = t[fk.parent].select(F.col(fk.parent_key).alias("_parent")).distinct()
        missing = F.col("rule").isNull() & F.col(fk.column).isNotNull() & F.col("_parent").isNull()
        rows = (
            rows.join(parents, F.col(fk.column) == F.col("_parent"), "left")
            .withColumn("_missing", missing)
            .withColumn("rule", F.when(F.col("_missing"), F.lit(fk.rule(table))).otherwise(F.col("rule")))
            .withColumn(
                "message",
                F.when(
                    F.col("_missing"),
                    F.concat(F.lit(f"no {fk.parent} row "), F.col(fk.column).cast("string")),
                ).otherwise(F.col("message")),
            )
            .select(*columns)
        )
    return rows


def _keys_checked(rows: DataFrame, existing: DataFrame, table: str) -> DataFrame:
    """For feeds that bring ids: an id used twice or already present is refused."""
    key = TABLES[table].key
    columns = rows.columns
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_times"))
    present = existing.select(key).distinct().withColumn("_present", F.lit(True))
    taken = F.col("rule").isNull() & ((F.col("_times") > 1) | F.col("_present").isNotNull())
    return (
        rows.join(counts, key, "left")
        .join(present, key, "left")
        .withColumn("rule", F.when(taken, F.lit(f"PK {table}.{key}")).otherwise(F.col("rule")))
        .withColumn("message", F.when(F.col("rule").startswith("PK "), F.lit("key is taken")).otherwise(F.col("message")))
        .select(*columns)
    )


def _triggers(table: str, t: Mapping[str, DataFrame], rows: DataFrame, existing: DataFrame, scope: str) -> DataFrame:
    if table == "ConferenceDays":
        return validate_conference_days(t, rows, existing, scope).withColumn("trigger", F.lit("TRG-8"))
    if table == "WorkshopRegistration":
        return admit_workshop_registrations(t, rows, existing)
    admitters = {
        "ConferenceReservationDays": ("TRG-5", admit_day_reservations),
        "WorkshopsReservations": ("TRG-4", admit_workshop_reservations),
        "ConferenceDayRegistration": ("TRG-6", day_registration_quota),
    }
    if table not in admitters:
        return rows.withColumn("code", F.lit(None).cast("int")).withColumn("trigger", F.lit(None).cast("string"))
    trigger, admitter = admitters[table]
    return admitter(t, rows, existing, stored=True).drop("admitted").withColumn("trigger", F.lit(trigger))


def ingest(
    t: Mapping[str, DataFrame],
    table: str,
    new: DataFrame,
    order_by: list[str] | None = None,
    start_counter: int | None = None,
    scope: str = "global",
) -> Ingested:
    """Check ``new`` rows for ``table`` against the tables ``t`` and number them.

    Feeds normally come without ids and are numbered in ``order_by`` order; ids a feed brings are
    kept and must be new.  Rows that break a row rule or a reference use up no capacity.  The
    checked rows are written once to the shared folder, so the passes of the capacity rules and the
    caller's reads of both outcomes do not repeat the feed's own plan.

    The default service counter breaks its own value rule; ``start_counter`` sets another default.
    """
    spec = TABLES[table]
    overrides = {} if start_counter is None else {"ServiceCounter": start_counter}
    keyed = spec.key in new.columns
    if not keyed and not order_by:
        raise ValueError("order_by is needed to number rows")
    # Columns a feed is ordered by travel along until the ids are given.
    order = {} if keyed else {f"_order_{i}": F.col(c) for i, c in enumerate(order_by)}
    typed = with_defaults(new.withColumns(order), table, overrides, keep=tuple(order))
    rows = references_checked(row_checked(typed, table), table, t)
    if keyed:
        rows = cut_lineage(_keys_checked(rows, t[table], table))
    else:
        rows = assign_ids(rows, t[table], spec.key, list(order)).drop(*order)
    clean = rows.filter(F.col("rule").isNull()).drop("rule", "message")
    broken = rows.filter(F.col("rule").isNotNull()).withColumn("code", F.lit(None).cast("int"))
    outcome = _triggers(table, t, clean, t[table], scope)
    if "message" not in outcome.columns:
        outcome = outcome.withColumn("message", F.lit(None).cast("string"))
    outcome = outcome.withColumn("rule", F.when(F.col("code").isNotNull(), F.col("trigger"))).drop("trigger")
    columns = [*[c for c in rows.columns if c not in ("rule", "message")], "rule", "code", "message"]
    result = Ingested(outcome.select(*columns).unionByName(broken.select(*columns)))
    if table == "Payments":
        result.changed.update(apply_payments(t, result.accepted))
    return result
