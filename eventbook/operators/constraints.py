"""Constraint checks over whole tables: value rules, required columns, lengths, keys, references.

Every check returns ``(table_name, rule, key, message)``, one row per broken rule and row (per key
value for duplicate keys).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventbook.operators.key_bitmaps import missing_references, repeated_keys
from eventbook.schema import TABLES


def _shape(table: str, rule: Column, key: Column, message: Column) -> list[Column]:
    return [
        F.lit(table).alias("table_name"),
        rule.alias("rule"),
        key.cast("long").alias("key"),
        message.alias("message"),
    ]


def row_rules(
    table: str, columns: list[str], kinds: tuple[str, ...] = ("NN", "LEN", "CHK")
) -> list[tuple[str, Column, str]]:
    """``(rule, broken, text)`` for the rules that need only the row itself."""
    spec = TABLES[table]
    rules: list[tuple[str, Column, str]] = []
    present = [c for c in spec.columns if c.name in columns]
    if "NN" in kinds:
        rules += [
            (f"NN {table}.{c.name}", F.col(c.name).isNull(), f"{c.name} is required")
            for c in present
            if c.required
        ]
    if "LEN" in kinds:
        rules += [
            (f"LEN {table}.{c.name}", F.length(c.name) > c.length, f"{c.name} is longer than {c.length}")
            for c in present
            if c.length
        ]
    if "CHK" in kinds:
        rules += [(check.rule, check.broken(), check.text) for check in spec.checks]
    return rules


def row_violations(df: DataFrame, table: str, kinds: tuple[str, ...] = ("NN", "LEN", "CHK")) -> DataFrame:
    """All broken row rules in one pass; clean rows leave at a plain filter."""
    rules = row_rules(table, df.columns, kinds)
    suspect = reduce(Column.__or__, [F.coalesce(broken, F.lit(False)) for _, broken, _ in rules])
    hits = [
        F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(text).alias("message")))
        for rule, broken, text in rules
    ]
    return (
        df.filter(suspect)
        .select(F.col(TABLES[table].key).alias("key"), F.explode(F.array_compact(F.array(*hits))).alias("hit"))
        .select(*_shape(table, F.col("hit.rule"), F.col("key"), F.col("hit.message")))
    )


def key_violations(df: DataFrame, table: str, bitmaps: bool = False) -> DataFrame:
    """Key values that occur more than once; with ``bitmaps`` only rows of suspect words of keys move."""
    key = TABLES[table].key
    if bitmaps:
        found = repeated_keys(df, key).withColumnRenamed("key", key)
    else:
        found = df.groupBy(key).agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1)
    return found.select(
        *_shape(
            table,
            F.lit(f"PK {table}.{key}"),
            F.col(key),
            F.concat(F.lit("key occurs "), F.col("times").cast("string"), F.lit(" times")),
        )
    )


def reference_violations(df: DataFrame, table: str, t: Mapping[str, DataFrame], bitmaps: bool = False) -> DataFrame:
    """Rows whose reference names no parent row; an empty reference passes.

    One reference is an anti join.  A table with two of them is read once: each parent is a left join
    on its key, and the rows that found none are listed at the end.  With ``bitmaps`` the rows stay where
    they are and meet bitmaps of the parents' keys, which are made by jobs of their own.
    """
    spec = TABLES[table]
    if bitmaps:
        return missing_references(df, table, t).select(*_shape(table, F.col("rule"), F.col("key"), F.col("message")))
    names = [f"ref_{i}" for i in range(len(spec.foreign_keys))]
    rows = df.select(
        F.col(spec.key).alias("key"), *[F.col(fk.column).alias(name) for fk, name in zip(spec.foreign_keys, names)]
    )
    hits = []
    for fk, name in zip(spec.foreign_keys, names):
        # A parent key may occur twice; it must not multiply the rows that name it.
        parents = t[fk.parent].select(F.col(fk.parent_key).alias(f"{name}_parent")).distinct()
        same = F.col(name) == F.col(f"{name}_parent")
        message = F.concat(F.lit(f"no {fk.parent} row "), F.col(name).cast("string"))
        hit = F.struct(F.lit(fk.rule(table)).alias("rule"), message.alias("message"))
        if len(names) == 1:
            rows = rows.filter(F.col(name).isNotNull()).join(parents, same, "left_anti")
            hits.append(hit)
        else:
            rows = rows.join(parents, same, "left")
            hits.append(F.when(F.col(name).isNotNull() & F.col(f"{name}_parent").isNull(), hit))
    return rows.select("key", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(
        *_shape(table, F.col("hit.rule"), F.col("key"), F.col("hit.message"))
    )


def violations(
    t: Mapping[str, DataFrame],
    kinds: tuple[str, ...] = ("NN", "LEN", "CHK", "PK", "FK"),
    tables: tuple[str, ...] = tuple(TABLES),
    parents: Mapping[str, DataFrame] | None = None,
    bitmaps: bool = False,
) -> DataFrame:
    """Every broken rule of the chosen kinds over the chosen tables of ``t``.

    References are looked up in ``parents`` where given, else in ``t`` itself.  ``bitmaps`` checks keys and
    references by bitmaps of keys (see ``key_bitmaps``).
    """
    parts = []
    for table in tables:
        if row_rules(table, t[table].columns, kinds):
            parts.append(row_violations(t[table], table, kinds))
        if "PK" in kinds:
            parts.append(key_violations(t[table], table, bitmaps))
        if "FK" in kinds and TABLES[table].foreign_keys:
            parts.append(reference_violations(t[table], table, t if parents is None else parents, bitmaps))
    return reduce(DataFrame.unionByName, parts)
