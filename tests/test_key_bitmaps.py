"""Key checks by bitmaps against plain sets of keys."""

from collections import Counter

import pytest
from fixture import rows
from pyspark.sql import functions as F
from test_plans import physical

from eventbook.operators.constraints import key_violations, reference_violations
from eventbook.operators.key_bitmaps import KeyBitmaps, missing_references, repeated_keys
from eventbook.session import cut_lineage

KEYS = [-40_000, -32_768, -65, -64, -1, 0, 1, 62, 63, 64, 32_767, 32_768, 10**12, 2**63 - 1, -(2**63), 64, None]
ASKED = sorted({k + d for k in KEYS if k is not None for d in (-1, 0, 1) if -(2**63) <= k + d < 2**63})


@pytest.mark.parametrize("max_blocks", (100, 2))
def test_marks_are_exact(spark, max_blocks):
    parent = spark.createDataFrame([(k,) for k in KEYS], "id long")
    asked = spark.createDataFrame([(k,) for k in [*ASKED, None]], "ref long")
    keys = KeyBitmaps(parent, "id", max_blocks)
    assert keys.sent == (max_blocks == 100)
    got = {(r.ref, r.has) for r in keys.mark(asked, "ref", "has").collect()}
    assert got == {(k, k in KEYS) for k in ASKED} | {(None, False)}


def test_full_and_partly_filled_blocks(spark):
    parent = spark.range(0, 100_000).filter("id < 65536 or id % 7 = 0")
    keys = KeyBitmaps(parent, "id")
    wrong = keys.mark(spark.range(-10, 140_000), "id", "has").filter(
        F.col("has") != F.expr("id between 0 and 99999 and (id < 65536 or id % 7 = 0)")
    )
    assert wrong.count() == 0


def test_empty_parent_and_empty_child(spark):
    none = spark.createDataFrame([], "id long")
    assert rows(KeyBitmaps(none, "id").mark(spark.range(2), "id", "has")) == [(0, False), (1, False)]
    assert rows(KeyBitmaps(spark.range(2), "id").mark(none, "id", "has")) == []
    assert rows(repeated_keys(none, "id")) == []


@pytest.mark.parametrize("max_suspects", (1_000, 0))
def test_repeated_keys(spark, max_suspects):
    values = [None, None, 5, 5, 5, 6, -1, -1, 63, 64, 10**14, 10**14, *[7] * 500]
    df = spark.createDataFrame([(k,) for k in values], "id long").repartition(5)
    got = {(r.key, r.times) for r in repeated_keys(df, "id", max_suspects).collect()}
    assert got == {(k, n) for k, n in Counter(values).items() if n > 1}


def _child(spark):
    """A third of all bookings name one reservation; some references are empty or name no row."""
    ref = F.expr("case when id % 3 = 0 then 4 when id % 50 = 1 then null else id end")
    return cut_lineage(
        spark.range(2_000).select(
            F.col("id").alias("ReservationID"), F.expr("id % 11").alias("WorkshopID"), ref.alias("ReservationDayID")
        )
    )


def _parents(spark):
    twice = spark.range(1_500).union(spark.range(10))
    return {
        "Workshops": spark.range(10).withColumnRenamed("id", "WorkshopID"),
        "ConferenceReservationDays": twice.withColumnRenamed("id", "ReservationDayID"),
    }


def test_references_as_by_joins_and_child_stays(spark):
    child, parents = _child(spark), _parents(spark)
    want = rows(reference_violations(child, "WorkshopsReservations", parents))
    by_bitmaps = reference_violations(child, "WorkshopsReservations", parents, bitmaps=True)
    assert len(want) > 400 and rows(by_bitmaps) == want
    plan = physical(by_bitmaps)
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    beyond = missing_references(child, "WorkshopsReservations", parents, max_blocks=0)
    assert rows(beyond) == [(key, rule, message) for key, rule, message in rows(by_bitmaps, "key", "rule", "message")]


def test_keys_as_by_grouping(spark):
    df = _child(spark).withColumn("ReservationID", F.expr("ReservationID div 2 * 3"))
    want = rows(key_violations(df, "WorkshopsReservations"))
    assert len(want) == 1_000 and rows(key_violations(df, "WorkshopsReservations", bitmaps=True)) == want
