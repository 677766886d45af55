import random

import pytest
from pyspark.sql import functions as F

from eventbook.operators import event_log
from eventbook.operators.event_log import admit_log


def by_hand(rows, ends, free):
    """(id, admitted) event by event; rows: id, key, at, q; ends: id, at."""
    events = sorted([(at, 0, i, k, q) for i, k, at, q in rows if q is not None and at is not None] + [(at, 1, i, None, 0) for i, at in ends])
    left, standing, out = dict(free), {}, {i: True for i, _, _, _ in rows}
    for _, kind, i, k, q in events:
        if kind == 0 and k in left:
            out[i] = q <= left[k]
            if out[i]:
                left[k] -= q
                standing[i] = (k, q)
        elif kind == 1 and i in standing:
            k, q = standing.pop(i)
            left[k] += q
    return sorted(out.items())


def answer(spark, rows, ends, free, **tuning):
    r = spark.createDataFrame(rows, "id long, key long, moment long, q long")
    e = spark.createDataFrame(ends, "id long, moment long")
    f = spark.createDataFrame(sorted(free.items()), "key long, free long")
    return sorted((x["id"], x["admitted"]) for x in admit_log(r, e, f, "key", "id", "moment", F.col("q"), **tuning).collect())


def log(rng, key, rows, first, ends_share=0.5, most=4):
    moments = rng.sample(range(10 * rows), rows)
    out = [(first + n, key, at, rng.randrange(most)) for n, at in enumerate(moments)]
    ends = [(i, rng.randrange(10 * rows)) for i, *_ in out if rng.random() < ends_share]
    return out, ends + [(i, at + 3) for i, at in ends if rng.random() < 0.2]


def test_ten_thousand_random_logs(spark):
    rng, rows, ends, free = random.Random(1), [], [], {}
    for key in range(10_000):
        r, e = log(rng, key, rng.randrange(1, 9), 100 * key)
        rows += r
        ends += e
        free[key] = rng.randrange(-1, 8)
    assert answer(spark, rows, ends, free) == by_hand(rows, ends, free)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_hot_key_in_many_segments(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows, ends = log(rng, 1, 1200, 0, rng.choice([0.1, 0.5, 0.9]), rng.choice([2, 4, 9]))
    more, more_ends = log(rng, 2, 300, 5000)
    turns = []
    replayed = event_log._replayed
    monkeypatch.setattr(event_log, "_replayed", lambda *a: turns.append(1) or replayed(*a))
    free = {1: rng.choice([3, 40, 300]), 2: 5}
    assert answer(spark, rows + more, ends + more_ends, free, segment=64) == by_hand(rows + more, ends + more_ends, free)
    # Some thirty segments of the hot key, few of which are as large as its limit: still fewer turns.
    assert len(turns) <= 18


def test_odd_events(spark):
    rows = [(1, 1, 10, 3), (2, 1, 20, 3), (3, 1, 30, 3), (4, 1, 40, None), (5, 1, None, 2), (6, None, 50, 9), (7, 9, 55, 99), (8, 1, 60, 3), (9, 1, 70, 0), (10, 2, 1, 0), (11, 2, 2, 0)]
    # Before its row, of a refused row, at the same moment, twice, of an unknown row.
    ends = [(1, 5), (3, 35), (1, 10), (1, 45), (2, 20), (77, 3), (None, 4), (8, None)]
    free = {1: 5, 2: -1}
    assert answer(spark, rows, ends, free) == by_hand(rows, [e for e in ends if None not in e], free)
    assert answer(spark, rows, [], free) == by_hand(rows, [], free)
    assert answer(spark, [], ends, free) == []


def test_a_cancellation_lets_a_later_row_in(spark):
    rows = [(1, 1, 1, 4), (2, 1, 2, 4), (3, 1, 4, 4)]
    assert answer(spark, rows, [(1, 3)], {1: 5}) == [(1, True), (2, False), (3, True)]


def test_negative_quantities_are_an_error(spark):
    with pytest.raises(Exception, match="negative quantity"):
        answer(spark, [(1, 1, 1, -4)], [], {1: 5})
