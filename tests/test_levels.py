import random

import pytest
from fixture import rows

from eventbook.session import run_folder
from eventbook.streaming.levels import newest_of, sums_of


def add(spark, table, rng, batch, total):
    changed = {rng.randrange(5): rng.randrange(1, 9) for _ in range(3)}
    for key, n in changed.items():
        total[key] = total.get(key, 0) + n
    table.add(spark.createDataFrame(sorted(changed.items()), "k long, n long").coalesce(1), batch)


def test_many_batches_few_runs(spark):
    rng, total = random.Random(1), {}
    table = sums_of(spark, run_folder(spark, "levels"), "k", "n")
    assert table.last_batch() == -1 and rows(table.read()) == []
    for batch in range(100):
        add(spark, table, rng, batch, total)
        assert len(table.runs()) == sum(int(d) for d in oct(batch + 1)[2:])
    assert rows(table.read()) == sorted(total.items())
    # 100 = 1 * 64 + 4 * 8 + 4: nine runs, few files.
    assert len(table.runs()) == 9 and len(table.read().inputFiles()) <= 40
    # Inputs of merges go with the next merge of their level.
    assert len(table.store.names(f"{table.folder}/level=0")) <= 2 * table.fan


@pytest.mark.parametrize("lost", ["merge", "batch"])
def test_a_batch_that_failed_is_repeated(spark, lost):
    rng, total = random.Random(2), {}
    table = sums_of(spark, run_folder(spark, "levels"), "k", "n")
    for batch in range(7):
        add(spark, table, rng, batch, total)
    before = dict(total)
    state = rng.getstate()
    add(spark, table, rng, 7, total)
    if lost == "merge":  # the batch was written, its merge was not: readers use the runs themselves
        table.store.delete(f"{table.folder}/level=1/last=7/_SUCCESS")
        assert len(table.runs()) == 8 and rows(table.read()) == sorted(total.items())
    else:
        table.store.delete(f"{table.folder}/level=0/last=7/_SUCCESS")
        assert rows(table.read()) == sorted(before.items())
    rng.setstate(state)
    add(spark, table, rng, 7, dict(before))
    assert len(table.runs()) == 1 and rows(table.read()) == sorted(total.items())
    assert rows(table.read(6)) == sorted(before.items())


def test_newest_counts(spark):
    table = newest_of(spark, run_folder(spark, "levels"), "k", "n")
    for batch in range(20):
        df = spark.createDataFrame([(batch % 3, 100 - batch, batch), (7, batch, batch)], "k long, n long, batch long")
        table.add(df, batch)
    assert rows(table.read(), "k", "n") == [(0, 82), (1, 81), (2, 83), (7, 19)]


def test_a_missing_run_is_an_error(spark):
    table = sums_of(spark, run_folder(spark, "levels"), "k", "n")
    for batch in range(3):
        table.add(spark.createDataFrame([(1, 1)], "k long, n long"), batch)
    table.store.delete(f"{table.folder}/level=0/last=1")
    with pytest.raises(FileNotFoundError):
        table.read()
