"""Updates of stored partitions: same rows as the full update, and no other files."""

import datetime as dt
import threading
from pathlib import Path

import pytest
from fixture import booking, moment, reservation, rows, tables
from pyspark.sql import functions as F

from eventbook.operators import stored_updates
from eventbook.operators.lifecycle import cancel_reservations, refresh_overdue
from eventbook.operators.stored_updates import PARTITIONS, cancel_stored, refresh_overdue_stored, store_tables
from eventbook.plans import catalog
from eventbook.session import run_folder, side_by_side, unsorted_writes
from eventbook.sources import adapter

MONTHS = ("2020-01", "2020-02", "2020-03", "2020-04")


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(stored_updates, "RANGE", 25)


@pytest.fixture
def t(spark, small_ranges):
    """A hundred reservations over four months, a third of all bookings on one of them, one row without a flag."""
    reservations = [
        reservation(k, 11, 1, Date=moment(f"{MONTHS[k // 25]}-15 10:00:00"), Canceled=None if k == 7 else k % 10 == 0)
        for k in range(100)
    ]
    bookings = [booking(k, 1, 30 if k % 3 == 0 else k // 3, 1, canceled=None if k == 5 else False) for k in range(300)]
    seats = [
        {"ConferenceRegistrationID": k, "ReservationDayID": k, "ParticipantID": 1, "Canceled": False} for k in range(100)
    ]
    shops = [
        {"WorkshopRegistrationID": k, "ConferenceRegistrationID": 1, "WorkshopsReservationID": k, "Canceled": False}
        for k in range(300)
    ]
    return tables(
        spark,
        ConferenceReservationDays=reservations,
        WorkshopsReservations=bookings,
        ConferenceDayRegistration=seats,
        WorkshopRegistration=shops,
    )


def files(stored) -> dict[str, dict[str, set[str]]]:
    """File names by table and partition."""
    return {
        name: {folder.name.partition("=")[2]: {f.name for f in folder.glob("*.parquet")} for folder in Path(table.path).glob("part_=*")}
        for name, table in stored.items()
    }


def same(stored, want) -> None:
    for name in PARTITIONS:
        assert rows(stored[name].read()) == rows(want[name].select(*stored[name].read().columns)), name


def exchanged(before, after) -> dict[str, list[str]]:
    assert {name: set(parts) for name, parts in before.items()} == {name: set(parts) for name, parts in after.items()}
    return {name: sorted(p for p in parts if parts[p] != after[name][p]) for name, parts in before.items()}


def test_only_partitions_that_change_are_written(spark, t):
    stored = store_tables(spark, t, run_folder(spark, "stored"))
    same(stored, t)
    before, ids = files(stored), spark.createDataFrame([(7,), (7,), (51,), (60,), (4_000,), (None,)], "ReservationDayID long")
    changed = cancel_stored(stored, ids)
    # 60 is cancelled already and brings nothing along.
    assert changed["ConferenceReservationDays"] == ["2020-01", "2020-03"]
    assert changed["ConferenceDayRegistration"] == changed["WorkshopsReservations"] == ["0", "2"]
    # Bookings 22, 23 and 154, 155; every third one is on reservation 30.
    assert changed["WorkshopRegistration"] == ["0", "6"]
    assert exchanged(before, files(stored)) == changed
    same(stored, cancel_reservations(t, ids))


def test_repeated_update_and_empty_update_write_nothing(spark, t):
    stored = store_tables(spark, t, run_folder(spark, "stored"))
    ids = spark.createDataFrame([(30,)], "ReservationDayID long")
    for asked in (ids.limit(0), ids):
        before = files(stored)
        assert not any(cancel_stored(stored, asked).values())  # 30 is cancelled from the start
        assert files(stored) == before


def test_update_that_ended_early_is_repeated(spark, t):
    stored = store_tables(spark, t, run_folder(spark, "stored"))
    ids = spark.createDataFrame([(8,), (90,), (91,)], "ReservationDayID long")
    stored["WorkshopsReservations"].mark("Canceled", ids.filter("ReservationDayID <> 90"), "ReservationDayID")
    cancel_stored(stored, ids)
    same(stored, cancel_reservations(t, ids))


def test_overdue_months_only(spark, t):
    stored = store_tables(spark, t, run_folder(spark, "stored"))
    before, as_of = files(stored), dt.date(2020, 2, 14)
    changed = refresh_overdue_stored(stored, t["Clients"], as_of)
    assert changed["ConferenceReservationDays"] == ["2020-01"]
    assert exchanged(before, files(stored)) == changed
    same(stored, refresh_overdue(t, as_of))


def test_rows_without_date_or_reference(spark, small_ranges):
    t = tables(
        spark,
        ConferenceReservationDays=[reservation(1, 11, 1, Date=None), reservation(2, 11, 1)],
        WorkshopsReservations=[booking(1, 1, None, 1), booking(2, 1, 1, 1)],
        ConferenceDayRegistration=[],
        WorkshopRegistration=[],
    )
    stored = store_tables(spark, t, run_folder(spark, "stored"))
    ids = spark.createDataFrame([(1,)], "ReservationDayID long")
    changed = cancel_stored(stored, ids)
    assert changed["ConferenceReservationDays"] == ["none"] and changed["WorkshopsReservations"] == ["0"]
    assert changed["ConferenceDayRegistration"] == changed["WorkshopRegistration"] == []
    same(stored, cancel_reservations(t, ids))
    assert stored["WorkshopsReservations"].read().filter(F.col("ReservationDayID").isNull()).count() == 1


def test_sparse_ids_share_partitions(spark, small_ranges):
    """Ids of bookings that lie a range or more apart; one lies far from all others."""
    keys = [40 * k for k in range(1_500)] + [10**12, -7]
    shops = [
        {"WorkshopRegistrationID": k, "ConferenceRegistrationID": 1, "WorkshopsReservationID": key, "Canceled": False}
        for k, key in enumerate(keys)
    ]
    bookings = [booking(key, 1, k % 3, 1) for k, key in enumerate(keys)]
    t = tables(
        spark,
        ConferenceReservationDays=[reservation(k, 11, 1) for k in range(3)],
        WorkshopsReservations=bookings,
        ConferenceDayRegistration=[],
        WorkshopRegistration=shops,
    )
    stored = store_tables(spark, t, run_folder(spark, "stored"))
    before, ids = files(stored), spark.createDataFrame([(1,)], "ReservationDayID long")
    assert 64 < len(before["WorkshopRegistration"]) <= 256
    assert sum(len(names) for names in before["WorkshopRegistration"].values()) <= 300
    same(stored, t)
    assert exchanged(before, files(stored)) == {name: [] for name in PARTITIONS}
    assert cancel_stored(stored, ids)["WorkshopRegistration"] == exchanged(before, files(stored))["WorkshopRegistration"]
    same(stored, cancel_reservations(t, ids))


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_only_ids_are_written_beside(spark, t, monkeypatch, most):
    """Rows of exchanged partitions are written once, however many ids mark them."""
    beside, cut = [], stored_updates.cut_lineage
    monkeypatch.setattr(stored_updates, "MOST_SENT", most, raising=False)
    monkeypatch.setattr(stored_updates, "cut_lineage", lambda df: (beside.append(df.columns), cut(df))[1])
    stored = store_tables(spark, t, run_folder(spark, "stored"))
    before, ids = files(stored), spark.createDataFrame([(7,), (51,)], "ReservationDayID long")
    changed = cancel_stored(stored, ids)
    assert all(changed.values()) and exchanged(before, files(stored)) == changed
    assert beside and all(len(columns) == 1 for columns in beside), beside
    same(stored, cancel_reservations(t, ids))


@pytest.mark.parametrize(("most", "blocks", "moved"), [(0, 10, 0), (0, 0, 4)])
def test_rows_stay_where_they_are_read(spark, t, monkeypatch, most, blocks, moved):
    """Many ids are sent as bitmaps; only where they are too sparse for that, rows are brought together again."""
    stored = store_tables(spark, t, run_folder(spark, "stored"))
    monkeypatch.setattr(stored_updates, "MOST_SENT", most)
    monkeypatch.setattr(stored_updates, "MOST_BLOCKS", blocks, raising=False)
    together, tables_ = stored_updates.PartitionedTable._together, []
    monkeypatch.setattr(
        stored_updates.PartitionedTable, "_together", staticmethod(lambda new: (tables_.append(new.columns), together(new))[1])
    )
    before = files(stored)
    # Of the reservations only 51 is there and has not been cancelled; its three bookings have registrations.
    ids = spark.createDataFrame([(51,), (51,), (60,), (None,)], "ReservationDayID long")
    changed = cancel_stored(stored, ids)
    assert all(changed.values()) and exchanged(before, files(stored)) == changed
    assert len(tables_) == moved
    same(stored, cancel_reservations(t, ids))


def test_ids_of_no_row_are_left_out(spark, t, monkeypatch):
    """Far more ids than are sent, of which one has a row that is not marked yet."""
    stored = store_tables(spark, t, run_folder(spark, "stored"))
    monkeypatch.setattr(stored_updates, "MOST_SENT", 1)
    monkeypatch.setattr(stored_updates, "MOST_BLOCKS", 0, raising=False)
    monkeypatch.setattr(stored_updates.PartitionedTable, "_together", staticmethod(lambda new: pytest.fail("rows moved")))
    ids = spark.createDataFrame([(51,), (4_000,), (5_000_000,)], "ReservationDayID long")
    assert stored["ConferenceDayRegistration"].mark("Canceled", ids, "ReservationDayID") == ["2"]
    marked = stored["ConferenceDayRegistration"].read().filter("Canceled").select("ReservationDayID")
    assert [tuple(r) for r in marked.collect()] == [(51,)]


def test_bookings_in_tasks_are_the_bookings(spark, tmp_path, monkeypatch):
    lines = [(k % 7 if k % 5 else None, k % 3 if k % 4 else None, float(k), "RAN"[k % 3] if k % 6 else None) for k in range(200)]
    lines_ = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string")
    lines_.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(adapter, "TASK_LINES", 30, raising=False)
    model = adapter.SourceModel(spark, str(tmp_path))
    assert rows(model.bookings_in_tasks()) == rows(model.tables["WorkshopsReservations"])


def test_tasks_of_bookings_follow_each_other(spark, tmp_path, monkeypatch):
    """Grouped where one exchange has put them; a reservation of very many lines is spread, and stays in its range."""
    lines = [(40 if k % 2 else k, k % 50, 1.0, "R") for k in range(400)]
    lines_ = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string")
    lines_.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(adapter, "TASK_LINES", 30)
    monkeypatch.setattr(stored_updates, "RANGE", 25)
    model = adapter.SourceModel(spark, str(tmp_path))
    bookings = model.bookings_in_tasks()
    plan = bookings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning") == 1, plan
    spans = bookings.groupBy(F.spark_partition_id().alias("task")).agg(F.min("ReservationDayID"), F.max("ReservationDayID"))
    spans = [tuple(r)[1:] for r in spans.orderBy("task").collect()]
    assert len(spans) > 10 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)), spans
    monkeypatch.setattr(stored_updates.PartitionedTable, "_together", staticmethod(lambda new: pytest.fail("rows moved")))
    name = "WorkshopsReservations"
    stored = store_tables(spark, {name: bookings}, run_folder(spark, "stored"), [name], placed=[name])
    assert rows(stored[name].read()) == rows(model.tables[name])
    assert all(name.isdigit() for name in files(stored)[name])


def test_tables_are_changed_side_by_side(spark, t, monkeypatch):
    """All that follows the reservations at once, these last; after an error of one table they stay, and a repeated run ends the work."""
    stored = store_tables(spark, t, run_folder(spark, "stored"))
    ids = spark.createDataFrame([(7,), (51,)], "ReservationDayID long")
    mark, ended = stored_updates.PartitionedTable.mark, []
    together = threading.Barrier(3)

    def waiting(self, *args):
        if self.table != "ConferenceReservationDays":
            together.wait(120)
        parts = mark(self, *args)
        if self.table == broken:
            raise OSError("disk")
        ended.append(self.table)
        return parts

    monkeypatch.setattr(stored_updates.PartitionedTable, "mark", waiting)
    broken = "WorkshopsReservations"
    with pytest.raises(OSError, match="disk"):
        cancel_stored(stored, ids)
    assert sorted(ended) == ["ConferenceDayRegistration", "WorkshopRegistration"]
    broken = None
    cancel_stored(stored, ids)
    assert ended[-1] == "ConferenceReservationDays" and len(ended) == 6
    same(stored, cancel_reservations(t, ids))


def test_steps_side_by_side(spark):
    ended = []

    def failing():
        raise ValueError("first")

    with pytest.raises(ValueError, match="first"):
        side_by_side(spark, failing, lambda: ended.append(spark.range(10).count()))
    assert ended == [10]
    assert side_by_side(spark, lambda: 1, lambda: side_by_side(spark, lambda: 2, lambda: 3)) == [1, [2, 3]]


def test_unsorted_writes_leave_the_setting(spark, tmp_path):
    name, rows_ = "spark.sql.maxConcurrentOutputFileWriters", spark.range(100).withColumn("part", F.col("id") % 7)
    was = spark.conf.get(name, None)
    with pytest.raises(ValueError), unsorted_writes(spark, 3):
        rows_.write.partitionBy("part").parquet(f"{tmp_path}/rows")
        raise ValueError
    assert spark.conf.get(name, None) == was
    assert rows(spark.read.parquet(f"{tmp_path}/rows").select("id")) == [(k,) for k in range(100)]
    spark.conf.set(name, 5)
    with unsorted_writes(spark, 3):
        assert spark.conf.get(name) == "3"
    assert spark.conf.get(name) == "5"
    spark.conf.unset(name)


@pytest.mark.parametrize(("most", "blocks"), [(1_000_000, 4_096), (0, 4_096), (0, 0)])
def test_registrations_of_stored_bookings(spark, tmp_path, monkeypatch, most, blocks):
    """Bookings whose reservation nobody is registered for are left out before they move, where ids can be sent."""
    lines = [(k % 30 if k % 7 else None, k % 11 if k % 9 else None, 1.0, "RAN"[k % 3]) for k in range(300)]
    events = [(k if k % 8 else None, k % 5, "error" if k % 4 else "click") for k in range(60)]
    orders = [(k, 0, "OPF"[k % 3], 1.0, dt.datetime(1997, 1 + k % 9, 1)) for k in range(30)]
    for name, data, schema in (
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string"),
        ("events", events, "event_id long, user_id long, event_type string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"),
        ("supplier", [(k,) for k in range(5)], "s_suppkey long"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(stored_updates, "MOST_SENT", most)
    monkeypatch.setattr(stored_updates, "MOST_BLOCKS", blocks)
    plans, cut = [], catalog.cut_lineage
    monkeypatch.setattr(catalog, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().analyzed().toString()), cut(df))[1])
    stored = catalog._stored(adapter.SourceModel(spark, str(tmp_path)))
    want = adapter.SourceModel(spark, str(tmp_path)).tables
    assert rows(want["WorkshopRegistration"])
    same(stored, want)
    assert len(plans) == 1 and ("_marked" in plans[0]) == bool(most or blocks)
