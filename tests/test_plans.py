"""Shape of the plans: what reaches the scans, and what must never appear."""

import pytest

from eventbook.operators import admission, lifecycle, pricing, reports
from eventbook.plans.catalog import QUERIES
from eventbook.schema import TABLES
from eventbook.session import run_folder
from eventbook.sources.adapter import AS_OF, SourceModel
from eventbook.sources.tables import read_tables, write_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    """The derived tables written out, so that plans show plain scans."""
    folder = run_folder(spark, "plans")
    write_tables(SourceModel(spark, FOLDER).tables, folder)
    return read_tables(spark, folder)


def physical(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


LAZY = ("org_conferences", "org_client_debts", "client_debt_by_participant", "participant_workshops",
        "refresh_overdue_wreg", "apply_payments_clients", "register_date_range", "violations_fk")


@pytest.mark.parametrize("name", LAZY)
def test_no_products_and_no_python(spark, name):
    plan = physical(QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan


def test_key_filter_and_columns_reach_the_scan(spark, stored):
    plan = physical(reports.badge_names(stored, conference_id=3, day_id=12))
    assert "EqualTo(ConferenceDayID,12)" in plan and "EqualTo(ConferenceID,3)" in plan
    scans = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert any("struct<ReservationDayID:bigint,ConferenceDayID:bigint>" in line for line in scans)
    assert not any("Amount" in line for line in scans)


def test_open_reservations_are_filtered_at_the_scan(spark, stored):
    plan = physical(reports.org_client_debts(stored))
    assert "Not(EqualTo(Paid,true))" in plan and "Not(EqualTo(Canceled,true))" in plan


def test_overdue_ids_need_no_workshop_tables(spark, stored):
    plan = physical(lifecycle.overdue_reservations(stored, AS_OF))
    assert "Workshops" not in plan
    assert "LessThan(Date,1997-09-28T00:00)" in plan


def test_window_of_days_reaches_the_scan(spark, stored):
    plan = physical(pricing.conferences_with_free_terms(stored, AS_OF))
    assert "GreaterThanOrEqual(Start,1997-10-01T00:00)" in plan and "LessThan(Start,1997-10-23T00:00)" in plan


def test_left_join_of_the_participant_view_stays_inner(spark, stored):
    assert "Outer" not in physical(reports.participant_workshops(stored))


def test_top_clients_keep_only_the_top(spark, stored):
    assert "TakeOrderedAndProject" in physical(reports.org_top_clients(stored))


def test_rollup_expands_months_not_reservations(spark, stored):
    plan = reports.org_client_payments(stored)._jdf.queryExecution().optimizedPlan().toString()
    expand = plan[plan.index("Expand") :]
    assert "Aggregate" in expand  # the monthly sums lie below the expansion


def test_admission_answer_is_one_join(spark, stored):
    rows = stored["WorkshopsReservations"]
    plan = physical(admission.admit_workshop_reservations(stored, rows, stored=True))
    assert "Window" not in plan and "SortAggregate" not in plan


def test_secret_columns_are_in_no_output(spark):
    secret = {c.name for t in TABLES.values() for c in t.columns if c.secret}
    for name in LAZY:
        assert not secret & set(QUERIES[name](spark, FOLDER).columns)


def below_a_semi_join(plan: str, table: str) -> bool:
    """Whether a scan of the table (by a column only it has) feeds a semi join before any aggregate."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if table in line and line.strip(" :+-").startswith("Relation"):
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [x for x in reversed(lines[:i]) if len(x) - len(x.lstrip(" :+-")) < depth]
            path, least = [], depth
            for x in above:
                indent = len(x) - len(x.lstrip(" :+-"))
                if indent < least:
                    path.append(x.strip(" :+-"))
                    least = indent
            first = next((x for x in path if x.startswith(("Join", "Aggregate"))), "")
            if first.startswith("Join LeftSemi"):
                return True
    return False


@pytest.mark.parametrize(
    "build",
    [
        lambda t: pricing.conferences_with_free_terms(t, AS_OF),
        lambda t: pricing.workshops_with_free_terms(t, AS_OF),
        lambda t: reports.free_workshops(t, conference_id=3),
        lambda t: reports.client_debt_by_participant(t, participant_id=3),
    ],
)
def test_bookings_are_restricted_before_they_are_summed(stored, build):
    plan = build(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert below_a_semi_join(plan, "Quantity")
