"""Time the headline queries; one JSON line on stdout.

Folder from BENCH_SF_DIR, cores from BENCH_CPUS.  A query is timed from its first line to its last
row (planning, written intermediate tables and all), with the rows going nowhere.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from eventbook.plans.catalog import QUERIES  # noqa: E402
from eventbook.session import local_session  # noqa: E402

HEADLINE = (
    "available_day_places",
    "available_workshop_places",
    "reservation_day_cost",
    "conferences_with_free_terms_wide",
    "workshops_with_free_terms_wide",
    "org_conferences",
    "org_not_registered",
    "org_top_clients",
    "org_client_payments",
    "org_client_debts",
    "client_debt_per_reservation",
    "participant_workshops",
    "participant_conferences",
    "client_conference_cost",
    "client_debt_by_participant",
    "money_to_pay",
    "badge_names",
    "workshop_participants",
    "free_workshops",
    "refresh_overdue_wreg",
    "apply_payments_clients",
    "register_date_range",
    "workshop_conflicts",
    "admit_non_overlapping",
    "admit_workshop_reservations",
    "admit_workshop_registrations",
    "admit_day_reservations",
    "workshop_registration_quota",
    "validate_conference_days",
    "violations_fk",
    "ingest_day_reservations",
    "ingest_workshop_registrations",
    "assign_ids",
    "stream_occupancy",
    "stream_admission",
)


def run(name: str, spark, folder: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begun, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    run("available_day_places", spark, folder)  # start the engine, not counted
    times = {name: run(name, spark, folder) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
