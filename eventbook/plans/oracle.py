"""SQL counterparts of the registered queries, written on their own for another engine.

Each text reads the star-schema tables only.  Capacity rules are replayed row by row with recursive
queries, which is slow but plainly sequential; the two rules on workshop registrations, which feed
each other, by a walk through each group of rows that can touch each other.
"""

from __future__ import annotations

import re

from eventbook.schema import TABLES

AS_OF = "DATE '1997-10-01'"
WIDE = 400

# Derived tables.
_CTE = {
    "n_s": "SELECT count(*) AS n FROM supplier",
    "n_c": "SELECT count(*) AS n FROM customer",
    "n_o": "SELECT count(*) AS n FROM orders",
    "conf": """
        SELECT s_suppkey AS ConferenceID, s_name AS Name,
               CAST(first_day AS TIMESTAMP) + INTERVAL 8 HOUR AS "Start",
               CAST(first_day + extra AS TIMESTAMP) + INTERVAL 18 HOUR AS "End",
               CAST(150 + s_suppkey % 5 * 50 AS INTEGER) AS "Limit",
               CASE WHEN s_suppkey % 2 <> 0 THEN 'd' || s_suppkey END AS Description,
               CAST(10 + abs(s_acctbal) / 100 AS DECIMAL(19,4)) AS Price,
               first_day, extra, s_nationkey
        FROM (SELECT *, DATE '1997-10-01' + CAST(s_suppkey * 7 % 400 AS INTEGER) AS first_day,
                     CAST(s_suppkey % 3 AS INTEGER) AS extra FROM supplier)""",
    "days": """
        SELECT c.ConferenceID * 4 + i AS ConferenceDayID, n_name AS Location,
               first_day + CAST(i AS INTEGER) AS "Date", 28800 AS "Start", 64800 AS "End", c.ConferenceID
        FROM conf c LEFT JOIN nation ON s_nationkey = n_nationkey, range(0, 3) r(i) WHERE i <= extra""",
    "shops": """
        SELECT p_partkey AS WorkshopID, p_name AS Name, p_size * 20 AS "Limit",
               CAST((8 + p_partkey % 8) * 3600 AS INTEGER) AS "Start",
               CAST((9 + p_partkey % 8 + p_partkey % 3) * 3600 AS INTEGER) AS "End",
               CASE WHEN p_partkey % 2 <> 0 THEN 'd' || p_partkey END AS Description,
               p_brand AS Location,
               CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_retailprice END AS DECIMAL(19,4)) AS price,
               p_partkey % n * 4 + (p_partkey // n) % (1 + p_partkey % n % 3) AS ConferenceDayID
        FROM part, n_s""",
    "clients": """
        SELECT c_custkey AS ClientID, c_name AS Name, CAST(1 + c_custkey % 12 AS INTEGER) AS ServiceCounter,
               'Street ' || c_custkey AS Street, n_name AS City, n_name AS Country,
               lower(c_name) || CASE WHEN c_custkey % 50 = 0 THEN '.example.com' ELSE '@example.com' END AS Email,
               CASE WHEN c_custkey % 30 = 0 THEN NULL
                    WHEN c_custkey % 40 = 0 THEN 'x' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
                    ELSE lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS Phone,
               c_mktsegment = 'MACHINERY' AS isCompany
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "crd": """
        SELECT o_orderkey AS ReservationDayID, o_orderdate AS "Date", o_custkey AS ClientID,
               CAST(1 + o_orderkey % 5 AS INTEGER) AS N, CAST(o_orderkey % 3 AS INTEGER) AS S,
               o_orderstatus = 'P' AS Canceled, o_orderstatus = 'F' AS Paid,
               CAST(o_totalprice AS DECIMAL(19,4)) AS Amount,
               o_orderkey % n * 4 + (o_orderkey // n) % (1 + o_orderkey % n % 3) AS ConferenceDayID
        FROM orders, n_s""",
    "pays": """
        SELECT o_orderkey AS PaymentID, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS "Date",
               o_orderkey AS ReservationDayID FROM orders WHERE o_orderstatus = 'F'""",
    "wres": """
        SELECT l_orderkey * 100000 + l_partkey AS ReservationID, min(l_returnflag) = 'R' AS Canceled,
               l_partkey AS WorkshopID, l_orderkey AS ReservationDayID, CAST(sum(l_quantity) AS INTEGER) AS Quantity
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "people": """
        SELECT DISTINCT user_id AS ParticipantID, 'Participant#' || user_id AS Name,
               CAST(100000 + user_id AS DECIMAL(20,0)) AS StudentIndex, user_id % n AS ClientId FROM events, n_c""",
    "creg": """
        SELECT event_id AS ConferenceRegistrationID, event_id % greatest(n // 5, 1) AS ReservationDayID,
               user_id AS ParticipantID, event_type = 'error' AS Canceled FROM events, n_o""",
    "wreg": """
        SELECT ConferenceRegistrationID * 100000 + WorkshopID AS WorkshopRegistrationID, ConferenceRegistrationID,
               ReservationID AS WorkshopsReservationID, (ConferenceRegistrationID + WorkshopID) % 7 = 0 AS Canceled
        FROM creg JOIN wres USING (ReservationDayID) WHERE (ConferenceRegistrationID + WorkshopID) % 3 = 0""",
    # Feeds.
    "dayfeed": """
        SELECT ConferenceDayID, Location,
               CASE WHEN ConferenceDayID % 7 = 0 THEN "Date" + 5 ELSE "Date" END AS "Date",
               CASE WHEN ConferenceDayID % 11 = 0 THEN 25200 ELSE "Start" END AS "Start", "End", ConferenceID FROM days""",
    "requests": """
        SELECT ConferenceID, first_day - 1 AS d0, first_day + CAST(c_custkey % 4 AS INTEGER) AS d1, c_custkey AS ClientID,
               CAST(1 + c_custkey % 3 AS INTEGER) AS N, CAST(c_custkey % 2 AS INTEGER) AS S, c_custkey % 2 = 0 AS Paid,
               CAST(100 + c_custkey % 50 AS DECIMAL(19,4)) AS Amount
        FROM customer, n_s JOIN conf ON true WHERE ConferenceID = c_custkey % n""",
    # Views used by several texts.
    "day_taken": "SELECT ConferenceDayID, sum(N + S) AS taken FROM crd WHERE NOT Canceled GROUP BY 1",
    "day_free": """
        SELECT d.ConferenceDayID, CAST(c."Limit" - coalesce(taken, 0) AS BIGINT) AS free_places
        FROM days d JOIN conf c USING (ConferenceID) LEFT JOIN day_taken USING (ConferenceDayID)""",
    "shop_free": """
        SELECT WorkshopID, CAST("Limit" - coalesce((SELECT sum(Quantity) FROM wres r
               WHERE r.WorkshopID = shops.WorkshopID AND NOT Canceled), 0) AS BIGINT) AS free_places FROM shops""",
    "debts": """
        SELECT k.ClientID, k.Name, r.ReservationDayID,
               CAST(r.Amount + coalesce(b.Quantity * w.price, 0) AS DECIMAL(19,4)) AS debt, r."Date"
        FROM clients k JOIN crd r USING (ClientID) LEFT JOIN wres b ON b.ReservationDayID = r.ReservationDayID
             LEFT JOIN shops w ON w.WorkshopID = b.WorkshopID
        WHERE NOT r.Paid AND NOT r.Canceled""",
    "times": """
        SELECT g.WorkshopRegistrationID AS id, c.ParticipantID AS p, d."Date" AS d, w."Start" AS s, w."End" AS e
        FROM wreg g JOIN creg c USING (ConferenceRegistrationID) JOIN wres b ON b.ReservationID = g.WorkshopsReservationID
             JOIN shops w USING (WorkshopID) JOIN days d USING (ConferenceDayID) WHERE NOT g.Canceled""",
}

_ALWAYS_MATERIALIZED = {"wres", "wreg", "creg", "crd"}


def _sql(body: str, recursive: bool = False, **local: str) -> str:
    """``body`` with the derived tables it needs in front; ``local`` adds tables of its own."""
    known = {**_CTE, **local}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(known[name].replace(name, "") if name in local else known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in _ALWAYS_MATERIALIZED else ''}({known[name].strip()})" for name in order
    ]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()


def _week(day: str) -> str:
    return f"CAST(floor((date_diff('day', DATE '1970-01-01', CAST({day} AS DATE)) + 4) / 7.0) AS INTEGER)"


_FACTOR = f"(4 - ({_week('c.\"Start\"')} - {_week(AS_OF)}))"


def _replay(rows: str) -> dict[str, str]:
    """Sequential admission of ``rows`` (k, id, q, lim): table ``walk`` with ``ok`` per id."""
    return {
        "queue": f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS rn FROM ({rows})",
        "walk": """
            SELECT k, id, rn, coalesce(q <= lim, true) AS ok, CASE WHEN q <= lim THEN q ELSE 0 END AS used
            FROM queue WHERE rn = 1
            UNION ALL
            SELECT x.k, x.id, x.rn, coalesce(w.used + x.q <= x.lim, true), w.used + CASE WHEN w.used + x.q <= x.lim THEN x.q ELSE 0 END
            FROM walk w JOIN queue x ON x.k = w.k AND x.rn = w.rn + 1""",
    }


def _replay_sql(rows: str, body: str, **local: str) -> str:
    steps = _replay(rows)
    text = _sql(f"SELECT 1 FROM queue {' '.join(local)}", recursive=True, queue=steps["queue"], **local)
    head = text[: text.rindex("\nSELECT 1 FROM queue")]
    return f"{head},\nwalk AS ({steps['walk']})\n{body.strip()}"


ORACLES: dict[str, str] = {}

ORACLES["available_day_places"] = _sql("SELECT ConferenceDayID, free_places FROM day_free")
ORACLES["available_workshop_places"] = _sql("SELECT WorkshopID, free_places FROM shop_free")
ORACLES["reservation_day_cost"] = _sql(
    f"""SELECT ReservationDayID, CAST(N * full_price + S * cut_price * f AS BIGINT) AS cost,
               CAST((N * full_price + S * cut_price) * f AS BIGINT) AS cost_both_scaled
        FROM (SELECT r.ReservationDayID, r.N, r.S, CAST(round(c.Price, 0) AS BIGINT) AS full_price,
                     CAST(trunc(c.Price * 0.8) AS BIGINT) AS cut_price, {_FACTOR} AS f
              FROM crd r JOIN days d USING (ConferenceDayID) JOIN conf c USING (ConferenceID))"""
)


def _free_terms(days: int, key: str) -> str:
    return _sql(
        f"""SELECT c.Name AS conference_name, d."Date" AS event_date, f.free_places, d.Location, c.Description AS description,
                   CAST(c.Price * 0.8 * {_FACTOR} AS DECIMAL(19,4)) AS student_ticket,
                   CAST(c.Price * {_FACTOR} AS DECIMAL(19,4)) AS normal_ticket
            FROM days d JOIN conf c USING (ConferenceID) JOIN day_free f ON f.ConferenceDayID = {key}
            WHERE date_diff('day', {AS_OF}, CAST(c."Start" AS DATE)) BETWEEN 0 AND {days} AND f.free_places > 0"""
    )


ORACLES["conferences_with_free_terms"] = _free_terms(21, "d.ConferenceDayID")
ORACLES["conferences_with_free_terms_wide"] = _free_terms(WIDE, "d.ConferenceDayID")
ORACLES["conferences_with_free_terms_as_written"] = _free_terms(WIDE, "c.ConferenceID")


def _free_shops(days: int) -> str:
    return _sql(
        f"""SELECT w.Name AS workshop_name, c.Name AS conference_name, d."Date" AS conference_date, d.Location AS place,
                   f.free_places, w."Limit",
                   CASE WHEN w.price = 0 THEN 'darmowa' ELSE CAST(CAST(w.price AS DECIMAL(19,2)) AS VARCHAR) END AS price_label
            FROM shops w JOIN days d USING (ConferenceDayID) JOIN conf c USING (ConferenceID) JOIN shop_free f USING (WorkshopID)
            WHERE date_diff('day', {AS_OF}, d."Date") BETWEEN 0 AND {days} AND f.free_places > 0"""
    )


ORACLES["workshops_with_free_terms"] = _free_shops(21)
ORACLES["workshops_with_free_terms_wide"] = _free_shops(WIDE)

ORACLES["org_conferences"] = _sql(
    """SELECT c.Name AS conference_name, d."Date" AS day, c."Start" AS start_ts, c."End" AS end_ts, d.Location AS place,
              f.free_places, c."Limit" AS "limit",
              CAST(coalesce((SELECT sum(S) FROM crd r WHERE r.ConferenceDayID = d.ConferenceDayID), 0) AS BIGINT) AS students,
              CAST(coalesce((SELECT sum(N) FROM crd r WHERE r.ConferenceDayID = d.ConferenceDayID), 0) AS BIGINT) AS normals,
              CAST(coalesce((SELECT sum(r.ConferenceDayID) FROM crd r WHERE r.ConferenceDayID = d.ConferenceDayID), 0) AS BIGINT) AS reservation_id_sum,
              (SELECT count(*) FROM crd r WHERE r.ConferenceDayID = d.ConferenceDayID) AS reservation_count,
              c.Price AS base_price, c.Description AS description
       FROM conf c JOIN days d USING (ConferenceID) JOIN day_free f USING (ConferenceDayID)"""
)
ORACLES["org_not_registered"] = _sql(
    """SELECT k.Name, k.Phone, r.N + r.S - named AS unregistered, r."Date" AS reservation_date, c.Name AS conference_name
       FROM clients k JOIN (SELECT *, (SELECT count(ParticipantID) FROM creg WHERE creg.ReservationDayID = crd.ReservationDayID) AS named
                            FROM crd) r USING (ClientID)
            LEFT JOIN days d USING (ConferenceDayID) LEFT JOIN conf c USING (ConferenceID)
       WHERE r.N + r.S - named > 0"""
)
ORACLES["org_top_clients"] = _sql(
    """SELECT Name AS client_name, ServiceCounter AS service_counter FROM clients
       ORDER BY ServiceCounter DESC, ClientID LIMIT 100"""
)
ORACLES["org_client_payments"] = _sql(
    """SELECT k.Name, CAST(x.y AS INTEGER) AS year, CAST(x.m AS INTEGER) AS month, x.paid_amount,
              k.Street, k.City, k.Country, k.Email, k.Phone, k.isCompany
       FROM clients k RIGHT JOIN (
           SELECT ClientID, year("Date") AS y, month("Date") AS m, CAST(sum(Amount) AS DECIMAL(19,4)) AS paid_amount
           FROM crd GROUP BY ROLLUP (ClientID, year("Date"), month("Date"))) x ON k.ClientID = x.ClientID"""
)
ORACLES["org_client_debts"] = _sql("SELECT * FROM debts")
ORACLES["client_debt_per_reservation"] = _sql(
    """SELECT k.ClientID, k.Name, r.ReservationDayID, CAST(r.Amount + coalesce((
                  SELECT sum(b.Quantity * w.price) FROM wres b JOIN shops w USING (WorkshopID)
                  WHERE b.ReservationDayID = r.ReservationDayID AND NOT b.Canceled), 0) AS DECIMAL(19,4)) AS debt, r."Date"
       FROM clients k JOIN crd r USING (ClientID) WHERE NOT r.Paid AND NOT r.Canceled"""
)
ORACLES["participant_workshops"] = _sql(
    """SELECT p.ClientId, p.ParticipantID, g.Canceled, p.Name, w.Name AS workshop_name, w."Start", w."End", d."Date"
       FROM people p JOIN creg c USING (ParticipantID) LEFT JOIN wreg g ON g.ConferenceRegistrationID = c.ConferenceRegistrationID
            JOIN wres b ON b.ReservationID = g.WorkshopsReservationID JOIN shops w ON w.WorkshopID = b.WorkshopID
            JOIN days d ON d.ConferenceDayID = w.ConferenceDayID"""
)
ORACLES["participant_conferences"] = _sql(
    """SELECT DISTINCT g.ParticipantID, c.ConferenceID, c.Name, c."Start", c."End", c.Description
       FROM creg g JOIN crd r USING (ReservationDayID) JOIN days d USING (ConferenceDayID) JOIN conf c USING (ConferenceID)"""
)
ORACLES["client_conference_cost"] = _sql(
    """SELECT ClientID, ConferenceID, CAST(sum(Amount) AS DECIMAL(19,4)) AS to_pay
       FROM crd JOIN days USING (ConferenceDayID)
       GROUP BY GROUPING SETS ((ClientID, ConferenceID), (ClientID)) HAVING sum(Amount) > 0"""
)
ORACLES["client_debt_by_participant"] = _sql(
    """SELECT p.ParticipantID, CAST(coalesce(sum(x.debt), 0) AS DECIMAL(19,4)) AS debt
       FROM people p LEFT JOIN (SELECT g.ParticipantID, debts.debt FROM debts JOIN creg g
            ON g.ReservationDayID = debts.ReservationDayID WHERE NOT g.Canceled) x ON x.ParticipantID = p.ParticipantID
       GROUP BY p.ParticipantID"""
)
ORACLES["money_to_pay"] = _sql(
    """SELECT ClientID, ConferenceID, CAST(sum(Amount) AS DECIMAL(19,4)) AS to_pay
       FROM crd JOIN days USING (ConferenceDayID) WHERE NOT Paid GROUP BY ClientID, ConferenceID"""
)
ORACLES["money_to_pay_all_pairs"] = _sql(
    """SELECT q.ClientID, q.ConferenceID, CAST(coalesce((SELECT sum(r.Amount) FROM crd r JOIN days d USING (ConferenceDayID)
              WHERE NOT r.Paid AND r.ClientID = q.ClientID AND d.ConferenceID = q.ConferenceID), 0) AS DECIMAL(19,4)) AS to_pay
       FROM requests q"""
)
ORACLES["badge_names"] = _sql(
    """SELECT d.ConferenceID, d.ConferenceDayID, p.Name AS participant_name FROM days d JOIN crd r USING (ConferenceDayID)
       JOIN creg g USING (ReservationDayID) JOIN people p USING (ParticipantID)"""
)
ORACLES["workshop_participants"] = _sql(
    """SELECT b.WorkshopID, p.Name AS name FROM people p JOIN creg c USING (ParticipantID)
       JOIN wreg g USING (ConferenceRegistrationID) JOIN wres b ON b.ReservationID = g.WorkshopsReservationID"""
)
ORACLES["free_workshops"] = _sql(
    """SELECT d.ConferenceID, w.WorkshopID AS workshopid, w.Name FROM shops w JOIN days d USING (ConferenceDayID)
       JOIN shop_free f USING (WorkshopID) WHERE f.free_places > 0"""
)

# Updates.
_CRD_OUT = """ReservationDayID, "Date", ClientID, N AS NormalParticipantQuantity, S AS StudentParticipantQuantity,
              {canceled} AS Canceled, {paid} AS Paid, Amount, ConferenceDayID"""


def _cancelled(asked: str, became: str) -> dict[str, str]:
    """The four tables after a cancellation; ``asked`` and ``became`` select reservation ids."""
    return {
        "": _sql(
            f"SELECT {_CRD_OUT.format(canceled='Canceled OR ReservationDayID IN (' + asked + ')', paid='Paid')} FROM crd"
        ),
        **_cascade(became),
    }


def _cascade(became: str) -> dict[str, str]:
    return {
        "_wres": _sql(
            f"""SELECT ReservationID, Canceled OR ReservationDayID IN ({became}) AS Canceled, WorkshopID,
                       ReservationDayID, Quantity FROM wres"""
        ),
        "_wreg": _sql(
            f"""SELECT WorkshopRegistrationID, ConferenceRegistrationID, WorkshopsReservationID,
                       Canceled OR WorkshopsReservationID IN (SELECT ReservationID FROM wres WHERE ReservationDayID IN ({became}))
                       AS Canceled FROM wreg"""
        ),
        "_creg": _sql(
            f"""SELECT ConferenceRegistrationID, ReservationDayID, ParticipantID,
                       Canceled OR ReservationDayID IN ({became}) AS Canceled FROM creg"""
        ),
    }


_TENTH = "SELECT ReservationDayID FROM crd WHERE ReservationDayID % 10 = 0"
_OVERDUE = f"SELECT ReservationDayID FROM debts WHERE {_week(AS_OF)} - {_week('\"Date\"')} >= 1"
for _suffix, _text in _cancelled(_TENTH, _TENTH + " AND NOT Canceled").items():
    ORACLES[f"cancel_reservations{_suffix}"] = _text
    ORACLES[f"cancel_stored{_suffix}"] = _text
for _suffix, _text in _cancelled(_OVERDUE, _OVERDUE).items():
    ORACLES[f"refresh_overdue{_suffix}"] = _text
    ORACLES[f"refresh_overdue_stored{_suffix}"] = _text
for _suffix, _text in _cascade("SELECT ReservationDayID FROM crd WHERE Canceled").items():
    ORACLES[f"cancel_cascade{_suffix}"] = _text

ORACLES["apply_payments_reservations"] = _sql(
    f"SELECT {_CRD_OUT.format(canceled='Canceled', paid='Paid OR ReservationDayID IN (SELECT ReservationDayID FROM pays)')} FROM crd"
)
_COUNTER = """CAST(ServiceCounter + (SELECT count(*) FROM pays JOIN crd USING (ReservationDayID)
              WHERE crd.ClientID = clients.ClientID) AS INTEGER) AS ServiceCounter"""
ORACLES["apply_payments_clients"] = _sql(f"SELECT * REPLACE ({_COUNTER}) FROM clients")


def _range_rows(compare: str) -> str:
    return _sql(
        f"""SELECT CAST({AS_OF} AS TIMESTAMP) AS "Date", q.ClientID, q.N AS NormalParticipantQuantity,
                   q.S AS StudentParticipantQuantity, q.Paid, q.Amount, d.ConferenceDayID
            FROM requests q JOIN days d USING (ConferenceID) WHERE d."Date" >= q.d0 AND d."Date" {compare} q.d1"""
    )


ORACLES["register_date_range"] = _range_rows("<=")
ORACLES["register_date_range_exclusive"] = _range_rows("<")

# Rules on arriving rows.
ORACLES["workshop_conflicts"] = _sql(
    """SELECT a.id AS WorkshopRegistrationID, a.p AS ParticipantID, a.d AS "Date", min(b.id) AS conflicts_with, 52000 AS code
       FROM times a JOIN times b ON a.p = b.p AND a.d = b.d AND b.id < a.id AND a.s <= b.e AND b.s <= a.e
       GROUP BY 1, 2, 3"""
)
ORACLES["admit_non_overlapping"] = _sql(
    """, walk AS (
           SELECT p, d, id, rn, true AS ok, [{'s': s, 'e': e}] AS held FROM queue WHERE rn = 1
           UNION ALL
           SELECT x.p, x.d, x.id, x.rn, len(list_filter(w.held, lambda y: y.s <= x.e AND x.s <= y.e)) = 0,
                  CASE WHEN len(list_filter(w.held, lambda y: y.s <= x.e AND x.s <= y.e)) = 0
                       THEN list_append(w.held, {'s': x.s, 'e': x.e}) ELSE w.held END
           FROM walk w JOIN queue x ON x.p = w.p AND x.d = w.d AND x.rn = w.rn + 1)
       SELECT g.WorkshopRegistrationID, coalesce(ok, true) AS admitted FROM wreg g LEFT JOIN walk ON walk.id = g.WorkshopRegistrationID
    """.strip(),
    recursive=True,
    queue="SELECT *, row_number() OVER (PARTITION BY p, d ORDER BY id) AS rn FROM times",
)
ORACLES["admit_workshop_reservations"] = _replay_sql(
    """SELECT b.WorkshopID AS k, b.ReservationID AS id, CAST(b.Quantity AS BIGINT) AS q, CAST(w."Limit" AS BIGINT) AS lim
       FROM wres b JOIN shops w USING (WorkshopID) WHERE NOT b.Canceled""",
    """SELECT b.ReservationID, b.WorkshopID, CASE WHEN coalesce(ok, true) THEN 0 ELSE 53000 END AS code
       FROM wres b LEFT JOIN walk ON walk.id = b.ReservationID""",
    wres=_CTE["wres"],
)
_DAY_ROWS = """SELECT r.ConferenceDayID AS k, r.ReservationDayID AS id,
       CAST(CASE WHEN r.Canceled THEN 0 ELSE r.N + r.S END AS BIGINT) AS q, CAST({lim} AS BIGINT) AS lim
       FROM crd r JOIN days d USING (ConferenceDayID) JOIN conf c USING (ConferenceID) {more}"""
_DAY_OUT = """SELECT r.ReservationDayID, r.ConferenceDayID, CASE WHEN ok THEN 0 ELSE 52300 END AS code
       FROM crd r JOIN walk ON walk.id = r.ReservationDayID"""
ORACLES["admit_day_reservations"] = _replay_sql(_DAY_ROWS.format(lim='c."Limit"', more=""), _DAY_OUT)
ORACLES["admit_day_reservations_onto_existing"] = _replay_sql(
    _DAY_ROWS.format(
        lim='c."Limit" - coalesce(h.taken, 0)',
        more="""LEFT JOIN (SELECT ConferenceDayID, sum(crd.N + S) AS taken FROM crd, n_c
                           WHERE ClientID < n_c.n // 2 AND NOT Canceled GROUP BY 1) h USING (ConferenceDayID), n_c
                WHERE r.ClientID >= n_c.n // 2""",
    ),
    _DAY_OUT,
)
ORACLES["day_registration_quota"] = _sql(
    """SELECT g.ConferenceRegistrationID, g.ReservationDayID,
              CASE WHEN row_number() OVER (PARTITION BY g.ReservationDayID ORDER BY g.ConferenceRegistrationID) <= r.N + r.S
                   THEN 0 ELSE 56000 END AS code FROM creg g JOIN crd r USING (ReservationDayID)"""
)
ORACLES["workshop_registration_quota"] = _sql(
    """SELECT g.WorkshopRegistrationID, g.WorkshopsReservationID,
              CASE WHEN row_number() OVER (PARTITION BY g.WorkshopsReservationID ORDER BY g.WorkshopRegistrationID) <= b.Quantity
                   THEN 0 ELSE 56000 END AS code FROM wreg g JOIN wres b ON b.ReservationID = g.WorkshopsReservationID"""
)
def _joint_sql(arriving: str, standing: str, body: str, **local: str) -> str:
    """Both rules on workshop registrations, row by row in id order: table ``walk`` with ``code`` per id.

    ``arriving``: (id, b) rows; ``standing``: ids that were accepted before.  Rows that share neither a
    booking nor a participant's day, directly or through others, do not touch each other: each such
    group is walked on its own, all groups side by side.
    """
    text = _sql(
        "SELECT 1 FROM queue",
        recursive=True,
        queue=f"""
            SELECT a.id, a.b, w.Quantity AS seats, t.p, t.d, t.s, t.e FROM ({arriving}) a
            JOIN wres w ON w.ReservationID = a.b LEFT JOIN times t ON t.id = a.id""",
        **local,
    )
    head = text[: text.rindex("\nSELECT 1 FROM queue")]
    return f"""{head},
links AS MATERIALIZED (
    SELECT id, o FROM (SELECT id, lag(id) OVER (PARTITION BY b ORDER BY id) AS o FROM queue) WHERE o IS NOT NULL
    UNION ALL SELECT id, o FROM (SELECT id, lag(id) OVER (PARTITION BY p, d ORDER BY id) AS o FROM queue WHERE p IS NOT NULL) WHERE o IS NOT NULL),
near AS MATERIALIZED (SELECT id, o FROM links UNION ALL SELECT o, id FROM links),
groups(id, c) USING KEY (id) AS (
    SELECT id, id FROM queue
    UNION
    SELECT n.id, min(g.c) FROM groups g JOIN near n ON n.o = g.id JOIN recurring.groups h ON h.id = n.id WHERE g.c < h.c GROUP BY n.id),
stood AS MATERIALIZED ({standing}),
held AS MATERIALIZED (SELECT b, count(*) AS n FROM stood GROUP BY b),
turns AS MATERIALIZED (
    SELECT q.*, c, coalesce(n, 0) AS taken, row_number() OVER (PARTITION BY c ORDER BY q.id) AS rn,
           EXISTS (SELECT 1 FROM stood x JOIN times y ON y.id = x.id WHERE y.p = q.p AND y.d = q.d AND y.s <= q.e AND q.s <= y.e) AS stands
    FROM queue q JOIN groups USING (id) LEFT JOIN held h ON h.b = q.b),
walk(c, rn, id, code, b, p, d, s, e) USING KEY (c, rn) AS (
    SELECT DISTINCT c, 0::BIGINT, -1::BIGINT, -1, NULL::BIGINT, NULL::BIGINT, NULL::DATE, NULL::INTEGER, NULL::INTEGER FROM turns
    UNION
    SELECT q.c, q.rn, q.id,
           CASE WHEN stands OR EXISTS (SELECT 1 FROM recurring.walk a WHERE a.c = q.c AND a.code = 0 AND a.p = q.p AND a.d = q.d AND a.s <= q.e AND q.s <= a.e) THEN 52000
                WHEN taken + (SELECT count(*) FROM recurring.walk a WHERE a.c = q.c AND a.code = 0 AND a.b = q.b) >= q.seats THEN 56000 ELSE 0 END,
           q.b, q.p, q.d, q.s, q.e
    FROM walk w JOIN turns q ON q.c = w.c AND q.rn = w.rn + 1)
{body.strip()}"""


_NONE_STANDING = "SELECT id, b FROM (SELECT 0 AS id, 0 AS b) WHERE false"
ORACLES["admit_workshop_registrations"] = _joint_sql(
    "SELECT WorkshopRegistrationID AS id, WorkshopsReservationID AS b FROM wreg",
    _NONE_STANDING,
    "SELECT id AS WorkshopRegistrationID, code FROM walk WHERE rn > 0",
)
_FIFTH = "SELECT WorkshopRegistrationID AS id, WorkshopsReservationID AS b FROM wreg WHERE ConferenceRegistrationID % 5"
ORACLES["ingest_workshop_registrations"] = _joint_sql(
    f"{_FIFTH} <> 0",
    f"{_FIFTH} = 0",
    """SELECT id AS WorkshopRegistrationID, CASE code WHEN 52000 THEN 'TRG-2' WHEN 56000 THEN 'TRG-7' ELSE '' END AS rule, code
       FROM walk WHERE rn > 0""",
)
_DAY_CODE = """CASE WHEN f."Date" < CAST(c."Start" AS DATE) OR f."Date" > CAST(c."End" AS DATE) THEN 56002
                    WHEN f."Start" < hour(c."Start") * 3600 OR f."End" > hour(c."End") * 3600 THEN 56003 ELSE 0 END"""


def _day_codes(place: str) -> str:
    return _sql(
        f"""SELECT ConferenceDayID, CAST(CASE WHEN code = 0 AND row_number() OVER (PARTITION BY code, {place} ORDER BY ConferenceDayID) > 1
                   THEN 56004 ELSE code END AS INTEGER) AS code
            FROM (SELECT f.*, {_DAY_CODE} AS code FROM dayfeed f JOIN conf c USING (ConferenceID))"""
    )


ORACLES["validate_conference_days"] = _day_codes('"Date"')
ORACLES["validate_conference_days_per_conference"] = _day_codes('"Date", ConferenceID')

# Constraint checks.
_NAMES = {
    "Clients": "clients",
    "Participants": "people",
    "Conferences": "conf",
    "ConferenceDays": "days",
    "Workshops": "shops",
    "ConferenceReservationDays": "crd",
    "Payments": "pays",
    "WorkshopsReservations": "wres",
    "ConferenceDayRegistration": "creg",
    "WorkshopRegistration": "wreg",
}
_KEYS = {
    "Clients": "ClientID",
    "Participants": "ParticipantID",
    "Conferences": "ConferenceID",
    "ConferenceDays": "ConferenceDayID",
    "Workshops": "WorkshopID",
    "ConferenceReservationDays": "ReservationDayID",
    "Payments": "PaymentID",
    "WorkshopsReservations": "ReservationID",
    "ConferenceDayRegistration": "ConferenceRegistrationID",
    "WorkshopRegistration": "WorkshopRegistrationID",
}
_REFERENCES = (
    ("Participants", "ClientId", "Clients", 0),
    ("ConferenceDays", "ConferenceID", "Conferences", 0),
    ("Workshops", "ConferenceDayID", "ConferenceDays", 0),
    ("ConferenceReservationDays", "ClientID", "Clients", 0),
    ("ConferenceReservationDays", "ConferenceDayID", "ConferenceDays", 1),
    ("Payments", "ReservationDayID", "ConferenceReservationDays", 0),
    ("WorkshopsReservations", "WorkshopID", "Workshops", 0),
    ("WorkshopsReservations", "ReservationDayID", "ConferenceReservationDays", 1),
    ("ConferenceDayRegistration", "ReservationDayID", "ConferenceReservationDays", 0),
    ("ConferenceDayRegistration", "ParticipantID", "Participants", 1),
    ("WorkshopRegistration", "ConferenceRegistrationID", "ConferenceDayRegistration", 0),
    ("WorkshopRegistration", "WorkshopsReservationID", "WorkshopsReservations", 1),
)
_DAMAGED_NAME = "CASE WHEN {key} % 89 = 0 THEN NULL WHEN {key} % 83 = 0 THEN repeat(Name, 60) ELSE Name END"


def _broken_reference(column: str, key: str, step: int) -> str:
    return f"CASE WHEN ({key} + {step}) % 97 = 0 THEN -1 - {column} ELSE {column} END"


ORACLES["violations_checks"] = _sql(
    """SELECT 'Clients' AS table_name, 'CHK-1' AS rule, ClientID AS key, 'ServiceCounter must be above 0' AS message FROM clients WHERE ServiceCounter <= 0
       UNION ALL SELECT 'Clients', 'CHK-2', ClientID, 'Email must contain @' FROM clients WHERE Email NOT LIKE '%@%'
       UNION ALL SELECT 'Clients', 'CHK-3', ClientID, 'Phone must not contain letters' FROM clients WHERE regexp_matches(Phone, '[A-Za-z]')
       UNION ALL SELECT 'Conferences', 'CHK-4', ConferenceID, 'Limit must be above 0' FROM conf WHERE "Limit" <= 0
       UNION ALL SELECT 'Conferences', 'CHK-5', ConferenceID, 'Start must be before End' FROM conf WHERE "Start" >= "End"
       UNION ALL SELECT 'Workshops', 'CHK-6', WorkshopID, 'Limit must be above 0' FROM shops WHERE "Limit" <= 0
       UNION ALL SELECT 'Workshops', 'CHK-7', WorkshopID, 'Start must be before End' FROM shops WHERE "Start" >= "End" """
)


def _named(condition: str, kind: str, text: str) -> str:
    return _sql(
        " UNION ALL ".join(
            f"""SELECT '{table}' AS table_name, '{kind} {table}.Name' AS rule, key, '{text}' AS message
                FROM (SELECT {_KEYS[table]} AS key, {_DAMAGED_NAME.format(key=_KEYS[table])} AS Name FROM {_NAMES[table]})
                WHERE {condition}"""
            for table in ("Clients", "Participants", "Conferences", "Workshops")
        )
    )


ORACLES["violations_not_null"] = _named("Name IS NULL", "NN", "Name is required")
ORACLES["violations_length"] = _named("length(Name) > 255", "LEN", "Name is longer than 255")
ORACLES["violations_fk"] = _sql(
    " UNION ALL ".join(
        f"""SELECT '{child}' AS table_name, 'FK {child}.{column}' AS rule, key, 'no {parent} row ' || ref AS message
            FROM (SELECT {_KEYS[child]} AS key, {_broken_reference(column, _KEYS[child], step)} AS ref FROM {_NAMES[child]})
            WHERE ref NOT IN (SELECT {_KEYS[parent]} FROM {_NAMES[parent]})"""
        for child, column, parent, step in _REFERENCES
    )
)
ORACLES["violations_pk"] = """
    SELECT 'WorkshopsReservations' AS table_name, 'PK WorkshopsReservations.ReservationID' AS rule,
           l_orderkey * 10 + l_linenumber AS key, 'key occurs ' || count(*) || ' times' AS message
    FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber HAVING count(*) > 1"""
ORACLES["violations_fk_bitmaps"] = ORACLES["violations_fk"]
ORACLES["violations_pk_bitmaps"] = ORACLES["violations_pk"]

# Bulk ingest.
ORACLES["ingest_clients"] = _sql(
    """SELECT (SELECT max(ClientID) FROM clients WHERE ClientID % 2 = 0) + row_number() OVER (ORDER BY ClientID) AS ClientID,
              Name, 'Polska' AS Country, isCompany, CASE WHEN isCompany THEN 0 ELSE ServiceCounter END AS ServiceCounter,
              CASE WHEN isCompany THEN 'CHK-1' WHEN Email NOT LIKE '%@%' THEN 'CHK-2'
                   WHEN regexp_matches(Phone, '[A-Za-z]') THEN 'CHK-3' ELSE '' END AS rule, 0 AS code
       FROM clients WHERE ClientID % 2 = 1"""
)
ORACLES["ingest_participants"] = _sql(
    f"""SELECT (SELECT max(ParticipantID) FROM people WHERE ParticipantID % 2 = 0) + row_number() OVER (ORDER BY StudentIndex) AS ParticipantID,
              StudentIndex, ref AS ClientId,
              CASE WHEN damaged IS NULL THEN 'NN Participants.Name' WHEN length(damaged) > 255 THEN 'LEN Participants.Name'
                   WHEN ref NOT IN (SELECT ClientID FROM clients) THEN 'FK Participants.ClientId' ELSE '' END AS rule, 0 AS code
       FROM (SELECT *, {_broken_reference("ClientId", "ParticipantID", 0)} AS ref,
                    {_DAMAGED_NAME.format(key="ParticipantID")} AS damaged FROM people WHERE ParticipantID % 2 = 1)"""
)
ORACLES["ingest_conferences"] = _sql(
    f"""SELECT (SELECT max(ConferenceID) FROM conf) + row_number() OVER (ORDER BY "Start", ConferenceID) AS ConferenceID, "Start", Price,
              CASE WHEN damaged IS NULL THEN 'NN Conferences.Name' WHEN length(damaged) > 255 THEN 'LEN Conferences.Name'
                   WHEN ConferenceID % 17 = 0 THEN 'CHK-4' WHEN ConferenceID % 13 = 0 THEN 'CHK-5' ELSE '' END AS rule, 0 AS code
       FROM (SELECT *, {_DAMAGED_NAME.format(key="ConferenceID")} AS damaged FROM conf)"""
)
ORACLES["ingest_conference_days"] = _sql(
    f"""SELECT id AS ConferenceDayID, ConferenceID, "Date", CASE WHEN code = 0 THEN '' ELSE 'TRG-8' END AS rule, CAST(code AS INTEGER) AS code
       FROM (SELECT id, ConferenceID, "Date", CASE WHEN code > 0 THEN code
                    WHEN "Date" IN (SELECT "Date" FROM days WHERE ConferenceID % 3 = 0) THEN 56004
                    WHEN row_number() OVER (PARTITION BY code, "Date" ORDER BY id) > 1 THEN 56004 ELSE 0 END AS code
             FROM (SELECT f.*, {_DAY_CODE} AS code,
                          (SELECT max(ConferenceDayID) FROM days WHERE ConferenceID % 3 = 0)
                          + row_number() OVER (ORDER BY f.ConferenceDayID) AS id
                   FROM dayfeed f JOIN conf c USING (ConferenceID) WHERE f.ConferenceID % 3 <> 0))"""
)
ORACLES["ingest_workshops"] = _sql(
    f"""SELECT (SELECT max(WorkshopID) FROM shops) + row_number() OVER (ORDER BY WorkshopID) AS WorkshopID, ref AS ConferenceDayID,
              CAST(0 AS DECIMAL(19,4)) AS price,
              CASE WHEN damaged IS NULL THEN 'NN Workshops.Name' WHEN length(damaged) > 255 THEN 'LEN Workshops.Name'
                   WHEN ref NOT IN (SELECT ConferenceDayID FROM days) THEN 'FK Workshops.ConferenceDayID' ELSE '' END AS rule, 0 AS code
       FROM (SELECT *, {_broken_reference("ConferenceDayID", "WorkshopID", 0)} AS ref,
                    {_DAMAGED_NAME.format(key="WorkshopID")} AS damaged FROM shops)"""
)
_DAY_FEED = f"""
    SELECT *, (SELECT max(ReservationDayID) FROM crd WHERE ClientID % 2 = 0) + row_number() OVER (ORDER BY "Date", ReservationDayID) AS id,
           CASE WHEN kref NOT IN (SELECT ClientID FROM clients) THEN 'FK ConferenceReservationDays.ClientID'
                WHEN dref NOT IN (SELECT ConferenceDayID FROM days) THEN 'FK ConferenceReservationDays.ConferenceDayID' ELSE '' END AS broken
    FROM (SELECT *, {_broken_reference("ClientID", "ReservationDayID", 0)} AS kref,
                 {_broken_reference("ConferenceDayID", "ReservationDayID", 1)} AS dref FROM crd)
    WHERE kref % 2 <> 0"""
_DAY_LIMITS = """JOIN days d ON d.ConferenceDayID = {day} JOIN conf c ON c.ConferenceID = d.ConferenceID
    LEFT JOIN (SELECT ConferenceDayID, sum(N + S) AS taken FROM crd WHERE {standing} AND NOT Canceled GROUP BY 1) h
    ON h.ConferenceDayID = {day}"""
ORACLES["ingest_day_reservations"] = _replay_sql(
    f"""SELECT a.dref AS k, a.id, CAST(a.N + a.S AS BIGINT) AS q, CAST(c."Limit" - coalesce(h.taken, 0) AS BIGINT) AS lim
        FROM arriving a {_DAY_LIMITS.format(day="a.dref", standing="ClientID % 2 = 0")} WHERE a.broken = ''""",
    """SELECT a.id AS ReservationDayID, a.kref AS ClientID, a.dref AS ConferenceDayID, false AS Canceled,
              CASE WHEN broken <> '' THEN broken WHEN NOT ok THEN 'TRG-5' ELSE '' END AS rule,
              CASE WHEN NOT ok THEN 52300 ELSE 0 END AS code
       FROM arriving a LEFT JOIN walk ON walk.id = a.id""",
    arriving=_DAY_FEED,
)
ORACLES["ingest_workshop_reservations"] = _replay_sql(
    """SELECT a.wref AS k, a.ReservationID AS id, CAST(a.Quantity AS BIGINT) AS q,
              CAST(w."Limit" - coalesce(h.taken, 0) AS BIGINT) AS lim
       FROM arriving a JOIN shops w ON w.WorkshopID = a.wref
            LEFT JOIN (SELECT WorkshopID, sum(Quantity) AS taken FROM wres WHERE ReservationDayID % 4 = 0 AND NOT Canceled GROUP BY 1) h
            ON h.WorkshopID = a.wref
       WHERE a.broken = '' AND NOT a.Canceled""",
    """SELECT a.ReservationID, a.wref AS WorkshopID,
              CASE WHEN broken <> '' THEN broken WHEN NOT ok THEN 'TRG-4' ELSE '' END AS rule,
              CASE WHEN NOT ok THEN 53000 ELSE 0 END AS code
       FROM arriving a LEFT JOIN walk ON walk.id = a.ReservationID""",
    arriving=f"""
        SELECT *, CASE WHEN wref NOT IN (SELECT WorkshopID FROM shops) THEN 'FK WorkshopsReservations.WorkshopID'
                       WHEN rref NOT IN (SELECT ReservationDayID FROM crd) THEN 'FK WorkshopsReservations.ReservationDayID'
                       WHEN ReservationDayID % 4 = 0 THEN 'PK WorkshopsReservations.ReservationID' ELSE '' END AS broken
        FROM (SELECT *, {_broken_reference("WorkshopID", "ReservationID", 0)} AS wref,
                     {_broken_reference("ReservationDayID", "ReservationID", 1)} AS rref FROM wres)""",
)
ORACLES["ingest_payments"] = _sql(
    f"""SELECT (SELECT max(PaymentID) FROM pays) + row_number() OVER (ORDER BY "Date", PaymentID) AS PaymentID, "Date", ref AS ReservationDayID,
              CASE WHEN ref NOT IN (SELECT ReservationDayID FROM crd) THEN 'FK Payments.ReservationDayID' ELSE '' END AS rule, 0 AS code
       FROM (SELECT *, {_broken_reference("ReservationDayID", "PaymentID", 0)} AS ref FROM pays)"""
)
_PAID_REFS = f"SELECT {_broken_reference('ReservationDayID', 'PaymentID', 0)} AS ref FROM pays"
ORACLES["ingest_payments_clients"] = _sql(
    f"""SELECT ClientID, CAST(ServiceCounter + (SELECT count(*) FROM ({_PAID_REFS}) JOIN crd ON ReservationDayID = ref
               WHERE crd.ClientID = clients.ClientID) AS INTEGER) AS ServiceCounter FROM clients"""
)
ORACLES["ingest_payments_reservations"] = _sql(
    f"SELECT ReservationDayID, Paid OR ReservationDayID IN ({_PAID_REFS}) AS Paid FROM crd"
)
ORACLES["ingest_day_registrations"] = _sql(
    f"""SELECT id AS ConferenceRegistrationID, rref AS ReservationDayID, pref AS ParticipantID,
              CASE WHEN broken <> '' THEN broken WHEN rn > r.N + r.S - coalesce(standing, 0) THEN 'TRG-6' ELSE '' END AS rule,
              CASE WHEN broken = '' AND rn > r.N + r.S - coalesce(standing, 0) THEN 56000 ELSE 0 END AS code
       FROM (SELECT *, row_number() OVER (PARTITION BY broken, rref ORDER BY id) AS rn FROM (
                SELECT *, (SELECT max(ConferenceRegistrationID) FROM creg WHERE ParticipantID % 2 = 0)
                          + row_number() OVER (ORDER BY ConferenceRegistrationID) AS id,
                       CASE WHEN rref NOT IN (SELECT ReservationDayID FROM crd) THEN 'FK ConferenceDayRegistration.ReservationDayID'
                            WHEN pref NOT IN (SELECT ParticipantID FROM people) THEN 'FK ConferenceDayRegistration.ParticipantID' ELSE '' END AS broken
                FROM (SELECT *, {_broken_reference("ReservationDayID", "ConferenceRegistrationID", 0)} AS rref,
                             {_broken_reference("ParticipantID", "ConferenceRegistrationID", 1)} AS pref FROM creg)
                WHERE pref % 2 <> 0)) a
            LEFT JOIN crd r ON r.ReservationDayID = a.rref
            LEFT JOIN (SELECT ReservationDayID AS hid, count(*) AS standing FROM creg WHERE ParticipantID % 2 = 0 GROUP BY 1) h ON h.hid = a.rref"""
)
ORACLES["register_date_range_booked"] = _replay_sql(
    f"""SELECT a.ConferenceDayID AS k, a.id, CAST(a.N + a.S AS BIGINT) AS q, CAST(c."Limit" - coalesce(h.taken, 0) AS BIGINT) AS lim
        FROM arriving a {_DAY_LIMITS.format(day="a.ConferenceDayID", standing="true")}""",
    """SELECT a.id AS ReservationDayID, a.ClientID, a.ConferenceDayID, CASE WHEN NOT ok THEN 'TRG-5' ELSE '' END AS rule,
              CASE WHEN NOT ok THEN 52300 ELSE 0 END AS code FROM arriving a JOIN walk ON walk.id = a.id""",
    arriving="""
        SELECT q.*, d.ConferenceDayID, (SELECT max(ReservationDayID) FROM crd)
               + row_number() OVER (ORDER BY q.ClientID, d.ConferenceDayID) AS id
        FROM requests q JOIN days d USING (ConferenceID) WHERE d."Date" >= q.d0 AND d."Date" <= q.d1""",
)
# Request by request, day by day; what is left of a conference's days is a list in the order of its days.
_GROUP_DAYS = """
    SELECT q.ConferenceID AS k, q.ClientID, d.ConferenceDayID, q.N + q.S AS q, d.place,
           row_number() OVER (PARTITION BY q.ConferenceID ORDER BY q.ClientID, d.place) AS rn
    FROM (SELECT c_custkey AS ClientID, ConferenceID, first_day + CAST(c_custkey % 5 % 3 AS INTEGER) AS d0, first_day + CAST(2 + c_custkey % 2 AS INTEGER) AS d1,
                 CAST(10 + c_custkey % 37 AS BIGINT) AS N, c_custkey % 11 AS S
          FROM customer, n_s JOIN conf ON true WHERE ConferenceID = c_custkey % n) q
    JOIN (SELECT *, row_number() OVER (PARTITION BY ConferenceID ORDER BY "Date", ConferenceDayID) AS place FROM days) d USING (ConferenceID)
    WHERE d."Date" BETWEEN q.d0 AND q.d1"""
_CHAINS = _sql(
    "SELECT 1 FROM wanted, places", recursive=True, wanted=_GROUP_DAYS,
    places="""SELECT ConferenceID AS k, list(free_places ORDER BY "Date", ConferenceDayID) AS f FROM days JOIN day_free USING (ConferenceDayID) GROUP BY 1""",
)
ORACLES["book_date_ranges"] = (
    _CHAINS[: _CHAINS.rindex("\nSELECT 1 FROM wanted")]
    + """,
walk AS (
    SELECT k, rn, ClientID, ConferenceDayID, true AS asked, q <= f[place] AS ok, q > f[place] AS ended,
           list_transform(f, lambda x, i: CASE WHEN i = place AND q <= x THEN x - q ELSE x END) AS f
    FROM wanted JOIN places USING (k) WHERE rn = 1
    UNION ALL
    SELECT x.k, x.rn, x.ClientID, x.ConferenceDayID, NOT (w.ended AND x.ClientID = w.ClientID),
           NOT (w.ended AND x.ClientID = w.ClientID) AND x.q <= w.f[x.place], (w.ended AND x.ClientID = w.ClientID) OR x.q > w.f[x.place],
           list_transform(w.f, lambda y, i: CASE WHEN i = x.place AND x.q <= y AND NOT (w.ended AND x.ClientID = w.ClientID) THEN y - x.q ELSE y END)
    FROM walk w JOIN wanted x ON x.k = w.k AND x.rn = w.rn + 1
)
SELECT (SELECT max(ReservationDayID) FROM crd) + row_number() OVER (ORDER BY ClientID, rn) AS ReservationDayID, ClientID, ConferenceDayID,
       CASE WHEN ok THEN '' ELSE 'TRG-5' END AS rule, CASE WHEN ok THEN 0 ELSE 52300 END AS code
FROM walk WHERE asked"""
)


def _log_sql(key: str, row: str, rows: str, ends: str) -> str:
    """Event by event per key: places used and the rows that stand."""
    text = _sql(
        "SELECT 1 FROM queue, tight, standing", recursive=True, standing=rows,
        queue=f"""SELECT *, row_number() OVER (PARTITION BY k ORDER BY moment, kind) AS rn
                  FROM (SELECT k, id, q, lim, moment, 0 AS kind FROM standing UNION ALL
                        SELECT k, id, q, lim, ends, 1 FROM (SELECT s.*, {ends} FROM standing s) WHERE ends IS NOT NULL)""",
        tight="SELECT k FROM standing GROUP BY k HAVING sum(q) > max(lim)",
    )
    fits = "x.kind = 0 AND w.used + x.q <= x.lim"
    out = "x.kind = 1 AND list_contains(w.ids, x.id)"
    return (
        text[: text.rindex("\nSELECT 1 FROM queue")]
        + f""",
walk AS (
    SELECT k, rn, id, kind, q <= lim AS ok, CASE WHEN q <= lim THEN q ELSE 0 END AS used, CASE WHEN q <= lim THEN [id] ELSE [] END AS ids
    FROM queue JOIN tight USING (k) WHERE rn = 1
    UNION ALL
    SELECT x.k, x.rn, x.id, x.kind, {fits}, w.used + CASE WHEN {fits} THEN x.q WHEN {out} THEN -x.q ELSE 0 END,
           CASE WHEN {fits} THEN list_append(w.ids, x.id) WHEN {out} THEN list_filter(w.ids, lambda i: i <> x.id) ELSE w.ids END
    FROM walk w JOIN queue x ON x.k = w.k AND x.rn = w.rn + 1
)
SELECT s.id AS {row}, s.k AS {key}, coalesce(ok, true) AS admitted FROM standing s LEFT JOIN (SELECT id, ok FROM walk WHERE kind = 0) USING (id)"""
    )


ORACLES["admit_day_log"] = _log_sql(
    "ConferenceDayID", "ReservationDayID",
    """SELECT r.ConferenceDayID AS k, r.ReservationDayID AS id, CAST(r.N + r.S AS BIGINT) AS q, CAST(c."Limit" AS BIGINT) AS lim, 2 * r.ReservationDayID AS moment
       FROM crd r JOIN days d USING (ConferenceDayID) JOIN conf c USING (ConferenceID)""",
    "CASE WHEN s.id % 3 = 0 THEN 2 * (s.id + 1 + (s.id * 7) % 900) + 1 END AS ends",
)
ORACLES["admit_workshop_log"] = _log_sql(
    "WorkshopID", "ReservationID",
    """SELECT b.WorkshopID AS k, b.ReservationID AS id, CAST(b.Quantity AS BIGINT) AS q, CAST(w."Limit" AS BIGINT) AS lim, 2 * b.ReservationID AS moment
       FROM wres b JOIN shops w USING (WorkshopID)""",
    "CASE WHEN s.id % 7 = 0 THEN 2 * s.id + 100000 * (s.id % 5000) + 1 END AS ends",
)
ORACLES["assign_ids"] = """
    SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS new_id, o_orderkey FROM orders"""
ORACLES["column_defaults"] = _sql(
    "SELECT ClientID, 0 AS ServiceCounter, 'Polska' AS Country, Phone, false AS isCompany FROM clients"
)
ORACLES["typed_from_text"] = _sql("SELECT * FROM shops")
ORACLES["parse_clock_orders"] = """
    SELECT o_orderkey, CAST(CASE WHEN m > 59 OR (half < 2 AND h > 12) OR h > 23 THEN -1
                                 WHEN half = 0 THEN h % 12 * 3600 + m * 60
                                 WHEN half = 1 THEN (h % 12 + 12) * 3600 + m * 60
                                 ELSE h * 3600 + m * 60 END AS INTEGER) AS seconds
    FROM (SELECT o_orderkey, o_orderkey % 26 AS h, o_orderkey % 61 AS m, o_orderkey % 3 AS half FROM orders)"""
ORACLES["stored_tables"] = _sql(f"SELECT {_CRD_OUT.format(canceled='Canceled', paid='Paid')} FROM crd")

# Streams, after everything has arrived.
ORACLES["stream_occupancy"] = _sql(
    """SELECT d.ConferenceDayID, CAST(coalesce(taken, 0) AS BIGINT) AS taken, f.free_places
       FROM days d JOIN day_free f USING (ConferenceDayID) LEFT JOIN day_taken USING (ConferenceDayID)"""
)
ORACLES["stream_workshop_occupancy"] = _sql(
    """SELECT WorkshopID, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST("Limit" - coalesce(taken, 0) AS BIGINT) AS free_places
       FROM shops LEFT JOIN (SELECT l_partkey, sum(CAST(l_quantity AS INTEGER)) AS taken FROM lineitem
                             WHERE l_returnflag <> 'R' GROUP BY 1) ON l_partkey = WorkshopID"""
)
ORACLES["stream_admission"] = _replay_sql(
    _DAY_ROWS.format(lim='c."Limit"', more=""),
    "SELECT r.ReservationDayID, r.ConferenceDayID, ok AS admitted FROM crd r JOIN walk ON walk.id = r.ReservationDayID",
)
ORACLES["stream_workshop_admission"] = _replay_sql(
    """SELECT o_orderkey % n AS k, o_orderkey AS id, CAST(o_orderkey % 97 AS BIGINT) AS q, CAST(w."Limit" AS BIGINT) AS lim
       FROM orders, (SELECT count(*) AS n FROM part) JOIN shops w ON true
       WHERE w.WorkshopID = o_orderkey % n AND o_orderstatus <> 'P'""",
    """SELECT o_orderkey AS ReservationID, o_orderkey % (SELECT count(*) FROM part) AS WorkshopID, coalesce(ok, true) AS admitted
       FROM orders LEFT JOIN walk ON walk.id = o_orderkey""",
)
ORACLES["stream_payments"] = _sql(f"SELECT ClientID, {_COUNTER} FROM clients")
ORACLES["stream_paid_reservations"] = _sql(
    "SELECT ReservationDayID, Paid OR ReservationDayID IN (SELECT ReservationDayID FROM pays) AS Paid FROM crd"
)

# The same rows when they arrive in several batches, in order of their keys.
ORACLES |= {f"{name}_batches": text for name, text in ORACLES.items() if name.startswith("stream_")}
# Reservations as a stream as well: the same counts in whatever order events come.
ORACLES["stream_joined_payments"] = ORACLES["stream_payments"]

# Tables that break each rule at fixed key steps: which rows do follows from the steps.
_STEPS = {"Conferences": 7, "ConferenceDays": 13}


def _broken_at(table: str, position: int) -> str:
    return f"{_KEYS[table]} % {_STEPS.get(table, 101)} = {position}"


def _each_column(kind: str) -> str:
    parts = []
    for table, spec in TABLES.items():
        columns = [c for c in spec.columns if not c.secret and c.name != spec.key]
        for position, c in enumerate(columns):
            text = f"{c.name} is required" if kind == "NN" else f"{c.name} is longer than {c.length}"
            if c.required if kind == "NN" else c.length:
                parts.append(
                    f"""SELECT '{table}' AS table_name, '{kind} {table}.{c.name}' AS rule, CAST({_KEYS[table]} AS BIGINT) AS key,
                               '{text}' AS message FROM {_NAMES[table]} WHERE {_broken_at(table, position)}"""
                )
    return _sql(" UNION ALL ".join(parts))


ORACLES["violations_of_every_nn"] = _each_column("NN")
ORACLES["violations_of_every_len"] = _each_column("LEN")
ORACLES["violations_of_every_pk"] = _sql(
    " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, 'PK {table}.{key}' AS rule, CAST({key} AS BIGINT) AS key, 'key occurs 2 times' AS message
            FROM {_NAMES[table]} WHERE {_broken_at(table, 0)}"""
        for table, key in _KEYS.items()
    )
)
ORACLES["violations_of_every_chk"] = _sql(
    f"""SELECT 'Clients' AS table_name, 'CHK-1' AS rule, ClientID AS key, 'ServiceCounter must be above 0' AS message FROM clients WHERE {_broken_at("Clients", 0)}
       UNION ALL SELECT 'Clients', 'CHK-2', ClientID, 'Email must contain @' FROM clients WHERE {_broken_at("Clients", 1)} OR Email NOT LIKE '%@%'
       UNION ALL SELECT 'Clients', 'CHK-3', ClientID, 'Phone must not contain letters' FROM clients WHERE {_broken_at("Clients", 2)} OR regexp_matches(Phone, '[A-Za-z]')
       UNION ALL SELECT 'Conferences', 'CHK-4', ConferenceID, 'Limit must be above 0' FROM conf WHERE {_broken_at("Conferences", 0)}
       UNION ALL SELECT 'Conferences', 'CHK-5', ConferenceID, 'Start must be before End' FROM conf WHERE {_broken_at("Conferences", 1)}
       UNION ALL SELECT 'Workshops', 'CHK-6', WorkshopID, 'Limit must be above 0' FROM shops WHERE {_broken_at("Workshops", 0)}
       UNION ALL SELECT 'Workshops', 'CHK-7', WorkshopID, 'Start must be before End' FROM shops WHERE {_broken_at("Workshops", 1)}"""
)
ORACLES["available_day_places_unknown_flags"] = _sql(
    """SELECT d.ConferenceDayID, CAST(c."Limit" - coalesce(taken, 0) AS BIGINT) AS free_places
       FROM days d JOIN conf c USING (ConferenceID) LEFT JOIN (
            SELECT ConferenceDayID, sum(N + S) AS taken FROM crd WHERE NOT Canceled AND ReservationDayID % 5 <> 0 GROUP BY 1) USING (ConferenceDayID)"""
)

# One key of a report: its rows among those of all keys.
ORACLES["free_workshops_of_conference"] = f"SELECT * FROM ({ORACLES['free_workshops']}) WHERE ConferenceID = 3"
ORACLES["client_debt_of_participant"] = f"SELECT * FROM ({ORACLES['client_debt_by_participant']}) WHERE ParticipantID = 3"
