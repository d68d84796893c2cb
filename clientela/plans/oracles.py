"""The catalogue's queries in plain SQL, written independently of the Spark code.

Joins are spelled out one by one where the Spark side folds them together, and
quantiles, rankings and pair counts use SQL's own means. The SQL runs in DuckDB
on views named like the parquet files.
"""

from __future__ import annotations

from clientela.plans.catalogue import FLAGS, PAIR_SUPPORT, RULE_CONFIDENCE, RULE_SUPPORT, TARGETS

KEYS = "ID_CLI, ID_CAMP, ID_DELIVERY"


def _same(a: str, b: str, columns: str) -> str:
    return " AND ".join(
        f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in columns.split(", ")
    )


def _distinct(column: str) -> str:
    """Distinct values, null counted as one."""
    return f"count(DISTINCT {column}) + coalesce(max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END), 0)"


def _prep(letter: str, word: str, code: str) -> str:
    return f"""SELECT ID_EVENT AS ID_EVENT_{letter}, {KEYS}, TYP_CAMP,
        EVENT_DATETIME AS {word}_DATETIME, EVENT_DATE AS {word}_DATE
        FROM event_clean WHERE TYP_EVENT = '{code}'"""


def _first(prep: str, letter: str, word: str) -> str:
    return f"""SELECT * EXCLUDE (rn, n_rows, n_dated) FROM (
        SELECT *, row_number() OVER (PARTITION BY {KEYS}
                 ORDER BY {word}_DATETIME, ID_EVENT_{letter} NULLS LAST, TYP_CAMP) AS rn,
               count(*) OVER (PARTITION BY {KEYS}) AS n_rows,
               count({word}_DATETIME) OVER (PARTITION BY {KEYS}) AS n_dated
        FROM {prep}) WHERE rn = 1 AND n_rows = n_dated"""


def _churn(horizon: str) -> str:
    return f"""
        SELECT ID_CLI, max(TIC_DATE) FILTER (TIC_DATE <= ref) AS LAST_DATE,
               CAST(max(ref) - max(TIC_DATE) FILTER (TIC_DATE <= ref) AS INTEGER) AS RECENCY,
               count(DISTINCT ID_TICKET) FILTER (TIC_DATE <= ref) AS FREQUENCY,
               CAST(sum(CAST(AMOUNT AS DECIMAL(18,2))) FILTER (TIC_DATE <= ref) AS DOUBLE) AS MONETARY,
               count(*) FILTER (TIC_DATE > ref) = 0 AS CHURNED
        FROM purchases, (SELECT max(TIC_DATE) - {horizon} AS ref FROM fx_ticket)
        GROUP BY ID_CLI HAVING count(*) FILTER (TIC_DATE <= ref) > 0"""


def _cell() -> str:
    """Scores R, F and M by the limits r, f and m."""

    def passed(value: str, limits: str) -> str:
        return " + ".join(f"({value} > {limits}[{i}])::INT" for i in range(1, 5))

    return f"""5 - ({passed('RECENCY', 'r')}) AS R, 1 + {passed('FREQUENCY', 'f')} AS F,
               1 + {passed('MONETARY', 'm')} AS M"""


def _newton(steps: int = 25, ridge: float = 0.01) -> str:
    """Weights k, b0 to b3 of the regressions on ``model_points`` after so many Newton steps."""
    x = ["1", "x1", "x2", "x3"]
    upper = [(i, j) for i in range(4) for j in range(i, 4)]
    z = "b0 + b1 * x1 + b2 * x2 + b3 * x3"
    sums = ", ".join(
        [f"sum((p - y) * {x[i]}) / count(*) + {ridge if i else 0} * b{i} AS g{i}" for i in range(4)]
        + [f"sum(p * (1 - p) * {x[i]} * {x[j]}) / count(*) + {ridge if i == j > 0 else 0} AS h{i}{j}" for i, j in upper]
    )
    system = f"""SELECT i, k, b0, b1, b2, b3, {sums}
        FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM step JOIN model_points USING (k) WHERE i < {steps})
        GROUP BY i, k, b0, b1, b2, b3"""
    for c in range(3):
        rows = ", ".join(
            [f"h{i}{j} - h{c}{i} * h{c}{j} / h{c}{c} AS h{i}{j}" for i, j in upper if i > c]
            + [f"g{i} - h{c}{i} * g{c} / h{c}{c} AS g{i}" for i in range(c + 1, 4)]
        )
        system = f"SELECT * REPLACE ({rows}) FROM ({system})"
    return f"""
        WITH RECURSIVE step(i, k, b0, b1, b2, b3) AS (
          SELECT 0, k, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM model_scale
          UNION ALL
          SELECT i + 1, k, b0 - d0, b1 - d1, b2 - d2, b3 - d3
          FROM (SELECT *, (g0 - h01 * d1 - h02 * d2 - h03 * d3) / h00 AS d0
                FROM (SELECT *, (g1 - h12 * d2 - h13 * d3) / h11 AS d1
                      FROM (SELECT *, (g2 - h23 * d3) / h22 AS d2
                            FROM (SELECT *, g3 / h33 AS d3 FROM ({system}))))))
        SELECT k, b0, b1, b2, b3, m1, s1, m2, s2, m3, s3 FROM step JOIN model_scale USING (k) WHERE i = {steps}"""


_INPUTS = "CAST(RECENCY AS DOUBLE) AS x1, ln(1 + FREQUENCY) AS x2, ln(1 + greatest(MONETARY, 0)) AS x3"
_MODELLED = """round(1 / (1 + exp(-(b0 + b1 * ((x1 - m1) / s1) + b2 * ((x2 - m2) / s2) + b3 * ((x3 - m3) / s3)))), 6)"""


# Named sub-queries, in an order in which each uses only earlier ones.
PARTS = {
    "fx_address": """
        WITH one AS (
          SELECT c_custkey AS k, n_name, r_name FROM customer
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        copies AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE k % 3 = 0)
        SELECT k AS ID_ADDRESS,
               CASE WHEN k % 29 <> 0 THEN lpad(CAST(k * 7 % 100000 AS VARCHAR), 5, '0') END AS CAP,
               CASE WHEN k % 17 <> 0 THEN n_name END AS PRV,
               CASE WHEN k % 23 <> 0 THEN r_name END AS REGION
        FROM copies
        UNION ALL SELECT NULL, '00100', 'NATION_0', 'AFRICA'""",
    "fx_account": """SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS ID_ADDRESS FROM orders""",
    "fx_campaign": "SELECT p_partkey AS ID_CAMP, p_type AS TYP_CAMP, 'EMAIL' AS CHANNEL_CAMP FROM part",
    "fx_event": """
        SELECT event_id AS ID_EVENT, user_id AS ID_CLI, k % 10 AS ID_CAMP,
               (k % 10) * 10 + (k // 10) % 2 AS ID_DELIVERY,
               CASE event_type WHEN 'signup' THEN 'S' WHEN 'view' THEN 'V' WHEN 'click' THEN 'C'
                    WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'B' END AS TYP_EVENT,
               strftime(ts, '%Y-%m-%dT%H:%M:%S') AS EVENT_DATE
        FROM (SELECT *, TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
    "fx_event_missing": """
        SELECT ID_EVENT, ID_CLI, CASE WHEN ID_EVENT % 13 = 1 THEN NULL ELSE ID_CAMP END AS ID_CAMP,
               CASE WHEN ID_EVENT % 7 = 2 THEN NULL ELSE ID_DELIVERY END AS ID_DELIVERY,
               CASE WHEN ID_EVENT % 31 = 3 THEN NULL ELSE TYP_EVENT END AS TYP_EVENT,
               CASE WHEN ID_EVENT % 17 = 4 THEN NULL ELSE EVENT_DATE END AS EVENT_DATE
        FROM fx_event""",
    "fx_ticket": """
        SELECT o_orderkey AS ID_TICKET, o_custkey AS ID_CLI, CAST(o_orderdate AS DATE) AS TIC_DATE,
               o_totalprice AS AMOUNT FROM orders""",
    "fx_basket": """
        SELECT DISTINCT l_orderkey AS ID_TICKET, p_brand AS ITEM
        FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_orderkey IS NOT NULL AND p_brand IS NOT NULL""",
    "purchases": "SELECT * FROM fx_ticket WHERE ID_CLI IS NOT NULL AND TIC_DATE IS NOT NULL",
    # addresses
    "addr_clean": """
        SELECT DISTINCT * FROM fx_address
        WHERE CAP IS NOT NULL AND PRV IS NOT NULL AND REGION IS NOT NULL""",
    "dist_province": f"""
        SELECT PRV, {_distinct('ID_ADDRESS')} AS TOT_ID_ADDRESS,
               ({_distinct('ID_ADDRESS')}) / sum({_distinct('ID_ADDRESS')}) OVER () AS PERCENT
        FROM addr_clean GROUP BY PRV""",
    "dist_region": f"""
        SELECT REGION, {_distinct('ID_ADDRESS')} AS TOT_ID_ADDRESS,
               ({_distinct('ID_ADDRESS')}) / sum({_distinct('ID_ADDRESS')}) OVER () AS PERCENT
        FROM addr_clean GROUP BY REGION""",
    "covered": """
        SELECT *, sum(TOT_ID_ADDRESS) OVER (ORDER BY PERCENT DESC, PRV ROWS UNBOUNDED PRECEDING)
                  / sum(TOT_ID_ADDRESS) OVER () AS PERCENT_COVERED
        FROM dist_province""",
    "marked": """
        SELECT *, PERCENT_COVERED < 0.5 OR (PERCENT_COVERED > 0.5
                  AND lag(PERCENT_COVERED) OVER (ORDER BY PERCENT DESC, PRV) < 0.5) AS AUX
        FROM covered""",
    "best_prv": """
        SELECT *, CASE WHEN AUX IS NULL THEN NULL WHEN AUX THEN PRV ELSE 'others' END AS BEST_PRV
        FROM marked""",
    # events
    "event_source": "SELECT * FROM fx_event",
    "event_typed": """
        SELECT * REPLACE (CAST(EVENT_DATETIME AS DATE) AS EVENT_DATE),
               CAST(hour(EVENT_DATETIME) AS INTEGER) AS EVENT_HOUR
        FROM (SELECT *, strptime(EVENT_DATE, '%Y-%m-%dT%H:%M:%S') AS EVENT_DATETIME
              FROM event_source)""",
    "event_clean": """
        SELECT e.* REPLACE (CASE WHEN TYP_EVENT IN ('E', 'B') THEN 'F' ELSE TYP_EVENT END AS TYP_EVENT),
               c.TYP_CAMP
        FROM event_typed e LEFT JOIN fx_campaign c ON e.ID_CAMP IS NOT DISTINCT FROM c.ID_CAMP""",
    "sends": f"""
        SELECT ID_EVENT AS ID_EVENT_S, {KEYS}, TYP_CAMP, EVENT_DATE AS SEND_DATE
        FROM event_clean WHERE TYP_EVENT = 'S'""",
    "opens_prep": _prep("O", "OPEN", "V"),
    "total_opens": f"SELECT {KEYS}, {_distinct('ID_EVENT_O')} AS NUM_OPENs FROM opens_prep GROUP BY {KEYS}",
    "opens_counted": f"""
        SELECT p.*, t.NUM_OPENs FROM opens_prep p LEFT JOIN total_opens t ON {_same('p', 't', KEYS)}""",
    "opens": _first("opens_counted", "O", "OPEN"),
    "clicks_prep": _prep("C", "CLICK", "C"),
    "total_clicks": f"SELECT {KEYS}, {_distinct('ID_EVENT_C')} AS NUM_CLICKs FROM clicks_prep GROUP BY {KEYS}",
    "clicks_counted": f"""
        SELECT p.*, t.NUM_CLICKs FROM clicks_prep p LEFT JOIN total_clicks t ON {_same('p', 't', KEYS)}""",
    "clicks": _first("clicks_counted", "C", "CLICK"),
    "fails_prep": _prep("F", "FAIL", "F"),
    "fails": _first("fails_prep", "F", "FAIL"),
    "funnel_opens": f"""
        SELECT s.*, o.ID_EVENT_O, o.OPEN_DATE, o.NUM_OPENs
        FROM sends s LEFT JOIN opens o ON {_same('s', 'o', KEYS + ', TYP_CAMP')}
        WHERE o.OPEN_DATE IS NULL OR s.SEND_DATE <= o.OPEN_DATE""",
    "funnel_clicks": f"""
        SELECT s.*, c.ID_EVENT_C, c.CLICK_DATE, c.NUM_CLICKs
        FROM funnel_opens s LEFT JOIN clicks c ON {_same('s', 'c', KEYS + ', TYP_CAMP')}
        WHERE c.CLICK_DATE IS NULL OR s.OPEN_DATE <= c.CLICK_DATE""",
    "funnel_fails": f"""
        SELECT s.*, f.ID_EVENT_F
        FROM funnel_clicks s LEFT JOIN fails f ON {_same('s', 'f', KEYS + ', TYP_CAMP')}
        WHERE f.FAIL_DATE IS NULL OR s.SEND_DATE <= f.FAIL_DATE""",
    "funnel": f"""
        SELECT ID_EVENT_S, {KEYS}, TYP_CAMP, SEND_DATE,
               ID_EVENT_O IS NOT NULL AS OPENED, OPEN_DATE,
               CAST(date_diff('day', SEND_DATE, OPEN_DATE) AS INTEGER) AS DAYS_TO_OPEN, NUM_OPENs,
               ID_EVENT_C IS NOT NULL AS CLICKED, CLICK_DATE, NUM_CLICKs,
               ID_EVENT_F IS NOT NULL AS FAILED
        FROM funnel_fails""",
    "days_to_open": """
        SELECT AVG_DAYS_TO_OPEN, count(*) AS TOT_CLIs
        FROM (SELECT ID_CLI, CAST(floor(avg(DAYS_TO_OPEN)) AS DOUBLE) AS AVG_DAYS_TO_OPEN
              FROM funnel WHERE OPENED GROUP BY ID_CLI)
        GROUP BY AVG_DAYS_TO_OPEN""",
    "days_cumulative": """
        SELECT *, sum(TOT_CLIs) OVER (ORDER BY AVG_DAYS_TO_OPEN) / sum(TOT_CLIs) OVER () AS PERCENT_COVERED
        FROM days_to_open""",
    # repurchase interval
    "gaps": """
        SELECT * FROM (
          SELECT ID_CLI, TIC_DATE, CAST(TIC_DATE - lag(TIC_DATE) OVER (PARTITION BY ID_CLI
                 ORDER BY TIC_DATE, ID_TICKET) AS INTEGER) AS diff
          FROM purchases)
        WHERE diff > 0""",
    "longest": "SELECT ID_CLI, max(diff) AS Max FROM gaps GROUP BY ID_CLI",
    "clocks": """
        SELECT ID_CLI, CAST(coalesce(following, (SELECT max(TIC_DATE) FROM fx_ticket)) - TIC_DATE AS INTEGER) AS DAYS,
               following IS NOT NULL AS RETURNED
        FROM (SELECT ID_CLI, TIC_DATE, lead(TIC_DATE) OVER (PARTITION BY ID_CLI ORDER BY TIC_DATE) AS following
              FROM (SELECT DISTINCT ID_CLI, TIC_DATE FROM purchases))""",
    "ended": """
        SELECT DAYS, count(*) FILTER (RETURNED) AS RETURNED, count(*) FILTER (NOT RETURNED) AS CENSORED
        FROM clocks GROUP BY DAYS""",
    "running": """
        SELECT a.DAYS, a.RETURNED, a.CENSORED, CAST(sum(b.RETURNED + b.CENSORED) AS BIGINT) AS AT_RISK
        FROM ended a JOIN ended b ON b.DAYS >= a.DAYS GROUP BY ALL""",
    "survival": """
        SELECT a.DAYS, a.AT_RISK, a.RETURNED, a.CENSORED, round(product(1 - b.RETURNED / b.AT_RISK), 9) AS SURVIVAL
        FROM running a JOIN running b ON b.DAYS <= a.DAYS GROUP BY ALL""",
    # customer value
    "rfm_base": """
        SELECT ID_CLI, max(TIC_DATE) AS LAST_DATE,
               CAST((SELECT max(TIC_DATE) FROM fx_ticket) - max(TIC_DATE) AS INTEGER) AS RECENCY,
               count(DISTINCT ID_TICKET) AS FREQUENCY,
               CAST(sum(CAST(AMOUNT AS DECIMAL(18,2))) AS DOUBLE) AS MONETARY
        FROM purchases GROUP BY ID_CLI""",
    "rfm_cuts": """
        SELECT quantile_cont(CAST(RECENCY AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS r,
               quantile_cont(CAST(FREQUENCY AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS f,
               quantile_cont(MONETARY, [0.2, 0.4, 0.6, 0.8]) AS m
        FROM rfm_base""",
    "rfm_scores": """
        SELECT ID_CLI, RECENCY, FREQUENCY, MONETARY,
               CAST(5 - (RECENCY > r[1])::INT - (RECENCY > r[2])::INT - (RECENCY > r[3])::INT
                      - (RECENCY > r[4])::INT AS INTEGER) AS R_SCORE,
               CAST(1 + (FREQUENCY > f[1])::INT + (FREQUENCY > f[2])::INT + (FREQUENCY > f[3])::INT
                      + (FREQUENCY > f[4])::INT AS INTEGER) AS F_SCORE,
               CAST(1 + (MONETARY > m[1])::INT + (MONETARY > m[2])::INT + (MONETARY > m[3])::INT
                      + (MONETARY > m[4])::INT AS INTEGER) AS M_SCORE
        FROM rfm_base, rfm_cuts""",
    "rfm_named": """
        SELECT *, CASE
            WHEN R_SCORE >= 4 AND F_SCORE >= 4 AND M_SCORE >= 4 THEN 'champions'
            WHEN R_SCORE <= 2 AND F_SCORE >= 4 AND M_SCORE >= 4 THEN 'at risk'
            WHEN F_SCORE >= 4 THEN 'loyal'
            WHEN M_SCORE >= 4 THEN 'big spenders'
            WHEN R_SCORE >= 4 AND F_SCORE <= 2 THEN 'new or rare'
            WHEN R_SCORE <= 2 AND F_SCORE <= 2 THEN 'lost'
            ELSE 'regular' END AS SEGMENT
        FROM rfm_scores""",
    # churn: rates of the cells of three scores, in and out of folds
    "labels": _churn(
        "( SELECT CAST(ceil(quantile_cont(CAST(Max AS DOUBLE), 0.9)) AS INTEGER) FROM longest )"
    ),
    "label_cuts": """
        SELECT quantile_cont(CAST(RECENCY AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS r,
               quantile_cont(CAST(FREQUENCY AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS f,
               quantile_cont(MONETARY, [0.2, 0.4, 0.6, 0.8]) AS m
        FROM labels""",
    "label_cells": f"SELECT CHURNED, ((ID_CLI % 3) + 3) % 3 AS FOLD, {_cell()} FROM labels, label_cuts",
    "cells": """
        SELECT r.i AS R, f.i AS F, m.i AS M
        FROM range(1, 6) r(i), range(1, 6) f(i), range(1, 6) m(i)""",
    "rates": """
        SELECT R, F, M, coalesce(
                 (SELECT avg(CHURNED::INT) FROM label_cells l WHERE l.R = c.R AND l.F = c.F AND l.M = c.M),
                 (SELECT avg(CHURNED::INT) FROM label_cells l WHERE l.R = c.R),
                 (SELECT avg(CHURNED::INT) FROM label_cells l)) AS P
        FROM cells c""",
    "churn_scored": f"""
        SELECT b.*, P AS CHURN_PROBABILITY
        FROM (SELECT ID_CLI, RECENCY, FREQUENCY, MONETARY, {_cell()} FROM rfm_base, label_cuts) b
        JOIN rates USING (R, F, M)""",
    "held_out": """
        SELECT o.FOLD, o.CHURNED, coalesce(
                 (SELECT avg(CHURNED::INT) FROM label_cells l
                  WHERE l.FOLD <> o.FOLD AND l.R = o.R AND l.F = o.F AND l.M = o.M),
                 (SELECT avg(CHURNED::INT) FROM label_cells l WHERE l.FOLD <> o.FOLD AND l.R = o.R),
                 (SELECT avg(CHURNED::INT) FROM label_cells l WHERE l.FOLD <> o.FOLD)) AS P
        FROM label_cells o""",
    "held_out_counts": """
        SELECT FOLD, P, count(*) FILTER (CHURNED) AS pos, count(*) FILTER (NOT CHURNED) AS neg
        FROM held_out GROUP BY FOLD, P""",
    # churn: regressions on everyone (k = -1) and on all folds but one
    "model_rows": f"SELECT ID_CLI, ((ID_CLI % 3) + 3) % 3 AS FOLD, CHURNED, CHURNED::INT AS y, {_INPUTS} FROM labels",
    "model_members": "SELECT k, y, x1, x2, x3 FROM model_rows, range(-1, 3) r(k) WHERE k <> FOLD",
    "model_scale": "SELECT k, " + ", ".join(
        f"avg(x{j}) AS m{j}, coalesce(nullif(stddev_pop(x{j}), 0), 1) AS s{j}" for j in (1, 2, 3)
    ) + " FROM model_members GROUP BY k",
    "model_points": "SELECT k, y, " + ", ".join(f"(x{j} - m{j}) / s{j} AS x{j}" for j in (1, 2, 3))
    + " FROM model_members JOIN model_scale USING (k)",
    "newton": _newton(),
    "modelled": f"SELECT FOLD, CHURNED, {_MODELLED} AS P FROM model_rows JOIN newton ON k = FOLD",
    "modelled_counts": """
        SELECT FOLD, P, count(*) FILTER (CHURNED) AS pos, count(*) FILTER (NOT CHURNED) AS neg
        FROM modelled GROUP BY FOLD, P""",
    # baskets
    "basket_total": "SELECT count(DISTINCT ID_TICKET) AS total FROM fx_basket",
    "items": "SELECT ITEM, count(*) AS n FROM fx_basket GROUP BY ITEM",
    "pairs": """
        SELECT a.ITEM AS ITEM_A, b.ITEM AS ITEM_B, count(*) AS n
        FROM fx_basket a JOIN fx_basket b ON a.ID_TICKET = b.ID_TICKET AND a.ITEM < b.ITEM
        GROUP BY ALL""",
    "least": f"SELECT ceil(CAST({RULE_SUPPORT} AS DOUBLE) * total) AS few FROM basket_total",
    # Sets of each ticket's items, one item longer per step, while they are frequent.
    "grown": """
        WITH RECURSIVE grown(ID_TICKET, list, last, n) AS (
          SELECT ID_TICKET, [ITEM], ITEM, n FROM fx_basket JOIN items USING (ITEM) WHERE n >= (SELECT few FROM least)
          UNION ALL
          SELECT * FROM (
            SELECT ID_TICKET, list, last, count(*) OVER (PARTITION BY list) AS n
            FROM (SELECT g.ID_TICKET, list_append(g.list, b.ITEM) AS list, b.ITEM AS last
                  FROM grown g JOIN fx_basket b ON g.ID_TICKET = b.ID_TICKET AND b.ITEM > g.last))
          WHERE n >= (SELECT few FROM least))
        SELECT list, min(n) AS n FROM grown GROUP BY list""",
    "frequent": "SELECT array_to_string(list, '|') AS ITEMS, list, n, total FROM grown, basket_total",
    "split": """
        SELECT array_to_string(list_filter(list, lambda x: x <> c), '|') AS ANTECEDENT,
               c AS CONSEQUENT, n, total
        FROM (SELECT *, unnest(list) AS c FROM frequent WHERE len(list) > 1)""",
}

MISSING_SOURCE = {"event_source": "SELECT * FROM fx_event_missing"}


def _uses(sql: str, name: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return name in words


def query(final: str, parts: dict[str, str] = PARTS) -> str:
    """``final`` preceded by the sub-queries it needs, directly or indirectly."""
    needed, text = [], final
    for name in reversed(parts):
        if _uses(text, name):
            needed.append(name)
            text += "\n" + parts[name]
    # Materialised, or a self-join would be evaluated for each of its uses.
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({parts[name]})" for name in reversed(needed))
    return f"WITH {ctes}\n{final}" if ctes else final


def _audit(left: str, right: str, key: str, a: str, b: str, count: str) -> str:
    return f"""
        SELECT {a}, {b}, {_distinct('k')} AS {count} FROM (
          SELECT l.{a}, r.{b}, coalesce(l.{key}, r.{key}) AS k
          FROM (SELECT DISTINCT {key}, CAST(1 AS INTEGER) AS {a} FROM {left}) l
          FULL JOIN (SELECT DISTINCT {key}, CAST(1 AS INTEGER) AS {b} FROM {right}) r
          ON l.{key} IS NOT DISTINCT FROM r.{key})
        GROUP BY {a}, {b}"""


def _overview(by: str) -> str:
    return f"""
        SELECT {by + ',' if by else ''} min(SEND_DATE) AS MIN_DATE, max(SEND_DATE) AS MAX_DATE,
               {_distinct('ID_EVENT_S')} AS TOT_EVENTs, {_distinct('ID_CLI')} AS TOT_CLIs
        FROM funnel {'GROUP BY ' + by if by else ''}"""


def _shares(flag: str, by_type: bool) -> str:
    if not by_type:
        return f"""
            SELECT 'ALL' AS TYP_CAMP, {flag}, TOT_EVENTs, TOT_CLIs,
                   TOT_EVENTs / all_events AS PERCENT_EVENTs, TOT_CLIs / all_clients AS PERCENT_CLIs
            FROM (SELECT {flag}, {_distinct('ID_EVENT_S')} AS TOT_EVENTs,
                         {_distinct('ID_CLI')} AS TOT_CLIs FROM funnel GROUP BY {flag}),
                 (SELECT {_distinct('ID_EVENT_S')} AS all_events,
                         {_distinct('ID_CLI')} AS all_clients FROM funnel)"""
    return f"""
        SELECT p.TYP_CAMP, {flag}, TOT_EVENTs, TOT_CLIs,
               TOT_EVENTs / all_events AS PERCENT_EVENTs, TOT_CLIs / all_clients AS PERCENT_CLIs
        FROM (SELECT TYP_CAMP, {flag}, {_distinct('ID_EVENT_S')} AS TOT_EVENTs,
                     {_distinct('ID_CLI')} AS TOT_CLIs FROM funnel GROUP BY TYP_CAMP, {flag}) p
        LEFT JOIN (SELECT TYP_CAMP, {_distinct('ID_EVENT_S')} AS all_events,
                          {_distinct('ID_CLI')} AS all_clients FROM funnel GROUP BY TYP_CAMP) t
        ON p.TYP_CAMP IS NOT DISTINCT FROM t.TYP_CAMP"""


def _stack(flag: str) -> str:
    return f"SELECT TYP_CAMP, {flag}, TOT_EVENTs FROM ({_shares(flag, True)})"


def _fill(flag: str, by_type: bool) -> str:
    return f"""
        SELECT TYP_CAMP, {flag}, TOT_EVENTs,
               TOT_EVENTs / sum(TOT_EVENTs) OVER (PARTITION BY TYP_CAMP) AS SHARE
        FROM ({_shares(flag, by_type)})"""


def _count_share(column: str) -> str:
    n = _distinct("ID_CLI")
    return f"""
        SELECT {column}, {n} AS TOT_ID_CLI, ({n}) / sum({n}) OVER () AS PERCENT
        FROM funnel GROUP BY {column}"""


def _profile(source: str, columns: dict[str, str]) -> str:
    """``columns`` maps a name to its Spark type."""
    selects = []
    for name, kind in columns.items():
        number = {
            "string": "CAST(NULL AS DOUBLE)",
            "boolean": f"CAST(CAST({name} AS INTEGER) AS DOUBLE)",
            "date": f"CAST({name} - DATE '1970-01-01' AS DOUBLE)",
        }.get(kind, f"CAST({name} AS DOUBLE)")
        selects.append(f"""
            SELECT '{name}' AS "COLUMN", '{kind}' AS "TYPE", count(*) AS N_ROWS,
                   count(*) - count({name}) AS N_MISSING, min(v) AS "MIN",
                   quantile_cont(v, 0.25) AS Q1, quantile_cont(v, 0.5) AS "MEDIAN",
                   avg(v) AS "MEAN", quantile_cont(v, 0.75) AS Q3, max(v) AS "MAX"
            FROM (SELECT {name}, {number} AS v FROM {source})""")
    return " UNION ALL ".join(selects)


def _auc(counts: str) -> str:
    return f"""
        SELECT CAST(a.FOLD AS INTEGER) AS FOLD,
               sum(a.pos * b.neg * CASE WHEN a.P > b.P THEN 2 WHEN a.P = b.P THEN 1 ELSE 0 END)
               / nullif(2 * sum(a.pos * b.neg), 0) AS AUC
        FROM {counts} a JOIN {counts} b ON a.FOLD = b.FOLD
        GROUP BY a.FOLD"""


def _levels(source: str, columns: list[str]) -> str:
    selects = []
    for name in columns:
        ranked = f"""
            SELECT {name} AS level, count(*) AS n,
                   row_number() OVER (ORDER BY count(*) DESC, {name}) AS r
            FROM {source} WHERE {name} IS NOT NULL GROUP BY {name}"""
        selects += [
            f"SELECT '{name}' AS \"COLUMN\", level AS LEVEL, n AS N FROM ({ranked}) WHERE r <= 6",
            f"""SELECT '{name}', '(Other)', CAST(sum(n) AS BIGINT) FROM ({ranked}) WHERE r > 6
                HAVING count(*) > 0""",
            f"""SELECT '{name}', NULL, count(*) FROM {source} WHERE {name} IS NULL
                HAVING count(*) > 0""",
        ]
    return " UNION ALL ".join(selects)


ADDRESS = {"ID_ADDRESS": "bigint", "CAP": "string", "PRV": "string", "REGION": "string"}
CAMPAIGN = {"ID_CAMP": "bigint", "TYP_CAMP": "string", "CHANNEL_CAMP": "string"}
EVENT = {
    "ID_EVENT": "bigint", "ID_CLI": "bigint", "ID_CAMP": "bigint", "ID_DELIVERY": "bigint",
    "TYP_EVENT": "string", "EVENT_DATE": "string",
}
FUNNEL = {
    "ID_EVENT_S": "bigint", "ID_CLI": "bigint", "ID_CAMP": "bigint", "TYP_CAMP": "string",
    "ID_DELIVERY": "bigint", "SEND_DATE": "date", "OPENED": "boolean", "OPEN_DATE": "date",
    "DAYS_TO_OPEN": "int", "NUM_OPENs": "bigint", "CLICKED": "boolean", "CLICK_DATE": "date",
    "NUM_CLICKs": "bigint", "FAILED": "boolean",
}

_FINAL = {
    "csv_round_trip": "SELECT * FROM fx_event",
    "csv_round_trip_ticket": "SELECT * FROM fx_ticket",
    "csv_round_trip_address": "SELECT * FROM fx_address",
    "csv_round_trip_campaign": "SELECT * FROM fx_campaign",
    "csv_round_trip_account": "SELECT * FROM fx_account",
    "csv_round_trip_fidelity": "SELECT c_custkey AS ID_CLI FROM customer",
    "csv_round_trip_multiline": """
        SELECT *, CASE ID_EVENT % 5 WHEN 0 THEN 'first line' || chr(10) || 'second of ' || ID_EVENT
                    WHEN 1 THEN 'said "yes";' || chr(13) || chr(10) || chr(13) || chr(10) || 'then left'
                    WHEN 2 THEN chr(10) WHEN 3 THEN 'one line' END AS NOTE
        FROM fx_event""",
    "na_tokens_default": "SELECT * FROM fx_event_missing",
    "na_tokens_address": """
        SELECT * REPLACE (CASE PRV WHEN 'NATION_0' THEN 'NA' ELSE PRV END AS PRV) FROM fx_address""",
    "sink_region_csv": "SELECT * FROM dist_region",
    "addr_duplicate_audit": f"""
        SELECT {_distinct('ID_ADDRESS')} AS TOT_ID_ADDRESSes, count(*) AS TOT_ROWs FROM fx_address""",
    "addr_distinct": "SELECT DISTINCT * FROM fx_address",
    "addr_missing_patterns": f"""
        SELECT CAP IS NOT NULL AS w_CAP, PRV IS NOT NULL AS w_PRV, REGION IS NOT NULL AS w_REGION,
               {_distinct('ID_ADDRESS')} AS TOT_ADDs
        FROM (SELECT DISTINCT * FROM fx_address) GROUP BY ALL""",
    "addr_prv_without_region": """
        SELECT DISTINCT * FROM fx_address WHERE PRV IS NOT NULL AND REGION IS NULL""",
    "addr_clean": "SELECT * FROM addr_clean",
    "dist_province": "SELECT * FROM dist_province",
    "dist_region": "SELECT * FROM dist_region",
    "addr_best_prv": "SELECT * FROM best_prv",
    "top20_province": "SELECT * FROM best_prv ORDER BY PERCENT DESC, PRV LIMIT 20",
    "chart_best_prv": """
        SELECT BEST_PRV, CAST(sum(TOT_ID_ADDRESS) AS BIGINT) AS TOT_ID_ADDRESS
        FROM best_prv GROUP BY BEST_PRV""",
    "null_safe_join": """
        SELECT a.ID_ADDRESS, c.CAP, c.PRV, c.REGION
        FROM fx_account a LEFT JOIN addr_clean c ON a.ID_ADDRESS IS NOT DISTINCT FROM c.ID_ADDRESS""",
    "consistency_address": _audit(
        "fx_account", "addr_clean", "ID_ADDRESS", "is_in_df_2", "is_in_df_3", "NUM_ID_ADDRESSes"
    ),
    "consistency_client": _audit(
        "( SELECT c_custkey AS ID_CLI FROM customer )", "fx_event",
        "ID_CLI", "is_in_df_1", "is_in_df_6", "NUM_ID_CLIs",
    ),
    "consistency_campaign": _audit(
        "fx_campaign", "fx_event", "ID_CAMP", "is_in_df_5", "is_in_df_6", "NUM_ID_CAMPs"
    ),
    "campaign_clean": "SELECT ID_CAMP, TYP_CAMP FROM fx_campaign",
    "event_typed": "SELECT * FROM event_typed",
    "event_recode": """
        SELECT * REPLACE (CASE WHEN TYP_EVENT IN ('E', 'B') THEN 'F' ELSE TYP_EVENT END AS TYP_EVENT)
        FROM fx_event""",
    "event_enriched": """
        SELECT e.*, c.TYP_CAMP FROM fx_event e
        LEFT JOIN fx_campaign c ON e.ID_CAMP IS NOT DISTINCT FROM c.ID_CAMP""",
    "event_clean": "SELECT * FROM event_clean",
    "touch_sends": "SELECT * FROM sends",
    "touch_opens": "SELECT * FROM opens",
    "touch_clicks": "SELECT * FROM clicks",
    "touch_fails": "SELECT * FROM fails",
    "touch_open_counts": "SELECT * FROM total_opens",
    "touch_click_counts": "SELECT * FROM total_clicks",
    "funnel": "SELECT * FROM funnel",
    "funnel_unique_ids": "SELECT * FROM funnel",
    "overview": _overview(""),
    "overview_by_type": _overview("TYP_CAMP"),
    "dist_num_opens": _count_share("NUM_OPENs"),
    "dist_num_clicks": _count_share("NUM_CLICKs"),
    "days_to_open_hist": "SELECT * FROM days_to_open",
    "days_to_open_cumulative": "SELECT * FROM days_cumulative",
    "chart_days_to_open": "SELECT * FROM days_to_open WHERE AVG_DAYS_TO_OPEN < 14",
    "chart_days_to_open_cumulative": "SELECT * FROM days_cumulative WHERE AVG_DAYS_TO_OPEN < 14",
    "chart_overview_by_type": f"SELECT TYP_CAMP, TOT_EVENTs FROM ( {_overview('TYP_CAMP')} )",
    "chart_num_opens": f"SELECT NUM_OPENs, TOT_ID_CLI FROM ( {_count_share('NUM_OPENs')} )",
    "chart_num_clicks": f"SELECT NUM_CLICKs, TOT_ID_CLI FROM ( {_count_share('NUM_CLICKs')} )",
    "flag_share_opened": _shares("OPENED", False),
    "chart_fill_opened": _fill("OPENED", False),
    **{f"flag_share_by_type_{name}": _shares(flag, True) for name, flag in FLAGS.items()},
    **{f"chart_stack_by_type_{name}": _stack(flag) for name, flag in FLAGS.items()},
    **{f"chart_fill_by_type_{name}": _fill(flag, True) for name, flag in FLAGS.items()},
    "profile_address": _profile("fx_address", ADDRESS),
    "profile_address_clean": _profile("addr_clean", ADDRESS),
    "profile_campaign": _profile("fx_campaign", CAMPAIGN),
    "profile_campaign_clean": _profile(
        "fx_campaign", {c: t for c, t in CAMPAIGN.items() if c != "CHANNEL_CAMP"}
    ),
    "profile_event": _profile("fx_event", EVENT),
    "profile_funnel": _profile("funnel", FUNNEL),
    "levels_address": _levels("fx_address", ["CAP", "PRV", "REGION"]),
    "levels_campaign": _levels("fx_campaign", ["TYP_CAMP", "CHANNEL_CAMP"]),
    "levels_address_clean": _levels("addr_clean", ["CAP", "PRV", "REGION"]),
    "levels_campaign_clean": _levels("fx_campaign", ["TYP_CAMP"]),
    "levels_funnel": _levels("funnel", ["TYP_CAMP"]),
    "levels_event": _levels("fx_event", ["TYP_EVENT", "EVENT_DATE"]),
    "repurchase_gaps": "SELECT * FROM gaps",
    "max_gap_per_customer": "SELECT * FROM longest",
    "gap_quantile_90": """
        SELECT quantile_cont(CAST(Max AS DOUBLE), 0.9) AS DAYS, count(*) AS CUSTOMERS FROM longest""",
    "gap_ecdf": """
        SELECT Max, count(*) AS n, min(c) AS SHARE
        FROM (SELECT Max, cume_dist() OVER (ORDER BY Max) AS c FROM longest) GROUP BY Max""",
    "rfm_base": "SELECT * FROM rfm_base",
    "rfm_scores": "SELECT * FROM rfm_scores",
    "rfm_segments": """
        SELECT SEGMENT, count(*) AS CUSTOMERS,
               CAST(sum(CAST(MONETARY AS DECIMAL(18,2))) AS DOUBLE) AS SPENT,
               count(*) / (SELECT count(*) FROM rfm_named) AS CUSTOMER_SHARE,
               CAST(sum(CAST(MONETARY AS DECIMAL(18,2))) AS DOUBLE)
               / (SELECT CAST(sum(CAST(MONETARY AS DECIMAL(18,2))) AS DOUBLE) FROM rfm_named) AS SPENT_SHARE
        FROM rfm_named GROUP BY SEGMENT""",
    "churn_labels": "SELECT * FROM labels",
    "churn_labels_160": _churn("160"),
    "churn_labels_rolling": """
        SELECT REF_DATE, ID_CLI, max(TIC_DATE) FILTER (TIC_DATE <= REF_DATE) AS LAST_DATE,
               CAST(max(REF_DATE) - max(TIC_DATE) FILTER (TIC_DATE <= REF_DATE) AS INTEGER) AS RECENCY,
               count(DISTINCT ID_TICKET) FILTER (TIC_DATE <= REF_DATE) AS FREQUENCY,
               CAST(sum(CAST(AMOUNT AS DECIMAL(18,2))) FILTER (TIC_DATE <= REF_DATE) AS DOUBLE) AS MONETARY,
               count(*) FILTER (TIC_DATE > REF_DATE AND TIC_DATE <= REF_DATE + ahead) = 0 AS CHURNED
        FROM purchases, (SELECT ahead, max_day - ahead - CAST(30 * w AS INTEGER) AS REF_DATE
                         FROM (SELECT max(TIC_DATE) AS max_day FROM fx_ticket),
                              (SELECT CAST(ceil(quantile_cont(CAST(Max AS DOUBLE), 0.9)) AS INTEGER) AS ahead FROM longest),
                              range(0, 12) r(w))
        GROUP BY ID_CLI, REF_DATE HAVING count(*) FILTER (TIC_DATE <= REF_DATE) > 0""",
    "churn_scores": "SELECT ID_CLI, RECENCY, FREQUENCY, MONETARY, CHURN_PROBABILITY FROM churn_scored",
    "churn_quality": _auc("held_out_counts"),
    "churn_model_scores": f"""
        SELECT ID_CLI, RECENCY, FREQUENCY, MONETARY, {_MODELLED} AS CHURN_PROBABILITY
        FROM (SELECT *, {_INPUTS} FROM rfm_base) JOIN newton ON k = -1""",
    "churn_model_quality": _auc("modelled_counts"),
    "churn_targets": """
        SELECT c.ID_CLI, RECENCY, FREQUENCY, MONETARY, CHURN_PROBABILITY,
               CHURN_PROBABILITY * MONETARY AS MONEY_AT_RISK, coalesce(SENDS, 0) AS SENDS,
               coalesce(OPENS, 0) AS OPENS, coalesce(CLICKS, 0) AS CLICKS
        FROM churn_scored c LEFT JOIN (
          SELECT ID_CLI, count(*) AS SENDS, count(*) FILTER (OPENED) AS OPENS,
                 count(*) FILTER (CLICKED) AS CLICKS
          FROM funnel GROUP BY ID_CLI) f ON c.ID_CLI = f.ID_CLI""",
    "churn_targets_top": f"""
        SELECT TYP_CAMP, ID_CLI, CHURN_PROBABILITY, MONEY_AT_RISK, CAST(RANK AS INTEGER) AS RANK
        FROM (SELECT *, row_number() OVER (PARTITION BY TYP_CAMP ORDER BY MONEY_AT_RISK DESC, ID_CLI) AS RANK
              FROM (SELECT DISTINCT TYP_CAMP, ID_CLI FROM funnel)
              JOIN (SELECT ID_CLI, CHURN_PROBABILITY, CHURN_PROBABILITY * MONETARY AS MONEY_AT_RISK FROM churn_scored) USING (ID_CLI))
        WHERE RANK <= {TARGETS}""",
    "gap_survival": "SELECT * FROM survival",
    "gap_survival_90": """
        SELECT min(DAYS) FILTER (SURVIVAL <= 0.1) AS DAYS, min(SURVIVAL) AS LAST_SURVIVAL,
               CAST(coalesce(sum(RETURNED + CENSORED), 0) AS BIGINT) AS CLOCKS
        FROM survival""",
    "sink_region_csv_file": "SELECT * FROM dist_region",
    "funnel_summary": " UNION ALL ".join(
        [
            f"SELECT '{scope}' AS SCOPE, TYP_CAMP, '{flag}' AS FLAG, {flag} AS SIDE, * EXCLUDE (TYP_CAMP, {flag})"
            f" FROM ({_shares(flag, scope == 'type')})"
            for scope in ("all", "type") for flag in FLAGS.values()
        ]
        + [
            f"SELECT '{scope}', {name}, NULL, NULL, TOT_EVENTs, TOT_CLIs, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE)"
            f" FROM ({_overview(by)})"
            for scope, name, by in (("all", "'ALL'", ""), ("type", "TYP_CAMP", "TYP_CAMP"))
        ]
    ),
    "basket_pairs": f"""
        SELECT ITEM_A, ITEM_B, p.n AS TICKETS, p.n / total AS SUPPORT,
               p.n / a.n AS CONFIDENCE_AB, p.n / b.n AS CONFIDENCE_BA,
               p.n / a.n / (b.n / total) AS LIFT
        FROM pairs p JOIN items a ON ITEM_A = a.ITEM JOIN items b ON ITEM_B = b.ITEM, basket_total
        WHERE p.n >= ceil(CAST({PAIR_SUPPORT} AS DOUBLE) * total)""",
    "basket_sets": "SELECT ITEMS, CAST(len(list) AS INTEGER) AS SIZE, n AS TICKETS FROM frequent",
    "basket_rules": f"""
        SELECT ANTECEDENT, CONSEQUENT, s.n / a.n AS CONFIDENCE, s.n / a.n / (c.n / s.total) AS LIFT,
               s.n / s.total AS SUPPORT
        FROM split s JOIN frequent a ON a.ITEMS = s.ANTECEDENT JOIN frequent c ON c.ITEMS = s.CONSEQUENT
        WHERE s.n / a.n >= {RULE_CONFIDENCE}""",
}

ORACLES: dict[str, str] = {name: query(sql) for name, sql in _FINAL.items()}
ORACLES["funnel_missing"] = query("SELECT * FROM funnel", {**PARTS, **MISSING_SOURCE})
