"""Feature, target and instrument queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlife.operators import features
from ledgerlife.plans.registry import query
from ledgerlife.sources.sample_tables import with_tables

_B2C = "b2c AS (SELECT * FROM trade_log WHERE party_code IN (SELECT party_code FROM client_kyc WHERE B2C = 'Y'))"
_DTU = f"""{_B2C},
    dtu AS (SELECT DISTINCT party_code, sauda_date FROM b2c)"""

_STATS = """,
    stats AS (
      SELECT dtu.party_code, dtu.sauda_date, count(DISTINCT h.sauda_date) AS trade_days_cnt,
             count(*) AS total_trades, CAST(sum(h.OC) AS BIGINT) AS total_order_count, avg(h.T_O) AS avg_investment
      FROM dtu JOIN trade_log h ON h.party_code = dtu.party_code
       AND h.sauda_date BETWEEN dtu.sauda_date - 30 AND dtu.sauda_date
      GROUP BY dtu.party_code, dtu.sauda_date)"""
_PICK_STATS = """
    SELECT party_code, sauda_date, trade_days_cnt, total_trades, total_order_count,
           round(avg_investment + 1e-9, 6) AS avg_investment FROM stats WHERE trade_days_cnt {cond}"""


def _rounded(df, *columns, digits=6):
    """Round for comparison; the small shift keeps exact ties off the edge in both engines."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in columns})


@query("cohort_trade_stats", with_tables("event_log kyc", _DTU + _STATS + _PICK_STATS.format(cond=">= 4")))
def cohort_trade_stats(t):
    return _rounded(features.cohort_trade_stats(t.event_log, t.kyc), "avg_investment")


@query("cohort_trade_stats_below_4", with_tables("purchase_log kyc", _DTU + _STATS + _PICK_STATS.format(cond="< 4")))
def cohort_trade_stats_below_4(t):
    return _rounded(
        features.cohort_trade_stats(t.purchase_log, t.kyc, min_days=None, max_days=3), "avg_investment"
    )


# Closed days of a span are counted per (party, day) against the days the calendar lacks.
_CLOSED = """,
    bounds AS (SELECT min(sauda_date) - 100 AS lo, max(sauda_date) + 100 AS hi FROM trade_log),
    closed AS (
      SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM bounds)
      WHERE CAST(d AS DATE) NOT IN (SELECT TradingDay FROM trading_days))"""
_NEXT = """,
    ahead AS (
      SELECT dtu.party_code, dtu.sauda_date, min(n.sauda_date) AS first_next,
             count(DISTINCT n.sauda_date) AS future_days
      FROM dtu LEFT JOIN trade_log n ON n.party_code = dtu.party_code
       AND n.sauda_date BETWEEN dtu.sauda_date + 1 AND dtu.sauda_date + 61
      GROUP BY dtu.party_code, dtu.sauda_date),
    next_trades AS (
      SELECT party_code, sauda_date, future_days,
             coalesce(CASE WHEN future_days {cond} THEN first_next END, sauda_date + 65) AS next_trade
      FROM ahead),
    spans AS (
      SELECT a, b, count(day) AS n FROM (SELECT DISTINCT sauda_date AS a, next_trade AS b FROM next_trades)
      LEFT JOIN closed ON day BETWEEN a AND b AND day <= a + 60 GROUP BY a, b),
    targets AS (
      SELECT party_code, sauda_date, future_days, next_trade,
             CAST(date_diff('day', sauda_date, next_trade) - 1 - n AS INTEGER) AS inactive_days
      FROM next_trades JOIN spans ON sauda_date = a AND next_trade = b)"""


@query(
    "next_trade_target",
    with_tables(
        "purchase_log kyc trading_days", _DTU + _CLOSED + _NEXT.format(cond=">= 1") + " SELECT * FROM targets"
    ),
)
def next_trade_target(t):
    trades = t.purchase_log
    return features.next_trade_target(trades, t.kyc, t.trading_days(trades))


@query(
    "next_trade_target_min_4",
    with_tables(
        "event_log kyc trading_days", _DTU + _CLOSED + _NEXT.format(cond=">= 4") + " SELECT * FROM targets"
    ),
)
def next_trade_target_min_4(t):
    trades = t.event_log
    return features.next_trade_target(trades, t.kyc, t.trading_days(trades), min_future_days=4)


@query(
    "next_trade_target_below_4",
    with_tables(
        "order_log kyc trading_days", _DTU + _CLOSED + _NEXT.format(cond="BETWEEN 1 AND 3") + " SELECT * FROM targets"
    ),
)
def next_trade_target_below_4(t):
    trades = t.order_log
    return features.next_trade_target(trades, t.kyc, t.trading_days(trades), max_future_days=3)


# Gaps are looked up in a table of all spans that occur.
_RECENCY = """,
    party_day AS (SELECT DISTINCT party_code, sauda_date FROM trade_log),
    lagged AS (
      SELECT a.party_code, a.sauda_date, list_sort(list(b.sauda_date), 'DESC') AS past
      FROM party_day a JOIN party_day b ON a.party_code = b.party_code
       AND b.sauda_date BETWEEN a.sauda_date - 30 AND a.sauda_date
      GROUP BY a.party_code, a.sauda_date),
    filled AS (
      SELECT party_code, sauda_date, sauda_date AS d0, coalesce(past[2], sauda_date - 30) AS d1,
             coalesce(past[3], sauda_date - 30) AS d2, coalesce(past[4], sauda_date - 30) AS d3,
             CASE WHEN past[3] IS NULL THEN 30 ELSE 0 END AS p2, CASE WHEN past[4] IS NULL THEN 60 ELSE 0 END AS p3
      FROM lagged)"""
_SPANS = """,
    spans3 AS (
      SELECT a, b, count(day) AS n FROM (
        SELECT d1 AS a, d0 AS b FROM filled UNION SELECT d2, d1 FROM filled UNION SELECT d3, d2 FROM filled)
      LEFT JOIN closed ON day BETWEEN a AND b GROUP BY a, b),
    gaps AS (
      SELECT filled.*, CAST(date_diff('day', d1, d0) - 1 - s1.n AS INTEGER) AS gap_1,
             CAST(date_diff('day', d2, d1) - 1 - s2.n + p2 AS INTEGER) AS gap_2,
             CAST(date_diff('day', d3, d2) - 1 - s3.n + p3 AS INTEGER) AS gap_3
      FROM filled JOIN spans3 s1 ON s1.a = d1 AND s1.b = d0 JOIN spans3 s2 ON s2.a = d2 AND s2.b = d1
      JOIN spans3 s3 ON s3.a = d3 AND s3.b = d2),
    recency AS (
      SELECT *, round((gap_1 + gap_2 + gap_3) / 3.0 + 1e-9, 6) AS mean_last_3,
             round((SELECT stddev_samp(g) FROM (SELECT unnest([gap_1, gap_2, gap_3]) AS g)) + 1e-9, 6) AS stddev_last_3
      FROM gaps)"""


@query(
    "recency_features",
    with_tables(
        "purchase_log kyc trading_days",
        _DTU + _CLOSED + _RECENCY + _SPANS + """
        SELECT party_code, sauda_date, gap_1, gap_2, gap_3, mean_last_3, stddev_last_3 FROM recency""",
    ),
)
def recency_features(t):
    trades = t.purchase_log
    return _rounded(features.recency_features(trades, t.trading_days(trades)), "mean_last_3", "stddev_last_3")


_WEEK = """,
    party_day AS (SELECT DISTINCT party_code, sauda_date FROM b2c),
    anchors AS (
      SELECT party_code, week_start, max(sauda_date) AS anchor FROM (
        SELECT party_code, sauda_date, CAST(date_trunc('week', sauda_date) AS DATE) AS week_start FROM party_day)
      WHERE sauda_date <= week_start + 4 GROUP BY party_code, week_start),
    stats AS (
      SELECT w.party_code, w.week_start, w.anchor, count(DISTINCT h.sauda_date) AS trade_days_cnt,
             count(*) AS total_trades, CAST(sum(h.OC) AS BIGINT) AS total_order_count,
             round(avg(h.T_O) + 1e-9, 6) AS avg_investment
      FROM anchors w JOIN trade_log h ON h.party_code = w.party_code
       AND h.sauda_date BETWEEN w.week_start - 30 AND w.week_start
      GROUP BY ALL HAVING count(DISTINCT h.sauda_date) >= {min_days}),
    next_trades AS (
      SELECT s.party_code, s.week_start, coalesce(min(n.sauda_date), s.week_start + 65) AS next_trade
      FROM stats s LEFT JOIN trade_log n ON n.party_code = s.party_code
       AND n.sauda_date BETWEEN s.week_start + 5 AND s.week_start + 66
      GROUP BY s.party_code, s.week_start),
    lagged AS (
      SELECT s.party_code, s.week_start, list_sort(list(b.sauda_date), 'DESC') AS past
      FROM stats s JOIN party_day b ON s.party_code = b.party_code
       AND b.sauda_date BETWEEN s.week_start - 30 AND s.week_start + 4
      GROUP BY s.party_code, s.week_start),
    filled AS (
      SELECT party_code, week_start, past[1] AS d0, coalesce(past[2], week_start - 30) AS d1,
             coalesce(past[3], week_start - 30) AS d2, coalesce(past[4], week_start - 30) AS d3,
             CASE WHEN past[3] IS NULL THEN 30 ELSE 0 END AS p2, CASE WHEN past[4] IS NULL THEN 60 ELSE 0 END AS p3
      FROM lagged)"""


@query(
    "week_cohort",
    with_tables(
        "purchase_log kyc trading_days",
        _B2C + _CLOSED + _WEEK.format(min_days=4) + _SPANS + """,
        tail AS (
          SELECT party_code, week_start, anchor, next_trade, count(day) AS n
          FROM stats JOIN next_trades USING (party_code, week_start)
          LEFT JOIN closed ON day BETWEEN anchor AND next_trade AND day <= week_start + 64
          GROUP BY ALL)
        SELECT stats.*, next_trade,
               CAST(date_diff('day', stats.anchor, next_trade) - 1 - n AS INTEGER) AS inactive_days,
               gap_1, gap_2, gap_3, mean_last_3, stddev_last_3
        FROM stats JOIN tail USING (party_code, week_start) JOIN recency USING (party_code, week_start)""",
    ),
)
def week_cohort(t):
    trades = t.purchase_log
    weeks = features.week_cohort(trades, t.kyc, t.trading_days(trades))
    return _rounded(weeks, "avg_investment", "mean_last_3", "stddev_last_3")


_DEMOGRAPHICS = """
    SELECT k.party_code, round(date_diff('day', birthdate, {as_of}) / 365.0, 2) AS age,
           CASE WHEN date_diff('day', birthdate, {as_of}) / 365.0 <= 35 THEN 1
                WHEN date_diff('day', birthdate, {as_of}) / 365.0 <= 45 THEN 2 ELSE 3 END AS new_age,
           CAST(date_diff('day', activefrom, {as_of}) AS INTEGER) AS activeinsys,
           CASE incomedetails WHEN 'BELOW 1 LAC' THEN 1 WHEN '1-5 LAC' THEN 2 WHEN '5-10 LAC' THEN 3
                WHEN '10-25 LAC' THEN 4 WHEN '>25 LAC' THEN 5 ELSE 0 END AS new_incomedetails,
           CASE WHEN gender IN ('F', 'f') THEN 1 ELSE 0 END AS gender_f,
           CASE riskcategory WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS riskcategory_new,
           coalesce(occupation, 'other') AS occupation, coalesce(riskcategory, 'other') AS riskcategory,
           coalesce(c.Tier, 'Tier-III') AS Tier
    FROM client_kyc k LEFT JOIN city_tier c
      ON upper(substr(k.City, 1, 1)) || lower(substr(k.City, 2)) = c.City AND c.Tier IS NOT NULL"""


@query("demographic_features", with_tables("kyc tiers", _DEMOGRAPHICS.format(as_of="DATE '2022-02-03'")))
def demographic_features(t):
    return features.demographic_features(t.kyc, t.tiers, "2022-02-03")


_DATASET = """
        SELECT party_code, sauda_date, trade_days_cnt, total_trades, total_order_count,
               round(avg_investment + 1e-9, 6) AS avg_investment, gap_1, gap_2, gap_3, mean_last_3, stddev_last_3,
               next_trade, inactive_days, coalesce(occupation, 'other') AS occupation,
               coalesce(c.Tier, 'Tier-III') AS Tier,
               CASE incomedetails WHEN 'BELOW 1 LAC' THEN 1 WHEN '1-5 LAC' THEN 2 WHEN '5-10 LAC' THEN 3
                    WHEN '10-25 LAC' THEN 4 WHEN '>25 LAC' THEN 5 ELSE 0 END AS new_incomedetails,
               CASE WHEN gender IN ('F', 'f') THEN 1 ELSE 0 END AS gender_f,
               CASE riskcategory WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS riskcategory_new,
               CASE WHEN date_diff('day', birthdate, sauda_date) / 365.0 <= 35 THEN 1
                    WHEN date_diff('day', birthdate, sauda_date) / 365.0 <= 45 THEN 2 ELSE 3 END AS new_age,
               CAST(date_diff('day', activefrom, sauda_date) AS INTEGER) AS activeinsys
        FROM stats JOIN targets USING (party_code, sauda_date) JOIN recency USING (party_code, sauda_date)
        LEFT JOIN client_kyc k USING (party_code) LEFT JOIN city_tier c
          ON upper(substr(k.City, 1, 1)) || lower(substr(k.City, 2)) = c.City AND c.Tier IS NOT NULL
        WHERE trade_days_cnt >= 4"""


def next_trade_dataset_sql(query_text: str | None = None) -> str:
    """SQL of the data set, or of a query over it under the name ``next_trade_rows``."""
    parts = _DTU + _CLOSED + _STATS + _NEXT.format(cond=">= 1") + _RECENCY + _SPANS
    body = _DATASET if query_text is None else f",\n    next_trade_rows AS ({_DATASET}),\n    {query_text.strip()}"
    return with_tables("purchase_log kyc tiers trading_days", parts + body)


@query("next_trade_dataset", next_trade_dataset_sql())
def next_trade_dataset(t):
    trades = t.purchase_log
    rows = features.next_trade_dataset(trades, t.kyc, t.trading_days(trades), t.tiers)
    return _rounded(rows, "avg_investment", "mean_last_3", "stddev_last_3")


@query(
    "instrument_mix",
    with_tables(
        "event_log", "SELECT sauda_date, INST_TYPE, count(*) AS Total FROM trade_log GROUP BY sauda_date, INST_TYPE"
    ),
)
def instrument_mix(t):
    return features.instrument_mix(t.event_log)


@query(
    "instrument_mix_by_inactivity",
    with_tables(
        "event_log kyc trading_days",
        _DTU + _CLOSED + _NEXT.format(cond=">= 4") + """
        SELECT t.sauda_date,
               CASE WHEN inactive_days BETWEEN 0 AND 2 THEN '0-2' WHEN inactive_days BETWEEN 3 AND 5 THEN '3-5'
                    WHEN inactive_days BETWEEN 6 AND 10 THEN '6-10' WHEN inactive_days BETWEEN 11 AND 39 THEN '11-39'
                    ELSE '40-50' END AS bucket, INST_TYPE, count(*) AS Total
        FROM targets t JOIN trade_log i ON t.party_code = i.party_code AND t.sauda_date = i.sauda_date
        WHERE future_days >= 4 GROUP BY ALL""",
    ),
)
def instrument_mix_by_inactivity(t):
    trades = t.event_log
    return features.instrument_mix_by_inactivity(trades, t.kyc, t.trading_days(trades))
