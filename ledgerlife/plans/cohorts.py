"""Cohort dormancy and daily-user queries."""

from __future__ import annotations

import calendar as month_lengths

from pyspark.sql import functions as F

from ledgerlife.operators import base, calendar, cohorts, dtu
from ledgerlife.plans.registry import query
from ledgerlife.sources.sample_tables import with_tables


def month_bounds(year: int, month: int) -> tuple[str, str]:
    return f"{year}-{month:02d}-01", f"{year}-{month:02d}-{month_lengths.monthrange(year, month)[1]}"


COHORT_MONTHS = [month_bounds(1995, m) for m in range(1, 13)]
MONTH_ENDS = [month_bounds(1995, m)[1] for m in range(4, 13)] + [month_bounds(1996, m)[1] for m in (1, 2)]

_COHORT_VALUES = ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in COHORT_MONTHS)
_AS_OF_VALUES = ", ".join(f"(DATE '{d}')" for d in MONTH_ENDS)

_B2C_TRADES = "b2c AS (SELECT * FROM trade_log WHERE party_code IN (SELECT party_code FROM client_kyc WHERE B2C = 'Y'))"

_CELLS = f"""{_B2C_TRADES},
    cohort_list(cohort_start, cohort_end) AS (VALUES {_COHORT_VALUES}),
    as_of_list(as_of) AS (VALUES {_AS_OF_VALUES}),
    per_party AS (
      SELECT as_of, party_code, min(sauda_date) AS first_trade, max(sauda_date) AS last_trade
      FROM b2c JOIN as_of_list ON sauda_date <= as_of GROUP BY as_of, party_code),
    cells AS (
      SELECT cohort_start, cohort_end, as_of, count(*) AS parties,
             count(*) FILTER (date_diff('day', last_trade, as_of) > 60) AS dormant
      FROM per_party JOIN cohort_list ON first_trade BETWEEN cohort_start AND cohort_end
      WHERE as_of > cohort_end + 60 GROUP BY ALL)"""


@query(
    "first_trade_cohort",
    with_tables(
        "order_log",
        """SELECT party_code, min(sauda_date) AS first_trade, max(sauda_date) AS last_trade,
           CAST(date_trunc('month', min(sauda_date)) AS DATE) AS activation_month
           FROM trade_log GROUP BY party_code""",
    ),
)
def first_trade_cohort(t):
    return cohorts.first_trade_cohort(t.order_log)


@query(
    "dormancy_rate",
    with_tables(
        "order_log kyc",
        f"""{_B2C_TRADES},
        p AS (SELECT party_code, min(sauda_date) AS f, max(sauda_date) AS l FROM b2c
              WHERE sauda_date <= DATE '1995-12-31' GROUP BY party_code
              HAVING min(sauda_date) BETWEEN DATE '1995-01-01' AND DATE '1995-03-31')
        SELECT count(*) AS parties, count(*) FILTER (date_diff('day', l, DATE '1995-12-31') > 60) AS dormant,
               round(100.0 * count(*) FILTER (date_diff('day', l, DATE '1995-12-31') > 60) / count(*), 2)
                 AS dormancy_pct
        FROM p""",
    ),
)
def dormancy_rate(t):
    return cohorts.dormancy_rate(t.order_log, t.kyc, "1995-12-31", "1995-01-01", "1995-03-31")


@query(
    "dormancy_matrix",
    with_tables(
        "order_log kyc",
        f"""{_CELLS}
        SELECT *, round(100.0 * dormant / parties, 2) AS dormancy_pct FROM cells""",
    ),
)
def dormancy_matrix(t):
    return cohorts.dormancy_matrix(t.order_log, t.kyc, COHORT_MONTHS, MONTH_ENDS)


QUARTERS = [("1995-01-01", "1995-03-31"), ("1995-04-01", "1995-06-30"), ("1995-07-01", "1995-09-30"), ("1995-10-01", "1995-12-31")]


@query(
    "dormancy_matrix_overlapping",
    with_tables(
        "order_log kyc",
        _CELLS.replace(_COHORT_VALUES, _COHORT_VALUES + "".join(f", (DATE '{a}', DATE '{b}')" for a, b in QUARTERS))
        + " SELECT *, round(100.0 * dormant / parties, 2) AS dormancy_pct FROM cells",
    ),
)
def dormancy_matrix_overlapping(t):
    return cohorts.dormancy_matrix(t.order_log, t.kyc, COHORT_MONTHS + QUARTERS, MONTH_ENDS)


@query(
    "dormancy_grid",
    with_tables(
        "order_log kyc",
        f"""{_CELLS}
        SELECT cohort_start, """
        + ", ".join(
            f"max(CASE WHEN as_of = DATE '{d}' THEN round(100.0 * dormant / parties, 2) END) AS \"{d}\""
            for d in MONTH_ENDS
        )
        + " FROM cells GROUP BY cohort_start",
    ),
)
def dormancy_grid(t):
    return cohorts.dormancy_grid(dormancy_matrix(t), MONTH_ENDS)


_DTU = f"""{_B2C_TRADES},
    dtu AS (SELECT DISTINCT party_code, sauda_date FROM b2c),
    typed AS (
      SELECT dtu.*, date_diff('day', f, sauda_date) AS age,
             CASE WHEN f <= sauda_date - {{old}} THEN 'type1'
                  WHEN f BETWEEN sauda_date - ({{old}} - 1) AND sauda_date - 1 THEN 'type2'
                  WHEN f = sauda_date THEN 'type3' END AS customer_type
      FROM dtu JOIN (SELECT party_code, min(sauda_date) AS f FROM b2c GROUP BY party_code) USING (party_code))"""
_BACK = """,
    back AS (
      SELECT a.party_code, a.sauda_date,
             bool_or(b.sauda_date = a.sauda_date + 1) AS b1,
             bool_or(b.sauda_date BETWEEN a.sauda_date + 2 AND a.sauda_date + 7) AS b7,
             bool_or(b.sauda_date BETWEEN a.sauda_date + 8 AND a.sauda_date + 30) AS b30
      FROM dtu a JOIN dtu b ON a.party_code = b.party_code GROUP BY ALL)"""
_MIX = """
    SELECT sauda_date, count(*) AS users,
           count(*) FILTER (customer_type = 'type1') AS type1,
           count(*) FILTER (customer_type = 'type2') AS type2,
           count(*) FILTER (customer_type = 'type3') AS type3,
           round(100.0 * count(*) FILTER (customer_type = 'type1') / count(*), 2) AS type1_pct,
           round(100.0 * count(*) FILTER (customer_type = 'type2') / count(*), 2) AS type2_pct,
           round(100.0 * count(*) FILTER (customer_type = 'type3') / count(*), 2) AS type3_pct
    FROM typed GROUP BY sauda_date"""


@query("dtu_type_mix", with_tables("order_log kyc", _DTU.format(old=90) + _MIX))
def dtu_type_mix(t):
    return dtu.dtu_type_mix(t.order_log, t.kyc)


@query("dtu_type_mix_dense", with_tables("event_log kyc", _DTU.format(old=10) + _MIX))
def dtu_type_mix_dense(t):
    return dtu.dtu_type_mix(t.event_log, t.kyc, old_after=10)


@query(
    "dtu_return_rate",
    with_tables(
        "event_log kyc",
        _DTU.format(old=90) + _BACK + """
        SELECT sauda_date, count(*) AS users, count(*) FILTER (b1) AS t1, count(*) FILTER (b7) AS t7,
               count(*) FILTER (b30) AS t30, round(100.0 * count(*) FILTER (b1) / count(*), 2) AS t1_pct,
               round(100.0 * count(*) FILTER (b7) / count(*), 2) AS t7_pct,
               round(100.0 * count(*) FILTER (b30) / count(*), 2) AS t30_pct
        FROM back GROUP BY sauda_date""",
    ),
)
def dtu_return_rate(t):
    return dtu.dtu_return_rate(t.event_log, t.kyc)


@query(
    "dtu_profile",
    with_tables(
        "event_log kyc",
        _DTU.format(old=5) + _BACK + """
        SELECT sauda_date, count(*) AS users,
               round(100.0 * count(*) FILTER (customer_type = 'type1') / count(*), 2) AS type1_pct,
               round(100.0 * count(*) FILTER (customer_type = 'type2') / count(*), 2) AS type2_pct,
               round(100.0 * count(*) FILTER (customer_type = 'type3') / count(*), 2) AS type3_pct,
               round(100.0 * count(*) FILTER (b1) / count(*), 2) AS t1_pct,
               round(100.0 * count(*) FILTER (b7) / count(*), 2) AS t7_pct,
               round(100.0 * count(*) FILTER (b30) / count(*), 2) AS t30_pct
        FROM typed JOIN back USING (party_code, sauda_date)
        GROUP BY sauda_date""",
    ),
)
def dtu_profile(t):
    return dtu.dtu_profile(t.event_log, t.kyc, old_after=5)


_COUNT_MIX = """,
    later AS (
      SELECT typed.party_code, typed.sauda_date, customer_type, count(dtu.sauda_date) AS n
      FROM typed LEFT JOIN dtu ON typed.party_code = dtu.party_code
       AND dtu.sauda_date BETWEEN typed.sauda_date + 1 AND typed.sauda_date + 30
      GROUP BY ALL),
    shares AS (
      SELECT sauda_date, customer_type, count(*) AS users,
             round(100.0 * count(*) FILTER (n BETWEEN 2 AND 5) / count(*), 2) AS pct_2_5,
             round(100.0 * count(*) FILTER (n BETWEEN 6 AND 10) / count(*), 2) AS pct_6_10,
             round(100.0 * count(*) FILTER (n > 10) / count(*), 2) AS pct_gt_10
      FROM later GROUP BY ALL)
    SELECT *, round(100.0 - (pct_2_5 + pct_6_10 + pct_gt_10), 2) AS pct_1 FROM shares"""


@query("trade_day_count_mix", with_tables("event_log kyc", _DTU.format(old=10) + _COUNT_MIX))
def trade_day_count_mix(t):
    return dtu.trade_day_count_mix(t.event_log, t.kyc, old_after=10)


@query("trade_day_count_mix_sparse", with_tables("order_log kyc", _DTU.format(old=90) + _COUNT_MIX))
def trade_day_count_mix_sparse(t):
    return dtu.trade_day_count_mix(t.order_log, t.kyc)


@query(
    "business_days_between",
    with_tables(
        "order_log trading_days",
        """closed AS (
          SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '1994-12-01', DATE '2002-03-01',
                 INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT TradingDay FROM trading_days)),
        gaps AS (
          SELECT party_code, prev_date, sauda_date FROM (
            SELECT party_code, sauda_date, lag(sauda_date) OVER (PARTITION BY party_code ORDER BY sauda_date) AS prev_date
            FROM (SELECT DISTINCT party_code, sauda_date FROM trade_log)) WHERE prev_date IS NOT NULL),
        spans AS (
          SELECT a, b, count(day) AS n FROM (SELECT DISTINCT prev_date AS a, sauda_date AS b FROM gaps)
          LEFT JOIN closed ON day BETWEEN a AND b GROUP BY a, b)
        SELECT party_code, prev_date, sauda_date,
               CAST(date_diff('day', prev_date, sauda_date) - 1 - n AS INTEGER) AS business_days
        FROM gaps JOIN spans ON prev_date = a AND sauda_date = b""",
    ),
)
def business_days_between(t):
    trades = t.order_log
    gaps = base.party_days(trades).withColumn("prev_date", F.lag("sauda_date").over(base.in_day_order()))
    gaps = gaps.filter(F.col("prev_date").isNotNull())
    return calendar.business_days_between(gaps, "prev_date", "sauda_date", t.trading_days(trades))


@query(
    "trading_day_check",
    with_tables(
        "order_log trading_days",
        """SELECT day, day IN (SELECT TradingDay FROM trading_days) AS is_trading_day
           FROM (SELECT DISTINCT sauda_date AS day FROM trade_log)""",
    ),
)
def trading_day_check(t):
    trades = t.order_log
    return calendar.check_trading_days(trades.select("sauda_date"), t.trading_days(trades))


@query(
    "closed_days",
    with_tables(
        "order_log trading_days",
        """SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(min(sauda_date), max(sauda_date),
           INTERVAL 1 DAY)) AS d FROM trade_log) WHERE CAST(d AS DATE) NOT IN (SELECT TradingDay FROM trading_days)""",
    ),
)
def closed_days(t):
    span = t.order_log.agg(F.min("sauda_date").alias("low"), F.max("sauda_date").alias("high"))
    days = span.select(F.explode(F.sequence("low", "high")).alias("day"))
    return calendar.closed_days(t.trading_days(t.order_log), days=days)
