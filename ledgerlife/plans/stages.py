"""Daily summary, stage, order-profile and feature-mart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlife.functions import codes
from ledgerlife.operators import orders, states
from ledgerlife.plans.registry import query
from ledgerlife.sources.sample_tables import ORDER_LOG_FLAGS, with_tables

_FLAGS = ", ".join(codes.TRADE_FLAGS)


def daily(t, tasks=None):
    return states.daily_summary(t.order_log, ORDER_LOG_FLAGS, tasks)


def _round(df, digits=4, *columns):
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in columns})


@query(
    "daily_summary",
    with_tables(
        "order_log daily",
        f"""SELECT party_code, sauda_date, cumulative_trade_days,
            round(average_gap_last_four_trades_weeks + 1e-9, 6) AS average_gap_last_four_trades_weeks,
            average_gap_last_four_trades_label, {_FLAGS} FROM daily_summary""",
    ),
)
def daily_summary(t):
    return _round(daily(t), 6, "average_gap_last_four_trades_weeks")


_TARGETS = """
    reached AS (
      SELECT d.*, d.sauda_date + 30 AS cutoff_sauda_date, {reached} AS target_trade_days
      FROM daily_summary d WHERE d.sauda_date BETWEEN DATE '1995-06-01' AND DATE '2000-12-31'),
    targets AS (
      SELECT *, CASE WHEN target_trade_days = 1 THEN 0 WHEN target_trade_days IN (2, 3) THEN 1
                     WHEN target_trade_days > 3 THEN 2 END AS settle_target,
             CASE WHEN target_trade_days > 3 THEN 1
                  WHEN target_trade_days IN (2, 3) AND cumulative_trade_days > 1 THEN 0 END AS frequent_target
      FROM reached)"""
_INTENDED = _TARGETS.format(
    reached="""(SELECT max(n.cumulative_trade_days) FROM daily_summary n WHERE n.party_code = d.party_code
                AND n.sauda_date BETWEEN d.sauda_date AND d.sauda_date + 30
                AND n.sauda_date <= DATE '2000-12-31')"""
)
_LITERAL = _TARGETS.format(reached="max(cumulative_trade_days) OVER (PARTITION BY party_code)")
_PICK_TARGETS = """ SELECT party_code, sauda_date, cutoff_sauda_date, cumulative_trade_days, target_trade_days,
                   settle_target, frequent_target FROM targets"""
_TARGET_COLUMNS = [
    "party_code", "sauda_date", "cutoff_sauda_date", "cumulative_trade_days", "target_trade_days", "settle_target",
    "frequent_target",
]


def targets(t, horizon_days=30, tasks=None):
    return states.transition_targets(daily(t, tasks), "1995-06-01", "2000-12-31", horizon_days)


@query("transition_targets", with_tables("order_log daily", _INTENDED + _PICK_TARGETS))
def transition_targets(t):
    return targets(t).select(*_TARGET_COLUMNS)


@query("transition_targets_whole_range", with_tables("order_log daily", _LITERAL + _PICK_TARGETS))
def transition_targets_whole_range(t):
    return targets(t, None).select(*_TARGET_COLUMNS)


# The whole log, without dates.
_EVERY_DAY = _INTENDED.replace(" WHERE d.sauda_date BETWEEN DATE '1995-06-01' AND DATE '2000-12-31'", "").replace("AND n.sauda_date <= DATE '2000-12-31'", "")


@query("transition_targets_all_days", with_tables("order_log daily", _EVERY_DAY + _PICK_TARGETS))
def transition_targets_all_days(t):
    return states.transition_targets(daily(t)).select(*_TARGET_COLUMNS)


STATE_DATES = ["1995-06-30", "1996-06-30", "1997-06-30", "1998-06-30", "1999-06-30"]
_STATES = """as_of_list(as_of) AS (VALUES {dates}),
    last_seen AS (
      SELECT k.party_code, as_of, max(d.sauda_date) AS last_day, max(d.cumulative_trade_days) AS n
      FROM (SELECT DISTINCT party_code FROM client_kyc) k CROSS JOIN as_of_list
      LEFT JOIN daily_summary d ON d.party_code = k.party_code AND d.sauda_date <= as_of
      GROUP BY k.party_code, as_of),
    states AS (
      SELECT party_code, as_of,
             CASE WHEN n IS NULL THEN 'KYC' WHEN date_diff('day', last_day, as_of) > 90 THEN 'Dormant'
                  WHEN n = 1 THEN 'First Sauda' WHEN n < 4 THEN 'Settling-In'
                  WHEN date_diff('day', last_day, as_of) <= 7 THEN 'Frequent W-r'
                  WHEN date_diff('day', last_day, as_of) <= 15 THEN 'Frequent BW-r'
                  WHEN date_diff('day', last_day, as_of) <= 30 THEN 'Frequent M-r'
                  WHEN date_diff('day', last_day, as_of) <= 90 THEN 'Frequent Q-r' END AS state
      FROM last_seen)""".format(dates=", ".join(f"(DATE '{d}')" for d in STATE_DATES))


@query("user_state", with_tables("order_log kyc daily", _STATES + " SELECT party_code, as_of, state FROM states"))
def user_state(t):
    return states.user_state(daily(t), STATE_DATES, t.kyc)


@query(
    "state_transitions",
    with_tables(
        "order_log kyc daily",
        _STATES + """,
        pairs AS (
          SELECT as_of, state, lead(as_of) OVER w AS next_as_of, lead(state) OVER w AS next_state FROM states
          WINDOW w AS (PARTITION BY party_code ORDER BY as_of))
        SELECT as_of, next_as_of, state, next_state, count(*) AS parties FROM pairs
        WHERE next_as_of IS NOT NULL GROUP BY ALL""",
    ),
)
def state_transitions(t):
    return states.state_transitions(daily(t), STATE_DATES, t.kyc)


_COUNTS = ", ".join(
    f"count(*) FILTER ({column} = '{code}') AS {name}" for name, (column, code) in codes.ORDER_COUNTERS.items()
)
_PROFILE = f"""ord_log AS (SELECT DISTINCT * FROM order_detail WHERE dt >= DATE '1995-06-01'),
    profile AS (
      SELECT straccountid AS party_id, dt AS sauda_date2, {_COUNTS},
             count(*) FILTER (strgroup <> 'EQ' AND strgroup <> 'XX') AS Special_eq,
             count(*) FILTER (strrejectionby <> '') AS rejected_by_cnt,
             count(DISTINCT nullif(strsymbolname, '')) AS underlying_assets_cnt
      FROM ord_log GROUP BY straccountid, dt)"""


def profile(t, since="1995-06-01"):
    return orders.daily_order_profile(t.order_detail, since, t.order_tasks)


@query("daily_order_profile", with_tables("order_detail", _PROFILE + " SELECT * FROM profile"))
def daily_order_profile(t):
    return profile(t)


@query(
    "order_lists",
    with_tables(
        "order_detail",
        """ord_log AS (SELECT DISTINCT * FROM order_detail),
        lists AS (
          SELECT straccountid, dt,
                 coalesce(list_sort(list(DISTINCT strsymbolname) FILTER (strsymbolname <> '')), []) AS a,
                 coalesce(list_sort(list(strrejectionby) FILTER (strrejectionby <> '')), []) AS r
          FROM ord_log GROUP BY ALL)
        SELECT straccountid AS party_id, dt AS sauda_date2, array_to_string(a, ',') AS assets,
               array_to_string(r, ',') AS rejections, CAST(len(a) AS INTEGER) AS underlying_assets_cnt,
               CAST(len(r) AS BIGINT) AS rejected_by_cnt FROM lists""",
    ),
)
def order_lists(t):
    lists = orders.order_lists(t.order_detail)
    spelled = F.flatten(
        F.transform("rejections", lambda item: F.array_repeat(item["value"], item["times"].cast("int")))
    )
    return lists.withColumns({"assets": F.array_join("assets", ","), "rejections": F.array_join(spelled, ",")})


_NAMES = ", ".join(orders.COUNTERS)


def _mart_sql(chained: bool) -> str:
    day = ("t.party_code2", "t.sauda_date1") if chained else ("d.party_code", "d.sauda_date")
    person = "p.party_id" if chained else "d.party_code"
    flags = ", ".join(f"coalesce({flag}, 0) = 1 AS {flag}" for flag in codes.TRADE_FLAGS)
    return f""",
    turnover AS (
      SELECT party_code AS party_code2, sauda_date AS sauda_date1, sum(Brokerage) AS Brokerage, sum(T_O) AS T_O
      FROM trade_log GROUP BY party_code, sauda_date),
    mart AS (
      SELECT d.party_code, d.sauda_date, d.cutoff_sauda_date, d.cumulative_trade_days, d.target_trade_days,
             d.settle_target, d.frequent_target, {flags}, k.gender, k.riskcategory, k.incomedetails, k.occupation,
             k.City, round(t.Brokerage + 1e-9, 4) AS Brokerage, round(t.T_O + 1e-9, 4) AS T_O,
             {_NAMES}, rejected_by_cnt, underlying_assets_cnt,
             round(date_diff('day', k.birthdate, DATE '2022-02-03') / 365.0, 2) AS age
      FROM targets d
      LEFT JOIN turnover t ON d.party_code = t.party_code2 AND d.sauda_date = t.sauda_date1
      LEFT JOIN profile p ON {day[0]} = p.party_id AND {day[1]} = p.sauda_date2
      LEFT JOIN client_kyc k ON {person} = k.party_code)"""


_MART = _INTENDED + ",\n    " + _PROFILE + _mart_sql(False)
# The profile starts later than the targets here, so that the chain has misses.
_CHAIN_START = "1996-09-01"
_MART_CHAINED = _INTENDED + ",\n    " + _PROFILE.replace("1995-06-01", _CHAIN_START) + _mart_sql(True)


_EVERY_PROFILE = _PROFILE.replace("DATE '1995-06-01'", "DATE '1900-01-01'")


@query("daily_order_profile_all_days", with_tables("order_detail", _EVERY_PROFILE + " SELECT * FROM profile"))
def daily_order_profile_all_days(t):
    return profile(t, None)


@query("customer_feature_mart_all_days", with_tables("order_log kyc daily order_detail", _EVERY_DAY + ",\n    " + _EVERY_PROFILE + _mart_sql(False) + " SELECT * FROM mart"))
def customer_feature_mart_all_days(t):
    built = orders.customer_feature_mart(states.transition_targets(daily(t, t.order_tasks)), t.order_log, profile(t, None), t.kyc, "2022-02-03", tasks=t.order_tasks)
    return _round(built, 4, "Brokerage", "T_O")


def mart(t):
    built = orders.customer_feature_mart(targets(t, tasks=t.order_tasks), t.order_log, profile(t), t.kyc, "2022-02-03", tasks=t.order_tasks)
    return _round(built, 4, "Brokerage", "T_O")


@query("customer_feature_mart", with_tables("order_log kyc daily order_detail", _MART + " SELECT * FROM mart"))
def customer_feature_mart(t):
    return mart(t)


@query(
    "customer_feature_mart_chained",
    with_tables("order_log kyc daily order_detail", _MART_CHAINED + " SELECT * FROM mart"),
)
def customer_feature_mart_chained(t):
    built = orders.customer_feature_mart(targets(t, tasks=t.order_tasks), t.order_log, profile(t, _CHAIN_START), t.kyc, "2022-02-03", chained=True, tasks=t.order_tasks)
    return _round(built, 4, "Brokerage", "T_O")


_TIER = "upper(substr(City, 1, 1)) || lower(substr(City, 2))"
_SETTLE_NAMES = [c for c in orders.COUNTERS if c not in codes.SPARSE_COUNTERS]


@query(
    "settle_dataset",
    with_tables(
        "order_log kyc tiers daily order_detail",
        _MART + f"""
        SELECT settle_target, {_FLAGS}, CASE gender WHEN 'f' THEN 'F' ELSE gender END AS gender, riskcategory,
               incomedetails, occupation, Brokerage, T_O, {", ".join(_SETTLE_NAMES)}, rejected_by_cnt,
               underlying_assets_cnt, age,
               coalesce((SELECT Tier FROM city_tier c WHERE c.City = {_TIER.replace("City", "mart.City")}), 'Tier-III')
                 AS Tier
        FROM mart WHERE cumulative_trade_days = 1 AND sauda_date <= DATE '2000-06-30'""",
    ),
)
def settle_dataset(t):
    return orders.settle_dataset(mart(t), t.tiers, "2000-06-30")


_SUMS = ", ".join(
    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}"
    for c in [*_SETTLE_NAMES, "rejected_by_cnt", "underlying_assets_cnt"]
)


@query(
    "frequent_dataset",
    with_tables(
        "order_log kyc tiers daily order_detail",
        _MART + f""",
        chosen AS (SELECT * FROM mart WHERE cumulative_trade_days IN (2, 3) AND sauda_date <= DATE '2000-06-30'),
        folded AS (
          SELECT party_code, {", ".join(f"bool_or({f}) AS {f}" for f in codes.TRADE_FLAGS)}, {_SUMS},
                 round(coalesce(sum(Brokerage), 0) + 1e-9, 4) AS Brokerage, round(coalesce(sum(T_O), 0) + 1e-9, 4) AS T_O,
                 round(coalesce(sum(age), 0) + 1e-9, 4) AS age
          FROM chosen GROUP BY party_code),
        labels AS (
          SELECT DISTINCT party_code, frequent_target, CASE gender WHEN 'f' THEN 'F' ELSE gender END AS gender,
                 riskcategory, incomedetails, occupation, City FROM chosen)
        SELECT {_FLAGS}, {", ".join(_SETTLE_NAMES)}, rejected_by_cnt, underlying_assets_cnt, Brokerage, T_O, age,
               frequent_target, gender, riskcategory, incomedetails, occupation,
               coalesce((SELECT Tier FROM city_tier c WHERE c.City = {_TIER.replace("City", "labels.City")}), 'Tier-III')
                 AS Tier
        FROM folded JOIN labels USING (party_code)""",
    ),
)
def frequent_dataset(t):
    return _round(orders.frequent_dataset(mart(t), t.tiers, "2000-06-30"), 4, "Brokerage", "T_O", "age")
