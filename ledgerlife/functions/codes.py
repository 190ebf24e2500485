"""Codes, labels and limits that results depend on."""

# Income text -> ordinal, anything else -> 0.
INCOME_ORDINALS = {
    "BELOW 1 LAC": 1,
    "1-5 LAC": 2,
    "5-10 LAC": 3,
    "10-25 LAC": 4,
    ">25 LAC": 5,
}

# Risk text -> ordinal, anything else -> 0.
RISK_ORDINALS = {"MEDIUM": 1, "HIGH": 2}

# Average-gap label -> days, anything else -> 100.
GAP_LABEL_DAYS = {"Week": 7, "TwoWeeks": 15, "Month": 30, "Quarter": 90}
GAP_LABEL_OTHER_DAYS = 100
GAP_LABEL_OTHER = "Other"

# Inclusive bounds of the inactive-day buckets.
INACTIVITY_BUCKETS = [(0, 2), (3, 5), (6, 10), (11, 39), (40, 50)]

# City tier of a city that is not listed.
UNLISTED_CITY_TIER = "Tier-III"

# 0/1 product flags of the daily summary.
TRADE_FLAGS = [
    "has_mis_trade",
    "has_cnc_trade",
    "has_fut_idx_trade",
    "has_fut_stk_trade",
    "has_opt_idx_trade",
    "has_opt_stk_trade",
    "has_curr_trade",
    "has_comm_trade",
]

# Order counter -> (order attribute, code it counts).
ORDER_COUNTERS = {
    "Day_validity": ("strordduration", "DAY"),
    "Immediate_or_Cancel": ("strordduration", "IOC"),
    "Good_till_days": ("strordduration", "GTD"),
    "Good_till_cancel": ("strordduration", "GTC"),
    "End_of_Session": ("strordduration", "EOS"),
    "Delivery_cash": ("strproduct", "CNC"),
    "Margin_intraday": ("strproduct", "MIS"),
    "Margin_delivery": ("strproduct", "MARGIN"),
    "Normal_fno": ("strproduct", "NRML"),
    "Bracket_order": ("strproduct", "BO"),
    "Arbitrage_order": ("strproduct", "ARB"),
    "Cover_order": ("strproduct", "CO"),
    "Market_clearing": ("strordertype", "MKT"),
    "Limit_clearing": ("strordertype", "L"),
    "Stop_loss_clearing": ("strordertype", "SL"),
    "Buy": ("strtranstype", "B"),
    "Sell": ("strtranstype", "S"),
    "No_group": ("strgroup", "XX"),
}

# Groups that are not a special equity group.
ORDINARY_GROUPS = ("EQ", "XX")

# Counters too sparse to train on.
SPARSE_COUNTERS = ["End_of_Session", "Cover_order", "Good_till_cancel", "Good_till_days", "Arbitrage_order"]
