"""Schemas of the input tables, so that text sources need no inference."""

from __future__ import annotations

from pyspark.sql import types as T

from ledgerlife.functions.codes import TRADE_FLAGS


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TRADE_LOG = _struct(
    party_code=T.LongType(),
    sauda_date=T.DateType(),
    INST_TYPE=T.StringType(),
    OC=T.LongType(),
    T_O=T.DoubleType(),
    Brokerage=T.DoubleType(),
)

CLIENT_KYC = _struct(
    party_code=T.LongType(),
    B2C=T.StringType(),
    gender=T.StringType(),
    riskcategory=T.StringType(),
    incomedetails=T.StringType(),
    occupation=T.StringType(),
    birthdate=T.DateType(),
    activefrom=T.DateType(),
    City=T.StringType(),
)

TRADING_DAYS = _struct(TradingDay=T.DateType())

CITY_TIER = _struct(City=T.StringType(), Tier=T.StringType())

ORDER_DETAIL = _struct(
    straccountid=T.LongType(),
    strguiorgordid=T.LongType(),
    dt=T.DateType(),
    strordduration=T.StringType(),
    strproduct=T.StringType(),
    strordertype=T.StringType(),
    strtranstype=T.StringType(),
    strstrategycode=T.StringType(),
    strinsttype=T.StringType(),
    strgroup=T.StringType(),
    strsymbolname=T.StringType(),
    strrejectionby=T.StringType(),
)

DAILY_SUMMARY = T.StructType(
    [
        T.StructField("party_code", T.LongType()),
        T.StructField("sauda_date", T.DateType()),
        T.StructField("cumulative_trade_days", T.IntegerType()),
        T.StructField("average_gap_last_four_trades_weeks", T.DoubleType()),
        T.StructField("average_gap_last_four_trades_label", T.StringType()),
    ]
    + [T.StructField(flag, T.IntegerType()) for flag in TRADE_FLAGS]
)
