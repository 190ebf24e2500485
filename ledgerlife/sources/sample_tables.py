"""Adapters that give the sample tables the shape of the lifecycle inputs.

Attributes the tables lack (B2C mark, city, order codes) are derived with
arithmetic, CASE and casts only. ``SQL`` holds the same adapters as CTE bodies
for the SQL oracles.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlife.functions.codes import TRADE_FLAGS

# Instrument text in each log that sets a product flag.
ORDER_LOG_FLAGS = {
    "has_mis_trade": ["1-URGENT"],
    "has_cnc_trade": ["2-HIGH"],
    "has_fut_idx_trade": ["3-MEDIUM"],
    "has_fut_stk_trade": ["4-NOT SPECIFIED"],
    "has_opt_idx_trade": ["5-LOW"],
    "has_opt_stk_trade": ["1-URGENT", "2-HIGH"],
    "has_curr_trade": ["4-NOT SPECIFIED", "5-LOW"],
    "has_comm_trade": [],
}

#: Order lines that one task joins and counts.
LINES_PER_TASK = 250_000


class SampleTables:
    """The sample folder as lifecycle inputs; each property is a lazy scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._scans: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A lazy scan; the file footer is read once per table for its schema."""
        if name not in self._scans:
            self._scans[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._scans[name]

    @property
    def order_log(self) -> DataFrame:
        """Trade log over years: one trade per order."""
        return self.table("orders").select(
            F.col("o_custkey").alias("party_code"),
            F.col("o_orderdate").cast("date").alias("sauda_date"),
            F.col("o_orderpriority").alias("INST_TYPE"),
            (F.col("o_orderkey") % 5 + 1).alias("OC"),
            F.col("o_totalprice").alias("T_O"),
            (F.col("o_totalprice") * 0.0005).alias("Brokerage"),
        )

    @property
    def event_log(self) -> DataFrame:
        """Trade log over one month: most parties trade most days."""
        return self.table("events").select(
            F.col("user_id").alias("party_code"),
            F.col("ts").cast("date").alias("sauda_date"),
            F.col("event_type").alias("INST_TYPE"),
            F.lit(1).cast("long").alias("OC"),
            F.col("value").alias("T_O"),
            (F.col("value") * 0.0005).alias("Brokerage"),
        )

    @property
    def purchase_log(self) -> DataFrame:
        """The whole event log; a name of its own for the next-trade features."""
        return self.event_log

    @property
    def kyc(self) -> DataFrame:
        balance, key = F.col("c_acctbal"), F.col("c_custkey")
        customers = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        return customers.select(
            key.alias("party_code"),
            F.when(balance >= 0, "Y").otherwise("N").alias("B2C"),
            F.when(key % 3 == 0, "F").when(key % 3 == 1, "M").otherwise("f").alias("gender"),
            F.when(key % 5 == 0, "HIGH").when(key % 5 == 1, "MEDIUM").when(key % 5 == 2, "LOW").alias("riskcategory"),
            F.when(balance < 0, "BELOW 1 LAC").when(balance < 2500, "1-5 LAC").when(balance < 5000, "5-10 LAC")
            .when(balance < 7500, "10-25 LAC").when(balance < 9500, ">25 LAC").alias("incomedetails"),
            F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment")).alias("occupation"),
            F.date_add(F.lit("1950-01-01").cast("date"), ((key * 37) % 18000).cast("int")).alias("birthdate"),
            F.date_add(F.lit("1994-01-01").cast("date"), (key % 365).cast("int")).alias("activefrom"),
            F.col("n_name").alias("City"),
        )

    @property
    def tiers(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").filter(key < 20).select(
            F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.substr("n_name", F.lit(2)))).alias("City"),
            F.when(key < 8, "Tier-I").when(key < 16, "Tier-II").alias("Tier"),
        )

    def trading_days(self, trades: DataFrame) -> DataFrame:
        """Weekdays of the log's date range, less the first of January and July."""
        span = trades.agg(F.min("sauda_date").alias("low"), F.max("sauda_date").alias("high"))
        day = F.col("TradingDay")
        holiday = (F.dayofmonth(day) == 1) & F.month(day).isin(1, 7)
        return span.select(F.explode(F.sequence("low", "high")).alias("TradingDay")).filter(
            (F.weekday(day) < 5) & ~holiday
        )

    @functools.cached_property
    def order_tasks(self) -> int:
        """Tasks for steps over order lines or party-days of orders, by the number of lines."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table("lineitem").count() // LINES_PER_TASK))

    @property
    def order_detail(self) -> DataFrame:
        # Tasks by the number of lines: the join's rows stay in its tasks up to the counts per party-day, and left to
        # the bytes shuffled, a task would take millions of these narrow rows.
        lines = self.table("lineitem").repartition(self.order_tasks, "l_orderkey").join(
            self.table("orders").repartition(self.order_tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        line, supplier, part, quantity = (
            F.col(c) for c in ("l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
        )

        def pick(number, *texts):
            out = F.when(number == 0, texts[0])
            for i, text in enumerate(texts[1:], 1):
                out = out.when(number == i, text)
            return out

        return lines.select(
            F.col("o_custkey").alias("straccountid"),
            F.col("l_orderkey").alias("strguiorgordid"),
            F.col("o_orderdate").cast("date").alias("dt"),
            pick(line % 5, "DAY", "IOC", "GTD", "GTC", "EOS").alias("strordduration"),
            pick(supplier % 7, "CNC", "MIS", "MARGIN", "NRML", "BO", "ARB", "CO").alias("strproduct"),
            F.when(F.col("l_returnflag") == "A", "MKT").when(F.col("l_returnflag") == "N", "L").otherwise("SL")
            .alias("strordertype"),
            F.when(F.col("l_linestatus") == "O", "B").otherwise("S").alias("strtranstype"),
            F.concat(F.lit("S"), line.cast("string")).alias("strstrategycode"),
            F.concat(F.lit("I"), (supplier % 3).cast("string")).alias("strinsttype"),
            pick(part % 4, "XX", "EQ", "BT").alias("strgroup"),
            F.concat(F.lit("SYM"), (part % 50).cast("string")).alias("strsymbolname"),
            F.when(quantity < 5, "").when(quantity < 10, "RMS").when(quantity < 12, "OMS").alias("strrejectionby"),
        )


def _weekday_calendar(log: str, name: str = "trading_days") -> str:
    return f"""{name} AS (
      SELECT CAST(d AS DATE) AS TradingDay
      FROM (SELECT unnest(generate_series(min(sauda_date), max(sauda_date), INTERVAL 1 DAY)) AS d FROM {log})
      WHERE isodow(d) <= 5 AND NOT (day(d) = 1 AND month(d) IN (1, 7)))"""


SQL = {
    "order_log": """trade_log AS (
      SELECT o_custkey AS party_code, CAST(o_orderdate AS DATE) AS sauda_date, o_orderpriority AS INST_TYPE,
             o_orderkey % 5 + 1 AS OC, o_totalprice AS T_O, o_totalprice * 0.0005 AS Brokerage
      FROM orders)""",
    "event_log": """trade_log AS (
      SELECT user_id AS party_code, CAST(ts AS DATE) AS sauda_date, event_type AS INST_TYPE,
             1 AS OC, value AS T_O, value * 0.0005 AS Brokerage
      FROM events)""",
    "purchase_log": """trade_log AS (
      SELECT user_id AS party_code, CAST(ts AS DATE) AS sauda_date, event_type AS INST_TYPE,
             1 AS OC, value AS T_O, value * 0.0005 AS Brokerage
      FROM events)""",
    "kyc": """client_kyc AS (
      SELECT c_custkey AS party_code,
             CASE WHEN c_acctbal >= 0 THEN 'Y' ELSE 'N' END AS B2C,
             CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'f' END AS gender,
             CASE c_custkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' END AS riskcategory,
             CASE WHEN c_acctbal < 0 THEN 'BELOW 1 LAC' WHEN c_acctbal < 2500 THEN '1-5 LAC'
                  WHEN c_acctbal < 5000 THEN '5-10 LAC' WHEN c_acctbal < 7500 THEN '10-25 LAC'
                  WHEN c_acctbal < 9500 THEN '>25 LAC' END AS incomedetails,
             CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment END AS occupation,
             DATE '1950-01-01' + CAST((c_custkey * 37) % 18000 AS INTEGER) AS birthdate,
             DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS activefrom,
             n_name AS City
      FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "tiers": """city_tier AS (
      SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS City,
             CASE WHEN n_nationkey < 8 THEN 'Tier-I' WHEN n_nationkey < 16 THEN 'Tier-II' END AS Tier
      FROM nation WHERE n_nationkey < 20)""",
    "trading_days": _weekday_calendar("trade_log"),
    "order_detail": """order_detail AS (
      SELECT o_custkey AS straccountid, l_orderkey AS strguiorgordid, CAST(o_orderdate AS DATE) AS dt,
             CASE l_linenumber % 5 WHEN 0 THEN 'DAY' WHEN 1 THEN 'IOC' WHEN 2 THEN 'GTD' WHEN 3 THEN 'GTC'
                  ELSE 'EOS' END AS strordduration,
             CASE l_suppkey % 7 WHEN 0 THEN 'CNC' WHEN 1 THEN 'MIS' WHEN 2 THEN 'MARGIN' WHEN 3 THEN 'NRML'
                  WHEN 4 THEN 'BO' WHEN 5 THEN 'ARB' ELSE 'CO' END AS strproduct,
             CASE l_returnflag WHEN 'A' THEN 'MKT' WHEN 'N' THEN 'L' ELSE 'SL' END AS strordertype,
             CASE l_linestatus WHEN 'O' THEN 'B' ELSE 'S' END AS strtranstype,
             'S' || l_linenumber AS strstrategycode, 'I' || (l_suppkey % 3) AS strinsttype,
             CASE l_partkey % 4 WHEN 0 THEN 'XX' WHEN 1 THEN 'EQ' WHEN 2 THEN 'BT' END AS strgroup,
             'SYM' || (l_partkey % 50) AS strsymbolname,
             CASE WHEN l_quantity < 5 THEN '' WHEN l_quantity < 10 THEN 'RMS'
                  WHEN l_quantity < 12 THEN 'OMS' END AS strrejectionby
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}
SQL["daily"] = """daily AS (
      SELECT party_code, sauda_date,
             CAST(row_number() OVER per AS INTEGER) AS cumulative_trade_days,
             avg(gap) OVER (PARTITION BY party_code ORDER BY sauda_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
               AS mean_gap, {flags}
      FROM (SELECT *, date_diff('day', lag(sauda_date) OVER (PARTITION BY party_code ORDER BY sauda_date),
                                sauda_date) AS gap
            FROM (SELECT party_code, sauda_date, {raw_flags}
                  FROM trade_log GROUP BY party_code, sauda_date) AS party_day) AS gaps
      WINDOW per AS (PARTITION BY party_code ORDER BY sauda_date)),
    daily_summary AS (
      SELECT party_code, sauda_date, cumulative_trade_days,
             mean_gap / 7.0 AS average_gap_last_four_trades_weeks,
             CASE WHEN mean_gap <= 7 THEN 'Week' WHEN mean_gap <= 15 THEN 'TwoWeeks' WHEN mean_gap <= 30 THEN 'Month'
                  WHEN mean_gap <= 90 THEN 'Quarter' ELSE 'Other' END AS average_gap_last_four_trades_label,
             {flags}
      FROM daily)""".format(
    flags=", ".join(TRADE_FLAGS),
    raw_flags=", ".join(
        "CAST(max(CASE WHEN INST_TYPE IN ({}) THEN 1 ELSE 0 END) AS INTEGER) AS {}".format(
            ", ".join(f"'{v}'" for v in values), flag
        )
        if values
        else f"CAST(0 AS INTEGER) AS {flag}"
        for flag, values in ORDER_LOG_FLAGS.items()
    ),
)


def with_tables(names: str, query: str) -> str:
    """A SQL text whose CTEs are the named adapters, followed by the query.

    A query that needs CTEs of its own starts with them and a comma is added.
    """
    bodies = ",\n    ".join(SQL[name] for name in names.split())
    text = query.strip()
    glue = ",\n    " if not text.upper().startswith("SELECT") else "\n    "
    return f"WITH {bodies}{glue}{text}"
