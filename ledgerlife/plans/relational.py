"""The single relational steps, each as a query over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlife.functions import columns as C
from ledgerlife.operators import base, metrics
from ledgerlife.plans.registry import query
from ledgerlife.plans.stages import daily
from ledgerlife.session import scratch_path
from ledgerlife.sources import readers
from ledgerlife.sources.sample_tables import with_tables


@query(
    "view_with_parameters",
    with_tables(
        "order_log",
        """SELECT *, sauda_date + 30 AS cutoff_sauda_date FROM trade_log
           WHERE sauda_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""",
    ),
)
def view_with_parameters(t):
    readers.register(t.order_log, "trade_log_input")
    return readers.define_view(
        t.spark,
        "training_rows",
        """SELECT *, date_add(sauda_date, 30) AS cutoff_sauda_date FROM trade_log_input
           WHERE sauda_date BETWEEN CAST(:first AS DATE) AND CAST(:last AS DATE)""",
        first="1996-01-01",
        last="1998-12-31",
    )


@query(
    "date_choices",
    with_tables("order_log", "SELECT DISTINCT sauda_date FROM trade_log WHERE sauda_date >= DATE '1997-01-01'"),
)
def date_choices(t):
    return readers.date_choices(t.order_log, "sauda_date", first="1997-01-01")


@query(
    "project_and_reorder",
    with_tables(
        "order_log",
        "SELECT sauda_date AS trade_day, party_code AS party, T_O * OC AS weighted FROM trade_log",
    ),
)
def project_and_reorder(t):
    renamed = t.order_log.withColumnsRenamed({"party_code": "party", "sauda_date": "trade_day"})
    derived = renamed.withColumn("weighted", F.col("T_O") * F.col("OC"))
    return derived.drop("INST_TYPE", "OC", "T_O", "Brokerage").select("trade_day", "party", "weighted")


@query(
    "columns_by_type",
    with_tables("kyc", "SELECT B2C, gender, riskcategory, incomedetails, occupation, City FROM client_kyc"),
)
def columns_by_type(t):
    return t.kyc.select(*metrics.columns_of_type(t.kyc, "string"))


@query(
    "predicate_filters",
    with_tables(
        "kyc",
        """SELECT party_code, B2C, gender, riskcategory FROM client_kyc
           WHERE B2C = 'Y' AND gender IN ('F', 'f') AND riskcategory IS NOT NULL AND occupation IS NULL
             AND activefrom BETWEEN DATE '1994-02-01' AND DATE '1994-11-30'""",
    ),
)
def predicate_filters(t):
    active = F.col("activefrom").between(C.as_date("1994-02-01"), C.as_date("1994-11-30"))
    return t.kyc.filter(
        (F.col("B2C") == "Y") & F.col("gender").isin("F", "f") & F.col("riskcategory").isNotNull()
        & F.col("occupation").isNull() & active
    ).select("party_code", "B2C", "gender", "riskcategory")


@query(
    "in_subquery",
    with_tables(
        "order_log kyc",
        """SELECT DISTINCT party_code, sauda_date FROM trade_log
           WHERE party_code IN (SELECT party_code FROM client_kyc WHERE B2C = 'Y')""",
    ),
)
def in_subquery(t):
    return base.party_days(t.order_log, kyc=t.kyc)


@query(
    "having_on_aggregates",
    with_tables(
        "order_log",
        """SELECT party_code, count(DISTINCT sauda_date) AS trade_days, min(sauda_date) AS first_trade FROM trade_log
           GROUP BY party_code HAVING count(DISTINCT sauda_date) >= 4 AND min(sauda_date) <= DATE '1996-01-01'""",
    ),
)
def having_on_aggregates(t):
    parties = t.order_log.groupBy("party_code").agg(
        F.count_distinct("sauda_date").alias("trade_days"), F.min("sauda_date").alias("first_trade")
    )
    return parties.filter((F.col("trade_days") >= 4) & (F.col("first_trade") <= C.as_date("1996-01-01")))


@query(
    "masked_first_row",
    with_tables(
        "kyc",
        """SELECT party_code, gender, occupation FROM client_kyc
           WHERE gender = 'F' AND occupation = 'MACHINERY' AND B2C = 'Y' ORDER BY party_code LIMIT 1""",
    ),
)
def masked_first_row(t):
    picked = t.kyc.filter((F.col("gender") == "F") & (F.col("occupation") == "MACHINERY") & (F.col("B2C") == "Y"))
    return picked.orderBy("party_code").limit(1).select("party_code", "gender", "occupation")


@query(
    "inner_and_left_joins",
    with_tables(
        "order_log kyc",
        """totals AS (SELECT party_code, count(*) AS trades FROM trade_log GROUP BY party_code)
        SELECT k.party_code, k.City, coalesce(trades, 0) AS trades FROM client_kyc k
        LEFT JOIN totals USING (party_code) WHERE B2C = 'Y'""",
    ),
)
def inner_and_left_joins(t):
    totals = t.order_log.groupBy("party_code").agg(F.count("*").alias("trades"))
    customers = t.kyc.filter(F.col("B2C") == "Y").select("party_code", "City")
    return customers.join(totals, "party_code", "left").na.fill({"trades": 0})


@query(
    "instruments_of_day_users",
    with_tables(
        "event_log kyc",
        """users AS (SELECT DISTINCT party_code, sauda_date FROM trade_log
                     WHERE party_code IN (SELECT party_code FROM client_kyc WHERE B2C = 'Y'))
        SELECT u.party_code, u.sauda_date, l.INST_TYPE, count(*) AS trades FROM users u
        LEFT JOIN trade_log l ON u.party_code = l.party_code AND u.sauda_date = l.sauda_date
        GROUP BY u.party_code, u.sauda_date, l.INST_TYPE""",
    ),
)
def instruments_of_day_users(t):
    trades = t.event_log
    codes = trades.groupBy("party_code", "sauda_date", "INST_TYPE").agg(F.count("*").alias("trades"))
    return base.party_days(trades, kyc=t.kyc).join(codes, ["party_code", "sauda_date"], "left")


@query(
    "grouped_aggregates",
    with_tables(
        "order_log",
        """SELECT INST_TYPE, sauda_date, count(*) AS trades, count(DISTINCT party_code) AS parties,
                  CAST(sum(OC) AS BIGINT) AS orders, round(avg(T_O) + 1e-9, 6) AS mean_turnover,
                  min(T_O) AS low, max(T_O) AS high, count(*) FILTER (OC = 1) AS single_orders
           FROM trade_log GROUP BY INST_TYPE, sauda_date""",
    ),
)
def grouped_aggregates(t):
    return t.order_log.groupBy("INST_TYPE", "sauda_date").agg(
        F.count("*").alias("trades"),
        F.count_distinct("party_code").alias("parties"),
        F.sum("OC").alias("orders"),
        F.round(F.avg("T_O") + 1e-9, 6).alias("mean_turnover"),
        F.min("T_O").alias("low"),
        F.max("T_O").alias("high"),
        F.count_if(F.col("OC") == 1).alias("single_orders"),
    )


@query("group_sizes", with_tables("order_log daily", """SELECT average_gap_last_four_trades_label, count(*) AS size
       FROM daily_summary GROUP BY average_gap_last_four_trades_label"""))
def group_sizes(t):
    return daily(t).groupBy("average_gap_last_four_trades_label").agg(F.count("*").alias("size"))


@query("row_count", "SELECT count(*) AS n FROM orders")
def row_count(t):
    return t.order_log.agg(F.count("*").alias("n"))


@query(
    "last_row_per_party",
    """SELECT party_code, o_orderkey, T_O FROM (
         SELECT o_custkey AS party_code, o_orderkey, o_totalprice AS T_O,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def last_row_per_party(t):
    rows = t.table("orders").select(F.col("o_custkey").alias("party_code"), "o_orderkey", F.col("o_totalprice").alias("T_O"))
    return base.one_per_key(rows, ["party_code"], "o_orderkey", last=True)


@query(
    "first_row_per_day",
    """SELECT sauda_date, o_orderkey, party_code FROM (
         SELECT CAST(o_orderdate AS DATE) AS sauda_date, o_orderkey, o_custkey AS party_code,
                row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn FROM orders)
       WHERE rn = 1""",
)
def first_row_per_day(t):
    rows = t.table("orders").select(
        F.col("o_orderdate").cast("date").alias("sauda_date"), "o_orderkey", F.col("o_custkey").alias("party_code")
    )
    return base.one_per_key(rows, ["sauda_date"], "o_orderkey")


@query(
    "lead_and_lags",
    with_tables(
        "order_log",
        """d AS (SELECT DISTINCT party_code, sauda_date FROM trade_log)
        SELECT party_code, sauda_date, lead(sauda_date) OVER w AS next_date, lag(sauda_date) OVER w AS prev_1,
               lag(sauda_date, 2) OVER w AS prev_2, lag(sauda_date, 3) OVER w AS prev_3
        FROM d WINDOW w AS (PARTITION BY party_code ORDER BY sauda_date)""",
    ),
)
def lead_and_lags(t):
    order = base.in_day_order()
    return base.party_days(t.order_log).withColumns(
        {"next_date": F.lead("sauda_date").over(order)}
        | {f"prev_{n}": F.lag("sauda_date", n).over(order) for n in (1, 2, 3)}
    )


@query(
    "random_sample",
    with_tables(
        "order_log",
        """SELECT party_code, sauda_date, INST_TYPE, OC, T_O, Brokerage FROM trade_log
           ORDER BY md5('7' || '|' || party_code || '|' || strftime(sauda_date, '%Y-%m-%d') || '|' || INST_TYPE || '|' || OC), T_O
           LIMIT 100""",
    ),
)
def random_sample(t):
    return metrics.random_sample(t.order_log, 100, seed=7, by=["party_code", "sauda_date", "INST_TYPE", "OC"], ties=["T_O"])


@query(
    "append_results",
    with_tables(
        "event_log",
        """SELECT 'instrument' AS kind, INST_TYPE AS value, CAST(NULL AS DATE) AS sauda_date, count(*) AS Total
           FROM trade_log GROUP BY INST_TYPE
           UNION ALL SELECT 'day', NULL, sauda_date, count(*) FROM trade_log GROUP BY sauda_date""",
    ),
)
def append_results(t):
    trades = t.event_log
    kinds = trades.groupBy(F.lit("instrument").alias("kind"), F.col("INST_TYPE").alias("value"))
    days = trades.groupBy(F.lit("day").alias("kind"), "sauda_date")
    total = F.count("*").alias("Total")
    return base.append_all(kinds.agg(total), days.agg(total))


@query(
    "scalar_functions",
    with_tables(
        "kyc",
        """SELECT party_code, CAST(strftime(birthdate, '%Y%m') AS VARCHAR) AS birth_month,
               CAST(birthdate + 65 AS DATE) AS plus_65, CAST(birthdate - 90 AS DATE) AS minus_90,
               CAST(date_diff('day', birthdate, activefrom) AS INTEGER) AS days_before_active,
               CAST(date_diff('day', birthdate, activefrom) / 365.0 AS DOUBLE) AS age,
               coalesce(riskcategory, 'other') AS risk, coalesce(occupation, 'no_data') AS work,
               B2C = 'Y' AS is_b2c, CAST(B2C = 'Y' AS INTEGER) AS b2c_flag,
               upper(substr(City, 1, 1)) || lower(substr(City, 2)) AS city_name,
               TRY_CAST(substr(City, 8) AS DOUBLE) AS city_number, TRY_CAST(City AS DOUBLE) AS not_a_number,
               CASE WHEN party_code % 100 <= 90 THEN 1 ELSE 0 END AS within_90,
               CASE WHEN party_code % 60 BETWEEN 0 AND 2 THEN '0-2' WHEN party_code % 60 BETWEEN 3 AND 5 THEN '3-5'
                    WHEN party_code % 60 BETWEEN 6 AND 10 THEN '6-10' WHEN party_code % 60 BETWEEN 11 AND 39 THEN '11-39'
                    ELSE '40-50' END AS bucket,
               round(exp(-(party_code % 7)), 9) AS decay, round(pow(0.5, party_code % 5), 9) AS halves,
               party_code::DOUBLE / nullif(party_code % 3, 0) AS ratio,
               CAST(CASE WHEN occupation IS NULL THEN 1.0 ELSE 2.5 END AS DOUBLE) AS known
           FROM client_kyc""",
    ),
)
def scalar_functions(t):
    born, active, key = F.col("birthdate"), F.col("activefrom"), F.col("party_code")
    return t.kyc.select(
        key,
        F.date_format(born, "yyyyMM").alias("birth_month"),
        F.date_add(born, 65).alias("plus_65"),
        F.date_add(born, -90).alias("minus_90"),
        F.datediff(active, born).alias("days_before_active"),
        C.age_years(born, active).alias("age"),
        F.coalesce("riskcategory", F.lit("other")).alias("risk"),
        F.coalesce("occupation", F.lit("no_data")).alias("work"),
        (F.col("B2C") == "Y").alias("is_b2c"),
        (F.col("B2C") == "Y").cast("int").alias("b2c_flag"),
        C.capitalized(F.col("City")).alias("city_name"),
        C.to_number(F.substr("City", F.lit(8))).alias("city_number"),
        C.to_number(F.col("City")).alias("not_a_number"),
        C.event_within(key % 100).alias("within_90"),
        C.inactivity_bucket(key % 60).alias("bucket"),
        F.round(F.exp(-(key % 7)), 9).alias("decay"),
        F.round(C.power(F.lit(0.5), key % 5), 9).alias("halves"),
        F.try_divide(key.cast("double"), key % 3).alias("ratio"),
        C.nan_or_null_to(F.when(F.col("occupation").isNotNull(), 2.5), 1.0).alias("known"),
    )


@query(
    "blank_cells_to_null",
    """SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, l_orderkey,
              CASE WHEN l_quantity >= 5 AND l_quantity < 10 THEN 'RMS' WHEN l_quantity >= 10 AND l_quantity < 12 THEN 'OMS' END
                AS strrejectionby FROM lineitem""",
)
def blank_cells_to_null(t):
    quantity = F.col("l_quantity")
    cells = t.table("lineitem").select(
        "l_linenumber",
        "l_orderkey",
        F.when(quantity < 5, "  ").when(quantity < 10, "RMS").when(quantity < 12, "OMS").alias("strrejectionby"),
    )
    return readers.blanks_to_null(cells)


@query(
    "emptiness_check",
    with_tables(
        "order_log",
        """SELECT INST_TYPE, count(*) FILTER (OC > 4) = 0 AS no_large_orders FROM trade_log GROUP BY INST_TYPE
           UNION ALL SELECT 'whole log', count(*) = 0 FROM trade_log""",
    ),
)
def emptiness_check(t):
    """Per instrument whether no trade has five orders or more, and whether the log has a row at all."""
    kinds = t.order_log.groupBy("INST_TYPE").agg((F.count_if(F.col("OC") > 4) == 0).alias("no_large_orders"))
    whole = t.spark.createDataFrame([("whole log", not readers.has_rows(t.order_log))], "INST_TYPE string, no_large_orders boolean")
    return kinds.unionByName(whole)


@query(
    "daily_date_range",
    with_tables(
        "order_log kyc",
        """SELECT party_code, CAST(d AS DATE) AS day FROM (
             SELECT party_code, unnest(generate_series(f, l, INTERVAL 1 DAY)) AS d FROM (
               SELECT party_code, min(sauda_date) AS f, max(sauda_date) AS l
               FROM trade_log GROUP BY party_code))""",
    ),
)
def daily_date_range(t):
    spans = t.order_log.groupBy("party_code").agg(F.min("sauda_date").alias("f"), F.max("sauda_date").alias("l"))
    return spans.select("party_code", F.explode(F.sequence("f", "l")).alias("day"))


# Text with separators, quotes, line breaks, blanks and nothing.
_NOTE = """CASE party_code % 7 WHEN 0 THEN 'a, b' WHEN 1 THEN 'he said "x"' WHEN 2 THEN concat('line', chr(10), 'break') WHEN 3 THEN '  ' WHEN 4 THEN ''
             WHEN 5 THEN NULL ELSE INST_TYPE END"""


@query(
    "file_round_trip",
    with_tables(
        "order_log",
        f"""noted AS (SELECT *, {_NOTE} AS note FROM trade_log)
        SELECT format, INST_TYPE, count(*) AS rows_read, count(*) FILTER (note IS NULL OR note = '' AND format = 'csv') AS nulls,
               count(*) FILTER (note = '' AND format <> 'csv') AS blanks,
               CAST(sum(coalesce(length(note), 0)) AS BIGINT) AS chars, count(*) FILTER (note LIKE '%' || chr(10) || '%') AS breaks,
               count(*) FILTER (note LIKE '%"%') AS quotes, min(sauda_date) AS first_day, CAST(sum(OC) AS BIGINT) AS orders,
               round(sum(T_O), 2) AS turnover
        FROM noted, (VALUES ('csv'), ('orc'), ('parquet')) AS formats(format) GROUP BY format, INST_TYPE""",
    ),
)
def file_round_trip(t):
    """The trade log with awkward text, written in each format and read back; an empty text is a null in CSV."""
    rows = t.order_log.withColumn("note", F.expr(_NOTE.replace("chr(10)", "char(10)")))
    found = None
    for name, write in (("csv", readers.write_csv), ("orc", readers.write_orc), ("parquet", readers.write_parquet)):
        path = scratch_path(t.spark, name)
        write(rows, path)
        back = {"csv": lambda: readers.read_csv(t.spark, path, rows.schema, multiline=True), "orc": lambda: readers.read_orc(t.spark, path), "parquet": lambda: readers.read_parquet(t.spark, path)}[name]()
        text = F.col("note")
        one = back.groupBy(F.lit(name).alias("format"), "INST_TYPE").agg(
            F.count("*").alias("rows_read"), F.count_if(text.isNull()).alias("nulls"), F.count_if(text == "").alias("blanks"),
            F.sum(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("chars"), F.count_if(text.contains("\n")).alias("breaks"), F.count_if(text.contains('"')).alias("quotes"),
            F.min("sauda_date").alias("first_day"), F.sum("OC").cast("long").alias("orders"), F.round(F.sum("T_O"), 2).alias("turnover"),
        )
        found = one if found is None else found.unionByName(one)
    return found
