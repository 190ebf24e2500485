"""Report queries on rule-based predictions, profiles and density."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlife.functions import columns as C
from ledgerlife.operators import features, metrics
from ledgerlife.plans.features import next_trade_dataset_sql
from ledgerlife.plans.registry import query
from ledgerlife.plans.stages import _INTENDED, targets
from ledgerlife.sources.sample_tables import with_tables


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in columns})


def dataset(t):
    trades = t.purchase_log
    return features.next_trade_dataset(trades, t.kyc, t.trading_days(trades), t.tiers)


_BUCKETS = "(VALUES ('Overall', -1000000, 1000000), ('0-2', 0, 2), ('3-5', 3, 5), ('6-10', 6, 10), ('11-39', 11, 39), ('40-50', 40, 50)) AS b(bucket, lo, hi)"


@query(
    "baseline_regression_report",
    next_trade_dataset_sql(
        f"""rows AS (SELECT mean_last_3 AS p, inactive_days AS a FROM next_trade_rows WHERE mean_last_3 IS NOT NULL)
        SELECT bucket, count(a) AS total_records, round(sqrt(avg(pow(p - a, 2))) + 1e-9, 4) AS rmse,
               round(avg(abs(p - a)) + 1e-9, 4) AS mae
        FROM {_BUCKETS} LEFT JOIN rows ON a BETWEEN lo AND hi GROUP BY bucket"""
    ),
)
def baseline_regression_report(t):
    scored = features.baseline_predictor(dataset(t))
    return _round(metrics.regression_report(scored, "prediction", "inactive_days"), 4, "rmse", "mae")


@query(
    "baseline_regression_report_by_day",
    next_trade_dataset_sql(
        f"""rows AS (SELECT sauda_date, mean_last_3 AS p, inactive_days AS a FROM next_trade_rows),
        grid AS (SELECT sauda_date, bucket, lo, hi FROM (SELECT DISTINCT sauda_date FROM rows) CROSS JOIN {_BUCKETS})
        SELECT grid.sauda_date, bucket, count(a) AS total_records, round(sqrt(avg(pow(p - a, 2))) + 1e-9, 4) AS rmse,
               round(avg(abs(p - a)) + 1e-9, 4) AS mae
        FROM grid LEFT JOIN rows ON grid.sauda_date = rows.sauda_date AND a BETWEEN lo AND hi
        GROUP BY grid.sauda_date, bucket"""
    ),
)
def baseline_regression_report_by_day(t):
    scored = features.baseline_predictor(dataset(t))
    report = metrics.regression_report(scored, "prediction", "inactive_days", by=["sauda_date"])
    return _round(report, 4, "rmse", "mae")


@query(
    "baseline_predictor",
    next_trade_dataset_sql(
        """picked AS (SELECT party_code, sauda_date, inactive_days, mean_last_3 AS prediction FROM next_trade_rows)
        SELECT * FROM picked"""
    ),
)
def baseline_predictor(t):
    scored = features.baseline_predictor(dataset(t))
    return _round(scored.select("party_code", "sauda_date", "inactive_days", "prediction"), 6, "prediction")


def staged(t):
    """Settle target beside a naive prediction: the party stays in its present stage."""
    return targets(t).withColumn("prediction", C.settle_target(F.col("cumulative_trade_days")))


_STAGED = _INTENDED + """,
    staged AS (SELECT settle_target AS t, CASE WHEN cumulative_trade_days = 1 THEN 0
                      WHEN cumulative_trade_days IN (2, 3) THEN 1 ELSE 2 END AS p FROM targets)"""
_CLASSES = """,
    classes AS (SELECT t AS class FROM staged UNION SELECT p FROM staged),
    counts AS (
      SELECT class, (SELECT count(*) FROM staged WHERE t = class) AS support,
             (SELECT count(*) FROM staged WHERE p = class) AS predicted,
             (SELECT count(*) FROM staged WHERE p = class AND t = class) AS hits FROM classes),
    report AS (
      SELECT class, support, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS precision,
             coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall,
             coalesce(2.0 * hits / nullif(predicted + support, 0)::DOUBLE, 0) AS f1 FROM counts)"""


@query(
    "classification_report",
    with_tables(
        "order_log daily",
        _STAGED + _CLASSES + """
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
        FROM report""",
    ),
)
def classification_report(t):
    report = metrics.classification_report(staged(t), "settle_target", "prediction")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "classification_summary",
    with_tables(
        "order_log daily",
        _STAGED + _CLASSES + """
        SELECT (SELECT round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) FROM staged) AS accuracy,
               round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
               round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision,
               round(sum(recall * support) / sum(support), 6) AS weighted_recall,
               round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support
        FROM report""",
    ),
)
def classification_summary(t):
    summary = metrics.classification_summary(staged(t), "settle_target", "prediction")
    return summary.withColumns({c: F.round(c, 6) for c in summary.columns if c != "support"})


@query(
    "confusion_matrix",
    with_tables(
        "order_log daily",
        _STAGED + """
        SELECT t AS label, p AS prediction, count(*) AS rows,
               round(count(*) / sum(count(*)) OVER (PARTITION BY t)::DOUBLE, 6) AS share_of_label
        FROM staged GROUP BY t, p""",
    ),
)
def confusion_matrix(t):
    matrix = metrics.confusion_matrix(staged(t), "settle_target", "prediction")
    return matrix.withColumn("share_of_label", F.round("share_of_label", 6))


@query(
    "never_predicted",
    with_tables(
        "order_log daily",
        _INTENDED + """,
        rough AS (SELECT settle_target AS t, CASE WHEN cumulative_trade_days > 3 THEN 2 ELSE 0 END AS p FROM targets)
        SELECT DISTINCT t AS class FROM rough WHERE t NOT IN (SELECT p FROM rough)""",
    ),
)
def never_predicted(t):
    rough = F.when(F.col("cumulative_trade_days") > 3, 2).otherwise(0)
    return metrics.never_predicted(targets(t).withColumn("prediction", rough), "settle_target", "prediction")


@query(
    "feature_value_counts",
    with_tables(
        "kyc",
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", {c} AS value, count(*) AS count FROM client_kyc WHERE {c} IS NOT NULL GROUP BY {c}'
            for c in ("B2C", "gender", "riskcategory", "incomedetails", "occupation", "City")
        ),
    ),
)
def feature_value_counts(t):
    return metrics.feature_value_counts(t.kyc, ["B2C", "gender", "riskcategory", "incomedetails", "occupation", "City"])


@query(
    "column_modes",
    with_tables(
        "kyc",
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", arg_max(v, (n, -r)) AS mode, max(n) AS count FROM (SELECT {c} AS v, count(*) AS n, '
            f"row_number() OVER (ORDER BY {c}) AS r FROM client_kyc WHERE {c} IS NOT NULL GROUP BY {c})"
            for c in ("gender", "riskcategory", "incomedetails", "occupation", "City")
        ),
    ),
)
def column_modes(t):
    return metrics.column_modes(t.kyc, ["gender", "riskcategory", "incomedetails", "occupation", "City"])


@query(
    "null_profile",
    with_tables(
        "kyc",
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", count(*) FILTER ({c} IS NULL) AS nulls FROM client_kyc'
            for c in ("party_code", "B2C", "gender", "riskcategory", "incomedetails", "occupation", "birthdate",
                      "activefrom", "City")
        ),
    ),
)
def null_profile(t):
    return metrics.null_profile(t.kyc)


_GRID = list(range(0, 51, 2))


@query(
    "density",
    next_trade_dataset_sql(
        f"""scale AS (SELECT count(*) AS n, stddev_samp(inactive_days) * pow(count(*), -0.2) AS h FROM next_trade_rows)
        SELECT CAST(x AS DOUBLE) AS x,
               round(sum(exp(-0.5 * pow((x - inactive_days) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) + 1e-9, 6)
                 AS density
        FROM next_trade_rows CROSS JOIN scale CROSS JOIN (SELECT unnest({_GRID}) AS x) GROUP BY x"""
    ),
)
def density(t):
    return _round(metrics.density(dataset(t), "inactive_days", _GRID), 6, "density")
