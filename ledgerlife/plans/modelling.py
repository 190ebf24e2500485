"""Model queries: fits on the whole sample log, scored on later dates."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlife.operators import boosting, cox, explain, features, metrics, models, orders, parametric, search, survival
from ledgerlife.plans.metrics import dataset
from ledgerlife.plans.registry import query
from ledgerlife.plans.stages import _MART, daily, profile, states
from ledgerlife.plans.stages import settle_dataset as settle_rows
from ledgerlife.plans.survival import _LABEL, _LONG, _PERSON, long_subjects
from ledgerlife.session import reused
from ledgerlife.sources.sample_tables import with_tables

# -- next trade ---------------------------------------------------------------

SPLIT_DAY = "2024-01-15"


def _split(df, column, day):
    return df.filter(F.col(column) <= day), df.filter(F.col(column) > day)


def _regression(rows, column="sauda_date"):
    # Stored: training and scoring read one data set.
    train, test = _split(reused(rows), column, SPLIT_DAY)
    model = models.next_trade_model(train)
    return metrics.regression_report(models.regression_scores(model, test), "prediction", "inactive_days", by=[column])


@query("next_trade_model")
def next_trade_model(t):
    return _regression(dataset(t))


@query("next_trade_model_below_4")
def next_trade_model_below_4(t):
    trades = t.purchase_log
    rows = features.next_trade_dataset(
        trades, t.kyc, t.trading_days(trades), t.tiers, min_days=None, max_days=3, with_recency=False
    )
    train, test = _split(reused(rows), "sauda_date", "2024-01-08")
    model = models.next_trade_model(train)
    return metrics.regression_report(models.regression_scores(model, test), "prediction", "inactive_days")


@query("next_trade_model_week")
def next_trade_model_week(t):
    trades = t.purchase_log
    weeks = features.week_cohort(trades, t.kyc, t.trading_days(trades), min_days=2)
    return _regression(features.with_demographics(weeks, t.kyc, t.tiers, day="week_start"), "week_start")


@query("next_trade_model_week_below_4")
def next_trade_model_week_below_4(t):
    trades = t.purchase_log
    weeks = features.week_cohort(trades, t.kyc, t.trading_days(trades), min_days=1, max_days=3)
    rows = features.with_demographics(weeks.drop(*features.RECENCY), t.kyc, t.tiers, day="week_start")
    train, test = _split(reused(rows), "week_start", "2024-01-08")
    model = models.next_trade_model(train)
    return metrics.regression_report(models.regression_scores(model, test), "prediction", "inactive_days")


# -- settle and frequent ------------------------------------------------------

# A year's horizon fits the sample log, whose parties trade every few months.
HORIZON = 365
#: Rounds that the second configuration and the comparison with one against the rest run.
ROUNDS = 4


def _marts(t, *ranges):
    """Marts of several date ranges over one daily summary and one order profile, both computed once."""
    summary, detail = reused(daily(t, t.order_tasks)), reused(profile(t, min(start for start, _ in ranges)))
    targets = [states.transition_targets(summary, start, end, HORIZON, t.order_tasks) for start, end in ranges]
    return [orders.customer_feature_mart(rows, t.order_log, detail, t.kyc, "2022-02-03", tasks=t.order_tasks) for rows in targets]


def settle_sets(t):
    """First-trade rows of two date ranges, both built by the same function and stored."""
    marts = _marts(t, ("1995-01-01", "1995-12-31"), ("1996-01-01", "2001-08-01"))
    return [reused(orders.settle_dataset(mart, t.tiers)) for mart in marts]


def frequent_sets(t):
    marts = _marts(t, ("1995-01-01", "1996-12-31"), ("1997-01-01", "2001-08-01"))
    return [reused(orders.frequent_dataset(mart, t.tiers)) for mart in marts]


def _scored(model, test, label, classes):
    return models.score(model, models.labelled(test, label), classes)


def _report(model, test, label, classes):
    return metrics.classification_report(_scored(model, test, label, classes), label, "prediction")


_TEXTS = {"occupation": ("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY")}
_NUMBERS, _BOOLEANS = ("T_O", "underlying_assets_cnt", "rejected_by_cnt", "age"), ("has_mis_trade", "has_cnc_trade")
# One-hot texts, numbers with the mean and flags with the most frequent value for gaps, all standardised.
_ENTRIES = [f"CAST(coalesce({c} = '{v}', false) AS DOUBLE)" for c, values in _TEXTS.items() for v in values]
_ENTRIES += [f"coalesce(CAST({c} AS DOUBLE), avg({c}) OVER ())" for c in _NUMBERS]
_ENTRIES += [f"CAST(coalesce({c}, (SELECT mode({c}) FROM chosen)) = {v} AS DOUBLE)" for c in _BOOLEANS for v in ("false", "true")]


@query(
    "preprocessed_vector",
    with_tables(
        "order_log kyc tiers daily order_detail",
        _MART + f""",
        chosen AS (SELECT * FROM mart WHERE cumulative_trade_days = 1 AND sauda_date <= DATE '2000-06-30'),
        entries AS (SELECT settle_target, {", ".join(f"{e} AS e{i}" for i, e in enumerate(_ENTRIES))} FROM chosen)
        SELECT settle_target, {", ".join(
            f"round(coalesce((e{i} - avg(e{i}) OVER ()) / nullif(stddev_samp(e{i}) OVER (), 0), 0), 6) + 0.0::DOUBLE AS x{i}" for i in range(len(_ENTRIES)))}
        FROM entries""",
    ),
)
def preprocessed_vector(t):
    """The preprocessing of some columns of each kind, entry by entry."""
    rows = reused(settle_rows(t).select("settle_target", *_TEXTS, *_NUMBERS, *_BOOLEANS))
    fitted = Pipeline(stages=models.preprocessing(rows, "settle_target")).fit(rows)
    values = fitted.transform(rows).select("settle_target", vector_to_array("features").alias("f"))
    return values.select("settle_target", *[(F.round(F.get("f", F.lit(i)), 6) + 0.0).alias(f"x{i}") for i in range(len(_ENTRIES))])


@query("preprocessed_features")
def preprocessed_features(t):
    train, test = settle_sets(t)
    fitted = Pipeline(stages=models.preprocessing(train, "settle_target")).fit(train)
    return fitted.transform(test).select("settle_target", vector_to_array("features").alias("features"))


@query("settle_random_forest")
def settle_random_forest(t):
    train, test = settle_sets(t)
    return _report(models.classify_random_forest(train, "settle_target"), test, "settle_target", 3)


@query("settle_decision_tree")
def settle_decision_tree(t):
    train, test = settle_sets(t)
    return _report(models.classify_decision_tree(train, "settle_target"), test, "settle_target", 3)


@query("settle_logistic")
def settle_logistic(t):
    train, test = settle_sets(t)
    return _scored(models.classify_logistic(train, "settle_target"), test, "settle_target", 3).select(
        "settle_target", "prediction", "probability_class_0", "probability_class_1", "probability_class_2"
    )


@query("settle_boosted_trees")
def settle_boosted_trees(t):
    train, test = settle_sets(t)
    model = models.classify_boosted_trees(train, "settle_target", 3, models.SETTLE)
    return _scored(model, test, "settle_target", 3).select(
        "settle_target", "prediction", "probability_class_0", "probability_class_1", "probability_class_2"
    )


@query("settle_boosted_trees_2")
def settle_boosted_trees_2(t):
    train, test = settle_sets(t)
    model = models.classify_boosted_trees(train, "settle_target", 3, models.SETTLE, "boosted_trees_2", rounds=ROUNDS)
    return _scored(model, test, "settle_target", 3).select(
        "settle_target", "prediction", "probability_class_0", "probability_class_1", "probability_class_2"
    )


@query("frequent_random_forest")
def frequent_random_forest(t):
    train, test = frequent_sets(t)
    return _report(models.classify_random_forest(train, "frequent_target", models.FREQUENT), test, "frequent_target", 2)


@query("frequent_decision_tree")
def frequent_decision_tree(t):
    train, test = frequent_sets(t)
    return _report(models.classify_decision_tree(train, "frequent_target", models.FREQUENT), test, "frequent_target", 2)


@query("frequent_logistic")
def frequent_logistic(t):
    train, test = frequent_sets(t)
    return _report(models.classify_logistic(train, "frequent_target", models.FREQUENT), test, "frequent_target", 2)


@query("frequent_boosted_trees")
def frequent_boosted_trees(t):
    train, test = frequent_sets(t)
    model = models.classify_boosted_trees(train, "frequent_target", 2, models.FREQUENT)
    return _scored(model, test, "frequent_target", 2).select(
        "frequent_target", "prediction", "probability_class_0", "probability_class_1"
    )


# Three features of each trade and a label of three classes that depends on them.
_BOOSTED = """rows AS (
      SELECT OC AS f0, party_code % 11 AS f1, month(sauda_date) AS f2, CAST((OC * 2 + party_code % 11 + month(sauda_date) // 4 + party_code % 3) % 3 AS INTEGER) AS y
      FROM trade_log),
    shares AS (SELECT y AS k, count(*) / (SELECT count(*) FROM rows)::DOUBLE AS p FROM rows GROUP BY y),
    marked AS (
      SELECT k, f0, f1, f2, 0 AS node, p - (y = k)::INTEGER AS g, 1.5 * p * (1 - p) AS h FROM rows, shares),
    edges AS (
      SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS edge
      FROM (SELECT DISTINCT 0 AS f, f0 AS v FROM rows UNION SELECT DISTINCT 1, f1 FROM rows UNION SELECT DISTINCT 2, f2 FROM rows))"""
_SPLITS = """,
    cells{i} AS (
      SELECT k, node, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n
      FROM (SELECT k, node, g, h, unnest([0, 1, 2]) AS f, unnest([f0, f1, f2]) AS v FROM {rows}) GROUP BY ALL),
    left{i} AS (
      SELECT k, node, f, v, sum(g) OVER (w ORDER BY v) AS gl, sum(h) OVER (w ORDER BY v) AS hl, CAST(sum(n) OVER (w ORDER BY v) AS BIGINT) AS nl,
             sum(g) OVER w AS tg, sum(h) OVER w AS th, sum(n) OVER w AS tn FROM cells{i} WINDOW w AS (PARTITION BY k, node, f)),
    gains{i} AS (
      SELECT *, pow(greatest(abs(gl) - 0.5, 0), 2) / (hl + 2) + pow(greatest(abs(tg - gl) - 0.5, 0), 2) / (th - hl + 2)
                - pow(greatest(abs(tg) - 0.5, 0), 2) / (th + 2) AS gain
      FROM left{i} JOIN edges USING (f, v) WHERE edge IS NOT NULL AND nl >= 20 AND tn - nl >= 20 AND hl >= 0.001 AND th - hl >= 0.001)"""
_STEP = boosting.Boosting(rounds=1, learning_rate=1.5, max_depth=2, num_leaves=4, lambda_l1=0.5, lambda_l2=2.0)


def _boosting_rows(t):
    party = F.col("party_code") % 11
    label = (F.col("OC") * 2 + party + F.floor(F.month("sauda_date") / 4) + F.col("party_code") % 3) % 3
    return t.order_log.select(F.col("OC").alias("f0"), party.alias("f1"), F.month("sauda_date").alias("f2"), label.cast("int").alias("y"))


@query(
    "boosted_split_gains",
    with_tables(
        "order_log",
        _BOOSTED + _SPLITS.format(i=0, rows="marked") + """
        SELECT CAST(k AS INTEGER) AS "class", 'f' || f AS feature, edge::DOUBLE AS edge, nl AS rows_left, round(gain, 6) AS gain FROM gains0 WHERE gain >= 0""",
    ),
)
def boosted_split_gains(t):
    """Every split of the first round's roots with its gain."""
    rows = reused(_boosting_rows(t))
    model = boosting.prepared(rows, "y", ["f0", "f1", "f2"], 3, _STEP)
    ready, usual = boosting.boosting_rows(rows, "y", model)
    roots = [boosting.Tree(0, [-1], [0], [0.0]) for _ in range(3)]
    hist = boosting.histogram(ready, roots, 0, [{0}] * 3, range(3), 3, 3)
    found = boosting.candidates(hist, usual, boosting.root_totals(ready, 3), _STEP)
    edge = F.get(F.get(F.array(*[F.array(*[F.lit(v) for v in e]) for e in model.edges]), F.col("f")), F.col("b"))
    return found.select(F.col("k").alias("class"), F.concat(F.lit("f"), F.col("f").cast("string")).alias("feature"), edge.alias("edge"), F.col("nl").alias("rows_left"), F.round("gain", 6).alias("gain"))


_LEAF = "-1.5 * sign({g}) * greatest(abs({g}) - 0.5, 0) / ({h} + 2)"


@query(
    "boosted_first_trees",
    with_tables(
        "order_log",
        _BOOSTED + _SPLITS.format(i=0, rows="marked") + """,
        best0 AS (SELECT * FROM gains0 WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, v) = 1),
        halves AS (
          SELECT m.k, f0, f1, f2, CASE WHEN [f0, f1, f2][b.f + 1] < b.edge THEN 1 ELSE 2 END AS node, m.g, m.h FROM marked m JOIN best0 b ON b.k = m.k)"""
        + _SPLITS.format(i=1, rows="halves") + """,
        best1 AS (SELECT * FROM gains1 WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, v) = 1),
        tops AS (SELECT k, node, sum(g) AS g, sum(h) AS h FROM halves GROUP BY k, node),
        nodes AS (
          SELECT k, 0 AS node, 'f' || f AS feature, edge::DOUBLE AS edge, NULL::DOUBLE AS value FROM best0
          UNION ALL SELECT k, node, 'f' || f, edge::DOUBLE, NULL FROM best1
          UNION ALL SELECT k, node, NULL, NULL, """ + _LEAF.format(g="g", h="h") + """ FROM tops ANTI JOIN best1 USING (k, node)
          UNION ALL SELECT k, 2 * node + 1, NULL, NULL, """ + _LEAF.format(g="gl", h="hl") + """ FROM best1
          UNION ALL SELECT k, 2 * node + 2, NULL, NULL, """ + _LEAF.format(g="(tg - gl)", h="(th - hl)") + """ FROM best1)
        SELECT 0 AS round, CAST(k AS INTEGER) AS "class", node, feature, edge, round(value, 9) AS value FROM nodes""",
    ),
)
def boosted_first_trees(t):
    """The trees of one round, two levels deep."""
    rows = reused(_boosting_rows(t))
    return boosting.tree_nodes(rows, boosting.fit_boosted(rows, "y", ["f0", "f1", "f2"], 3, _STEP)).withColumn("value", F.round("value", 9))


@query("settle_one_against_rest")
def settle_one_against_rest(t):
    """Log loss on the later range of the softmax trees and of MLlib's one against the rest, with the same number of trees."""
    train, test = settle_sets(t)
    many = {**models.SETTLE, "one_against_rest": {**models.SETTLE["one_against_rest"], "maxIter": ROUNDS}}
    fits = {"softmax": models.classify_boosted_trees(train, "settle_target", 3, rounds=ROUNDS), "one_against_rest": models.classify_one_against_rest(train, "settle_target", 3, many)}
    rows = [(name, models.evaluate(model, test, "settle_target", 3).first()["test_log_loss"]) for name, model in fits.items()]
    return t.spark.createDataFrame(rows, "model string, log_loss double")


@query("model_evaluation")
def model_evaluation(t):
    train, test = frequent_sets(t)
    model = models.classify_decision_tree(train, "frequent_target", models.FREQUENT)
    return models.evaluate(model, test, "frequent_target", 2)


@query(
    "evaluation",
    with_tables(
        "order_log",
        """scored AS (
          SELECT CASE WHEN OC >= 3 THEN 1 ELSE 0 END AS y, (party_code * 7 + OC * 13) % 97 / 97.0::DOUBLE AS p FROM trade_log),
        told AS (SELECT y, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS h FROM scored),
        per AS (
          SELECT c, count(*) FILTER (y = c)::DOUBLE AS support, count(*) FILTER (h = c)::DOUBLE AS predicted,
                 count(*) FILTER (y = c AND h = c)::DOUBLE AS hits
          FROM told, (VALUES (0), (1)) AS classes(c) GROUP BY c),
        report AS (
          SELECT *, hits / predicted AS precision_, hits / support AS recall_, 2 * hits / (predicted + support) AS f1_ FROM per),
        levels AS (SELECT p, count(*) FILTER (y = 1)::DOUBLE AS up, count(*) FILTER (y = 0)::DOUBLE AS down FROM told GROUP BY p),
        ranked AS (SELECT *, sum(down) OVER (ORDER BY p) - down AS below FROM levels),
        auc AS (SELECT sum(up * (below + down / 2)) / (sum(up) * sum(down)) AS area FROM ranked),
        loss AS (SELECT avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15))) AS log_loss FROM told)
        SELECT round(sum(hits) / sum(support), 9) AS test_accuracy, round(avg(precision_), 9) AS test_macro_precision,
               round(avg(recall_), 9) AS test_macro_recall, round(avg(f1_), 9) AS test_macro_f1,
               round(sum(precision_ * support) / sum(support), 9) AS test_weighted_precision,
               round(sum(recall_ * support) / sum(support), 9) AS test_weighted_recall,
               round(sum(f1_ * support) / sum(support), 9) AS test_weighted_f1, round(sum(support), 9) AS test_support,
               round((SELECT log_loss FROM loss), 9) AS test_log_loss, round((SELECT area FROM auc), 9) AS test_roc_auc
        FROM report""",
    ),
)
def evaluation(t):
    chance = ((F.col("party_code") * 7 + F.col("OC") * 13) % 97) / F.lit(97.0)
    rows = t.order_log.select((F.col("OC") >= 3).cast("int").alias("y"), chance.alias("probability_class_1"))
    rows = rows.withColumns(
        {"probability_class_0": 1 - F.col("probability_class_1"), "prediction": (F.col("probability_class_1") >= 0.5).cast("int")}
    )
    found = models.evaluation(rows, "y", 2)
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query("model_search")
def model_search(t):
    train, _ = frequent_sets(t)
    found = models.model_search(train, "frequent_target", 2, models.FREQUENT, parallelism=4)
    return models.search_results(t.spark, found)


@query("budgeted_search")
def budgeted_search(t):
    """Successive halving over nine configurations within two minutes."""
    train, _ = frequent_sets(t)
    return search.search_table(t.spark, search.budgeted_search(train, "frequent_target", 2, 120, configurations=9))


@query("tree_importance")
def tree_importance(t):
    train, test = frequent_sets(t)
    model = models.classify_decision_tree(train, "frequent_target", models.FREQUENT)
    return explain.tree_importance(model, models.labelled(test, "frequent_target"))


def _inputs(df, label):
    return [name for names in models.feature_columns(df, label).values() for name in names]


@query("permutation_importance")
def permutation_importance(t):
    train, test = frequent_sets(t)
    model = models.classify_decision_tree(train, "frequent_target", models.FREQUENT)
    rows = models.labelled(test, "frequent_target")
    return explain.permutation_importance(model, rows, "frequent_target", _inputs(rows, "frequent_target"))


_PARTY = ("trades", "orders", "days")


@query(
    "kernel_shap_linear",
    with_tables(
        "order_log",
        """parties AS (
          SELECT party_code, count(*) AS trades, CAST(sum(OC) AS BIGINT) AS orders, count(DISTINCT sauda_date) AS days FROM trade_log GROUP BY party_code),
        marked AS (SELECT *, md5(concat_ws('|', '0', trades, orders, days)) AS mark FROM parties),
        background AS (SELECT * FROM marked ORDER BY mark LIMIT 10),
        examples AS (SELECT * FROM marked ORDER BY mark, party_code LIMIT 100),
        middle AS (SELECT avg(trades) AS m0, avg(orders) AS m1, avg(days) AS m2 FROM background)
        SELECT party_code, unnest(['trades', 'orders', 'days']) AS feature,
               unnest([round(2 * (trades - m0), 6) + 0.0::DOUBLE, round(-0.5 * (orders - m1), 6) + 0.0::DOUBLE, round(0.25 * (days - m2), 6) + 0.0::DOUBLE]) AS contribution,
               round(2 * m0 - 0.5 * m1 + 0.25 * m2, 6) AS base, round(2 * trades - 0.5 * orders + 0.25 * days, 6)::DOUBLE AS predicted
        FROM examples, middle""",
    ),
)
def kernel_shap_linear(t):
    """Kernel SHAP of a linear function, whose contributions are known."""
    parties = t.order_log.groupBy("party_code").agg(F.count("*").alias("trades"), F.sum("OC").cast("long").alias("orders"), F.count_distinct("sauda_date").alias("days"))
    score = lambda df: df.withColumn("prediction", 2.0 * F.col("trades") - 0.5 * F.col("orders") + 0.25 * F.col("days"))
    found = explain.kernel_shap(score, parties, parties, _PARTY, keep=["party_code"])
    return found.select("party_code", "feature", *[(F.round(c, 6) + 0.0).alias(c) for c in ("contribution", "base", "predicted")])


@query("kernel_shap_importance")
def kernel_shap_importance(t):
    """Mean absolute Kernel SHAP contribution of each feature, over 100 examples and 10 background rows."""
    train, test = frequent_sets(t)
    model = models.classify_decision_tree(train, "frequent_target", models.FREQUENT)
    rows = models.labelled(test, "frequent_target")
    return explain.shapley_importance(explain.kernel_shap(model.transform, train, rows, _inputs(rows, "frequent_target")))


@query("shapley_importance")
def shapley_importance(t):
    train, test = frequent_sets(t)
    model = models.classify_decision_tree(train, "frequent_target", models.FREQUENT)
    rows = models.labelled(test, "frequent_target")
    values = explain.shapley_values(model, train, rows, _inputs(rows, "frequent_target"))
    return explain.shapley_importance(values)


# -- survival models ----------------------------------------------------------

COVARIATES = ["Tier", "occupation", "new_incomedetails", "gender_f", "riskcategory_new"]
STRATUM = f"{_LABEL}_new"


def encoded(t):
    """Survival subjects with 0/1 covariates, as the hazard model takes them."""
    rows = reused(long_subjects(t).select("tenure", "target", STRATUM, *COVARIATES))
    return survival.dummies(rows, COVARIATES)


def _names(df):
    return [c for c in df.columns if c not in ("tenure", "target", STRATUM)]


def fitted_cox(t):
    rows = encoded(t)
    return cox.cox_fit(rows, "tenure", "target", _names(rows), [STRATUM]), rows


@query("cox_summary")
def cox_summary(t):
    return cox.cox_summary(fitted_cox(t)[0])


# The partial likelihood at coefficients of 0.2 and -0.1, written out step by step.
_COX = _LONG + ",\n    people AS (" + _PERSON + f"""),
    centre AS (SELECT avg(gender_f::DOUBLE) AS m1, avg(riskcategory_new::DOUBLE) AS m2 FROM people),
    subjects AS (
      SELECT tenure AS t, target AS e, {_LABEL}_new AS g, gender_f - m1 AS z1, riskcategory_new - m2 AS z2,
             exp(0.2 * (gender_f - m1) - 0.1 * (riskcategory_new - m2)) AS w
      FROM people, centre),
    daily_sums AS (
      SELECT g, t, count(*) FILTER (e = 1) AS d, sum(w) AS w0, sum(w * z1) AS w1, sum(w * z2) AS w2, sum(w * z1 * z1) AS w11,
             sum(w * z1 * z2) AS w12, sum(w * z2 * z2) AS w22, coalesce(sum(w) FILTER (e = 1), 0) AS t0,
             coalesce(sum(w * z1) FILTER (e = 1), 0) AS t1, coalesce(sum(w * z2) FILTER (e = 1), 0) AS t2,
             coalesce(sum(w * z1 * z1) FILTER (e = 1), 0) AS t11, coalesce(sum(w * z1 * z2) FILTER (e = 1), 0) AS t12,
             coalesce(sum(w * z2 * z2) FILTER (e = 1), 0) AS t22
      FROM subjects GROUP BY g, t),
    at_risk AS (
      SELECT g, t, d, t0, t1, t2, t11, t12, t22, sum(w0) OVER later AS s0, sum(w1) OVER later AS s1, sum(w2) OVER later AS s2,
             sum(w11) OVER later AS s11, sum(w12) OVER later AS s12, sum(w22) OVER later AS s22
      FROM daily_sums WINDOW later AS (PARTITION BY g ORDER BY t DESC)),
    baseline AS (
      SELECT g, t, d / s0 AS hazard, sum(d / s0) OVER (PARTITION BY g ORDER BY t) AS cumulative FROM at_risk)"""


@query(
    "cox_partial_likelihood",
    with_tables(
        "order_log kyc tiers daily",
        _COX + """,
        steps AS (
          SELECT *, k / d::DOUBLE AS a FROM (SELECT *, unnest(generate_series(0, d - 1)) AS k FROM at_risk WHERE d > 0)),
        terms AS (
          SELECT s0 - a * t0 AS f, s1 - a * t1 AS f1, s2 - a * t2 AS f2, s11 - a * t11 AS f11, s12 - a * t12 AS f12,
                 s22 - a * t22 AS f22 FROM steps),
        sums AS (
          SELECT sum(ln(f)) AS l, sum(f1 / f) AS g1, sum(f2 / f) AS g2, sum(f11 / f - f1 * f1 / (f * f)) AS i11,
                 sum(f12 / f - f1 * f2 / (f * f)) AS i12, sum(f22 / f - f2 * f2 / (f * f)) AS i22 FROM terms),
        seen AS (SELECT sum(z1) AS x1, sum(z2) AS x2 FROM subjects WHERE e = 1)
        SELECT unnest(['log_likelihood', 'gradient_gender_f', 'gradient_riskcategory_new', 'information_gender_f_gender_f',
                       'information_gender_f_riskcategory_new', 'information_riskcategory_new_riskcategory_new']) AS quantity,
               unnest([round(0.2 * x1 - 0.1 * x2 - l, 4), round(x1 - g1, 4), round(x2 - g2, 4), round(i11, 4), round(i12, 4),
                       round(i22, 4)]) AS value
        FROM sums, seen""",
    ),
)
def cox_partial_likelihood(t):
    rows = cox.partial_likelihood(long_subjects(t), "tenure", "target", ["gender_f", "riskcategory_new"], [0.2, -0.1], [STRATUM])
    return rows.withColumn("value", F.round("value", 4))


def _given_cox(t):
    rows = long_subjects(t)
    return cox.cox_at(rows, "tenure", "target", ["gender_f", "riskcategory_new"], [0.2, -0.1], [STRATUM])[0], rows


@query(
    "cox_baseline_given",
    with_tables(
        "order_log kyc tiers daily",
        _COX + f"""
        SELECT g AS {STRATUM}, t AS duration, round(hazard, 9) AS baseline_hazard,
               round(cumulative, 9) AS baseline_cumulative_hazard, round(exp(-cumulative), 9) AS baseline_survival FROM baseline""",
    ),
)
def cox_baseline_given(t):
    found = cox.cox_baseline(_given_cox(t)[0])
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.startswith("baseline")})


@query(
    "cox_predict_given",
    with_tables(
        "order_log kyc tiers daily",
        _COX + f""",
        times(h) AS (VALUES (9), (30), (90)),
        level AS (
          SELECT g, h, coalesce(max(cumulative) FILTER (t <= h), 0) AS h0 FROM baseline, times GROUP BY g, h)
        SELECT party_code, sauda_date, h AS "time",
               round(exp(0.2 * (gender_f - m1) - 0.1 * (riskcategory_new - m2)), 9) AS partial_hazard,
               round(h0 * exp(0.2 * (gender_f - m1) - 0.1 * (riskcategory_new - m2)), 9) AS cumulative_hazard,
               round(exp(-h0 * exp(0.2 * (gender_f - m1) - 0.1 * (riskcategory_new - m2))), 9) AS survival
        FROM people JOIN level ON g = {STRATUM}, centre""",
    ),
)
def cox_predict_given(t):
    model, rows = _given_cox(t)
    found = cox.cox_predict(model, rows, [9, 30, 90])
    return found.select(
        "party_code", "sauda_date", "time", *[F.round(c, 9).alias(c) for c in ("partial_hazard", "cumulative_hazard", "survival")]
    )


@query("cox_baseline")
def cox_baseline(t):
    return cox.cox_baseline(fitted_cox(t)[0])


@query("cox_predict")
def cox_predict(t):
    model, rows = fitted_cox(t)
    return cox.cox_predict(model, rows, [9, 30, 90])


@query("cox_tests")
def cox_tests(t):
    return cox.cox_tests(fitted_cox(t)[0])


_RESIDUAL = _COX + """,
        steps AS (
          SELECT *, k / d::DOUBLE AS a FROM (SELECT *, unnest(generate_series(0, d - 1)) AS k FROM at_risk WHERE d > 0)),
        terms AS (
          SELECT g, t, s0 - a * t0 AS f, s1 - a * t1 AS f1, s2 - a * t2 AS f2, s11 - a * t11 AS f11, s12 - a * t12 AS f12,
                 s22 - a * t22 AS f22 FROM steps),
        information AS (
          SELECT sum(f11 / f - f1 * f1 / (f * f)) AS i11, sum(f12 / f - f1 * f2 / (f * f)) AS i12, sum(f22 / f - f2 * f2 / (f * f)) AS i22 FROM terms),
        expected AS (SELECT g, t, sum(f1 / f) AS e1, sum(f2 / f) AS e2 FROM terms GROUP BY g, t),
        seen AS (SELECT g, t, count(*) AS d, sum(z1) AS x1, sum(z2) AS x2 FROM subjects WHERE e = 1 GROUP BY g, t),
        residuals AS (
          SELECT g, t, d, x1 - e1 AS r1, x2 - e2 AS r2, (SELECT count(*) FROM subjects WHERE e = 1) AS n, i11, i12, i22, i11 * i22 - i12 * i12 AS det
          FROM seen JOIN expected USING (g, t), information)"""


@query(
    "schoenfeld_given",
    with_tables(
        "order_log kyc tiers daily",
        _RESIDUAL + f"""
        SELECT g AS {STRATUM}, t AS duration, d AS events, unnest(['gender_f', 'riskcategory_new']) AS covariate,
               unnest([round(r1, 6) + 0.0::DOUBLE, round(r2, 6) + 0.0::DOUBLE]) AS residual,
               unnest([round(n * (i22 * r1 - i12 * r2) / det / d + 0.2, 6), round(n * (i11 * r2 - i12 * r1) / det / d - 0.1, 6)]) AS scaled
        FROM residuals""",
    ),
)
def schoenfeld_given(t):
    """Residuals of the proportional hazards at given coefficients, plain and scaled."""
    found = cox.schoenfeld_residuals(_given_cox(t)[0])
    return found.withColumns({"residual": F.round("residual", 6) + 0.0, "scaled": F.round("scaled", 6)})


@query("residual_trend")
def residual_trend(t):
    """Local lines through the scaled residuals, by intervals of 30 days."""
    return cox.residual_trend(cox.schoenfeld_residuals(fitted_cox(t)[0]), 30)


@query("ph_assumption_test_km")
def ph_assumption_test_km(t):
    return cox.ph_assumption_test(fitted_cox(t)[0], transform="km")


@query("ph_assumption_test")
def ph_assumption_test(t):
    return cox.ph_assumption_test(fitted_cox(t)[0])


@query(
    "exponential_fit",
    with_tables(
        "order_log daily",
        _LONG + """,
        totals AS (SELECT sum(target)::DOUBLE AS d, sum(tenure)::DOUBLE AS e FROM surv)
        SELECT round(e / d, 6) AS lambda_, round(-d * ln(e / d) - d, 4) AS log_likelihood,
               round(2.0 + 2.0 * (d * ln(e / d) + d), 4) AS aic FROM totals""",
    ),
)
def exponential_fit(t):
    fit = parametric.exponential_fit(long_subjects(t), "tenure", "target")
    return fit.withColumns(
        {"lambda_": F.round("lambda_", 6), "log_likelihood": F.round("log_likelihood", 4), "aic": F.round("aic", 4)}
    )


@query("parametric_survival")
def parametric_survival(t):
    return parametric.parametric_survival(long_subjects(t), "tenure", "target")


@query("aft_regression")
def aft_regression(t):
    rows = encoded(t)
    model = parametric.aft_regression(rows, "tenure", "target", _names(rows))
    return parametric.aft_summary(t.spark, model, _names(rows))


# Log likelihood with first and second derivatives by the error z, as SQL: of events, and of censored rows.
_SOFT = "ln(1 + exp(z))"
_P = "(1 / (1 + exp(-z)))"
_AFT_TERMS = {
    "weibull": (("z - exp(z)", "1 - exp(z)", "-exp(z)"), ("-exp(z)", "-exp(z)", "-exp(z)")),
    "log_logistic": ((f"z - 2 * {_SOFT}", f"1 - 2 * {_P}", f"-2 * {_P} * (1 - {_P})"), (f"-{_SOFT}", f"-{_P}", f"-{_P} * (1 - {_P})")),
}
_AFT_SUMS = {
    "log_likelihood": "l - CASE WHEN e = 1 THEN ln(0.7) + ln(t) ELSE 0 END", "gradient_intercept": "-a / 0.7", "gradient_gender_f": "-a * x1 / 0.7",
    "gradient_riskcategory_new": "-a * x2 / 0.7", "gradient_log_scale": "-a * z - e", "information_intercept_intercept": "-b / 0.49",
    "information_intercept_gender_f": "-b * x1 / 0.49", "information_intercept_riskcategory_new": "-b * x2 / 0.49",
    "information_intercept_log_scale": "-(a + b * z) / 0.7", "information_gender_f_gender_f": "-b * x1 * x1 / 0.49",
    "information_gender_f_riskcategory_new": "-b * x1 * x2 / 0.49", "information_gender_f_log_scale": "-(a + b * z) * x1 / 0.7",
    "information_riskcategory_new_riskcategory_new": "-b * x2 * x2 / 0.49", "information_riskcategory_new_log_scale": "-(a + b * z) * x2 / 0.7",
    "information_log_scale_log_scale": "-(a * z + b * z * z)",
}
_AFT_GIVEN = ([4.8, 0.1, -0.05], 0.7)


def _aft_sql(distribution):
    event, censored = _AFT_TERMS[distribution]
    either = ", ".join(f"CASE WHEN e = 1 THEN {x} ELSE {y} END AS {n}" for x, y, n in zip(event, censored, "lab"))
    return f"""
        SELECT '{distribution}' AS distribution, unnest([{", ".join(f"'{n}'" for n in _AFT_SUMS)}]) AS quantity,
               unnest([{", ".join(f"round(sum({v}), 4)" for v in _AFT_SUMS.values())}]) AS value
        FROM (SELECT *, {either} FROM errors)"""


@query(
    "aft_likelihood_given",
    with_tables(
        "order_log kyc tiers daily",
        _LONG + ",\n    people AS (" + _PERSON + """),
        errors AS (
          SELECT tenure::DOUBLE AS t, target AS e, gender_f::DOUBLE AS x1, riskcategory_new::DOUBLE AS x2,
                 (ln(tenure) - 4.8 - 0.1 * gender_f + 0.05 * riskcategory_new) / 0.7 AS z FROM people)""" + " UNION ALL ".join(map(_aft_sql, _AFT_TERMS)),
    ),
)
def aft_likelihood_given(t):
    """Likelihood, gradient and information of accelerated failure times at given values."""
    rows, found = reused(long_subjects(t)), None
    for distribution in _AFT_TERMS:
        one = parametric.aft_likelihood(rows, "tenure", "target", ["gender_f", "riskcategory_new"], distribution, *_AFT_GIVEN)
        one = one.select(F.lit(distribution).alias("distribution"), "quantity", F.round("value", 4).alias("value"))
        found = one if found is None else found.unionByName(one)
    return found


@query("aft_fits")
def aft_fits(t):
    """Accelerated failure times by three distributions, with errors, intervals and AIC."""
    rows, found = encoded(t), None
    for distribution in parametric.ERRORS:
        one = parametric.aft_fit_summary(t.spark, parametric.aft_fit(rows, "tenure", "target", _names(rows), distribution))
        found = one if found is None else found.unionByName(one)
    return found


_FITS = {"weibull": (150.0, 1.2), "exponential": (150.0,), "log_normal": (120.0, 1.1), "log_logistic": (110.0, 1.5)}


@query(
    "parametric_likelihoods",
    with_tables(
        "order_log daily",
        _LONG + """,
        errors AS (
          SELECT tenure::DOUBLE AS t, target AS e, (ln(tenure) - ln(150.0)) * 1.2 AS w, tenure / 150.0 AS x, (ln(tenure) - ln(120.0)) / 1.1 AS n,
                 (ln(tenure) - ln(110.0)) * 1.5 AS g FROM surv),
        tails AS (
          SELECT n, 0.5 - 0.5 * sign(n) * 2 / sqrt(pi()) * exp(-n * n / 2)
                    * coalesce(sum(exp((2 * k + 1) * ln(abs(n) / sqrt(2)) + k * ln(2) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))), 0) AS tail
          FROM (SELECT DISTINCT n FROM errors WHERE n <> 0), range(0, 120) AS r(k) GROUP BY n UNION ALL SELECT 0, 0.5),
        fits AS (
          SELECT 'weibull' AS distribution, 2 AS p, sum(CASE WHEN e = 1 THEN w - exp(w) + ln(1.2) - ln(t) ELSE -exp(w) END) AS l FROM errors
          UNION ALL SELECT 'exponential', 1, sum(CASE WHEN e = 1 THEN -ln(150.0) ELSE 0 END - x) FROM errors
          UNION ALL SELECT 'log_normal', 2, sum(CASE WHEN e = 1 THEN -n * n / 2 - ln(2 * pi()) / 2 - ln(1.1) - ln(t) ELSE ln(tail) END) FROM errors JOIN tails USING (n)
          UNION ALL SELECT 'log_logistic', 2, sum(CASE WHEN e = 1 THEN g - 2 * ln(1 + exp(g)) + ln(1.5) - ln(t) ELSE -ln(1 + exp(g)) END) FROM errors)
        SELECT distribution, round(l, 4) AS log_likelihood, round(2 * p - 2 * l, 4) AS aic FROM fits""",
    ),
)
def parametric_likelihoods(t):
    """Likelihood and AIC of the four distributions at given parameters."""
    found = parametric.parametric_likelihood(reused(long_subjects(t)), "tenure", "target", _FITS)
    return found.withColumns({c: F.round(c, 4) for c in ("log_likelihood", "aic")})


@query(
    "margin_shares",
    with_tables(
        "order_log",
        """odds AS (
          SELECT party_code, sauda_date, OC, 1 / (1 + exp(-(party_code % 7 - 3) / 2.0)) AS a, 1 / (1 + exp(-(OC - 3.0))) AS b, 1 / (1 + exp(-(party_code % 5 - 2.0))) AS c
          FROM trade_log)
        SELECT party_code, sauda_date, OC, round(a / (a + b + c), 9) AS probability_class_0, round(b / (a + b + c), 9) AS probability_class_1,
               round(c / (a + b + c), 9) AS probability_class_2 FROM odds""",
    ),
)
def margin_shares(t):
    """Class probabilities of one-against-rest margins."""
    margins = [(F.col("party_code") % 7 - 3) / F.lit(2.0), F.col("OC") - F.lit(3.0), F.col("party_code") % 5 - F.lit(2.0)]
    shares = models.margin_shares(margins)
    return t.order_log.select("party_code", "sauda_date", "OC", *[F.round(s, 9).alias(f"probability_class_{i}") for i, s in enumerate(shares)])


_WEIGHTS = [[0.1, 0.2, -0.05], [0.0, -0.1, 0.02], [-0.2, 0.05, 0.1]]
_MARGINS = ", ".join(f"{a} + {b} * f0 + {c} * f1 AS m{k}" for k, (a, b, c) in enumerate(_WEIGHTS))
_GRADIENTS = [
    (f"gradient_{k}_{n}", f"round(avg(((y = {k})::INTEGER - exp(m{k}) / z) * {v}) - {0.01 * w if v != '1' else 0.0}, 9)")
    for k, row in enumerate(_WEIGHTS) for n, v, w in zip(("intercept", "f0", "f1"), ("1", "f0", "f1"), row)
]


@query(
    "logistic_likelihood_given",
    with_tables(
        "order_log",
        _BOOSTED.split(",\n    shares")[0] + f""",
        margins AS (SELECT *, {_MARGINS} FROM rows),
        sums AS (SELECT *, exp(m0) + exp(m1) + exp(m2) AS z FROM margins)
        SELECT unnest(['log_likelihood', {", ".join(f"'{n}'" for n, _ in _GRADIENTS)}]) AS quantity,
               unnest([round(avg(ln(exp([m0, m1, m2][y + 1]) / z)) - {0.005 * sum(w * w for row in _WEIGHTS for w in row[1:])!r}, 9), {", ".join(v for _, v in _GRADIENTS)}]) AS value
        FROM sums""",
    ),
)
def logistic_likelihood_given(t):
    """The penalised likelihood of three classes and its gradient at given weights."""
    found = models.logistic_likelihood(_boosting_rows(t), "y", ["f0", "f1"], _WEIGHTS, 0.01)
    return found.withColumn("value", F.round("value", 9))
