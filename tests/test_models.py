import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlife.operators import base, explain, metrics, models

SMALL = {
    "random_forest": {"numTrees": 8, "maxDepth": 4, "featureSubsetStrategy": "0.66"},
    "decision_tree": {"maxDepth": 4},
    "logistic": {"C": 10.0, "family": "multinomial"},
    "boosted_trees": {"rounds": 2, "max_depth": 3, "learning_rate": 0.5, "min_child_samples": 5},
    "one_against_rest": {"maxIter": 3, "maxDepth": 3},
    "seed": 7,
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for _ in range(300):
        kind, flag, amount = rng.choice("abc"), rng.random() < 0.5, rng.random()
        label = 2 if amount > 0.7 else (1 if flag else 0)
        data.append((kind, flag if rng.random() > 0.05 else None, amount if rng.random() > 0.05 else None, rng.random(), label))
    return spark.createDataFrame(data, "kind string, flag boolean, amount double, noise double, y int").persist()


FITS = {
    "forest": lambda r: models.classify_random_forest(r, "y", SMALL),
    "tree": lambda r: models.classify_decision_tree(r, "y", SMALL),
    "logistic": lambda r: models.classify_logistic(r, "y", SMALL),
    "boosted": lambda r: models.classify_boosted_trees(r, "y", 3, SMALL),
    "one_against_rest": lambda r: models.classify_one_against_rest(r, "y", 3, SMALL),
}


@pytest.mark.parametrize("name", FITS)
def test_probabilities_sum_to_one_and_unseen_values_score(rows, spark, name):
    model = FITS[name](rows)
    scored = models.score(model, rows, 3)
    total = sum(F.col(f"probability_class_{i}") for i in range(3))
    assert scored.filter(F.abs(total - 1) > 1e-9).isEmpty()
    accuracy = metrics.classification_summary(scored, "y", "prediction").first().accuracy
    assert accuracy > 0.75
    strange = spark.createDataFrame([("new", None, None, 0.5, 0)], rows.schema)
    assert models.score(model, strange, 3).count() == 1


def test_binary_trees_and_evaluation(rows):
    two = rows.filter("y < 2")
    model = models.classify_boosted_trees(two, "y", 2, SMALL)
    row = models.evaluate(model, two, "y", 2).first().asDict()
    assert row["test_accuracy"] > 0.85 and row["test_roc_auc"] > 0.85 and row["test_log_loss"] > 0
    assert "If" in models.tree_text(models.classify_decision_tree(two, "y", SMALL))


def test_search_keeps_the_best(rows, spark):
    found = models.model_search(rows, "y", 3, SMALL, folds=2, depths=(1, 4), families=("decision_tree",))
    table = models.search_results(spark, found).collect()
    assert [r.max_depth for r in table] == [4, 1]
    assert found.bestModel.stages[-1].depth > 1


def test_importance_finds_the_driving_columns(rows):
    model = models.classify_decision_tree(rows, "y", SMALL)
    features = ["kind", "flag", "amount", "noise"]
    lost = {r.feature: r.importance for r in explain.permutation_importance(model, rows, "y", features).collect()}
    assert lost["amount"] > 0.1 and lost["flag"] > 0.1 and abs(lost["kind"]) < 0.1
    weights = explain.tree_importance(model, rows).collect()
    assert sum(r.importance for r in weights) == pytest.approx(1.0)
    assert max(weights, key=lambda r: r.importance).feature.startswith("amount")


def test_permutation_keeps_each_feature_as_a_multiset(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7, float(i), None if i % 5 else "x", 3) for i in range(3000)] + [(1, 1.0, "x", 3)] * 50, "a int, b double, c string, d int")
    other = explain.permuted(rows, ["a", "b", "c"], seed=4).persist()
    assert other.columns == [*rows.columns, "_other"]
    for name in ("a", "b", "c"):
        assert other.select(f"_other.{name}").exceptAll(rows.select(name)).isEmpty() and other.count() == 3050
    assert other.drop("_other").exceptAll(rows).isEmpty()
    # Rows move, and far: the correlation with the old places is small.
    assert abs(other.filter("b > 1").selectExpr("corr(b, _other.b) AS r").first().r) < 0.1
    # The order is dealt over as many ranges as the session shuffles to.
    plans, whole = [], base.reused
    monkeypatch.setattr(base, "reused", lambda df: plans.append(df._jdf.queryExecution().toString()) or whole(df))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        base.placed(rows.select("b").distinct(), "b")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert re.search(r"rangepartitioning\(b.*, 23\)", plans[0])
    assert explain.permuted(rows.limit(0), ["a"]).count() == 0


def test_places_follow_the_order(spark):
    rows = spark.createDataFrame([((i * 7919) % 1009, "x") for i in range(1009)], "v int, t string")
    assert {r.v: r._place for r in base.placed(rows, "v").collect()} == {v: v for v in range(1009)}


def test_coalitions_carry_the_whole_weight():
    z, w = explain.coalitions(6, 1000)
    assert len(z) == 2**6 - 2 and len({tuple(r) for r in z}) == len(z)
    for size in range(1, 6):
        assert w[z.sum(1) == size].sum() == pytest.approx(5 / (size * (6 - size)))
    z, w = explain.coalitions(30, 200, seed=1)
    assert 200 <= 2 * 30 + len(z) and w.sum() == pytest.approx(sum(29 / (s * (30 - s)) for s in range(1, 30)))
    assert (z.sum(1) == 1).sum() >= 30 and (z.sum(1) == 29).sum() >= 30
    assert explain.coalitions(1, 10)[0].shape == (0, 1)


def _enumerated(f, background, example, m):
    """Shapley values by their definition."""
    value = {}
    for members in itertools.chain.from_iterable(itertools.combinations(range(m), s) for s in range(m + 1)):
        value[members] = sum(f([example[i] if i in members else b[i] for i in range(m)]) for b in background) / len(background)
    out = []
    for i in range(m):
        total = 0.0
        for members in value:
            if i not in members:
                s = len(members)
                total += math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) * (value[tuple(sorted((*members, i)))] - value[members])
        out.append(total)
    return out


def test_kernel_shap_equals_enumeration_and_linear_values(spark):
    rng = random.Random(3)
    names = [f"x{i}" for i in range(8)]
    data = [tuple(float(rng.randrange(5)) for _ in names) for _ in range(9)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], ", ".join(f"{n} double" for n in names) + ", id int")
    crossed = lambda r: r[0] * r[1] - 2 * r[2] + (r[3] > 2) * r[4] + r[5] * r[6] * r[7] / 4
    score = lambda df: df.withColumn("prediction", F.expr("x0 * x1 - 2 * x2 + CASE WHEN x3 > 2 THEN x4 ELSE 0 END + x5 * x6 * x7 / 4"))
    values = explain.kernel_shap(score, frame.filter("id < 4"), frame.filter("id >= 4"), names, keep=["id"]).collect()
    found = {(r.id, r.feature): r for r in values}
    assert len(found) == 5 * 8
    for i in range(4, 9):
        want = _enumerated(crossed, data[:4], data[i], 8)
        assert [found[i, n].contribution for n in names] == pytest.approx(want, abs=1e-9)
        assert found[i, "x0"].predicted == pytest.approx(crossed(data[i]))
    # A sample of coalitions still adds up, and gives a linear function exactly.
    weights = [i - 3.5 for i in range(8)]
    linear = lambda df: df.withColumn("prediction", sum(F.col(n) * w for n, w in zip(names, weights)))
    for r in explain.kernel_shap(linear, frame.filter("id < 4"), frame.filter("id >= 4"), names, most=40, keep=["id"]).collect():
        j = names.index(r.feature)
        assert r.contribution == pytest.approx(weights[j] * (data[r.id][j] - sum(d[j] for d in data[:4]) / 4), abs=1e-9)
    part = explain.kernel_shap(score, frame.filter("id < 4"), frame.filter("id >= 4"), names, most=40, keep=["id"])
    for r in part.groupBy("id").agg(F.sum("contribution").alias("s"), F.first("base").alias("b"), F.first("predicted").alias("p")).collect():
        assert r.s == pytest.approx(r.p - r.b)
    (one,) = explain.kernel_shap(lambda df: df.withColumn("prediction", 3 * F.col("x7")), frame.filter("id < 4"), frame.filter("id = 5"), ["x7"]).collect()
    assert one.contribution == pytest.approx(one.predicted - one.base)


def test_contributions_add_up(rows):
    model = models.classify_decision_tree(rows, "y", SMALL)
    features = ["kind", "flag", "amount", "noise"]
    background = rows.filter("amount is not null").orderBy("amount").limit(1)
    values = explain.shapley_values(model, background, rows, features, 1, 20, rounds=6)
    base = model.transform(background).first().prediction
    sums = [r[1] + base for r in values.groupBy("example").agg(F.sum("contribution")).collect()]
    assert len(sums) == 20 and all(min(abs(s - k) for k in (0, 1, 2)) < 1e-9 for s in sums)
    ranked = explain.shapley_importance(values).orderBy(F.desc("importance")).collect()
    assert ranked[0].feature == "amount" and {r.feature for r in ranked} == set(features)


def test_next_trade_model_fits_on_training_rows_only(spark):
    rng = random.Random(1)
    data = [(rng.randrange(4, 20), float(rng.randrange(10)), "a", "Tier-I") for _ in range(200)]
    train = spark.createDataFrame([(*r, int(r[1])) for r in data], "trade_days_cnt int, mean_last_3 double, occupation string, Tier string, inactive_days int")
    model = models.next_trade_model(train, trees=10, depth=5)
    test = spark.createDataFrame([(5, 3.0, "unseen", "Tier-II", 3), (5, None, None, None, 0)], train.schema)
    scored = models.regression_scores(model, test)
    assert scored.columns == [*train.columns, "prediction"] and scored.filter("prediction is null").isEmpty()
    assert scored.first().prediction == pytest.approx(3.0, abs=1.5)


def test_preprocessing_fills_encodes_and_standardises(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    train = spark.createDataFrame(
        [("a", True, 1.0, 0), ("b", True, None, 1), ("a", False, 4.0, 0), (None, None, 1.0, 1)],
        "kind string, flag boolean, amount double, y int",
    )
    fitted = Pipeline(stages=models.preprocessing(train, "y")).fit(train)
    raw = [r[0] for r in fitted.transform(train).select(vector_to_array("raw_features")).collect()]
    # kind = a, kind = b, amount with the mean for the gap, flag one-hot with the mode for the gap
    assert [r[:3] for r in raw] == [[1, 0, 1], [0, 1, 2], [1, 0, 4], [0, 0, 1]]
    assert [r[3:5] for r in raw] == [[0, 1], [0, 1], [1, 0], [0, 1]]
    scaled = [r[0] for r in fitted.transform(train).select(vector_to_array("features")).collect()]
    amounts = [r[2] for r in scaled]
    assert sum(amounts) == pytest.approx(0) and sum(a * a for a in amounts) / 3 == pytest.approx(1)


def test_models_are_saved_and_loaded(rows, tmp_path):
    from pyspark.ml import PipelineModel

    model = models.classify_decision_tree(rows, "y", SMALL)
    model.write().overwrite().save(f"{tmp_path}/tree")
    again = PipelineModel.load(f"{tmp_path}/tree")
    assert models.score(again, rows, 3).exceptAll(models.score(model, rows, 3)).isEmpty()


def test_boosted_classifiers_are_saved_and_loaded(rows, tmp_path):
    model = models.classify_boosted_trees(rows, "y", 3, SMALL, rounds=1)
    model.save(f"{tmp_path}/boosted")
    again = models.BoostedClassifier.load(f"{tmp_path}/boosted")
    assert again.trees == model.trees
    assert models.score(again, rows, 3).exceptAll(models.score(model, rows, 3)).isEmpty()
