"""Boosted trees beside a plain version that tries every split of every leaf in turn."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlife.operators import boosting
from ledgerlife.operators.boosting import Boosting
from ledgerlife.operators.boosting_rounds import xxhash
from ledgerlife.plans import modelling


def strength(g, h, s):
    shrunk = max(abs(g) - s.lambda_l1, 0.0)
    return shrunk**2 / (h + s.lambda_l2) if h + s.lambda_l2 else 0.0


def plain_tree(bins, g, h, s):
    """Leaf-wise growth: split the leaf of the largest gain until no leaf is left to split or enough are there."""
    def best(rows, depth):
        top = None
        if depth == s.max_depth:
            return None
        for f in range(bins.shape[1]):
            for b in range(bins[:, f].max()):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if min(len(left), len(right)) < max(1, s.min_child_samples) or min(h[left].sum(), h[right].sum()) < s.min_child_weight:
                    continue
                gain = strength(g[left].sum(), h[left].sum(), s) + strength(g[right].sum(), h[right].sum(), s) - strength(g[rows].sum(), h[rows].sum(), s)
                if gain > s.min_gain + 1e-12 and (top is None or gain > top[0] + 1e-9):
                    top = (gain, f, b, left, right)
        return top

    def value(rows, above):
        total = g[rows].sum()
        raw = -math.copysign(max(abs(total) - s.lambda_l1, 0.0), total) / (h[rows].sum() + s.lambda_l2)
        if s.path_smooth:
            w = len(rows) / s.path_smooth
            raw = (raw * w + above) / (w + 1)
        return raw

    every = np.arange(len(g))
    leaves = {0: (every, value(every, 0.0), best(every, 0))}
    inner = {}
    while len(leaves) < s.num_leaves:
        node = max((n for n in leaves if leaves[n][2]), key=lambda n: (leaves[n][2][0], -n), default=None)
        if node is None:
            break
        rows, own, (_, f, b, left, right) = leaves.pop(node)
        inner[node] = (f, b)
        depth = int(math.log2(node + 1)) + 1
        for child, part in ((2 * node + 1, left), (2 * node + 2, right)):
            leaves[child] = (part, value(part, own), best(part, depth))
    out = np.zeros(len(g))
    for rows, v, _ in leaves.values():
        out[rows] = s.learning_rate * v
    return inner, out


def plain_boost(bins, y, classes, s, start):
    scores = np.tile(np.array(start), (len(y), 1))
    trees = []
    for _ in range(s.rounds):
        if classes == 2:
            p = 1 / (1 + np.exp(-scores[:, 0]))
            parts = [(p - y, p * (1 - p))]
        else:
            e = np.exp(scores - scores.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            parts = [(p[:, k] - (y == k), classes / (classes - 1) * p[:, k] * (1 - p[:, k])) for k in range(classes)]
        grown = [plain_tree(bins, g, h, s) for g, h in parts]
        trees.append([inner for inner, _ in grown])
        scores = scores + np.stack([added for _, added in grown], axis=1)
    return trees, scores


def sample(n, classes, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 6, n), rng.integers(0, 2, n), rng.integers(0, 9, n) * rng.integers(0, 2, n), rng.normal(size=n).round(1)])
    y = ((x[:, 0] > 2).astype(int) + (x[:, 2] + 3 * x[:, 3] > 4).astype(int) * (classes > 2) + (rng.random(n) < 0.1)) % classes
    return x, y.astype(int)


def frame_of(spark, x, y):
    return spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, y int")


@pytest.mark.parametrize(
    "classes, settings",
    [
        (3, Boosting(rounds=2, learning_rate=0.7, max_depth=3, num_leaves=6, max_bin=64, min_child_samples=8, lambda_l1=0.4, lambda_l2=1.5, path_smooth=6.0)),
        (2, Boosting(rounds=3, learning_rate=1.8, max_depth=3, num_leaves=31, max_bin=64, min_child_samples=5, min_child_weight=1.0, lambda_l2=0.2, min_gain=0.05)),
    ],
)
def test_trees_and_scores_equal_the_plain_version(spark, classes, settings):
    x, y = sample(260, classes, classes)
    df = frame_of(spark, x, y)
    model = boosting.fit_boosted(df, "y", list("abcd"), classes, settings)
    bins = np.stack([np.searchsorted(model.edges[f], x[:, f], side="right") for f in range(4)], axis=1)
    trees, scores = plain_boost(bins, y, classes, settings, model.start)
    assert len(model.rounds) == settings.rounds
    for grown, want in zip(model.rounds, trees):
        for tree, inner in zip(grown, want):
            assert {n: (f, tree.bin[n]) for n, f in enumerate(tree.feature) if f >= 0} == inner
    found = boosting.boosted_scores(model, df.withColumn("id", F.monotonically_increasing_id())).orderBy("id").collect()
    if classes == 2:
        shares = np.stack([1 - 1 / (1 + np.exp(-scores[:, 0])), 1 / (1 + np.exp(-scores[:, 0]))], axis=1)
    else:
        e = np.exp(scores - scores.max(1, keepdims=True))
        shares = e / e.sum(1, keepdims=True)
    for r, want in zip(found, shares):
        assert [r[f"probability_class_{i}"] for i in range(classes)] == pytest.approx(list(want), abs=1e-9)
        assert want[int(r.prediction)] == pytest.approx(want.max())


def test_shares_seeds_and_nulls(spark):
    x, y = sample(400, 3, 9)
    df = frame_of(spark, x, y).unionByName(spark.createDataFrame([(None, None, None, None, 0), (float("nan"), 1.0, 2.0, 0.0, 1), (1.0, 1.0, 1.0, 1.0, None)], "a double, b double, c double, d double, y int"))
    s = Boosting(rounds=2, learning_rate=0.8, max_depth=3, min_child_samples=5, row_share=0.6, column_share=0.5, seed=5)
    one, two = (boosting.fit_boosted(df, "y", list("abcd"), 3, s) for _ in range(2))
    for a, b in zip(one.rounds, two.rounds):
        for t, u in zip(a, b):
            assert (t.feature, t.bin) == (u.feature, u.bin) and t.value == pytest.approx(u.value, abs=1e-9)
    for trees in one.rounds:  # two of the four columns for all trees of a round
        assert len({f for t in trees for f in t.feature if f >= 0}) <= 2
    scored = boosting.boosted_scores(one, df)
    assert scored.columns == [*df.columns, "prediction", *[f"probability_class_{i}" for i in range(3)]]
    assert scored.count() == 403 and scored.filter("abs(probability_class_0 + probability_class_1 + probability_class_2 - 1) > 1e-9").isEmpty()
    right = scored.filter("y = prediction").count()
    assert right > 260


def test_degenerate_inputs(spark):
    df = frame_of(spark, np.ones((30, 4)), np.arange(30) % 3)
    model = boosting.fit_boosted(df, "y", list("abcd"), 3, Boosting(rounds=3, min_child_samples=1))
    assert model.rounds == [] and boosting.boosted_scores(model, df).select("prediction").distinct().count() == 1
    empty = boosting.fit_boosted(df.limit(0), "y", list("abcd"), 2, Boosting(rounds=2))
    assert boosting.boosted_scores(empty, df).count() == 30
    assert boosting.tree_nodes(df, model).count() == 0


def test_high_steps_stay_finite(spark):
    """A step above 1 with strong penalties, as the tuned settings have."""
    x, y = sample(600, 3, 21)
    df = frame_of(spark, x, y)
    s = Boosting(rounds=3, learning_rate=4.97, max_depth=3, num_leaves=20, min_child_samples=20, lambda_l1=0.11, lambda_l2=37.0, path_smooth=10.0)
    scored = boosting.boosted_scores(boosting.fit_boosted(df, "y", list("abcd"), 3, s), df)
    assert scored.filter("isnan(probability_class_0)").isEmpty() and scored.filter("y = prediction").count() > 400


def test_bins_of_a_row_are_found_once(spark):
    """Two classes use the bins once in the walk; they must not be cut anew at each of its steps."""
    x, y = sample(200, 2, 4)
    df = frame_of(spark, x, y)
    model = boosting.fit_boosted(df, "y", list("abcd"), 2, Boosting(rounds=1, max_depth=2, min_child_samples=5))
    plan = boosting.boosted_scores(model, df)._jdf.queryExecution().optimizedPlan().toString()
    walks = [line for line in plan.splitlines() if "lambdafunction(" in line]
    assert "bucketizer_" in plan and walks and not any("bucketizer_" in line[line.index("lambdafunction("):] for line in walks)


def test_trees_do_not_depend_on_tasks_or_jobs(spark, monkeypatch):
    """Rows in one task and dealt over eight, all rounds in one job and two a job: the very same trees."""
    x, y = sample(500, 3, 13)
    df = frame_of(spark, x, y)
    s = Boosting(rounds=5, learning_rate=0.9, max_depth=4, min_child_samples=5, lambda_l2=1.0, row_share=0.7, column_share=0.75, seed=180656403)
    one = boosting.fit_boosted(df, "y", list("abcd"), 3, s)
    monkeypatch.setattr(boosting, "CELLS", 100)
    monkeypatch.setattr(boosting, "ROUNDS_A_JOB", 2)
    assert boosting._tasks(spark, 2000) == 8
    assert boosting.fit_boosted(df, "y", list("abcd"), 3, s).rounds == one.rounds and len(one.rounds) == 5


def test_rows_are_drawn_as_spark_hashes(spark):
    ids = np.array([0, 1, -1, 7, 2**40 + 3, -(2**63), 2**63 - 1])
    for seed in (0, 5, -3, 180656403, 2**40):
        found = spark.createDataFrame([(int(i),) for i in ids], "id bigint").select("id", F.xxhash64("id", F.lit(seed), F.lit(11)).alias("h")).collect()
        assert {r.id: r.h for r in found} == dict(zip(ids.tolist(), xxhash(ids, seed, 11).tolist()))


def test_settle_query_boosts_all_its_rounds(spark, monkeypatch):
    """The tuned configuration of the settle task has 1,199 rounds."""
    asked, fit = [], boosting.fit_boosted
    monkeypatch.setattr(boosting, "fit_boosted", lambda df, label, names, classes, s: asked.append(s.rounds) or fit(df, label, names, classes, replace(s, rounds=2)))
    x, y = sample(200, 3, 17)
    rows = frame_of(spark, x, y).withColumnRenamed("y", "settle_target")
    monkeypatch.setattr(modelling, "settle_sets", lambda t: [rows, rows])
    assert modelling.settle_boosted_trees(None).count() == 200 and asked == [1199]
