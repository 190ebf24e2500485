"""Successive halving under a budget, and resuming it."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.ml.tuning import ParamGridBuilder

from ledgerlife.operators import models, search


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for _ in range(500):
        amount, kind = rng.random(), rng.choice("ab")
        data.append((amount, kind, rng.random(), int(amount > 0.5) if rng.random() > 0.05 else 0))
    return spark.createDataFrame(data, "amount double, kind string, noise double, y int").persist()


def test_space_is_drawn_by_seed():
    assert search.space(9, 3) == search.space(9, 3) and search.space(9, 3) != search.space(9, 4)
    assert {c.family for c in search.space(9, 3)} == set(search.FAMILIES)


def test_rungs_halve_and_the_best_is_kept(rows, spark):
    found = search.budgeted_search(rows, "y", 2, 1e9, configurations=4, eta=2, families=("decision_tree", "logistic"))
    by_rung = {}
    for r in found.results:
        by_rung.setdefault(r["rung"], []).append(r)
    assert found.finished and [len(by_rung[k]) for k in sorted(by_rung)] == [4, 2, 1]
    assert [by_rung[k][0]["share"] for k in sorted(by_rung)] == [0.25, 0.5, 1.0]
    assert by_rung[0][0]["rows"] < by_rung[1][0]["rows"] < by_rung[2][0]["rows"]
    survivors = {r["configuration"] for r in by_rung[1]}
    assert survivors == {r["configuration"] for r in sorted(by_rung[0], key=lambda r: r["log_loss"])[:2]}
    assert found.best == by_rung[2][0]
    assert models.evaluate(found.model, rows, "y", 2).first()["test_accuracy"] > 0.8
    assert search.search_table(spark, found).count() == 7


def test_a_stopped_search_returns_its_best_and_goes_on(rows, tmp_path):
    ticks = iter(range(10_000))
    folder = f"{tmp_path}/search"
    arguments = dict(label="y", classes=2, folder=folder, configurations=4, eta=2, families=("decision_tree",))
    # No time at all: one fit is made and returned.
    first = search.budgeted_search(rows, seconds=0, clock=lambda: float(next(ticks)), **arguments)
    assert not first.finished and len(first.results) == 1 and first.model is not None
    # A budget that ends within the second rung returns a model of the highest rung with one.
    second = search.budgeted_search(rows, seconds=11, clock=lambda: float(next(ticks)), **arguments)
    assert not second.finished and len(first.results) < len(second.results) < 7
    assert second.best["rung"] == max(r["rung"] for r in second.results)
    before = {(r["rung"], r["configuration"]): r["seconds"] for r in second.results}
    last = search.budgeted_search(rows, seconds=1e9, **arguments)
    after = {(r["rung"], r["configuration"]): r["seconds"] for r in last.results}
    assert last.finished and len(after) == 7 and all(after[k] == before[k] for k in before)
    again = search.budgeted_search(rows, seconds=0, **arguments)
    assert again.finished and again.results == last.results and models.score(again.model, rows, 2).count() == 500


def test_search_fits_the_preprocessing_once_for_each_fold(rows, monkeypatch):
    fits, fit = [], StringIndexer._fit
    monkeypatch.setattr(StringIndexer, "_fit", lambda self, df: fits.append(self) or fit(self, df))
    models.model_search(rows, "y", 2, {**models.SETTLE, "decision_tree": {}}, folds=2, depths=(1, 2, 3), families=("decision_tree",))
    assert len(fits) == 2 + 1  # each fold, and the best candidate


def test_shared_stages_give_the_models_of_single_fits(rows):
    data = models.labelled(rows, "y").persist()
    shared, small = models.preprocessing(data, "y"), {"maxIter": 2, "subsamplingRate": 0.6, "maxDepth": 3}
    candidates = [shared + [c] for c in (models.decision_tree("y", {"maxDepth": 3}, 5), models.one_against_rest_trees("y", small, 5, 2))]
    whole = models._SharedStages(stages=[])
    found = dict(whole.fitMultiple(data, ParamGridBuilder().addGrid(whole.stages, candidates).build()))
    rules = lambda model: model.stages[-1].toDebugString.split("\n", 1)[1]
    for i, stages in enumerate(candidates):
        assert rules(found[i]) == rules(Pipeline(stages=stages).fit(data))
        assert "prediction" in found[i].transform(rows).columns
