"""Model search under a time budget, by successive halving.

Configurations are drawn from a space of settings. The first rung fits all of
them on a small hash sample of the training rows, each later one the better part on a sample
that grows by the same factor, the last on all. A rung's results and models are stored as they come, so
a stopped search goes on where it ended. When the time is up, the best model of
the highest rung that has one is returned.
"""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlife.operators import models
from ledgerlife.session import release, reused


@dataclass(frozen=True)
class Configuration:
    number: int
    family: str
    settings: dict = field(hash=False)

    def trainer(self, label: str, rows: int, seed: int):
        if self.family == "random_forest":
            return models.random_forest(label, self.settings, seed)
        if self.family == "decision_tree":
            return models.decision_tree(label, self.settings, seed)
        if self.family == "logistic":
            return models.logistic(label, self.settings, rows)
        raise ValueError(f"unknown family {self.family}")


FAMILIES = ("random_forest", "decision_tree", "logistic")


def space(n: int, seed: int = 0, families: Sequence[str] = FAMILIES) -> list[Configuration]:
    """``n`` configurations: families in turn, settings drawn evenly or by their logarithm."""
    draw = random.Random(seed)
    log = lambda low, high: math.exp(draw.uniform(math.log(low), math.log(high)))
    out = []
    for i in range(n):
        family = families[i % len(families)]
        if family == "random_forest":
            settings = {"numTrees": draw.randint(20, 100), "maxDepth": draw.randint(3, 12), "featureSubsetStrategy": f"{draw.uniform(0.2, 1.0):.2f}", "minWeightFractionPerNode": round(log(1e-4, 0.1), 6)}
        elif family == "decision_tree":
            settings = {"maxDepth": draw.randint(2, 12), "minWeightFractionPerNode": round(log(1e-4, 0.2), 6)}
        else:
            settings = {"C": round(log(1e-2, 1e3), 6)}
        out.append(Configuration(i, family, settings))
    return out


@dataclass
class Found:
    """The best model with its configuration and rung, all results, and whether the search came to its end."""

    model: PipelineModel | None
    best: dict | None
    results: list[dict]
    finished: bool


_SCHEMA = "rung int, configuration int, family string, settings string, share double, rows bigint, log_loss double, seconds double, error string"


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def budgeted_search(
    train: DataFrame, label: str, classes: int, seconds: float, folder: str | None = None, configurations: int = 27, eta: int = 3, held_out: float = 0.2, seed: int = 0,
    families: Sequence[str] = FAMILIES, clock: Callable[[], float] = time.monotonic,
) -> Found:
    """The best model by the log loss on held-out rows that ``seconds`` allow.

    Rows are dealt by a hash of their values, so a resumed search sees the same samples: a share of
    ``held_out`` judges all fits, a rung trains on a share of the others. Each rung keeps one in ``eta``
    configurations. A fit that has begun is ended; at least one is made, even when no time is left.
    ``folder``, on a file system that all executors share, holds results and models; a search over the same folder
    takes what is there. A fit that fails is a result without loss.
    """
    spark, start = train.sparkSession, clock()
    rows = models.labelled(train, label)
    mark = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns]), F.lit(1_000_000)) / 1e6
    rows = reused(rows.withColumn("_mark", mark))
    judged, given = rows.filter(F.col("_mark") < held_out).drop("_mark"), rows.filter(F.col("_mark") >= held_out)
    rungs = max(1, math.ceil(math.log(max(1, configurations), eta)))
    alive, results, kept = space(configurations, seed, families), [], None

    def stored_result(rung: int, number: int) -> dict | None:
        path = f"{folder}/rung={rung}/configuration={number}"
        if folder is None or not _exists(spark, f"{path}/_SUCCESS"):
            return None
        return json.loads(spark.read.text(path).first()[0])

    finished = True
    for rung in range(rungs + 1):
        share = eta ** float(rung - rungs)
        sample = given.filter(F.col("_mark") < held_out + (1 - held_out) * share).drop("_mark")
        n = sample.count()
        told = []
        for c in alive:
            known = stored_result(rung, c.number)
            if known is None:
                if clock() - start >= seconds and (results or told):
                    finished = False
                    break
                began, model, loss, failed = clock(), None, None, None
                try:
                    model = Pipeline(stages=models.preprocessing(sample, label) + [c.trainer(label, n, seed)]).fit(sample)
                    loss = models.evaluate(model, judged, label, classes).first()["test_log_loss"]
                except (PySparkException, Py4JJavaError) as error:  # a sample may lack what a family needs; the others go on
                    failed = str(error)[:500]
                known = {"rung": rung, "configuration": c.number, "family": c.family, "settings": json.dumps(c.settings, sort_keys=True), "share": share, "rows": n, "log_loss": loss, "seconds": clock() - began, "error": failed}
                if folder is not None:
                    if model is not None:
                        model.write().overwrite().save(f"{folder}/models/rung={rung}/configuration={c.number}")
                    spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/rung={rung}/configuration={c.number}")
            else:
                model = None
            told.append((known, model))
        results += [known for known, _ in told]
        usable = sorted((t for t in told if t[0]["log_loss"] is not None), key=lambda t: (t[0]["log_loss"], t[0]["configuration"]))
        if usable:
            kept = usable[0]
        if not finished:
            break
        best = {t[0]["configuration"] for t in usable[: max(1, math.ceil(len(alive) / eta))]}
        alive = [c for c in alive if c.number in best]
        if not alive:
            break
    model = None
    if kept is not None:
        model = kept[1] or PipelineModel.load(f"{folder}/models/rung={kept[0]['rung']}/configuration={kept[0]['configuration']}")
    release(rows)
    return Found(model, kept[0] if kept else None, results, finished)


def search_table(spark, found: Found) -> DataFrame:
    """All results of a search, rung by rung."""
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in found.results], _SCHEMA)
