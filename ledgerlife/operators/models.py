"""MLlib models: next-trade regression, stage classifiers, search and scoring."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from threading import Lock

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlife.operators import boosting, metrics
from ledgerlife.session import release, reused

# Tuned settings of the two classification tasks.
SETTLE = {
    "random_forest": {"numTrees": 49, "maxDepth": 12, "featureSubsetStrategy": "0.66", "minWeightFractionPerNode": 0.0125},
    "decision_tree": {"maxDepth": 10, "minWeightFractionPerNode": 0.0828},
    "logistic": {"C": 22.350922404139133, "family": "multinomial"},
    "boosted_trees": {
        "column_share": 0.5147819785390771, "lambda_l1": 0.11245591123401574, "lambda_l2": 37.22802054235251, "learning_rate": 4.973647345682165,
        "max_bin": 414, "max_depth": 8, "min_child_samples": 20, "rounds": 1199, "num_leaves": 112, "path_smooth": 10.119277938647777,
        "row_share": 0.7608431340785347,
    },
    "boosted_trees_2": {
        "column_share": 0.5388618260923027, "learning_rate": 1.3266911816246303, "max_depth": 5, "min_child_weight": 7, "rounds": 845,
        "row_share": 0.32424301245515147, "lambda_l2": 1.0, "max_bin": 256, "min_child_samples": 1, "num_leaves": 32,
    },
    "one_against_rest": {"maxDepth": 8, "stepSize": 1.0, "subsamplingRate": 0.7608431340785347, "maxBins": 414},
    "seed": 180656403,
}
FREQUENT = {
    "random_forest": {"numTrees": 103, "maxDepth": 12, "featureSubsetStrategy": "0.68", "minWeightFractionPerNode": 0.0068},
    "decision_tree": {"maxDepth": 4, "minWeightFractionPerNode": 0.0777},
    "logistic": {"C": 65.56841523483085, "family": "binomial"},
    "boosted_trees": {
        "column_share": 0.4665051886791723, "lambda_l1": 3.6772653198259615, "lambda_l2": 3.86341994827281, "learning_rate": 0.6787555528928094,
        "max_bin": 339, "max_depth": 7, "min_child_samples": 97, "rounds": 9, "num_leaves": 195, "path_smooth": 79.2942499229715,
        "row_share": 0.7299193995713901,
    },
    "one_against_rest": {"maxIter": 9, "maxDepth": 7, "stepSize": 0.6787555528928094, "subsamplingRate": 0.7299193995713901, "maxBins": 339, "minInstancesPerNode": 97},
    "seed": 522987681,
}


def feature_columns(df: DataFrame, *excluded: str) -> dict[str, list[str]]:
    """Feature names by treatment: categorical text, numeric and boolean."""
    kinds = {"categorical": ("string",), "numeric": ("double", "float", "int", "bigint", "smallint"), "boolean": ("boolean",)}
    return {
        use: [c for c in metrics.columns_of_type(df, *types) if c not in excluded] for use, types in kinds.items()
    }


def preprocessing(df: DataFrame, *excluded: str) -> list:
    """Stages that turn the columns of ``df`` into one standardised ``features`` vector.

    Text is one-hot encoded (unknown values give zeros), numbers take the mean
    where missing, booleans the most frequent value and are one-hot encoded.
    """
    columns = feature_columns(df, *excluded)
    text, numbers, flags = columns["categorical"], columns["numeric"], columns["boolean"]
    casts = [f"CAST(`{c}` AS DOUBLE) AS `{c}__n`" for c in numbers + flags]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__")] if casts else []
    parts = []
    if text:
        stages += [
            StringIndexer(
                inputCols=text, outputCols=[f"{c}__i" for c in text], handleInvalid="keep", stringOrderType="alphabetAsc"
            ),
            OneHotEncoder(inputCols=[f"{c}__i" for c in text], outputCols=[f"{c}__v" for c in text]),
        ]
        parts += [f"{c}__v" for c in text]
    if numbers:
        stages.append(Imputer(strategy="mean", inputCols=[f"{c}__n" for c in numbers], outputCols=[f"{c}__f" for c in numbers]))
        parts += [f"{c}__f" for c in numbers]
    if flags:
        stages += [
            Imputer(strategy="mode", inputCols=[f"{c}__n" for c in flags], outputCols=[f"{c}__f" for c in flags]),
            OneHotEncoder(
                inputCols=[f"{c}__f" for c in flags], outputCols=[f"{c}__v" for c in flags], handleInvalid="keep"
            ),
        ]
        parts += [f"{c}__v" for c in flags]
    return stages + [
        VectorAssembler(inputCols=parts, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows that carry a label, with the label as MLlib wants it."""
    return df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))


def random_forest(label: str, settings: Mapping, seed: int):
    return RandomForestClassifier(labelCol=label, impurity="gini", bootstrap=False, seed=seed, **settings)


def decision_tree(label: str, settings: Mapping, seed: int):
    return DecisionTreeClassifier(labelCol=label, impurity="entropy", seed=seed, **settings)


def logistic(label: str, settings: Mapping, rows: int):
    """L2 logistic regression; ``C`` weighs the data against the penalty as in 1 / (C * rows)."""
    settings = dict(settings)
    strength = settings.pop("C", None)
    penalty = 0.0 if strength is None else 1.0 / (strength * max(1, rows))
    return LogisticRegression(labelCol=label, regParam=penalty, elasticNetParam=0.0, **settings)


def one_against_rest_trees(label: str, settings: Mapping, seed: int, classes: int):
    """MLlib's gradient-boosted trees; more than two classes are fitted one against the rest."""
    trainer = GBTClassifier(labelCol=label, seed=seed, **settings)
    return trainer if classes <= 2 else OneVsRest(labelCol=label, classifier=trainer, parallelism=classes)


def _fit(train: DataFrame, label: str, trainer) -> object:
    """Fit preprocessing and a classifier on rows that are computed once.

    ``trainer`` gets the materialised rows, of which there is one per party.
    """
    rows = reused(labelled(train, label))
    fitted = Pipeline(stages=preprocessing(rows, label) + [trainer(rows)]).fit(rows)
    release(rows)
    return fitted


def classify_random_forest(train: DataFrame, label: str, settings: Mapping = SETTLE):
    return _fit(train, label, lambda rows: random_forest(label, settings["random_forest"], settings["seed"]))


def classify_decision_tree(train: DataFrame, label: str, settings: Mapping = SETTLE):
    return _fit(train, label, lambda rows: decision_tree(label, settings["decision_tree"], settings["seed"]))


def classify_logistic(train: DataFrame, label: str, settings: Mapping = SETTLE):
    return _fit(train, label, lambda rows: logistic(label, settings["logistic"], rows.count()))


def classify_one_against_rest(train: DataFrame, label: str, classes: int, settings: Mapping = SETTLE):
    return _fit(train, label, lambda rows: one_against_rest_trees(label, settings["one_against_rest"], settings["seed"], classes))


@dataclass
class BoostedClassifier:
    """Preprocessing and boosted trees on the entries of its vector."""

    preprocessing: PipelineModel
    trees: boosting.BoostedTrees

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction and one probability column per class."""
        return boosting.boosted_scores(self.trees, _entries(self.preprocessing, df)).select(
            *df.columns, "prediction", *[f"probability_class_{i}" for i in range(self.trees.classes)]
        )

    def save(self, path: str) -> None:
        """Write both parts below a path; ``load`` reads them back."""
        self.preprocessing.write().overwrite().save(f"{path}/preprocessing")
        SparkSession.active().createDataFrame([(json.dumps(asdict(self.trees)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/trees")

    @classmethod
    def load(cls, path: str) -> BoostedClassifier:
        held = json.loads(SparkSession.active().read.text(f"{path}/trees").first()[0])
        rounds = [[boosting.Tree(**tree) for tree in trees] for trees in held.pop("rounds")]
        trees = boosting.BoostedTrees(**{**held, "settings": boosting.Boosting(**held["settings"])}, rounds=rounds)
        return cls(PipelineModel.load(f"{path}/preprocessing"), trees)


def _entries(fitted: PipelineModel, df: DataFrame, *kept: str) -> DataFrame:
    """The entries of the feature vector as columns ``_f<i>``; trees need no scaling."""
    vector = fitted.transform(df).withColumn("_features", vector_to_array("raw_features"))
    size = _width(fitted, df)
    return vector.select(*(kept or df.columns), *[F.get("_features", F.lit(i)).alias(f"_f{i}") for i in range(size)])


def _width(fitted: PipelineModel, df: DataFrame) -> int:
    return fitted.transform(df.limit(0)).schema["raw_features"].metadata["ml_attr"]["num_attrs"]


def classify_boosted_trees(
    train: DataFrame, label: str, classes: int, settings: Mapping = SETTLE, configuration: str = "boosted_trees", rounds: int | None = None
) -> BoostedClassifier:
    """Boosted trees by one of the configurations of ``settings`` (``boosted_trees``, and ``boosted_trees_2`` where given).

    One softmax for all classes. ``rounds`` replaces the number of rounds of the configuration.
    """
    chosen = {**settings[configuration], **({} if rounds is None else {"rounds": rounds})}
    rows = reused(labelled(train, label))
    stages = preprocessing(rows, label)[:-1]
    fitted = Pipeline(stages=stages).fit(rows)
    entries = reused(_entries(fitted, rows, label))
    names = [c for c in entries.columns if c != label]
    trees = boosting.fit_boosted(entries, label, names, classes, boosting.Boosting(**chosen, seed=settings["seed"]))
    release(entries)
    release(rows)
    return BoostedClassifier(fitted, trees)


def tree_text(model) -> str:
    """The rules of a fitted tree model as text."""
    return model.stages[-1].toDebugString


def logistic_likelihood(df: DataFrame, label: str, features: Sequence[str], weights: Sequence[Sequence[float]], penalty: float = 0.0) -> DataFrame:
    """(quantity, value): mean log likelihood less the L2 penalty, and its gradient, at given weights.

    ``weights`` has a list for each class: the intercept, then one weight for each feature. Intercepts aren't penalised.
    Rows with a null take no part. This is the objective that ``logistic`` minimises, with the sign changed and before standardising.
    """
    x = [F.lit(1.0)] + [F.col(c).cast("double") for c in features]
    margins = [sum((v * F.lit(float(w)) for v, w in zip(x, row)), F.lit(0.0)) for row in weights]
    rows = df.select(label, *features).na.drop().select(F.col(label).cast("int").alias("y"), F.array(*x).alias("x"), F.array(*margins).alias("scores"))
    rows = rows.withColumn("p", F.array(*boosting.softmax(F.col("scores"), len(weights))))
    own = F.log(F.get("p", F.col("y")))
    square = sum(float(w) ** 2 for row in weights for w in row[1:])
    parts = [F.struct(F.lit("log_likelihood").alias("quantity"), (F.avg(own) - 0.5 * penalty * square).alias("value"))]
    for k, row in enumerate(weights):
        miss = (F.col("y") == k).cast("double") - F.get("p", F.lit(k))
        for j, name in enumerate(["intercept", *features]):
            shrink = penalty * float(row[j]) if j else 0.0
            parts.append(F.struct(F.lit(f"gradient_{k}_{name}").alias("quantity"), (F.avg(miss * F.get("x", F.lit(j))) - shrink).alias("value")))
    return rows.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def margin_shares(margins: Sequence[Column]) -> list[Column]:
    """Probabilities of classes from one margin each, against the rest: sigmoids scaled to sum to one."""
    odds = [1.0 / (1.0 + F.exp(-margin)) for margin in margins]
    total = odds[0]
    for value in odds[1:]:
        total = total + value
    return [value / total for value in odds]


def score(model, df: DataFrame, classes: int) -> DataFrame:
    """``df`` with the prediction and one probability column per class.

    One-against-rest trees give margins only; their sigmoids are scaled to sum to one.
    """
    scored = model.transform(df)
    if isinstance(model, BoostedClassifier):
        return scored
    if "probability" in scored.columns:
        values = vector_to_array("probability")
        shares = [F.get(values, F.lit(i)) for i in range(classes)]
    else:
        margins = vector_to_array("rawPrediction")
        shares = margin_shares([F.get(margins, F.lit(i)) for i in range(classes)])
    return scored.select(
        *df.columns, "prediction", *[F.coalesce(s, F.lit(0.0)).alias(f"probability_class_{i}") for i, s in enumerate(shares)]
    )


def evaluation(scored: DataFrame, label: str, classes: int, prefix: str = "test_") -> DataFrame:
    """One row of overall metrics on rows with a label, ``prediction`` and ``probability_class_<i>``.

    The area under the curve (two classes only, else null) is exact: every
    distinct score is a point of it.
    """
    scored = reused(scored)
    row = metrics.classification_summary(scored, label, "prediction").first().asDict()
    truth = F.col("probability_class_0")
    for i in range(1, classes):
        truth = F.when(F.col(label) == i, F.col(f"probability_class_{i}")).otherwise(truth)
    row["log_loss"] = scored.agg(F.avg(-F.log(F.greatest(truth, F.lit(1e-15))))).first()[0]
    row["roc_auc"] = None
    if classes == 2:
        ranked = scored.withColumns({"_rank": F.col("probability_class_1"), label: F.col(label).cast("double")})
        row["roc_auc"] = BinaryClassificationEvaluator(rawPredictionCol="_rank", labelCol=label, numBins=0).evaluate(ranked)
    release(scored)
    named = {f"{prefix}{name}": None if value is None else float(value) for name, value in row.items()}
    return scored.sparkSession.createDataFrame([tuple(named.values())], ", ".join(f"{n} double" for n in named))


def evaluate(model, test: DataFrame, label: str, classes: int, prefix: str = "test_") -> DataFrame:
    """One row of overall metrics of a model on a labelled data set."""
    return evaluation(score(model, labelled(test, label), classes), label, classes, prefix)


class _SharedStages(Pipeline):
    """A pipeline whose candidates begin with the same stages: those are fitted, and their rows kept, once for all.

    Rows are cached rather than written, as draws of rows go by partition: models are those of single fits.
    """

    def fitMultiple(self, dataset, paramMaps):
        each = [list(m[self.stages]) for m in paramMaps]
        first = Pipeline(stages=each[0][:-1]).fit(dataset)
        rows = first.transform(dataset).select(each[0][-1].getLabelCol(), "features").persist()
        left, lock = len(each), Lock()

        def fit(i):
            nonlocal left
            try:
                return PipelineModel(first.stages + [each[i][-1].fit(rows)])
            finally:
                with lock:
                    left -= 1
                    if not left:
                        rows.unpersist()

        return _FitMultipleIterator(fit, len(each))


def model_search(
    train: DataFrame, label: str, classes: int, settings: Mapping = SETTLE, folds: int = 3, parallelism: int = 2,
    families: Sequence[str] = ("random_forest", "decision_tree", "logistic", "boosted_trees"), depths: Sequence[int] = (4, 8),
):
    """Cross-validated search over model families and tree depths; gives the cross-validation model."""
    rows = reused(labelled(train, label))
    shared, seed = preprocessing(rows, label), settings["seed"]
    candidates: list = []
    if "logistic" in families:
        candidates.append(logistic(label, settings["logistic"], rows.count()))
    for depth in depths:
        deeper = {name: dict(settings[name], maxDepth=depth) for name in ("random_forest", "decision_tree", "one_against_rest")}
        if "random_forest" in families:
            candidates.append(random_forest(label, deeper["random_forest"], seed))
        if "decision_tree" in families:
            candidates.append(decision_tree(label, deeper["decision_tree"], seed))
        if "boosted_trees" in families:
            candidates.append(one_against_rest_trees(label, deeper["one_against_rest"], seed, classes))
    whole = _SharedStages(stages=[])
    grid = ParamGridBuilder().addGrid(whole.stages, [shared + [candidate] for candidate in candidates]).build()
    search = CrossValidator(
        estimator=whole,
        estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1"),
        numFolds=folds,
        parallelism=parallelism,
        seed=seed % 2**31,
    )
    found = search.fit(rows)
    release(rows)
    return found


def search_results(spark, fitted) -> DataFrame:
    """Mean score of every candidate of a search, best first."""
    rows = []
    for grid, value in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics):
        trainer = list(grid.values())[0][-1]
        depth = trainer.getOrDefault("maxDepth") if trainer.hasParam("maxDepth") else None
        rows.append((type(trainer).__name__, depth, float(value)))
    return spark.createDataFrame(sorted(rows, key=lambda r: -r[2]), "model string, max_depth int, mean_f1 double")


NEXT_TRADE_NUMBERS = [
    "trade_days_cnt", "total_trades", "total_order_count", "avg_investment", "activeinsys", "new_age",
    "new_incomedetails", "gender_f", "riskcategory_new",
]
NEXT_TRADE_RECENCY = ["gap_1", "gap_2", "gap_3", "mean_last_3", "stddev_last_3"]


def next_trade_model(train: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42):
    """Random-forest regression of the inactive days; encoders are fitted on the training days only.

    Trees choose among all features at each node. ``depth`` may go up to MLlib's limit of 30. The recency columns are used where the data set has them.
    """
    numbers = [c for c in NEXT_TRADE_NUMBERS + NEXT_TRADE_RECENCY if c in train.columns]
    text = [c for c in ("occupation", "Tier") if c in train.columns]
    filled = ", ".join(f"COALESCE(CAST(`{c}` AS DOUBLE), 0) AS `{c}__f`" for c in numbers)
    stages = [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        StringIndexer(
            inputCols=text, outputCols=[f"{c}__i" for c in text], handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCols=[f"{c}__i" for c in text], outputCols=[f"{c}__v" for c in text], handleInvalid="keep"),
        VectorAssembler(inputCols=[f"{c}__f" for c in numbers] + [f"{c}__v" for c in text], outputCol="features"),
        RandomForestRegressor(labelCol="inactive_days", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all"),
    ]
    rows = reused(train)
    fitted = Pipeline(stages=stages).fit(rows)
    release(rows)
    return fitted


def regression_scores(model, df: DataFrame) -> DataFrame:
    """``df`` with the model's prediction, features dropped again."""
    return model.transform(df).select(*df.columns, "prediction")
