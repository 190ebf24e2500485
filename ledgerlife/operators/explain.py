"""Feature importance: tree importances, permutation, Kernel SHAP and sampled Shapley walks."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlife.operators.base import placed
from ledgerlife.operators.metrics import random_sample
from ledgerlife.session import reused


def tree_importance(model, df: DataFrame) -> DataFrame:
    """Impurity importance of every entry of the feature vector of a fitted tree model."""
    weights = model.stages[-1].featureImportances.toArray()
    shape = model.transform(df.limit(0)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for part in shape.values() for a in part}
    source = next((s for s in model.stages if type(s).__name__ == "VectorAssembler"), None)
    if not names and source is not None:
        raw = model.transform(df.limit(0)).schema[source.getOutputCol()].metadata.get("ml_attr", {}).get("attrs", {})
        names = {a["idx"]: a.get("name", str(a["idx"])) for part in raw.values() for a in part}
    rows = [(names.get(i, f"feature_{i}"), float(w)) for i, w in enumerate(weights)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def permuted(df: DataFrame, features: Sequence[str], seed: int = 0, into: str = "_other") -> DataFrame:
    """``df`` with a struct of the features of another row, by a random permutation of all rows.

    Rows are numbered in the order of one hash and once more in that of another; a row takes
    the features of the one that has its number in the other order. Both orders are sorted over
    all tasks, so no part of it grows with the data alone.
    """
    marked = df.withColumn("_mark", F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])).withColumn("_row", F.monotonically_increasing_id())
    first = placed(marked, "_mark", "_row").drop("_mark", "_row")
    second = first.select(F.struct(*features).alias(into), "_place", F.xxhash64(F.lit(seed + 1), "_place").alias("_mark"))
    other = placed(second, "_mark", "_place", into="_new").select(into, F.col("_new").alias("_place"))
    return first.join(other, "_place").drop("_place")


def permutation_importance(model, df: DataFrame, label: str, features: Sequence[str], seed: int = 0) -> DataFrame:
    """Loss of accuracy when one feature is shuffled between rows.

    All features take their values from one random permutation of the rows, and are tried one at a time on
    copies of the row in one scoring pass.
    """
    shifted = permuted(df, features, seed).withColumn("_shuffled", F.explode(F.array(F.lit(""), *[F.lit(f) for f in features])))
    trial = shifted.withColumns(
        {f: F.when(F.col("_shuffled") == f, F.col("_other")[f]).otherwise(F.col(f)) for f in features}
    )
    right = F.avg((F.col("prediction") == F.col(label).cast("double")).cast("double"))
    scores = model.transform(trial).groupBy(F.col("_shuffled").alias("feature")).agg(right.alias("accuracy"))
    whole = F.max(F.when(F.col("feature") == "", F.col("accuracy"))).over(Window.partitionBy())
    return (
        scores.withColumn("importance", whole - F.col("accuracy"))
        .filter(F.col("feature") != "")
        .select("feature", "accuracy", "importance")
    )


def coalitions(features: int, most: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions (0/1 rows) with their weights by the Shapley kernel.

    Sizes are taken from both ends, smallest and largest first, in full as long as all
    coalitions of a size and its complement fit into ``most``; what is left of it is drawn with complements from the
    other sizes, which share their weight. Everything is enumerated if 2^features - 2 fits.
    """
    draw = random.Random(seed)
    sizes = list(range(1, features))
    kernel = {s: (features - 1) / (s * (features - s)) for s in sizes}
    rows: dict[tuple, float] = {}
    left = most
    while sizes:
        pair = {sizes[0], sizes[-1]}
        n = sum(math.comb(features, s) for s in pair)
        if n > left:
            break
        left -= n
        for s in sorted(pair):
            for members in itertools.combinations(range(features), s):
                rows[members] = kernel[s] / math.comb(features, s)
        sizes = sizes[1:-1]
    if sizes and left > 0:
        weight, drawn = sum(kernel[s] for s in sizes), []
        while len(drawn) < left:
            s = draw.choices(sizes, [kernel[s] for s in sizes])[0]
            members = tuple(sorted(draw.sample(range(features), s)))
            drawn += [members, tuple(i for i in range(features) if i not in set(members))]
        for members in drawn:
            rows[members] = rows.get(members, 0.0) + weight / len(drawn)
    z = np.zeros((len(rows), features))
    for i, members in enumerate(rows):
        z[i, list(members)] = 1.0
    return z, np.array(list(rows.values()))


def kernel_shap(
    score: Callable[[DataFrame], DataFrame], background: DataFrame, examples: DataFrame, features: Sequence[str], output: str = "prediction",
    background_rows: int = 10, example_rows: int = 100, most: int | None = None, seed: int = 0, keep: Sequence[str] = (),
) -> DataFrame:
    """Kernel SHAP: (example, .., feature, contribution, base, predicted).

    ``score`` adds the column ``output`` to a frame with the features. A
    coalition takes its members from the example and the others from each
    background row; the mean output is its value. Contributions solve the least
    squares over all coalitions, weighted by the Shapley kernel, under the
    constraint that they add up to the example's output less the mean output
    of the background. The normal equations have the same matrix for all examples, so it is
    inverted once, and an example's contributions are weighted sums over its scored rows: one
    aggregation. ``most`` coalitions are used (2048 and twice the number of features by default);
    all of them where they are fewer, which is exact. Examples and background are drawn by a hash of their features;
    ``keep`` names further columns of the examples to return.
    """
    names, m = list(features), len(features)
    z, w = coalitions(m, 2048 + 2 * m if most is None else most, seed)
    inverse = np.linalg.pinv(z.T @ (w[:, None] * z)) if len(z) else np.zeros((m, m))
    ones = inverse.sum(axis=1)
    share = ones / ones.sum() if ones.sum() else np.full(m, 1.0 / m)
    each = (inverse - np.outer(ones, ones) / ones.sum()) @ (z * w[:, None]).T if ones.sum() else np.zeros((m, len(z)))
    # The last two coalitions are the empty and the full one: they give the base and the example's own output.
    masks = [*z.astype(int).tolist(), [0] * m, [1] * m]
    weights = [*each.T.tolist(), (-each.sum(axis=1) - share).tolist(), share.tolist()]
    spark = examples.sparkSession
    table = spark.createDataFrame(list(zip(range(len(masks)), masks, weights)), "_c int, _mask array<int>, _w array<double>")

    def numbered(df: DataFrame, n: int, key: str, alias: str, more: Sequence[str]) -> DataFrame:
        sample = random_sample(df.select(F.struct(*names).alias(alias), *more), n, seed, by=[f"{alias}.{c}" for c in names], ties=more)
        return sample.withColumn(key, F.row_number().over(Window.orderBy(F.xxhash64(alias), *more)) - 1)

    start = reused(numbered(background, background_rows, "_b", "_from", ()))
    n = start.count()
    asked = reused(numbered(examples, example_rows, "example", "_to", list(keep)))
    trials = asked.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))))
    trials = trials.join(start, "_b").join(table, "_c")
    mixed = {c: F.when(F.get("_mask", F.lit(i)) == 1, F.col("_to")[c]).otherwise(F.col("_from")[c]) for i, c in enumerate(names)}
    scored = score(trials.select("example", *keep, "_c", "_w", *[v.alias(c) for c, v in mixed.items()]))
    value = F.col(output).cast("double")
    base = F.avg(F.when(F.col("_c") == len(masks) - 2, value))
    told = F.avg(F.when(F.col("_c") == len(masks) - 1, value))
    sums = [F.sum(value * F.get("_w", F.lit(i)) / n).alias(f"_s{i}") for i in range(m)]
    rows = scored.groupBy("example", *keep).agg(base.alias("base"), told.alias("predicted"), *sums)
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_s{i}").alias("contribution")) for i, c in enumerate(names)])
    return rows.select("example", *keep, F.inline(parts), "base", "predicted")


def shapley_values(
    model,
    background: DataFrame,
    examples: DataFrame,
    features: Sequence[str],
    background_rows: int = 10,
    example_rows: int = 100,
    rounds: int = 10,
    seed: int = 0,
    output: str = "prediction",
) -> DataFrame:
    """Sampled Shapley contributions of each feature to a model output, per example.

    Every round walks from a background row to the example, switching features
    one by one in random order; a feature's contribution is the mean change at
    its switch. All steps of all walks are rows of one scoring job.
    """
    names = list(features)

    def numbered(df: DataFrame, n: int, key: str, alias: str) -> DataFrame:
        sample = random_sample(df.select(F.struct(*names).alias(alias)), n, seed)
        return sample.withColumn(key, F.row_number().over(Window.orderBy(F.xxhash64(alias))) - 1)

    start = numbered(background, background_rows, "_b", "_from")
    found = start.agg(F.count("*")).scalar()
    walks = (
        numbered(examples, example_rows, "example", "_to")
        .withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
        .withColumn("_b", F.pmod(F.col("example") + F.col("round") * 7, found))
        .withColumn("_path", F.shuffle(F.sequence(F.lit(1), F.lit(len(names))), seed))
    )
    steps = walks.join(start, "_b").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    mixed = steps.withColumns(
        {
            name: F.when(F.array_position("_path", F.lit(i)) <= F.col("step"), F.col("_to")[name]).otherwise(
                F.col("_from")[name]
            )
            for i, name in enumerate(names, 1)
        }
    )
    scored = model.transform(mixed)
    walk = Window.partitionBy("example", "round").orderBy("step")
    change = F.col(output) - F.lag(output).over(walk)
    switched = F.get(F.array(*[F.lit(n) for n in names]), F.get("_path", F.col("step") - 1) - 1)
    return (
        scored.select("example", "round", "step", "_path", output)
        .withColumn("change", change)
        .filter(F.col("step") > 0)
        .groupBy("example", switched.alias("feature"))
        .agg(F.avg("change").alias("contribution"))
    )


def shapley_importance(values: DataFrame) -> DataFrame:
    """Mean absolute contribution of each feature."""
    return values.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
