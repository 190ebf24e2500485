"""Regression and classification reports, value profiles and density."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlife.functions import codes
from ledgerlife.functions import columns as C


def regression_report(
    df: DataFrame, prediction: str, actual: str, buckets: Sequence[tuple] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Count, RMSE and MAE overall and per bucket of the actual value, in one aggregation.

    The overall row also covers actual values outside every bucket; an empty
    bucket shows zero records and no error.
    """
    buckets = buckets or codes.INACTIVITY_BUCKETS
    truth = F.col(actual)
    error = F.col(prediction) - truth
    scopes = {"Overall": F.lit(True)} | {C.bucket_label(b): truth.between(*b) for b in buckets}
    sums, rows = [], []
    for i, (label, inside) in enumerate(scopes.items()):
        seen = inside & error.isNotNull()
        sums += [
            F.count_if(seen).alias(f"n_{i}"),
            F.sum(F.when(seen, error * error)).alias(f"sq_{i}"),
            F.sum(F.when(seen, F.abs(error))).alias(f"ab_{i}"),
        ]
        count = F.col(f"n_{i}")
        rows.append(
            F.struct(
                F.lit(label).alias("bucket"),
                count.alias("total_records"),
                F.sqrt(F.try_divide(F.col(f"sq_{i}"), count)).cast("double").alias("rmse"),
                F.try_divide(F.col(f"ab_{i}"), count).cast("double").alias("mae"),
            )
        )
    return df.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*rows)))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Row counts by true and predicted class, with the share of the true class."""
    counts = df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(
        F.count("*").alias("rows")
    )
    support = F.sum("rows").over(Window.partitionBy("label"))
    return counts.withColumn("share_of_label", F.col("rows") / support)


def _per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    pairs = df.groupBy(F.col(label).cast("int").alias("t"), F.col(prediction).cast("int").alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    nothing = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), nothing.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("p").alias("class"), nothing.alias("support"), F.col("n").alias("predicted"), nothing.alias("hits")),
    )
    return (
        pairs.select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support of each class seen as truth or prediction."""
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), zero)
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("hits"), F.col("predicted") + F.col("support")), zero)
    return _per_class(df, label, prediction).select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def classification_summary(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy with macro and support-weighted averages of the class report."""
    report = classification_report(df, label, prediction)
    total = F.sum("support")
    names = ["precision", "recall", "f1"]
    return report.agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), total).alias("accuracy"),
        *[F.avg(name).alias(f"macro_{name}") for name in names],
        *[F.try_divide(F.sum(F.col(name) * F.col("support")), total).alias(f"weighted_{name}") for name in names],
        total.alias("support"),
    )


def never_predicted(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Classes that occur as truth but are never predicted."""
    truth = df.select(F.col(label).cast("int").alias("class")).distinct()
    return truth.join(df.select(F.col(prediction).cast("int").alias("class")).distinct(), "class", "left_anti")


def _texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def feature_value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per value of each column (as text), nulls left out."""
    columns = list(columns or df.columns)
    long = _texts(df, columns).unpivot([], columns, "column", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("count"))


def column_modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value of each column; of equal counts the first in text order."""
    counts = feature_value_counts(df, columns)
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode"), F.max("count").alias("count")
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count of each column, one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "nulls")


def columns_of_type(df: DataFrame, *kinds: str) -> list[str]:
    """Names of the columns of the given simple types, as ``double`` or ``boolean``."""
    return [name for name, kind in df.dtypes if kind in kinds]


def random_sample(df: DataFrame, n: int, seed: int = 0, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """``n`` random rows (each partition keeps only its own best ``n``).

    With ``by`` the draw depends on the seed and those columns alone, not on
    the order of the rows: rows go by the MD5 of both as text, then by ``ties``.
    """
    if not by:
        return df.orderBy(F.rand(seed)).limit(n)
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by]))
    return df.orderBy(mark, *ties).limit(n)


#: Bins of a kernel width, the orders of their moments, and the widths beyond which the kernel is left out.
BINS, ORDERS, REACH = 8, 9, 8


def density(df: DataFrame, column: str, grid: Sequence[float], bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density of a column at the grid points.

    Without a bandwidth Scott's rule is used: the sample deviation times
    ``n ** -0.2``. Null and not-a-number are left out.

    Values are folded to bins of an eighth of the bandwidth, each with the moments
    of its offsets u from the middle: exp(-(s - u)^2 / 2) = exp(-s^2 / 2) * sum He_m(s) u^m / m!, with
    s the distance of a grid point in bandwidths. With |u| of at most 1/16 the terms
    left out after order 8 are below 1.09 / sqrt(9!) / 16^9 = 3e-14 of the kernel's top (Cramer's bound of Hermite polynomials), and
    the kernel beyond 8 bandwidths is below 2e-14. A grid point reads 130 bins at most, however many rows there are.
    """
    value = F.col(column).cast("double")
    rows = df.filter(F.col(column).isNotNull() & ~F.isnan(value)).select(value.alias("v"))
    facts = rows.agg(F.count("*").alias("total"), F.stddev_samp("v").alias("sd"))
    scott = F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    width: Column = scott if bandwidth is None else F.lit(float(bandwidth))
    scale = facts.select(F.struct(F.col("total"), F.when(width > 0, width).alias("width")).alias("s")).scalar()
    place = F.col("v") / F.col("s.width") * BINS
    binned = rows.withColumn("s", scale).withColumn("bin", F.floor(place))
    offset = (place - F.col("bin") - 0.5) / BINS
    moments = binned.groupBy("bin").agg(*[F.sum(F.pow(offset, F.lit(float(m)))).alias(f"m{m}") for m in range(ORDERS)])
    points = df.sparkSession.createDataFrame([(float(x),) for x in grid], "x double").withColumn("s", scale)
    at = F.col("x") / F.col("s.width")
    near = F.sequence(F.floor((at - REACH) * BINS), F.floor((at + REACH) * BINS))
    met = points.withColumn("bin", F.explode_outer(near)).join(moments, "bin", "left")
    distance = at - (F.col("bin") + 0.5) / BINS
    before, he, total, factorial = F.lit(0.0), F.lit(1.0), F.col("m0"), 1.0
    for m in range(1, ORDERS):
        before, he = he, distance * he - (m - 1) * before
        factorial *= m
        total = total + he * F.col(f"m{m}") / factorial
    weight = F.exp(-0.5 * distance * distance) * total / (F.col("s.total") * F.col("s.width") * F.lit(math.sqrt(2 * math.pi)))
    return met.groupBy("x").agg(F.when(F.max("s.width").isNotNull(), F.coalesce(F.sum(weight), F.lit(0.0))).alias("density"))
