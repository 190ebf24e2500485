"""Parametric survival fits: without covariates on the (duration, event) histogram, with them on folded subjects."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlife.operators.survival import chi_square_upper, gamma_tail, whole_days
from ledgerlife.session import release, reused


def _log_erfc(z: float) -> float:
    """Logarithm of the complementary error function, by its continued fraction where the value itself would vanish."""
    if z < 10:
        return math.log(math.erfc(z))
    fraction = 0.0
    for k in range(40, 0, -1):
        fraction = k / 2 / (z + fraction)
    return -z * z - math.log(math.sqrt(math.pi) * (z + fraction))


_log_erfc = np.vectorize(_log_erfc, otypes=[float])


def exponential_fit(df: DataFrame, duration: str, event: str) -> DataFrame:
    """Closed-form exponential fit: mean duration per event, log likelihood and AIC."""
    died = F.sum(F.col(event).cast("double"))
    rows = df.agg(died.alias("events"), F.sum(F.col(duration).cast("double")).alias("exposure"))
    scale = F.try_divide(F.col("exposure"), F.col("events"))
    likelihood = -F.col("events") * F.log(scale) - F.col("events")
    return rows.select(
        scale.alias("lambda_"), likelihood.alias("log_likelihood"), (2.0 - 2.0 * likelihood).alias("aic")
    )


def _weibull(t, scale, shape):
    x = (t / scale) ** shape
    return np.log(shape / scale) + (shape - 1) * np.log(t / scale) - x, -x


def _exponential(t, scale):
    return -np.log(scale) - t / scale, -t / scale


def _log_normal(t, scale, sigma):
    z = (np.log(t) - np.log(scale)) / sigma
    log_sf = math.log(0.5) + _log_erfc(z / math.sqrt(2))
    return -np.log(t * sigma * math.sqrt(2 * math.pi)) - z * z / 2, log_sf


def _log_logistic(t, scale, shape):
    x = (t / scale) ** shape
    log_sf = -np.log1p(x)
    return np.log(shape / scale) + (shape - 1) * np.log(t / scale) + 2 * log_sf, log_sf


# name -> (log density and log survival, parameter names)
DISTRIBUTIONS: dict[str, tuple[Callable, list[str]]] = {
    "weibull": (_weibull, ["lambda_", "rho_"]),
    "exponential": (_exponential, ["lambda_"]),
    "log_normal": (_log_normal, ["scale_", "sigma_"]),
    "log_logistic": (_log_logistic, ["alpha_", "beta_"]),
}


def _derivatives(f, x, h=1e-4):
    n = len(x)
    unit = np.eye(n) * h
    gradient = np.array([(f(x + unit[i]) - f(x - unit[i])) / (2 * h) for i in range(n)])
    hessian = np.empty((n, n))
    for i in range(n):
        for j in range(n):
            hessian[i, j] = (
                f(x + unit[i] + unit[j]) - f(x + unit[i] - unit[j]) - f(x - unit[i] + unit[j]) + f(x - unit[i] - unit[j])
            ) / (4 * h * h)
    return gradient, hessian


def _maximise(f, x, rounds=100):
    """Damped Newton ascent; falls back to the gradient where the surface is not concave. Tells whether it came to rest."""
    best = f(x)
    for _ in range(rounds):
        gradient, hessian = _derivatives(f, x)
        try:
            step = -np.linalg.solve(hessian, gradient)
        except np.linalg.LinAlgError:
            step = gradient
        if step @ gradient <= 0:
            step = gradient / max(1.0, np.abs(gradient).max())
        step = step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        while np.abs(step).max() > 1e-10 and not f(x + step) > best:
            step = step / 2
        if np.abs(step).max() <= 1e-10:
            return x, best, True
        x = x + step
        best = f(x)
    return x, best, False


def parametric_survival(
    df: DataFrame, duration: str, event: str, distributions=("weibull", "exponential", "log_normal", "log_logistic")
) -> DataFrame:
    """Maximum-likelihood fits compared by AIC, one row per parameter.

    Only the histogram of durations (a row per distinct day) leaves Spark.
    Durations must be positive; ``dropped_rows`` tells how many rows were not
    (or had none), ``converged`` whether the search came to rest.
    """
    whole_days(df, duration)
    dropped = df.agg(F.count_if(F.coalesce(F.col(duration) <= 0, F.lit(True)))).first()[0]
    counts = (
        df.filter(F.col(duration) > 0)
        .groupBy(F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"))
        .agg(F.count("*").alias("n"))
        .toPandas()
    )
    t, died, n = counts["t"].to_numpy(), counts["e"].to_numpy() == 1, counts["n"].to_numpy().astype(float)
    start_scale = (t * n).sum() / max(1.0, n[died].sum())
    fits = []
    for name in distributions:
        parts, names = DISTRIBUTIONS[name]

        def likelihood(logs, parts=parts):
            density, tail = parts(t, *np.exp(logs))
            return float((n * np.where(died, density, tail)).sum())

        start = np.zeros(len(names))
        start[0] = math.log(start_scale)
        logs, best, rests = _maximise(likelihood, start)
        _, hessian = _derivatives(likelihood, logs)
        errors = np.sqrt(np.maximum(np.diag(np.linalg.inv(-hessian)), 0.0))
        for parameter, value, error in zip(names, np.exp(logs), errors):
            fits.append((name, parameter, float(value), float(value * error), best, 2.0 * len(names) - 2.0 * best, rests, dropped))
    schema = "distribution string, parameter string, estimate double, se double, log_likelihood double, aic double, converged boolean, dropped_rows bigint"
    lowest = min(fit[5] for fit in fits)
    frame = df.sparkSession.createDataFrame(fits, schema)
    return frame.withColumn("lowest_aic", F.col("aic") == F.lit(lowest))


def aft_regression(df: DataFrame, duration: str, event: str, covariates: list[str], **settings):
    """Weibull accelerated-failure-time model with covariates, on MLlib.

    Refuses rows that it can't use: durations of zero or less, and nulls.
    """
    bad = ~(F.coalesce(F.col(duration), F.lit(0)) > 0) | F.col(event).isNull()
    for name in covariates:
        bad = bad | F.col(name).isNull()
    if not df.filter(bad).isEmpty():
        raise ValueError(f"{duration} must be positive, and {event} and the covariates not null")
    rows = df.withColumn("_label", F.col(duration).cast("double"))
    rows = VectorAssembler(inputCols=covariates, outputCol="_features", handleInvalid="error").transform(
        rows.withColumn("_observed", F.col(event).cast("double"))
    )
    trainer = AFTSurvivalRegression(
        featuresCol="_features", labelCol="_label", censorCol="_observed", **settings
    )
    return trainer.fit(rows)


def aft_summary(spark, model, covariates: list[str]) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(covariates, model.coefficients)]
    rows += [("intercept", float(model.intercept)), ("scale", float(model.scale))]
    return spark.createDataFrame(rows, "parameter string, estimate double")


# -- accelerated failure time with covariates -----------------------------------


def normal_tail(z: Column) -> tuple[Column, Column]:
    """Logarithm of the upper tail of the normal distribution, and density over tail (the inverse Mills ratio).

    By the incomplete gamma function up to 5, beyond by a continued fraction of which 60 steps give all digits.
    """
    log_density = -0.5 * z * z - 0.5 * math.log(2 * math.pi)
    half = 0.5 * gamma_tail(0.5, 0.5 * z * z, 120)
    tail = F.when(z >= 0, half).otherwise(1.0 - half)
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda s, n: z + n / s)
    near = z <= 5
    return F.when(near, F.log(tail)).otherwise(log_density - F.log(fraction)), F.when(near, F.exp(log_density) / tail).otherwise(fraction)


def _weibull_terms(z: Column) -> dict[str, tuple[Column, Column, Column]]:
    e = F.exp(F.least(z, F.lit(700.0)))
    return {"event": (z - e, 1.0 - e, -e), "censored": (-e, -e, -e)}


def _log_logistic_terms(z: Column) -> dict[str, tuple[Column, Column, Column]]:
    p = 1.0 / (1.0 + F.exp(F.least(-z, F.lit(700.0))))
    soft = F.when(z > 30, z).otherwise(F.log1p(F.exp(F.least(z, F.lit(30.0)))))
    return {"event": (z - 2.0 * soft, 1.0 - 2.0 * p, -2.0 * p * (1.0 - p)), "censored": (-soft, -p, -p * (1.0 - p))}


def _log_normal_terms(z: Column) -> dict[str, tuple[Column, Column, Column]]:
    log_tail, mills = normal_tail(z)
    return {"event": (-0.5 * z * z - 0.5 * math.log(2 * math.pi), -z, F.lit(-1.0)), "censored": (log_tail, -mills, -mills * (mills - z))}


#: Log likelihood of the error z with its first two derivatives, for events (density) and censored rows (tail).
ERRORS: dict[str, Callable[[Column], dict]] = {"weibull": _weibull_terms, "log_logistic": _log_logistic_terms, "log_normal": _log_normal_terms}


@dataclass
class AftModel:
    """log duration = intercept + covariates * coefficients + scale * error."""

    distribution: str
    covariates: list[str]
    coefficients: np.ndarray  # intercept first
    log_scale: float
    variance: np.ndarray  # of the coefficients and the log of the scale
    log_likelihood: float
    iterations: int
    converged: bool
    dropped_rows: int


def _aft_patterns(df: DataFrame, duration: str, event: str, covariates: Sequence[str]) -> tuple[DataFrame, int]:
    """Subjects folded to weighted patterns, and how many had a null or no positive duration."""
    bad = ~F.coalesce(F.col(duration) > 0, F.lit(False)) | F.col(event).isNull()
    for name in covariates:
        bad = bad | F.col(name).isNull()
    dropped = df.agg(F.count_if(bad)).first()[0]
    kept = df.filter(~bad).select(F.log(F.col(duration).cast("double")).alias("_y"), (F.col(event) == 1).alias("_died"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(covariates, 1)])
    return reused(kept.groupBy(*kept.columns).agg(F.count("*").cast("double").alias("_n"))), dropped


def _aft_score(patterns: DataFrame, p: int, distribution: str, coefficients: np.ndarray, log_scale: float):
    """Log likelihood, gradient and observed information at given values, by one aggregation to one row."""
    scale = math.exp(log_scale)
    x = [F.lit(1.0)] + [F.col(f"_x{i}") for i in range(1, p)]
    linear = F.lit(0.0)
    for part, b in zip(x, coefficients):
        linear = linear + part * F.lit(float(b))
    rows = patterns.withColumn("_z", (F.col("_y") - linear) / F.lit(scale))
    terms = ERRORS[distribution](F.col("_z"))
    died = F.col("_died")
    value, first, second = (F.when(died, e).otherwise(c) for e, c in zip(terms["event"], terms["censored"]))
    rows = rows.select("*", F.struct(value.alias("l"), first.alias("a"), second.alias("b")).alias("_t"))
    n, z, a, b = F.col("_n"), F.col("_z"), F.col("_t.a"), F.col("_t.b")
    sums = [F.sum(n * (F.col("_t.l") - F.when(died, log_scale + F.col("_y")).otherwise(0.0)))]
    sums += [F.sum(-n * a * v / scale) for v in x] + [F.sum(n * (-a * z - F.when(died, 1.0).otherwise(0.0)))]
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    sums += [F.sum(-n * b * x[j] * x[k] / scale**2) for j, k in pairs]
    sums += [F.sum(-n * (a + b * z) * v / scale) for v in x] + [F.sum(-n * (a * z + b * z * z))]
    row = [float(v or 0.0) for v in rows.agg(*[s.alias(f"v{i}") for i, s in enumerate(sums)]).first()]
    gradient, rest = np.array(row[1 : p + 2]), row[p + 2 :]
    information = np.zeros((p + 1, p + 1))
    for (j, k), v in zip(pairs, rest):
        information[j, k] = information[k, j] = v
    information[:p, p] = information[p, :p] = rest[len(pairs) : len(pairs) + p]
    information[p, p] = rest[-1]
    return row[0], gradient, information


def aft_likelihood(df: DataFrame, duration: str, event: str, covariates: Sequence[str], distribution: str, coefficients: Sequence[float], scale: float) -> DataFrame:
    """(quantity, value): log likelihood, gradient and information (upper half) at given values, intercept first, log of the scale last."""
    patterns, _ = _aft_patterns(df, duration, event, covariates)
    value, gradient, information = _aft_score(patterns, len(covariates) + 1, distribution, np.array(coefficients, dtype=float), math.log(scale))
    release(patterns)
    names = ["intercept", *covariates, "log_scale"]
    rows = [("log_likelihood", value)] + [(f"gradient_{c}", float(g)) for c, g in zip(names, gradient)]
    rows += [(f"information_{a}_{b}", float(information[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return df.sparkSession.createDataFrame(rows, "quantity string, value double")


def parametric_likelihood(df: DataFrame, duration: str, event: str, given: dict[str, tuple[float, ...]]) -> DataFrame:
    """(distribution, log_likelihood, aic) of fits without covariates at given parameters, as ``parametric_survival`` names them.

    Each is the log of the duration with a location and a scale: that of a Weibull is log(lambda) and 1 / rho, an exponential has rho 1.
    """
    found = None
    for name, values in given.items():
        location, scale = math.log(values[0]), 1.0 if name == "exponential" else values[1] if name == "log_normal" else 1.0 / values[1]
        one = aft_likelihood(df, duration, event, [], "weibull" if name == "exponential" else name, [location], scale).filter("quantity = 'log_likelihood'")
        one = one.select(F.lit(name).alias("distribution"), F.col("value").alias("log_likelihood"), (2.0 * len(values) - 2.0 * F.col("value")).alias("aic"))
        found = one if found is None else found.unionByName(one)
    return found


def aft_fit(df: DataFrame, duration: str, event: str, covariates: Sequence[str], distribution: str = "weibull", max_iterations: int = 60, tolerance: float = 1e-10) -> AftModel:
    """Accelerated failure time by maximum likelihood, with a Weibull, log-normal or log-logistic duration.

    Newton steps on the coefficients and the log of the scale, halved until the likelihood rises; where
    the information isn't positive definite its diagonal is raised. Rows with a null, or a duration of
    zero or less, take no part and are counted. Each step is one aggregation of the folded subjects.
    """
    if distribution not in ERRORS:
        raise ValueError(f"distribution is one of {', '.join(ERRORS)}, not {distribution}")
    covariates = list(covariates)
    patterns, dropped = _aft_patterns(df, duration, event, covariates)
    p = len(covariates) + 1
    facts = patterns.agg(F.sum(F.col("_n") * F.col("_y")) / F.sum("_n")).first()[0]
    at = np.zeros(p + 1)
    at[0] = facts or 0.0
    value, gradient, information = _aft_score(patterns, p, distribution, at[:p], at[p])
    iteration, converged = 0, False
    for iteration in range(1, max_iterations + 1):
        lift = 0.0
        while True:
            raised = information + lift * np.diag(np.maximum(np.abs(np.diag(information)), 1e-8))
            try:
                np.linalg.cholesky(raised)
                break
            except np.linalg.LinAlgError:
                lift = max(2.0 * lift, 1e-4)
        step = np.linalg.solve(raised, gradient)
        step = step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        for _ in range(30):
            trial = _aft_score(patterns, p, distribution, (at + step)[:p], (at + step)[p])
            if trial[0] >= value - 1e-12 * abs(value):
                break
            step = step / 2
        else:
            break
        at, change = at + step, abs(trial[0] - value)
        value, gradient, information = trial
        if change <= tolerance * max(1.0, abs(value)) and lift == 0.0:
            converged = True
            break
    release(patterns)
    return AftModel(distribution, covariates, at[:p], float(at[p]), np.linalg.pinv(information), value, iteration, converged, dropped)


def aft_fit_summary(spark, model: AftModel, z: float = 1.959963984540054) -> DataFrame:
    """Estimates with standard errors, z, p and intervals; ``log_scale`` last. AIC and the state of the fit on every row."""
    names, values = ["intercept", *model.covariates, "log_scale"], [*model.coefficients, model.log_scale]
    errors = np.sqrt(np.maximum(np.diag(model.variance), 0.0))
    frame = spark.createDataFrame([(n, float(v), float(e)) for n, v, e in zip(names, values, errors)], "parameter string, estimate double, se double")
    ratio = F.try_divide(F.col("estimate"), F.col("se"))
    return frame.withColumns(
        {
            "z": ratio, "p": chi_square_upper(ratio * ratio, 1), "lower": F.col("estimate") - z * F.col("se"), "upper": F.col("estimate") + z * F.col("se"),
            "distribution": F.lit(model.distribution), "log_likelihood": F.lit(model.log_likelihood), "aic": F.lit(2.0 * len(values) - 2.0 * model.log_likelihood),
            "converged": F.lit(model.converged), "dropped_rows": F.lit(model.dropped_rows).cast("long"),
        }
    )


def aft_predict(model: AftModel, df: DataFrame, days: Sequence[int]) -> DataFrame:
    """``df`` with the median duration and the survival at the given days, ``survival_at_<day>``; null covariates give nulls."""
    linear = F.lit(float(model.coefficients[0]))
    for name, b in zip(model.covariates, model.coefficients[1:]):
        linear = linear + F.col(name).cast("double") * F.lit(float(b))
    scale = math.exp(model.log_scale)
    middle = {"weibull": math.log(math.log(2.0)), "log_logistic": 0.0, "log_normal": 0.0}[model.distribution]
    tails = {f"survival_at_{d}": F.exp(ERRORS[model.distribution]((math.log(d) - linear) / scale)["censored"][0]) for d in days}
    return df.withColumns({"median_duration": F.exp(linear + middle * scale), **tails})
