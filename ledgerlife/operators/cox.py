"""Stratified Cox proportional hazards fitted from Spark aggregates.

Subjects that agree in stratum, duration, event and covariates are folded to
one weighted row first. A Newton step sums them by (stratum, duration), adds
risk sets up from the last day of each stratum, forms Efron's tie sums as
columns and adds everything up again: two rows with the likelihood, its gradient
and its information reach the driver, however many strata and days there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlife.functions.columns import constants
from ledgerlife.operators.survival import chi_square_upper, whole_days
from ledgerlife.session import release, reused

TIES = ("log_f", "f1", "a1", "f2", "a2", "aa2")
#: Powers kept by the series for few ties, and Bernoulli numbers over factorials of the summation formula.
ORDERS, EULER = 32, ((1 / 12, 1), (-1 / 720, 3), (1 / 30240, 5), (-1 / 1209600, 7), (1 / 47900160, 9))


def _ties(*values: Column) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(values, TIES)])


def _direct(risk: Column, tied: Column, count: Column) -> Column:
    """Tie sums added up step by step, for at most 64 steps."""

    def add(s, k):
        a = k / count
        f = risk - a * tied
        return _ties(s["log_f"] + F.log(f), s["f1"] + 1.0 / f, s["a1"] + a / f, s["f2"] + 1.0 / (f * f), s["a2"] + a / (f * f), s["aa2"] + a * a / (f * f))

    return F.aggregate(F.sequence(F.lit(0), F.least(count, F.lit(64)).cast("int") - 1), _ties(*[F.lit(0.0)] * 6), add)


def _series(risk: Column, tied: Column, count: Column) -> Column:
    """Tie sums by powers of u = tied / risk, for u of at most a quarter and more than 64 steps.

    With 1 / f = sum (a u)^m / risk every sum is a series over the power sums of
    a = 0, 1/d, ..., which Euler and Maclaurin's formula gives to the last digit here.
    """
    orders = range(ORDERS + 4)
    falling = lambda m, j: float(math.prod(m - i for i in range(j))) if m > j else 0.0
    constant = lambda values: F.array(*[F.lit(float(v)) for v in values])
    whole, half = constant(1 / (m + 1) for m in orders), constant(-0.5 if m else 0.0 for m in orders)
    parts = [(constant(b * falling(m, j) for m in orders), j) for b, j in EULER]

    def power(m):
        total = count * F.get(whole, m) + F.get(half, m)
        for values, j in parts:
            total = total + F.get(values, m) / F.pow(count, F.lit(float(j)))
        return total

    # Power sums are computed once for each row, then read by order.
    sums = F.transform(F.sequence(F.lit(0), F.lit(ORDERS + 3)), power)
    u = tied / risk

    def add(s, m):
        q0, q1, q2 = (F.get(s["q"], m + i) for i in range(3))
        logs = F.when(m > 0, s["ups"] / m * q0).otherwise(0.0)
        kept = F.when(m < ORDERS, s["ups"]).otherwise(0.0)
        more = {
            "log_f": s["log_f"] - logs, "f1": s["f1"] + kept * q0 / risk, "a1": s["a1"] + kept * q1 / risk, "f2": s["f2"] + (m + 1) * kept * q0 / (risk * risk),
            "a2": s["a2"] + (m + 1) * kept * q1 / (risk * risk), "aa2": s["aa2"] + (m + 1) * kept * q2 / (risk * risk),
        }
        return F.struct(s["q"].alias("q"), (s["ups"] * u).alias("ups"), *[v.alias(n) for n, v in more.items()])

    start = F.struct(sums.alias("q"), F.lit(1.0).alias("ups"), (count * F.log(risk)).alias("log_f"), *[F.lit(0.0).alias(n) for n in TIES[1:]])
    return F.aggregate(F.sequence(F.lit(0), F.lit(ORDERS + 1)), start, add, lambda s: _ties(*[s[n] for n in TIES]))


def _gamma(risk: Column, tied: Column, count: Column) -> Column:
    """Tie sums by differences of log gamma and its derivatives, for tied above a quarter of the risk.

    f = (x - a) d / tied over whole a, with x = d risk / tied, so the sums run
    over x, x - 1, ..., y. Terms below 16 are added one by one; for the others
    the asymptotic series are subtracted term by term, in forms that don't cancel.
    """
    c = count / tied
    x = count * risk / tied
    y0 = F.greatest(x - count + 1.0, F.lit(1.0))
    few = F.least(count, F.greatest(F.lit(0.0), F.ceil(16.0 - y0).cast("double")))
    steps = F.when(few > 0, F.sequence(F.lit(0), few.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.struct(*[F.lit(0.0).alias(f"s{i}") for i in range(3)])

    def add(s, k):
        y = y0 + k
        return F.struct((s["s0"] + F.log(y)).alias("s0"), (s["s1"] + 1.0 / y).alias("s1"), (s["s2"] + 1.0 / (y * y)).alias("s2"))

    near = F.aggregate(steps, zero, add)
    d, y = count - few, y0 + few
    z = y + d
    ratio = F.log1p(d / y)

    def differences(terms, sign=1.0):
        total = F.lit(0.0)
        for n, k in terms:
            total = total + sign * k * (F.pow(z, F.lit(-float(n))) - F.pow(y, F.lit(-float(n))))
        return total

    far0 = d * F.log(y) + (z - 0.5) * ratio - d - d / (12.0 * y * z) + differences(((3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680)))
    far1 = ratio + d / (2.0 * y * z) + differences(((2, -1 / 12), (4, 1 / 120), (6, -1 / 252), (8, 1 / 240)))
    far2 = d / (y * z) + d * (y + z) / (2.0 * y * y * z * z) + differences(((3, 1 / 6), (5, -1 / 30), (7, 1 / 42), (9, -1 / 30)), -1.0)
    s0, s1, s2 = (near[f"s{i}"] + F.when(d > 0, far).otherwise(0.0) for i, far in enumerate((far0, far1, far2)))
    f1, f2 = c * s1, c * c * s2
    return _ties(
        s0 - count * F.log(c), f1, (risk * f1 - count) / tied, f2, (risk * f2 - f1) / tied, (risk * risk * f2 - 2.0 * risk * f1 + count) / (tied * tied)
    )


def tie_sums(risk: Column, tied: Column, count: Column, most: int | None = None) -> Column:
    """Sums over the ``count`` Efron steps a = 0, 1/d, ... of log f, 1/f, a/f, 1/f^2, a/f^2, a^2/f^2 for f = risk - a * tied.

    A struct of doubles, exact to rounding for every count: added up for few steps, else in closed form.
    ``most`` is the largest count, if known: the closed forms are left out of the plan where none needs them.
    """
    risk, tied, count = (c.cast("double") for c in (risk, tied, count))
    if most is not None and most <= 64:
        return _direct(risk, tied, count)
    return F.when(count <= 64, _direct(risk, tied, count)).when(tied <= 0.25 * risk, _series(risk, tied, count)).otherwise(_gamma(risk, tied, count))


@dataclass
class CoxModel:
    covariates: list[str]
    strata: list[str]
    means: np.ndarray
    coefficients: np.ndarray
    variance: np.ndarray
    log_likelihood: float
    iterations: int
    patterns: DataFrame = field(repr=False)
    converged: bool = True
    dropped_rows: int = 0
    null_log_likelihood: float = float("nan")
    score_statistic: float = float("nan")

    def release(self) -> None:
        """Give up the folded subjects that were cached for the fit; the model can't predict baselines afterwards."""
        release(self.patterns)


def _centred(covariates: Sequence[str], means) -> list[Column]:
    return [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(covariates, means)]


def _linear(parts: Sequence[Column], weights) -> Column:
    total = F.lit(0.0)
    for part, weight in zip(parts, weights):
        total = total + part * F.lit(float(weight))
    return total


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(j, k) for j in range(p) for k in range(j, p)]


def _hazards(patterns: DataFrame, strata: Sequence[str], z: list[Column], coefficients) -> DataFrame:
    """Patterns with centred covariates ``_z<j>`` and their number times the hazard, ``_h``."""
    named = patterns.select(*strata, F.col("_duration").alias("duration"), "_event", "_n", *[c.alias(f"_z{j}") for j, c in enumerate(z)])
    weights = constants([float(b) for b in coefficients], "double")
    linear = f"aggregate(zip_with(array({', '.join(f'_z{j}' for j in range(len(z)))}), {weights}, (x, b) -> x * b), 0D, (s, v) -> s + v)"
    return named.withColumn("_h", F.expr(f"_n * exp({linear})"))


def risk_table(hazards: DataFrame, strata: Sequence[str], p: int, most: int | None = None) -> DataFrame:
    """A row for each stratum and day: sums over its events and its risk set, Efron's tie sums, and their running total.

    Columns: _d, _x_<j> (events); _s0, _s1_<j> (risk set, by hazard); _t0, _t1_<j> (events, by hazard); _ties; and _reach, the sum of
    1/f over all steps up to the day. Without events tie sums are null. A stratum has a row for each day of the log at most.
    """
    of_events = lambda v: F.sum(F.when(F.col("_event") == 1, v).otherwise(0.0))
    h = F.col("_h")
    moments = {"0": h, **{f"1_{j}": h * F.col(f"_z{j}") for j in range(p)}}
    sums = [F.sum(F.when(F.col("_event") == 1, F.col("_n")).otherwise(0)).alias("_d")] + [of_events(F.col("_n") * F.col(f"_z{j}")).alias(f"_x_{j}") for j in range(p)]
    sums += [F.sum(v).alias(f"_s{name}") for name, v in moments.items()] + [of_events(v).alias(f"_t{name}") for name, v in moments.items()]
    by_day = hazards.groupBy(*strata, "duration").agg(*sums)
    from_here = Window.partitionBy(*strata).orderBy(F.desc("duration"))
    so_far = Window.partitionBy(*strata).orderBy("duration")
    at_risk = by_day.withColumns({f"_s{name}": F.sum(f"_s{name}").over(from_here) for name in moments})
    tied = at_risk.withColumn("_ties", F.when(F.col("_d") > 0, tie_sums(F.col("_s0"), F.col("_t0"), F.col("_d"), most)))
    return tied.withColumn("_reach", F.coalesce(F.sum("_ties.f1").over(so_far), F.lit(0.0)))


def _expected(j: int) -> Column:
    """Sum of a covariate's means over the risk sets of a day's events."""
    return F.col(f"_s1_{j}") * F.col("_ties.f1") - F.col(f"_t1_{j}") * F.col("_ties.a1")


def _score(patterns: DataFrame, strata: Sequence[str], z: list[Column], coefficients, most: int | None = None):
    """Efron log likelihood, gradient and information, from one collected row each.

    The squares of covariates over all risk sets are not summed set by set: a subject is in the sets of all days up to
    its own, so its squares count by the sum of 1/f up to there, less the share that Efron's steps take from the tied.
    """
    p = len(z)
    hazards = _hazards(patterns, strata, z, coefficients)
    table = risk_table(hazards, strata, p, most).persist()
    parts = ["_ties.log_f"] + [f"_x_{j}" for j in range(p)] + [f"_s1_{j} * _ties.f1 - _t1_{j} * _ties.a1" for j in range(p)]
    parts += [
        f"_ties.a2 * (_s1_{j} * _t1_{k} + _s1_{k} * _t1_{j}) - _ties.f2 * _s1_{j} * _s1_{k} - _ties.aa2 * _t1_{j} * _t1_{k}" for j, k in _pairs(p)
    ]
    total = lambda values: F.expr(f"array({', '.join(f'coalesce(CAST(sum({v}) AS DOUBLE), 0D)' for v in values)})").alias("v")
    sums = table.filter("_d > 0").agg(total(parts))
    reach = table.select(*strata, "duration", "_reach", F.col("_ties.a1").alias("_a1"))
    weight = F.expr("_h * (_reach - CASE WHEN _event = 1 THEN coalesce(_a1, 0D) ELSE 0D END)")
    squares = hazards.join(reach, [*strata, "duration"]).withColumn("_w", weight).agg(total([f"_w * _z{j} * _z{k}" for j, k in _pairs(p)]))
    rows = [sums.first(), squares.first()]
    table.unpersist()
    sums, squares = (np.array(r["v"], dtype=float) for r in rows)
    seen, expected = sums[1 : 1 + p], sums[1 + p : 1 + 2 * p]
    information = np.zeros((p, p))
    for (j, k), outer, own in zip(_pairs(p), sums[1 + 2 * p :], squares):
        information[j, k] = information[k, j] = own + outer
    return float(seen @ np.asarray(coefficients, dtype=float) - sums[0]), seen - expected, information


def _folded(df: DataFrame, duration: str, event: str, covariates: list[str], strata: list[str]):
    """Subjects folded to weighted patterns, their mean covariates, and the number of rows left out for nulls."""
    needed = [duration, event, *covariates, *strata]
    whole_days(df, duration)
    gaps = F.lit(False)
    for name in needed:
        gaps = gaps | F.col(name).isNull()
    dropped = df.agg(F.count_if(gaps)).first()[0]
    patterns = reused(
        df.select(*needed)
        .na.drop()
        .groupBy(*strata, F.col(duration).alias("_duration"), F.col(event).alias("_event"), *covariates)
        .agg(F.count("*").alias("_n"))
    )
    total = F.sum("_n")
    first = patterns.agg(*[(F.sum(F.col(c) * F.col("_n")) / total).alias(f"m{i}") for i, c in enumerate(covariates)]).first()
    return patterns, np.array([float(v) for v in first]), dropped


def _most_tied(patterns: DataFrame, strata: Sequence[str]) -> int:
    """The largest number of events of a stratum on one day."""
    deaths = patterns.filter("_event = 1").groupBy(*strata, "_duration").agg(F.sum("_n").alias("_d"))
    return deaths.agg(F.max("_d")).first()[0] or 0


def cox_at(
    df: DataFrame, duration: str, event: str, covariates: Sequence[str], coefficients: Sequence[float], strata: Sequence[str] = ()
) -> tuple[CoxModel, np.ndarray, np.ndarray]:
    """The model at given coefficients, not fitted, with the gradient and information of the likelihood there."""
    covariates, strata = list(covariates), list(strata)
    patterns, means, dropped = _folded(df, duration, event, covariates, strata)
    at = np.array(coefficients, dtype=float)
    value, gradient, information = _score(patterns, strata, _centred(covariates, means), at, _most_tied(patterns, strata))
    model = CoxModel(covariates, strata, means, at, np.linalg.inv(information), value, 0, patterns, False, dropped)
    return model, gradient, information


def partial_likelihood(
    df: DataFrame, duration: str, event: str, covariates: Sequence[str], coefficients: Sequence[float], strata: Sequence[str] = ()
) -> DataFrame:
    """(quantity, value): log likelihood, gradient and information (upper half) at given coefficients."""
    model, gradient, information = cox_at(df, duration, event, covariates, coefficients, strata)
    rows = [("log_likelihood", model.log_likelihood)]
    rows += [(f"gradient_{c}", float(g)) for c, g in zip(model.covariates, gradient)]
    rows += [
        (f"information_{a}_{b}", float(information[i, j]))
        for i, a in enumerate(model.covariates)
        for j, b in enumerate(model.covariates)
        if i <= j
    ]
    model.release()
    return df.sparkSession.createDataFrame(rows, "quantity string, value double")


def cox_fit(
    df: DataFrame,
    duration: str,
    event: str,
    covariates: Sequence[str],
    strata: Sequence[str] = (),
    max_iterations: int = 30,
    tolerance: float = 1e-9,
) -> CoxModel:
    """Newton-Raphson on the partial likelihood with Efron's handling of ties.

    Rows with a null in a used column take no part; the model and its summary
    tell their number, and whether the steps converged.
    """
    covariates, strata = list(covariates), list(strata)
    patterns, means, dropped = _folded(df, duration, event, covariates, strata)
    z = _centred(covariates, means)
    coefficients, most = np.zeros(len(covariates)), _most_tied(patterns, strata)
    value, gradient, information = _score(patterns, strata, z, coefficients, most)
    without, score_test = value, float(gradient @ np.linalg.solve(information, gradient))
    iteration, converged = 0, False
    for iteration in range(1, max_iterations + 1):
        step = np.linalg.solve(information, gradient)
        for _ in range(12):
            trial = _score(patterns, strata, z, coefficients + step, most)
            if trial[0] >= value - 1e-10 * abs(value):
                break
            step = step / 2
        else:
            break  # no length of this step improves the likelihood
        coefficients = coefficients + step
        change = abs(trial[0] - value)
        value, gradient, information = trial
        if change <= tolerance * max(1.0, abs(value)):
            converged = True
            break
    return CoxModel(
        covariates, strata, means, coefficients, np.linalg.inv(information), value, iteration, patterns, converged, dropped, without, score_test
    )


def cox_summary(model: CoxModel, z: float = 1.959963984540054) -> DataFrame:
    """Coefficients, hazard ratios, standard errors, p-values and intervals."""
    errors = np.sqrt(np.diag(model.variance))
    rows = [(c, float(b), float(e)) for c, b, e in zip(model.covariates, model.coefficients, errors)]
    frame = model.patterns.sparkSession.createDataFrame(rows, "covariate string, coef double, se_coef double")
    ratio = F.col("coef") / F.col("se_coef")
    return frame.withColumns(
        {
            "exp_coef": F.exp("coef"),
            "z": ratio,
            "p": chi_square_upper(ratio * ratio, 1),
            "coef_lower": F.col("coef") - z * F.col("se_coef"),
            "coef_upper": F.col("coef") + z * F.col("se_coef"),
            "converged": F.lit(model.converged),
            "dropped_rows": F.lit(model.dropped_rows).cast("long"),
        }
    )


def cox_baseline(model: CoxModel) -> DataFrame:
    """Baseline hazard of a subject with mean covariates, per stratum and duration."""
    hazard = F.col("_n") * F.exp(_linear(_centred(model.covariates, model.means), model.coefficients))
    by_day = model.patterns.groupBy(*model.strata, F.col("_duration").alias("duration")).agg(
        F.sum(F.when(F.col("_event") == 1, F.col("_n")).otherwise(0)).alias("events"), F.sum(hazard).alias("weight")
    )
    from_here = Window.partitionBy(*model.strata).orderBy(F.desc("duration"))
    so_far = Window.partitionBy(*model.strata).orderBy("duration")
    return (
        by_day.withColumn("baseline_hazard", F.col("events") / F.sum("weight").over(from_here))
        .withColumn("baseline_cumulative_hazard", F.sum("baseline_hazard").over(so_far))
        .withColumn("baseline_survival", F.exp(-F.col("baseline_cumulative_hazard")))
        .drop("events", "weight")
    )


def cox_predict(model: CoxModel, df: DataFrame, times: Sequence[int]) -> DataFrame:
    """Partial hazard of each row, with its cumulative hazard and survival at the given days.

    The baseline is read as a step function; strata never seen give nulls.
    """
    base = cox_baseline(model)
    steps = [
        F.struct(
            F.lit(int(t)).alias("time"),
            F.coalesce(
                F.max(F.when(F.col("duration") <= t, F.col("baseline_cumulative_hazard"))), F.lit(0.0)
            ).alias("h0"),
        )
        for t in times
    ]
    lookup = base.groupBy(*model.strata).agg(F.array(*steps).alias("_steps"))
    partial = F.exp(_linear(_centred(model.covariates, model.means), model.coefficients))
    scored = df.withColumn("partial_hazard", partial)
    if model.strata:
        scored = scored.join(lookup, model.strata, "left")
    else:
        scored = scored.withColumn("_steps", lookup.scalar())
    rows = scored.select(*df.columns, "partial_hazard", F.inline_outer("_steps"))
    total = F.col("h0") * F.col("partial_hazard")
    return rows.withColumns({"cumulative_hazard": total, "survival": F.exp(-total)}).drop("h0")


def cox_tests(model: CoxModel) -> DataFrame:
    """Likelihood-ratio, Wald and score test that all coefficients are zero: (test, statistic, degrees, p)."""
    b = model.coefficients
    rows = [
        ("likelihood_ratio", 2.0 * (model.log_likelihood - model.null_log_likelihood), len(b)),
        ("wald", float(b @ np.linalg.solve(model.variance, b)), len(b)),
        ("score", model.score_statistic, len(b)),
    ]
    frame = model.patterns.sparkSession.createDataFrame(rows, "test string, statistic double, degrees int")
    return frame.withColumn("p", chi_square_upper(F.col("statistic"), len(b)))


def _residual_table(model: CoxModel) -> DataFrame:
    """A row for each stratum and day with events: _d, and _r_<j>, the sum of its events' Schoenfeld residuals."""
    hazards = _hazards(model.patterns, model.strata, _centred(model.covariates, model.means), model.coefficients)
    table = risk_table(hazards, model.strata, len(model.covariates), _most_tied(model.patterns, model.strata)).filter("_d > 0")
    return table.select(*model.strata, "duration", "_d", *[(F.col(f"_x_{j}") - _expected(j)).alias(f"_r_{j}") for j in range(len(model.covariates))])


def schoenfeld_residuals(model: CoxModel) -> DataFrame:
    """Residuals by stratum, day and covariate: (.., duration, events, covariate, residual, scaled).

    ``residual`` is the sum over the day's events of the covariate less its mean in the
    risk set; ``scaled`` is their mean, scaled by the variance of the
    coefficients and the number of all events, plus the coefficient: an
    estimate of the coefficient at that day.
    """
    p, table = len(model.covariates), reused(_residual_table(model))
    total = table.agg(F.coalesce(F.sum("_d"), F.lit(0)).cast("double").alias("n")).scalar()
    parts = []
    for j, name in enumerate(model.covariates):
        scaled = _linear([F.col(f"_r_{k}") for k in range(p)], model.variance[j]) * total / F.col("_d") + F.lit(float(model.coefficients[j]))
        parts.append(F.struct(F.lit(name).alias("covariate"), F.col(f"_r_{j}").alias("residual"), scaled.alias("scaled")))
    return table.select(*model.strata, "duration", F.col("_d").alias("events"), F.inline(F.array(*parts)))


def residual_trend(residuals: DataFrame, width: int, span: int = 4) -> DataFrame:
    """Local line through scaled residuals over time: (covariate, time, events, estimate).

    Days are binned by ``width``; the line at the middle of a bin is fitted to the bins up to
    ``span`` away with tricube weights, from five sums for each bin. Null where the bins don't determine a line.
    """
    t, n = F.col("duration").cast("double"), F.col("events").cast("double")
    bins = residuals.groupBy("covariate", F.floor(F.col("duration") / width).alias("bin")).agg(
        F.sum(n).alias("n"), F.sum(n * t).alias("t"), F.sum(n * t * t).alias("tt"), F.sum(n * F.col("scaled")).alias("s"), F.sum(n * t * F.col("scaled")).alias("ts")
    )
    away = F.col("away").cast("double") / (span + 1)
    weight = F.pow(1.0 - F.pow(F.abs(away), F.lit(3.0)), F.lit(3.0))
    near = bins.withColumn("away", F.explode(F.sequence(F.lit(-span), F.lit(span)))).withColumn("at", F.col("bin") + F.col("away"))
    sums = near.groupBy("covariate", "at").agg(*[F.sum(weight * F.col(c)).alias(c) for c in ("n", "t", "tt", "s", "ts")], F.max(F.when(F.col("away") == 0, F.col("n"))).alias("events"))
    middle = (F.col("at") + 0.5) * width
    spread = F.col("tt") - F.col("t") * F.col("t") / F.col("n")
    # Below this the days of the bins are one day but for rounding.
    slope = F.when(spread > 1e-9 * F.col("tt"), (F.col("ts") - F.col("t") * F.col("s") / F.col("n")) / spread)
    line = F.col("s") / F.col("n") + slope * (middle - F.col("t") / F.col("n"))
    return sums.filter("events is not null").select("covariate", middle.alias("time"), "events", line.alias("estimate"))


def ph_assumption_test(model: CoxModel, threshold: float = 0.05, transform: str = "rank") -> DataFrame:
    """Per covariate: do scaled Schoenfeld residuals trend with time?

    ``transform`` is ``rank`` (mean rank of a day's events among all) or ``km`` (one less the
    survival of all subjects before the day).
    """
    p = len(model.covariates)
    days = model.patterns.groupBy(F.col("_duration").alias("duration")).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_event") == 1, F.col("_n")).otherwise(0)).alias("d"))
    so_far, from_here = Window.orderBy("duration"), Window.orderBy(F.desc("duration"))  # a row for each day of the log
    if transform == "rank":
        days = days.withColumn("g", F.sum("d").over(so_far) - (F.col("d") - 1) / 2.0)
    elif transform == "km":
        risk = days.withColumn("risk", F.sum("n").over(from_here))
        # Nobody has a day behind the one on which all that are left have the event.
        gone = F.sum(F.when(F.col("d") < F.col("risk"), F.log1p(-F.col("d") / F.col("risk"))))
        days = risk.withColumn("g", 1.0 - F.exp(F.coalesce(gone.over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    else:
        raise ValueError(f"transform is rank or km, not {transform}")
    table = _residual_table(model).join(days.select("duration", F.col("g").alias("_g")), "duration")
    sums = [F.sum("_d"), F.sum(F.col("_d") * F.col("_g")), F.sum(F.col("_d") * F.col("_g") * F.col("_g"))]
    sums += [F.sum(f"_r_{j}") for j in range(p)] + [F.sum(F.col("_g") * F.col(f"_r_{j}")) for j in range(p)]
    row = [float(v or 0.0) for v in table.agg(*[v.alias(f"v{i}") for i, v in enumerate(sums)]).first()]
    total, first, second = row[:3]
    mean = first / total if total else 0.0
    spread = second - total * mean * mean
    trend = np.array(row[3 + p :]) - mean * np.array(row[3 : 3 + p])
    with np.errstate(divide="ignore", invalid="ignore"):
        statistic = (total * trend @ model.variance) ** 2 / (total * np.diag(model.variance) * spread)
    rows = [(c, float(s)) for c, s in zip(model.covariates, statistic)]
    frame = model.patterns.sparkSession.createDataFrame(rows, "covariate string, statistic double")
    return frame.withColumn("p", chi_square_upper(F.col("statistic"), 1)).withColumn("violated", F.col("p") < threshold)


def coefficient(model: CoxModel, name: str) -> float:
    """The coefficient of a covariate, 0 for one the model does not have (a reference level)."""
    return float(dict(zip(model.covariates, model.coefficients)).get(name, 0.0))


def hazard_at(model: CoxModel, time: int, stratum: dict | None = None, **values) -> float:
    """Cumulative hazard at a day for one described subject; missing covariates are 0."""
    base = cox_baseline(model).filter(F.col("duration") <= time)
    for name, value in (stratum or {}).items():
        base = base.filter(F.col(name) == value)
    level = base.agg(F.max("baseline_cumulative_hazard")).first()[0] or 0.0
    x = np.array([float(values.get(c, 0.0)) for c in model.covariates])
    return level * math.exp(float((x - model.means) @ model.coefficients))
