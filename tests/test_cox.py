import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlife.operators import cox, parametric, survival


def sample(n=160, seed=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 3, n) / 2.0])
    g = rng.integers(0, 2, n)
    t = np.ceil(rng.exponential(12 / np.exp(x @ [0.7, -0.5] + 0.3 * g))).astype(int)
    e = (rng.random(n) < 0.8).astype(int)
    return t, e, x, g


def efron(t, e, x, g, b):
    """Log likelihood, gradient and information by direct loops over tied deaths."""
    p = len(b)
    value, grad, info = 0.0, np.zeros(p), np.zeros((p, p))
    for s in np.unique(g):
        for when in np.unique(t[(g == s) & (e == 1)]):
            risk = (g == s) & (t >= when)
            tied = (g == s) & (t == when) & (e == 1)
            r, d = np.exp(x[risk] @ b), np.exp(x[tied] @ b)
            value += float((x[tied] @ b).sum())
            for step in range(tied.sum()):
                a = step / tied.sum()
                s0 = r.sum() - a * d.sum()
                s1 = (x[risk] * r[:, None]).sum(0) - a * (x[tied] * d[:, None]).sum(0)
                s2 = np.einsum("i,ij,ik->jk", r, x[risk], x[risk]) - a * np.einsum("i,ij,ik->jk", d, x[tied], x[tied])
                value -= math.log(s0)
                grad -= s1 / s0
                info += s2 / s0 - np.outer(s1, s1) / s0**2
            grad += x[tied].sum(0)
    return value, grad, info


def direct_fit(t, e, x, g):
    b = np.zeros(x.shape[1])
    for _ in range(30):
        _, grad, info = efron(t, e, x, g, b)
        b = b + np.linalg.solve(info, grad)
    return b, efron(t, e, x, g, b)


@pytest.fixture(scope="module")
def fitted(spark):
    t, e, x, g = sample()
    rows = [(int(a), int(b), float(c), float(d), int(h)) for a, b, (c, d), h in zip(t, e, x, g)]
    frame = spark.createDataFrame(rows, "t int, e int, x1 double, x2 double, g int")
    return cox.cox_fit(frame, "t", "e", ["x1", "x2"], ["g"]), frame, (t, e, x, g)


def test_fit_equals_direct_newton(fitted):
    model, _, data = fitted
    b, (value, _, info) = direct_fit(*data)
    assert model.coefficients == pytest.approx(b, abs=1e-6)
    assert model.variance == pytest.approx(np.linalg.inv(info), rel=1e-5)
    assert model.log_likelihood == pytest.approx(value, abs=1e-6)


def test_fit_without_strata(spark, fitted):
    _, frame, (t, e, x, g) = fitted
    model = cox.cox_fit(frame, "t", "e", ["x1", "x2"])
    b, _ = direct_fit(t, e, x, np.zeros_like(g))
    assert model.coefficients == pytest.approx(b, abs=1e-6)
    assert cox.cox_predict(model, frame, [5]).count() == frame.count()


def test_summary_and_coefficient_lookup(fitted):
    model, _, _ = fitted
    rows = {r.covariate: r for r in cox.cox_summary(model).collect()}
    one = rows["x1"]
    assert one.exp_coef == pytest.approx(math.exp(one.coef)) and one.coef_lower < one.coef < one.coef_upper
    assert one.p == pytest.approx(math.erfc(abs(one.z) / math.sqrt(2)), rel=1e-5)
    assert cox.coefficient(model, "x1") == one.coef and cox.coefficient(model, "other") == 0.0


def test_baseline_and_prediction(fitted):
    model, frame, (t, e, x, g) = fitted
    hazard = np.exp((x - model.means) @ model.coefficients)
    base = {(r.g, r.duration): r for r in cox.cox_baseline(model).collect()}
    for s in (0, 1):
        total = 0.0
        for when in np.unique(t[g == s]):
            total += ((g == s) & (t == when) & (e == 1)).sum() / hazard[(g == s) & (t >= when)].sum()
            assert base[s, when].baseline_cumulative_hazard == pytest.approx(total)
    row = cox.cox_predict(model, frame.limit(1), [0, 9]).collect()
    assert row[0].cumulative_hazard == 0.0 and row[0].survival == 1.0
    level = max(r.baseline_cumulative_hazard for (s, d), r in base.items() if s == row[1].g and d <= 9)
    assert row[1].cumulative_hazard == pytest.approx(level * row[1].partial_hazard)
    assert row[1].survival == pytest.approx(math.exp(-row[1].cumulative_hazard))
    told = cox.hazard_at(model, 9, {"g": row[1].g}, x1=row[1].x1, x2=row[1].x2)
    assert told == pytest.approx(row[1].cumulative_hazard)


def test_proportional_data_pass_and_crossing_hazards_fail(spark, fitted):
    model, _, _ = fitted
    assert not any(r.violated for r in cox.ph_assumption_test(model, threshold=0.001).collect())
    rng = np.random.default_rng(0)
    late = [(int(v), 1, 1.0) for v in 20 + rng.integers(0, 4, 150)]
    spread = [(int(v), 1, 0.0) for v in rng.integers(1, 60, 150)]
    crossing = cox.cox_fit(spark.createDataFrame(late + spread, "t int, e int, x double"), "t", "e", ["x"])
    assert cox.ph_assumption_test(crossing).first().violated


def test_ties_agree_with_plain_sums(spark):
    rows = [(risk, risk * tied, count) for risk in (5.0, 1e8) for tied in (1e-7, 0.2, 0.2501, 0.9, 0.9999, 1.0) for count in (1, 64, 65, 1000, 300_000)]
    frame = spark.createDataFrame(rows, "risk double, tied double, n int")
    for risk, tied, count, found in frame.select("*", cox.tie_sums(F.col("risk"), F.col("tied"), F.col("n")).alias("s")).collect():
        a = np.arange(count, dtype=np.longdouble) / count
        f = risk - a * np.longdouble(tied)
        plain = np.array([np.log(f), 1 / f, a / f, 1 / f**2, a / f**2, a**2 / f**2]).sum(axis=1).astype(float)
        assert [found[n] for n in cox.TIES] == pytest.approx(plain, rel=1e-11, abs=0), (risk, tied, count)


def test_two_rows_are_collected_for_a_thousand_strata(spark, monkeypatch):
    """What a likelihood needs of Spark doesn't grow with the strata."""
    rng = np.random.default_rng(8)
    g = np.arange(4000) % 1000
    x = rng.integers(0, 3, (4000, 1)) / 2.0
    t, e = rng.integers(1, 9, 4000), (rng.random(4000) < 0.7).astype(int)
    rows = [(int(a), int(b), float(c[0]), int(d)) for a, b, c, d in zip(t, e, x, g)]
    frame = spark.createDataFrame(rows, "t int, e int, x double, g int")
    taken = []
    for name in ("collect", "toPandas", "first"):
        whole = getattr(type(frame), name)
        monkeypatch.setattr(type(frame), name, lambda self, whole=whole, name=name: taken.append(self.count() if name != "first" else 1) or whole(self))
    model, gradient, information = cox.cox_at(frame, "t", "e", ["x"], [0.3], ["g"])
    monkeypatch.undo()
    assert max(taken) <= 2
    value, grad, info = efron(t, e, x - x.mean(0), g, [0.3])
    assert (model.log_likelihood, gradient[0], information[0, 0]) == pytest.approx((value, grad[0], info[0, 0]))


def test_global_tests_and_gamma_tails(spark, fitted):
    model, _, data = fitted
    value0, grad0, info0 = efron(*data, np.zeros(2))
    rows = {r.test: r for r in cox.cox_tests(model).collect()}
    assert rows["likelihood_ratio"].statistic == pytest.approx(2 * (model.log_likelihood - value0), rel=1e-6)
    assert rows["score"].statistic == pytest.approx(grad0 @ np.linalg.solve(info0, grad0))
    assert rows["wald"].statistic == pytest.approx(model.coefficients @ np.linalg.inv(model.variance) @ model.coefficients)
    assert all(r.p == pytest.approx(math.exp(-r.statistic / 2), rel=1e-10) for r in rows.values())
    values = [0.0, 1e-6, 0.3, 1.9, 2.1, 7.0, 25.0, 60.0, 400.0]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    found = frame.select("x", *[survival.chi_square_upper(F.col("x"), k).alias(f"q{k}") for k in (1, 2, 12)]).collect()
    assert list(found[-1]) == [None] * 4
    for x, q1, q2, q12 in found[:-1]:
        assert q1 == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9, abs=1e-15)
        assert q2 == pytest.approx(math.exp(-x / 2), rel=1e-10)
        assert q12 == pytest.approx(math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(6)), rel=1e-9, abs=1e-15)


def test_residuals_equal_direct_loops(fitted):
    model, frame, (t, e, x, g) = fitted
    b, z = model.coefficients, x - model.means
    want = {}
    for s in np.unique(g):
        for when in np.unique(t[(g == s) & (e == 1)]):
            risk, tied = (g == s) & (t >= when), (g == s) & (t == when) & (e == 1)
            r, d = np.exp(z[risk] @ b), np.exp(z[tied] @ b)
            total = z[tied].sum(0)
            for step in range(tied.sum()):
                a = step / tied.sum()
                total = total - ((z[risk] * r[:, None]).sum(0) - a * (z[tied] * d[:, None]).sum(0)) / (r.sum() - a * d.sum())
            want[int(s), int(when)] = tied.sum(), total
    n = sum(d for d, _ in want.values())
    found = cox.schoenfeld_residuals(model)
    rows = {(r.g, r.duration, r.covariate): r for r in found.collect()}
    assert len(rows) == 2 * len(want)
    for (s, when), (d, total) in want.items():
        scaled = n * model.variance @ total / d + b
        for j, name in enumerate(("x1", "x2")):
            r = rows[s, when, name]
            assert (r.events, r.residual, r.scaled) == pytest.approx((d, total[j], scaled[j]), abs=1e-8)
    # The trend of residuals that lie on a line is that line.
    line = found.withColumn("scaled", 2.0 + 0.25 * F.col("duration"))
    for r in cox.residual_trend(line, 3, 2).filter("estimate is not null").collect():
        assert r.estimate == pytest.approx(2.0 + 0.25 * r.time)
    assert not any(r.violated for r in cox.ph_assumption_test(model, 0.001, "km").collect())


def test_rows_with_nulls_are_told(spark):
    rows = [(1 + i % 9, i % 2, float(i % 5)) for i in range(60)] + [(3, 1, None), (None, 1, 1.0)]
    model = cox.cox_fit(spark.createDataFrame(rows, "t int, e int, x double"), "t", "e", ["x"])
    told = cox.cox_summary(model).first()
    assert told.dropped_rows == 2 and told.converged
    model.release()


def test_log_tail_of_long_durations():
    assert parametric._log_erfc([5.0, 9.999, 10.001, 40.0]) == pytest.approx([-27.2008895455, -102.85979700, -102.89998904, -1604.2615567], rel=1e-6)


def test_parametric_fits(spark):
    rng = np.random.default_rng(9)
    t = np.ceil(20 * rng.weibull(1.6, 4000)).astype(int)
    rows = [(int(min(v, 40)), int(v <= 40)) for v in t]
    frame = spark.createDataFrame(rows, "t int, e int")
    fits = parametric.parametric_survival(frame, "t", "e").collect()
    aic = {r.distribution: r.aic for r in fits}
    assert min(aic, key=aic.get) == "weibull" and {r.distribution for r in fits if r.lowest_aic} == {"weibull"}
    closed = parametric.exponential_fit(frame, "t", "e").first()
    numeric = next(r for r in fits if r.distribution == "exponential")
    assert numeric.estimate == pytest.approx(closed.lambda_, rel=1e-5) and numeric.aic == pytest.approx(closed.aic)
    # Each fit is a maximum: nudging any parameter lowers the likelihood.
    days = np.array([r[0] for r in rows], float)
    died = np.array([r[1] for r in rows]) == 1
    for name, (parts, names) in parametric.DISTRIBUTIONS.items():
        best = [next(r.estimate for r in fits if (r.distribution, r.parameter) == (name, n)) for n in names]

        def likelihood(values):
            density, tail = parts(days, *values)
            return np.where(died, density, tail).sum()

        top = likelihood(best)
        assert top == pytest.approx(next(r.log_likelihood for r in fits if r.distribution == name))
        for i in range(len(best)):
            for factor in (0.98, 1.02):
                nudged = list(best)
                nudged[i] *= factor
                assert likelihood(nudged) < top


def test_aft_direction(spark):
    rng = np.random.default_rng(3)
    rows = [(int(np.ceil(10 * math.exp(0.8 * x) * rng.weibull(1.5))), 1, float(x)) for x in rng.integers(0, 2, 500)]
    frame = spark.createDataFrame(rows, "t int, e int, x double")
    model = parametric.aft_regression(frame, "t", "e", ["x"])
    found = {r.parameter: r.estimate for r in parametric.aft_summary(spark, model, ["x"]).collect()}
    assert found["x"] == pytest.approx(0.8, abs=0.2)


def _errors(distribution, z, died):
    if distribution == "weibull":
        return z - math.exp(z) if died else -math.exp(z)
    if distribution == "log_logistic":
        return z - 2 * math.log1p(math.exp(z)) if died else -math.log1p(math.exp(z))
    return -z * z / 2 - math.log(2 * math.pi) / 2 if died else math.log(math.erfc(z / math.sqrt(2)) / 2)


@pytest.mark.parametrize("distribution", ["weibull", "log_logistic", "log_normal"])
def test_aft_likelihood_gradient_and_fit(spark, distribution):
    rng = np.random.default_rng(12)
    draw = {"weibull": lambda n: np.log(rng.exponential(1, n)), "log_logistic": lambda n: rng.logistic(0, 1, n), "log_normal": lambda n: rng.normal(0, 1, n)}[distribution]
    x = np.column_stack([rng.integers(0, 2, 900), rng.integers(0, 4, 900)])
    t = np.ceil(np.exp(3.5 + x @ [0.6, -0.3] + 0.5 * draw(900))).astype(int)
    stop = rng.integers(10, 90, 900)
    rows = [(int(min(a, c)), int(a <= c), float(u), float(v)) for a, c, (u, v) in zip(t, stop, x)]
    frame = spark.createDataFrame(rows + [(0, 1, 1.0, 1.0), (4, 1, None, 1.0), (None, 1, 0.0, 0.0)], "t int, e int, x1 double, x2 double")

    def likelihood(at):
        total = 0.0
        for d, e, u, v in rows:
            z = (math.log(d) - at[0] - at[1] * u - at[2] * v) / math.exp(at[3])
            total += _errors(distribution, z, e) - (at[3] + math.log(d) if e else 0.0)
        return total

    at = np.array([2.6, 0.4, -0.2, math.log(0.7)])
    found = {r.quantity: r.value for r in parametric.aft_likelihood(frame, "t", "e", ["x1", "x2"], distribution, at[:3], 0.7).collect()}
    assert found["log_likelihood"] == pytest.approx(likelihood(at), rel=1e-10)
    gradient, hessian = parametric._derivatives(likelihood, at)
    names = ["intercept", "x1", "x2", "log_scale"]
    assert [found[f"gradient_{n}"] for n in names] == pytest.approx(list(gradient), rel=1e-5, abs=1e-4)
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            assert found[f"information_{a}_{b}"] == pytest.approx(-hessian[i, j], rel=1e-3, abs=2e-2)
    model = parametric.aft_fit(frame, "t", "e", ["x1", "x2"], distribution)
    assert model.converged and model.dropped_rows == 3
    best = [*model.coefficients, model.log_scale]
    assert parametric._derivatives(likelihood, np.array(best))[0] == pytest.approx(np.zeros(4), abs=1e-2)
    table = {r.parameter: r for r in parametric.aft_fit_summary(spark, model).collect()}
    errors = np.sqrt(np.diag(np.linalg.inv(-parametric._derivatives(likelihood, np.array(best))[1])))
    assert [table[n].se for n in names] == pytest.approx(list(errors), rel=1e-3)
    assert abs(table["x1"].estimate - 0.6) < 0.15 and table["x1"].p < 1e-6
    seen = parametric.aft_predict(model, frame.limit(5), [7, 30]).collect()
    for r in seen:
        z = (math.log(7) - model.coefficients @ [1, r.x1, r.x2]) / math.exp(model.log_scale)
        assert r.survival_at_7 == pytest.approx(math.exp(_errors(distribution, z, False))) and r.survival_at_30 < r.survival_at_7


def test_normal_tail_far_out(spark):
    z = [-30.0, -5.0, -1.0, 0.0, 2.0, 4.999, 5.001, 12.0, 40.0]
    frame = spark.createDataFrame([(v,) for v in z], "z double")
    for v, log_tail, mills in frame.select("z", *[c.alias(n) for c, n in zip(parametric.normal_tail(F.col("z")), "lm")]).collect():
        want = math.log(0.5) + float(parametric._log_erfc(v / math.sqrt(2)))
        assert log_tail == pytest.approx(want, rel=1e-9, abs=1e-15)
        assert mills == pytest.approx(math.exp(-v * v / 2 - math.log(2 * math.pi) / 2 - want), rel=1e-8)
