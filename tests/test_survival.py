import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlife.operators import states, survival


def subjects(spark, rows):
    return spark.createDataFrame(rows, "t int, e int")


def curve(spark, rows):
    return {r.duration: r for r in survival.kaplan_meier(subjects(spark, rows), "t", "e").collect()}


def test_known_curve(spark):
    found = curve(spark, [(1, 1), (2, 1), (2, 0), (3, 1), (5, 0)])
    assert [found[d].at_risk for d in (1, 2, 3, 5)] == [5, 4, 2, 1]
    assert [found[d].survival for d in (1, 2, 3, 5)] == pytest.approx([0.8, 0.6, 0.3, 0.3])
    greenwood = 1 / 20 + 1 / 12
    half = 1.959963984540054 * math.sqrt(greenwood) / math.log(0.6)
    assert found[2].ci_lower == pytest.approx(0.6 ** math.exp(-half))
    assert found[2].ci_upper == pytest.approx(0.6 ** math.exp(half))
    assert found[3].cumulative_density == pytest.approx(0.7)


def test_last_subjects_all_having_the_event_end_at_zero(spark):
    found = curve(spark, [(1, 0), (2, 1), (3, 1), (3, 1)])
    assert found[3].survival == 0.0 and found[3].ci_lower is None
    points = survival.survival_points(survival.kaplan_meier(subjects(spark, [(4, 1)]), "t", "e"), [3, 4]).first()
    assert (points.median_survival, points.survival_at_3, points.survival_at_4) == (4, 1.0, 0.0)


def test_all_censored_has_no_median(spark):
    found = survival.kaplan_meier(subjects(spark, [(3, 0), (9, 0)]), "t", "e")
    assert {r.survival for r in found.collect()} == {1.0}
    assert survival.survival_points(found).first().median_survival is None


def test_curve_never_rises_and_matches_products(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1, 40), int(rng.random() < 0.6)) for _ in range(400)]
    found = curve(spark, rows)
    level = 1.0
    for t in sorted(found):
        risk = sum(1 for d, _ in rows if d >= t)
        died = sum(1 for d, e in rows if d == t and e)
        level *= 1 - died / risk
        assert found[t].survival == pytest.approx(level) and found[t].at_risk == risk
    assert all(found[a].survival >= found[b].survival for a, b in itertools.pairwise(sorted(found)))


def test_concordance_counts_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(1, 12), int(rng.random() < 0.7), rng.choice([rng.randrange(-4, 9) / 4, rng.random() * 1e-9])) for _ in range(120)]
    frame = spark.createDataFrame(rows, "t int, e int, s double")
    up = down = level = 0
    for (ta, ea, sa), (tb, eb, sb) in itertools.permutations(rows, 2):
        if ea and (tb > ta or (tb == ta and not eb)):
            up, down, level = up + (sb > sa), down + (sb < sa), level + (sb == sa)
    row = survival.concordance_index(frame, "t", "e", "s").first()
    assert (row.concordant, row.discordant, row.tied) == (up, down, level)
    assert row.concordance_index == pytest.approx((up + level / 2) / (up + down + level))
    same = survival.concordance_index(frame.selectExpr("t", "e", "1.0 AS s"), "t", "e", "s").first()
    assert same.concordance_index == 0.5


def test_scores_with_censoring(spark):
    frame = spark.createDataFrame([(5, 1, 0.5, 3.0), (9, 0, 0.5, 3.0), (9, 0, 0.5, 20.0), (2, 0, 0.5, 1.0)], "t int, e int, s double, p double")
    brier = survival.brier_score(frame, "t", "e", "s", 6).first()
    assert (brier.subjects, brier.brier_score) == (3, 0.25)
    assert survival.censored_mae(frame, "t", "e", "p").first().censored_mae == pytest.approx((2 + 6 + 0 + 1) / 4)


def test_logrank_pair(spark):
    rows = [(1, 1, "a"), (3, 1, "a"), (4, 0, "a"), (2, 1, "b"), (3, 1, "b"), (6, 1, "b")]
    test = survival.logrank_pairs(spark.createDataFrame(rows, "t int, e int, g string"), "t", "e", "g").first()
    difference = variance = 0.0
    for t in sorted({r[0] for r in rows if r[1]}):
        ra, rb = (sum(1 for d, _, g in rows if d >= t and g == x) for x in "ab")
        da, db = (sum(1 for d, e, g in rows if d == t and e and g == x) for x in "ab")
        n, d = ra + rb, da + db
        difference += da - d * ra / n
        variance += ra * rb * d * (n - d) / (n * n * (n - 1)) if n > 1 else 0
    statistic = difference**2 / variance
    assert test.statistic == pytest.approx(statistic)
    assert test.p_value == pytest.approx(math.erfc(math.sqrt(statistic / 2)), rel=1e-6)


def test_life_table_intervals(spark):
    rows = {r.interval_start: r for r in survival.life_table(subjects(spark, [(1, 1), (9, 1), (10, 0), (25, 1)]), "t", "e", 10).collect()}
    assert {k: (r.events, r.at_risk) for k, r in rows.items()} == {0: (2, 4), 10: (0, 2), 20: (1, 1)}
    assert rows[20].cumulative_hazard == pytest.approx(1.5)


def test_dummies(spark):
    frame = spark.createDataFrame([("b", 10), ("a", 2), (None, 10)], "c string, n int")
    rows = survival.dummies(frame, ["c", "n"])
    assert rows.columns == ["c_b", "n_10"]
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 0), (0, 1), (1, 1)]
    told = survival.dummies(frame, ["c"], drop_first=False, values={"c": ["a", "z"]})
    assert sorted(tuple(r) for r in told.select("c_a", "c_z").collect()) == [(0, 0), (0, 0), (1, 0)]
    long = survival.long_dummies(frame.withColumn("key", F.monotonically_increasing_id()), ["key"], ["c", "n"])
    assert sorted((r["column"], r["value"]) for r in long.collect()) == [("c", "a"), ("c", "b"), ("n", "10"), ("n", "10"), ("n", "2")]


def test_logrank_of_sixty_groups(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(1, 15), int(rng.random() < 0.7), rng.randrange(60)) for _ in range(1500)]
    found = {(r.group_a, r.group_b): r for r in survival.logrank_pairs(spark.createDataFrame(rows, "t int, e int, g int"), "t", "e", "g").collect()}
    assert len(found) == 60 * 59 // 2
    for a, b in [(0, 1), (3, 59), (20, 41)]:
        diff = var = 0.0
        for day in sorted({t for t, e, g in rows if e and g in (a, b)}):
            na, nb = (sum(t >= day for t, _, g in rows if g == x) for x in (a, b))
            da, db = (sum(t == day and e for t, e, g in rows if g == x) for x in (a, b))
            n, d = na + nb, da + db
            diff += da - d * na / n
            var += na * nb * d * (n - d) / (n * n * (n - 1)) if n > 1 else 0.0
        assert found[a, b].statistic == pytest.approx(diff * diff / var)
    for r in found.values():
        assert r.p_value == pytest.approx(math.erfc(math.sqrt(r.statistic / 2)), rel=1e-6)


def test_data_set(make):
    days = ["2021-10-01", "2021-10-02", "2021-10-03", "2021-11-01", "2021-11-08", "2022-03-01"]
    trades = [(1, d) for d in days] + [(2, d) for d in days[:4]] + [(3, d) for d in days[1:4]]
    daily = states.daily_summary(make.trades(trades), {})
    kyc = make.kyc([{"party_code": 1, "B2C": "Y", "gender": "f", "City": "PUNE"}])
    rows = survival.survival_dataset(daily, kyc, make.tiers([("Pune", "Tier-I")]), days=["2021-11-01"]).collect()
    by = {r.party_code: r for r in rows}
    assert sorted(by) == [1, 2]  # party 3 has three trade days only
    assert (by[1].tenure, by[1].target, by[1].Tier, by[1].gender_f) == (7, 1, "Tier-I", 1)
    assert (by[2].tenure, by[2].target, by[2].occupation, by[2].Tier) == (100, 0, "no_data", "Tier-III")
    every = survival.survival_dataset(daily, kyc, make.tiers([("Pune", "Tier-I")])).collect()
    late = next(r for r in every if str(r.sauda_date) == "2021-11-08")
    assert (late.tenure, late.target) == (113, 0)  # an observed gap above the limit keeps its length


def test_durations_must_be_whole_days(spark):
    with pytest.raises(TypeError):
        survival.kaplan_meier(spark.createDataFrame([(1.5, 1)], "t double, e int"), "t", "e")


def _weights(t, e):
    """Chance of being uncensored, as (at a day, just before it), by direct product."""
    def at(day, strict):
        value = 1.0
        for u in sorted(set(t)):
            if u < day or (u == day and not strict):
                risk = sum(v >= u for v in t)
                value *= 1 - sum(v == u and not d for v, d in zip(t, e)) / risk
        return value

    return at


def _censored_sample(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        risk = rng.choice([0.0, 0.5, 1.0, 2.0, rng.random()])
        t, c = 1 + int(rng.expovariate(0.1) / (1 + risk)), 1 + int(rng.expovariate(0.06))
        rows.append((min(t, c), int(t <= c), risk))
    return rows


def test_brier_scores_with_censoring_weights(spark):
    rows = _censored_sample(4)
    t, e = [r[0] for r in rows], [r[1] for r in rows]
    frame = spark.createDataFrame(rows, "t int, e int, risk double").withColumns({f"s{d}": F.exp(-0.05 * d * (1 + F.col("risk"))) for d in (2, 6, 11)})
    found = survival.brier_scores(frame, "t", "e", {2: "s2", 6: "s6", 11: "s11"})
    free = _weights(t, e)
    want = {}
    for day in (2, 6, 11):
        total = 0.0
        for u, died, risk in rows:
            s = math.exp(-0.05 * day * (1 + risk))
            if u <= day and died:
                total += s**2 / free(u, True)
            elif u > day:
                total += (1 - s) ** 2 / free(day, False)
        want[day] = total / len(rows)
    got = {r.day: r.brier_score for r in found.collect()}
    assert got == pytest.approx(want)
    assert survival.integrated(found, "day", "brier_score").first()[0] == pytest.approx((4 * (want[2] + want[6]) / 2 + 5 * (want[6] + want[11]) / 2) / 9)
    # Without censoring it is the plain score.
    known = frame.withColumn("e", F.lit(1))
    plain = survival.brier_score(known, "t", "e", "s6", 6).first().brier_score
    assert survival.brier_scores(known, "t", "e", {6: "s6"}).first().brier_score == pytest.approx(plain)


def test_auc_over_time_with_ties(spark):
    rows = _censored_sample(8) + [(5, 1, None)]
    frame = spark.createDataFrame(rows, "t int, e int, risk double")
    rows = [r for r in rows if r[2] is not None]
    free = _weights([r[0] for r in rows], [r[1] for r in rows])
    days = [1, 3, 8, 15, 10_000]
    found = {r.day: r for r in survival.auc_over_time(frame, "t", "e", "risk", days).collect()}
    areas = {}
    for day in days:
        cases = [(r, 1 / free(u, True)) for u, died, r in rows if u <= day and died]
        controls = [r for u, _, r in rows if u > day]
        assert (found[day].cases, found[day].controls) == pytest.approx((sum(w for _, w in cases), len(controls)))
        won = sum(w * ((r > c) + 0.5 * (r == c)) for r, w in cases for c in controls)
        areas[day] = won / (sum(w for _, w in cases) * len(controls)) if cases and controls else None
        assert found[day].auc == (None if areas[day] is None else pytest.approx(areas[day]))
    curve = survival.kaplan_meier(frame, "t", "e")
    level = {r.duration: r.survival for r in curve.collect()}
    at = [1.0] + [level[max(d for d in level if d <= day)] if min(level) <= day else 1.0 for day in days]
    lost = [(a - b, areas[day]) for a, b, day in zip(at, at[1:], days) if areas[day] is not None]
    mean = survival.mean_auc(survival.auc_over_time(frame, "t", "e", "risk", days), curve).first()[0]
    assert mean == pytest.approx(sum(w * a for w, a in lost) / sum(w for w, _ in lost))


def test_late_entry_counts_those_who_are_there(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 12), int(rng.random() < 0.6), rng.choice([None, 0, 0, 2, 5, 9, 12])) for _ in range(300)]
    frame = spark.createDataFrame(rows, "t int, e int, start int")
    seen = [(t, e, -1 if s is None else s) for t, e, s in rows if s is None or s < t]
    found = {r.duration: r for r in survival.kaplan_meier(frame, "t", "e", entry="start").collect()}
    assert set(found) == {t for t, _, _ in seen}
    level = 1.0
    for day in sorted(found):
        risk = sum(s < day <= t for t, _, s in seen)
        died = sum(t == day and e for t, e, _ in seen)
        level *= 1 - died / risk
        assert (found[day].at_risk, found[day].events, found[day].survival) == (risk, died, pytest.approx(level))
    # Without late entries the curve is the usual one.
    plain = survival.kaplan_meier(frame, "t", "e")
    assert survival.kaplan_meier(frame.withColumn("start", F.lit(0)), "t", "e", entry="start").exceptAll(plain).isEmpty()
