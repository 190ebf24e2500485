"""Survival queries on the gaps between a frequent party's trade days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlife.operators import base, survival
from ledgerlife.plans.registry import query
from ledgerlife.plans.stages import daily
from ledgerlife.sources.sample_tables import with_tables

_LABEL = "average_gap_last_four_trades_label"
_SURV = f"""leads AS (
      SELECT party_code, sauda_date, {_LABEL},
             date_diff('day', sauda_date, lead(sauda_date) OVER (PARTITION BY party_code ORDER BY sauda_date)) AS gap
      FROM daily_summary WHERE cumulative_trade_days > 3),
    surv AS (
      SELECT party_code, sauda_date, CAST(coalesce(gap, {{unseen}}) AS INTEGER) AS tenure,
             CASE WHEN gap <= {{limit}} THEN 1 ELSE 0 END AS target,
             CASE {_LABEL} WHEN 'Week' THEN 7 WHEN 'TwoWeeks' THEN 15 WHEN 'Month' THEN 30 WHEN 'Quarter' THEN 90
                  ELSE 100 END AS {_LABEL}_new
      FROM leads)"""
_SHORT = _SURV.format(limit=90, unseen=100)
_LONG = _SURV.format(limit=365, unseen=400)


def subjects(t):
    return survival.survival_dataset(daily(t), t.kyc, t.tiers)


def long_subjects(t):
    """The same with limits that fit the sample log's gaps of some months."""
    return survival.survival_dataset(daily(t), t.kyc, t.tiers, limit=365, unseen=400)


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in columns})


_PERSON = """
    SELECT s.*, coalesce(occupation, 'no_data') AS occupation, coalesce(c.Tier, 'Tier-III') AS Tier,
           CASE incomedetails WHEN 'BELOW 1 LAC' THEN 1 WHEN '1-5 LAC' THEN 2 WHEN '5-10 LAC' THEN 3
                WHEN '10-25 LAC' THEN 4 WHEN '>25 LAC' THEN 5 ELSE 0 END AS new_incomedetails,
           CASE WHEN gender IN ('F', 'f') THEN 1 ELSE 0 END AS gender_f,
           CASE riskcategory WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS riskcategory_new
    FROM surv s LEFT JOIN client_kyc k USING (party_code)
    LEFT JOIN city_tier c ON upper(substr(k.City, 1, 1)) || lower(substr(k.City, 2)) = c.City"""


@query("survival_dataset", with_tables("order_log kyc tiers daily", _SHORT + _PERSON))
def survival_dataset(t):
    return subjects(t)


@query(
    "survival_dataset_one_day",
    with_tables("order_log kyc tiers daily", _SHORT + _PERSON + " WHERE s.sauda_date = DATE '1999-03-01'"),
)
def survival_dataset_one_day(t):
    return survival.survival_dataset(daily(t), t.kyc, t.tiers, days=["1999-03-01"])


_RISK = """,
    hist AS (SELECT {by} tenure AS duration, count(*) FILTER (target = 1) AS events, count(*) AS subjects
             FROM surv GROUP BY ALL),
    risk AS (SELECT {by} duration, events, subjects - events AS censored,
                    CAST(sum(subjects) OVER ({part} ORDER BY duration DESC) AS BIGINT) AS at_risk FROM hist)"""
_KM = """,
    curve AS (
      SELECT *, product(1.0 - events::DOUBLE / at_risk) OVER ({part} ORDER BY duration) AS s,
             sum(CASE WHEN events < at_risk THEN events::DOUBLE / (at_risk::DOUBLE * (at_risk - events)) ELSE 0 END)
               OVER ({part} ORDER BY duration) AS v FROM risk)
    SELECT {by} duration, at_risk, events, censored, round(s + 1e-9, 6) AS survival,
           round(CASE WHEN s <= 1e-12 THEN NULL WHEN v = 0 THEN 1.0
                 ELSE pow(s, exp(-1.959963984540054 * sqrt(v) / ln(s))) END + 1e-9, 6) AS ci_lower,
           round(CASE WHEN s <= 1e-12 THEN NULL WHEN v = 0 THEN 1.0
                 ELSE pow(s, exp(1.959963984540054 * sqrt(v) / ln(s))) END + 1e-9, 6) AS ci_upper,
           round(1.0 - s + 1e-9, 6) AS cumulative_density FROM curve"""
_CURVE = ["survival", "ci_lower", "ci_upper", "cumulative_density"]


@query("kaplan_meier", with_tables("order_log daily", _LONG + _RISK.format(by="", part="") + _KM.format(by="", part="")))
def kaplan_meier(t):
    return _round(survival.kaplan_meier(long_subjects(t), "tenure", "target"), 6, *_CURVE)


@query(
    "kaplan_meier_late_entry",
    with_tables(
        "order_log daily",
        _LONG + """,
        seen AS (SELECT tenure, target, (party_code % 7) * 20 AS entry FROM surv WHERE (party_code % 7) * 20 < tenure),
        risk AS (
          SELECT tenure AS duration, count(*) FILTER (target = 1) AS events, count(*) FILTER (target = 0) AS censored,
                 (SELECT count(*) FROM seen s WHERE s.entry < seen.tenure AND s.tenure >= seen.tenure) AS at_risk
          FROM seen GROUP BY tenure)""" + _KM.format(by="", part=""),
    ),
)
def kaplan_meier_late_entry(t):
    """The curve of subjects that are watched only from a day of their own on."""
    rows = long_subjects(t).withColumn("entry", (F.col("party_code") % 7 * 20).cast("int"))
    return _round(survival.kaplan_meier(rows, "tenure", "target", entry="entry"), 6, *_CURVE)


_BY, _PART = f"{_LABEL}_new,", f"PARTITION BY {_LABEL}_new"


@query(
    "kaplan_meier_by_label",
    with_tables("order_log daily", _SHORT + _RISK.format(by=_BY, part=_PART) + _KM.format(by=_BY, part=_PART)),
)
def kaplan_meier_by_label(t):
    return _round(survival.kaplan_meier(subjects(t), "tenure", "target", [f"{_LABEL}_new"]), 6, *_CURVE)


@query(
    "survival_points",
    with_tables(
        "order_log daily",
        _LONG + _RISK.format(by="", part="") + """,
        curve AS (SELECT duration, product(1.0 - events::DOUBLE / at_risk) OVER (ORDER BY duration) AS s FROM risk)
        SELECT min(duration) FILTER (s <= 0.5 + 1e-12) AS median_survival,
               round(coalesce(arg_max(s, duration) FILTER (duration <= 7), 1.0) + 1e-9, 6) AS survival_at_7,
               round(coalesce(arg_max(s, duration) FILTER (duration <= 15), 1.0) + 1e-9, 6) AS survival_at_15,
               round(coalesce(arg_max(s, duration) FILTER (duration <= 30), 1.0) + 1e-9, 6) AS survival_at_30,
               round(coalesce(arg_max(s, duration) FILTER (duration <= 90), 1.0) + 1e-9, 6) AS survival_at_90
        FROM curve""",
    ),
)
def survival_points(t):
    points = survival.survival_points(survival.kaplan_meier(long_subjects(t), "tenure", "target"))
    return _round(points, 6, *[c for c in points.columns if c != "median_survival"])


_HAZARD = """
    SELECT {by} duration AS {name}, events, censored, at_risk, round(events::DOUBLE / at_risk + 1e-9, 6) AS hazard,
           round(sum(events::DOUBLE / at_risk) OVER ({part} ORDER BY duration) + 1e-9, 6) AS cumulative_hazard
    FROM risk"""


@query(
    "nelson_aalen",
    with_tables(
        "order_log daily",
        _LONG + _RISK.format(by="", part="") + _HAZARD.format(by="", part="", name="duration"),
    ),
)
def nelson_aalen(t):
    return _round(
        survival.nelson_aalen(long_subjects(t), "tenure", "target"), 6, "hazard", "cumulative_hazard"
    )


@query(
    "life_table",
    with_tables(
        "order_log daily",
        _LONG
        + _RISK.format(by="", part="").replace("tenure AS", "CAST(floor(tenure / 30) * 30 AS INTEGER) AS")
        + _HAZARD.format(by="", part="", name="interval_start"),
    ),
)
def life_table(t):
    return _round(survival.life_table(long_subjects(t), "tenure", "target", 30), 6, "hazard", "cumulative_hazard")


#: Tail of the chi-square distribution at one degree of freedom, by a published rational fit.
_TAIL = """1.0 / (1.0 + 0.5 * root) * exp(-1.26551223 - root * root + 1.0 / (1.0 + 0.5 * root) * (1.00002368
             + 1.0 / (1.0 + 0.5 * root) * (0.37409196 + 1.0 / (1.0 + 0.5 * root) * (0.09678418
             + 1.0 / (1.0 + 0.5 * root) * (-0.18628806 + 1.0 / (1.0 + 0.5 * root) * (0.27886807
             + 1.0 / (1.0 + 0.5 * root) * (-1.13520398 + 1.0 / (1.0 + 0.5 * root) * (1.48851587
             + 1.0 / (1.0 + 0.5 * root) * (-0.82215223 + 1.0 / (1.0 + 0.5 * root) * 0.17087277)))))))))"""


@query(
    "logrank_pairs",
    with_tables(
        "order_log daily",
        _LONG + f""",
        labelled AS (SELECT tenure AS t, target AS e, {_LABEL}_new AS g FROM surv),
        pairs AS (SELECT a.g AS group_a, b.g AS group_b FROM (SELECT DISTINCT g FROM labelled) a
                  JOIN (SELECT DISTINCT g FROM labelled) b ON a.g < b.g),
        times AS (SELECT DISTINCT group_a, group_b, t FROM pairs JOIN labelled ON g IN (group_a, group_b)),
        counts AS (
          SELECT times.*, (SELECT count(*) FROM labelled WHERE g = group_a AND labelled.t >= times.t) AS na,
                 (SELECT count(*) FROM labelled WHERE g = group_b AND labelled.t >= times.t) AS nb,
                 (SELECT count(*) FROM labelled WHERE g = group_a AND labelled.t = times.t AND e = 1) AS da,
                 (SELECT count(*) FROM labelled WHERE g = group_b AND labelled.t = times.t AND e = 1) AS db
          FROM times),
        tests AS (
          SELECT group_a, group_b,
                 pow(sum(da - (da + db) * na::DOUBLE / (na + nb)), 2)
                   / sum(CASE WHEN na + nb > 1 THEN na::DOUBLE * nb * (da + db) * (na + nb - da - db)
                         / ((na + nb)::DOUBLE * (na + nb) * (na + nb - 1)) ELSE 0 END) AS statistic
          FROM counts GROUP BY group_a, group_b)
        SELECT group_a, group_b, round(statistic + 1e-9, 6) AS statistic,
               round({_TAIL}, 9) AS p_value FROM (SELECT *, sqrt(statistic / 2.0) AS root FROM tests)""",
    ),
)
def logrank_pairs(t):
    tests = survival.logrank_pairs(long_subjects(t), "tenure", "target", f"{_LABEL}_new")
    return tests.withColumns({"statistic": F.round(F.col("statistic") + 1e-9, 6), "p_value": F.round("p_value", 9)})


def scored_gaps(t):
    """Frequent trade days with the gap that followed and the mean gap before as its prediction."""
    rows = daily(t).filter(F.col("cumulative_trade_days") > 3)
    following = F.lead("sauda_date").over(base.by_party().orderBy("sauda_date"))
    gap = F.datediff(following, "sauda_date")
    return rows.select(
        F.coalesce(gap, F.lit(400)).alias("tenure"),
        F.when(gap <= 365, 1).otherwise(0).alias("target"),
        (F.col("average_gap_last_four_trades_weeks") * 7.0).alias("expected"),
    ).withColumn("survival", F.exp(-30.0 / F.greatest("expected", F.lit(1.0))))


_SCORED = """scored AS (
      SELECT CAST(coalesce(gap, 400) AS INTEGER) AS tenure, CASE WHEN gap <= 365 THEN 1 ELSE 0 END AS target, expected,
             exp(-30.0 / greatest(expected, 1.0)) AS survival
      FROM (SELECT date_diff('day', sauda_date, lead(sauda_date) OVER (PARTITION BY party_code ORDER BY sauda_date)) AS gap,
                   average_gap_last_four_trades_weeks * 7.0 AS expected
            FROM daily_summary WHERE cumulative_trade_days > 3))"""


@query(
    "concordance_index",
    with_tables(
        "order_log daily",
        _SCORED + """,
        cells AS (SELECT tenure AS t, target AS e, expected AS s, count(*) AS n FROM scored GROUP BY ALL),
        pairs AS (
          SELECT CAST(sum(CASE WHEN a.s < b.s THEN a.n * b.n END) AS BIGINT) AS concordant,
                 CAST(sum(CASE WHEN a.s > b.s THEN a.n * b.n END) AS BIGINT) AS discordant,
                 CAST(sum(CASE WHEN a.s = b.s THEN a.n * b.n END) AS BIGINT) AS tied
          FROM cells a JOIN cells b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))
        SELECT *, (concordant + 0.5 * tied) / (concordant + discordant + tied)::DOUBLE AS concordance_index
        FROM pairs""".replace("SELECT *, (concordant", "SELECT concordant, discordant, tied, round((concordant").replace(
            "::DOUBLE AS concordance_index", "::DOUBLE, 6) AS concordance_index"
        ),
    ),
)
def concordance_index(t):
    index = survival.concordance_index(scored_gaps(t), "tenure", "target", "expected")
    return index.withColumn("concordance_index", F.round("concordance_index", 6))


@query(
    "brier_score",
    with_tables(
        "order_log daily",
        _SCORED + """
        SELECT count(*) AS subjects,
               round(avg(pow(survival - CASE WHEN tenure <= 30 AND target = 1 THEN 0.0 ELSE 1.0 END, 2)), 6) AS brier_score
        FROM scored WHERE tenure > 30 OR target = 1""",
    ),
)
def brier_score(t):
    score = survival.brier_score(scored_gaps(t), "tenure", "target", "survival", 30)
    return score.withColumn("brier_score", F.round("brier_score", 6))


DAYS = (30, 90, 180, 300)
_WEIGHED = _SCORED + """,
    days(h) AS (VALUES (30), (90), (180), (300)),
    levels AS (
      SELECT tenure AS d, count(*) FILTER (target = 0) AS c, sum(count(*)) OVER (ORDER BY tenure DESC) AS n, count(*) FILTER (target = 1) AS e
      FROM scored GROUP BY tenure),
    free AS (SELECT d, product(1.0 - c::DOUBLE / n) OVER (ORDER BY d) AS g, product(1.0 - e::DOUBLE / n) OVER (ORDER BY d) AS s FROM levels),
    before AS (SELECT d, lag(g, 1, 1.0) OVER (ORDER BY d) AS b FROM free),
    weighed AS (SELECT scored.*, b FROM scored JOIN before ON d = tenure)"""
_BRIER = _WEIGHED + """,
    brier AS (
      SELECT h, count(*) AS n, sum(CASE WHEN tenure <= h AND target = 1 THEN pow(exp(-h / greatest(expected, 1.0)), 2) / b
                                        WHEN tenure > h THEN pow(1.0 - exp(-h / greatest(expected, 1.0)), 2) / g ELSE 0 END) / count(*) AS score
      FROM weighed, (SELECT h, coalesce((SELECT arg_max(g, d) FROM free WHERE d <= h), 1.0) AS g FROM days) GROUP BY h)"""


def predicted_gaps(t):
    """The same with the chance of no trade until each of the days."""
    return scored_gaps(t).withColumns({f"survival_{d}": F.exp(-float(d) / F.greatest("expected", F.lit(1.0))) for d in DAYS})


def _brier(t):
    return survival.brier_scores(predicted_gaps(t), "tenure", "target", {d: f"survival_{d}" for d in DAYS})


@query("brier_scores", with_tables("order_log daily", _BRIER + " SELECT h AS day, n AS subjects, round(score, 9) AS brier_score FROM brier"))
def brier_scores(t):
    return _brier(t).withColumn("brier_score", F.round("brier_score", 9))


@query(
    "integrated_brier_score",
    with_tables(
        "order_log daily",
        _BRIER + """
        SELECT round(sum((h2 - h) * (score + score2) / 2) / sum(h2 - h), 9) AS integrated_brier_score
        FROM (SELECT h, score, lead(h) OVER (ORDER BY h) AS h2, lead(score) OVER (ORDER BY h) AS score2 FROM brier)""",
    ),
)
def integrated_brier_score(t):
    return survival.integrated(_brier(t), "day", "brier_score").withColumn("integrated_brier_score", F.round("integrated_brier_score", 9))


_AUC = _WEIGHED + """,
    cells AS (
      SELECT h, -expected AS score, sum(CASE WHEN tenure <= h AND target = 1 THEN 1 / b ELSE 0 END) AS cases, count(*) FILTER (tenure > h) AS controls
      FROM weighed, days WHERE expected IS NOT NULL GROUP BY h, expected),
    placed AS (SELECT *, sum(controls) OVER (PARTITION BY h ORDER BY score) - controls / 2.0 AS beaten FROM cells),
    areas AS (
      SELECT h, sum(cases) AS cases, CAST(sum(controls) AS BIGINT) AS controls, sum(cases * beaten) / (sum(cases) * sum(controls)) AS auc FROM placed GROUP BY h)"""


def _auc(t):
    ranked = scored_gaps(t).withColumn("risk", -F.col("expected"))
    return survival.auc_over_time(ranked, "tenure", "target", "risk", DAYS)


@query("auc_over_time", with_tables("order_log daily", _AUC + " SELECT h AS day, round(cases, 6) AS cases, controls, round(auc, 9) AS auc FROM areas"))
def auc_over_time(t):
    return _auc(t).withColumns({"cases": F.round("cases", 6), "auc": F.round("auc", 9)})


@query(
    "mean_auc",
    with_tables(
        "order_log daily",
        _AUC + """,
        curve AS (SELECT h, auc, coalesce((SELECT arg_max(s, d) FROM free WHERE d <= h), 1.0) AS s FROM areas),
        lost AS (SELECT auc, lag(s, 1, 1.0) OVER (ORDER BY h) - s AS w FROM curve)
        SELECT round(sum(auc * w) / sum(w), 9) AS mean_auc FROM lost WHERE auc IS NOT NULL""",
    ),
)
def mean_auc(t):
    curve = survival.kaplan_meier(scored_gaps(t), "tenure", "target")
    return survival.mean_auc(_auc(t), curve).withColumn("mean_auc", F.round("mean_auc", 9))


@query(
    "chi_square_tails",
    with_tables(
        "order_log",
        """stats AS (SELECT party_code, sum(OC) / 2.0::DOUBLE AS x FROM trade_log GROUP BY party_code),
        tails AS (
          SELECT party_code, x, k, 1 - sum(exp((k / 2.0 + n) * ln(x / 2) - x / 2 - lgamma(k / 2.0 + n + 1))) AS q
          FROM stats, (VALUES (1), (2), (12)) AS degrees(k), range(0, 300) AS r(n) GROUP BY party_code, x, k)
        SELECT party_code, x AS statistic, k AS degrees, round(abs(q), 9) AS p FROM tails""",
    ),
)
def chi_square_tails(t):
    stats = t.order_log.groupBy("party_code").agg((F.sum("OC") / F.lit(2.0)).alias("statistic"))
    tails = [F.struct(F.lit(k).alias("degrees"), F.round(survival.chi_square_upper(F.col("statistic"), k), 9).alias("p")) for k in (1, 2, 12)]
    return stats.select("party_code", "statistic", F.inline(F.array(*tails)))


@query(
    "censored_mae",
    with_tables(
        "order_log daily",
        _SCORED + """
        SELECT count(*) AS subjects, round(avg(CASE WHEN target = 1 THEN abs(tenure - expected)
               ELSE greatest(tenure - expected, 0.0) END), 6) AS censored_mae FROM scored""",
    ),
)
def censored_mae(t):
    score = survival.censored_mae(scored_gaps(t), "tenure", "target", "expected")
    return score.withColumn("censored_mae", F.round("censored_mae", 6))


@query(
    "dummies",
    with_tables(
        "order_log kyc tiers daily",
        "people AS (" + _PERSON.strip().replace("SELECT s.*,", "SELECT party_code, sauda_date,").replace(
            "surv s", "daily_summary s") + """)
        SELECT party_code, sauda_date, CAST(Tier = 'Tier-II' AS INTEGER) AS "Tier_Tier-II",
               CAST(Tier = 'Tier-III' AS INTEGER) AS "Tier_Tier-III",
               CAST(gender_f = 1 AS INTEGER) AS gender_f_1,
               CAST(riskcategory_new = 1 AS INTEGER) AS riskcategory_new_1,
               CAST(riskcategory_new = 2 AS INTEGER) AS riskcategory_new_2
        FROM people""",
    ),
)
def dummies(t):
    frame = survival.survival_dataset(daily(t), t.kyc, t.tiers, min_trade_days=1).select(
        "party_code", "sauda_date", "Tier", "gender_f", "riskcategory_new"
    )
    return survival.dummies(frame, ["Tier", "gender_f", "riskcategory_new"])
