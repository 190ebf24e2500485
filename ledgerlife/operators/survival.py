"""Survival data set and estimators on duration histograms.

Durations are whole days, so every curve is computed on one row per group and
distinct duration: at most the days of the log, however many subjects there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlife.functions import codes
from ledgerlife.functions import columns as C
from ledgerlife.operators import base
from ledgerlife.operators.features import kyc_rows, with_tier
from ledgerlife.session import reused


def survival_dataset(
    daily: DataFrame,
    kyc: DataFrame,
    tiers: DataFrame,
    days=None,
    since=None,
    limit: int = 90,
    unseen: int = 100,
    min_trade_days: int = 4,
) -> DataFrame:
    """Frequent parties trading on the given days, with the days to their next trade.

    ``target`` is 1 when the next trade came within ``limit`` days; a party with
    no later trade gets the duration ``unseen`` and target 0.
    """
    label = "average_gap_last_four_trades_label"
    first = min(str(d) for d in days) if since is None and isinstance(days, (list, tuple)) else since
    rows = base.dates_between(daily, first).filter(F.col("cumulative_trade_days") >= min_trade_days)
    rows = rows.select("party_code", "sauda_date", label).distinct()
    following = F.lead("sauda_date").over(base.by_party().orderBy("sauda_date"))
    rows = base.requested(rows.withColumn("tenure", F.datediff(following, "sauda_date")), days)
    rows = rows.withColumn("target", C.event_within(F.col("tenure"), limit)).na.fill({"tenure": unseen})
    person = kyc_rows(kyc, "gender", "riskcategory", "incomedetails", "occupation", "City")
    person = with_tier(person, tiers).na.fill({"occupation": "no_data"})
    return rows.join(person, "party_code", "left").select(
        "party_code",
        "sauda_date",
        "tenure",
        "target",
        F.coalesce("occupation", F.lit("no_data")).alias("occupation"),
        F.coalesce("Tier", F.lit(codes.UNLISTED_CITY_TIER)).alias("Tier"),
        C.income_bucket(F.col("incomedetails")).alias("new_incomedetails"),
        C.gender_flag(F.col("gender")).alias("gender_f"),
        C.risk_ordinal(F.col("riskcategory")).alias("riskcategory_new"),
        C.gap_label_days(F.col(label)).alias(f"{label}_new"),
    )


def dummies(
    df: DataFrame, columns: Sequence[str], drop_first: bool = True, values: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Replace each column by one 0/1 column per value, in value order, less the first.

    A null value gives 0 everywhere. ``values`` names the values of columns
    that are known; others are looked up. The result has a column for each, so
    this is for categories; ``long_dummies`` takes columns of any size.
    """
    missing = [c for c in columns if c not in (values or {})]
    seen = {**(values_of(df, missing) if missing else {}), **{c: list(v) for c, v in (values or {}).items()}}
    for name in columns:
        text = F.col(name).cast("string")
        for value in seen[name][1:] if drop_first else seen[name]:
            df = df.withColumn(f"{name}_{value}", F.coalesce((text == value).cast("int"), F.lit(0)))
    return df.drop(*columns)


def long_dummies(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The ones of the same table in long form: (key, column, value), a row for each value that is not null."""
    text = df.select(*key, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(list(key), list(columns), "column", "value").filter(F.col("value").isNotNull())


def values_of(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Distinct non-null values of category columns as text, in value order; one job for all columns."""
    numeric = {name for name, kind in df.dtypes if kind in ("int", "bigint", "smallint", "double", "float")}
    found: dict[str, list[str]] = {name: [] for name in columns}
    for row in long_dummies(df, [], columns).distinct().collect():
        found[row["column"]].append(row["value"])
    for name, values in found.items():
        values.sort(key=float if name in numeric else str)
    return found


def whole_days(df: DataFrame, duration: str) -> DataFrame:
    """Rows with a duration; refuses durations that are not whole days.

    The curves keep one row per distinct duration in a window, which is bounded
    only when durations are days.
    """
    kind = dict(df.select(duration).dtypes)[duration]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{duration} must be whole days, not {kind}; floor or bin it first")
    return df.filter(F.col(duration).isNotNull())


def at_risk_table(df: DataFrame, duration: str, event: str, by: Sequence[str] = (), entry: str | None = None) -> DataFrame:
    """Events, censored and at-risk counts per group and distinct duration.

    With ``entry`` a subject is at risk only on the days behind that one (null: from the start);
    those that would leave on or before their entry were never seen, and are left out.
    """
    rows, late = whole_days(df, duration), F.lit(0)
    if entry is not None:
        rows = whole_days(rows.withColumn(entry, F.coalesce(F.col(entry), F.lit(-1))), entry).filter(F.col(entry) < F.col(duration))
        # A subject comes in as it leaves: each side is a row, so that one sum from the last day gives who is there.
        sides = F.array(F.struct(F.col(duration).alias("_day"), F.lit(1).alias("_out")), F.struct(F.col(entry).cast(dict(rows.dtypes)[duration]).alias("_day"), F.lit(0).alias("_out")))
        rows = rows.select(*by, F.col(event).alias("_event"), F.inline(sides)).select(*by, F.col("_day").alias(duration), "_out", F.when(F.col("_out") == 1, F.col("_event")).alias(event))
        late = F.count_if(F.col("_out") == 0)
    counts = rows.groupBy(*by, duration).agg(F.count_if(F.col(event) == 1).alias("events"), (F.count("*") - late).alias("subjects"), late.alias("late"))
    from_here = Window.partitionBy(*by).orderBy(F.desc(duration))
    return counts.select(
        *by,
        F.col(duration).alias("duration"),
        "events",
        (F.col("subjects") - F.col("events")).alias("censored"),
        F.sum(F.col("subjects") - F.col("late")).over(from_here).alias("at_risk"),
        "subjects",
    ).filter("subjects > 0").drop("subjects")


def kaplan_meier(
    df: DataFrame, duration: str, event: str, by: Sequence[str] = (), z: float = 1.959963984540054, entry: str | None = None
) -> DataFrame:
    """Product-limit survival curve with a log-log band and cumulative density; ``entry`` as in ``at_risk_table``."""
    so_far = Window.partitionBy(*by).orderBy("duration")
    died, risk = F.col("events"), F.col("at_risk")
    table = at_risk_table(df, duration, event, by, entry).withColumns(
        {
            "extinct": F.max(died == risk).over(so_far),
            "log_s": F.sum(F.when(died < risk, F.log1p(-died / risk))).over(so_far),
            "spread": F.sum(F.when(died < risk, died / (risk * (risk - died)))).over(so_far),
        }
    )
    survival = F.when(F.col("extinct"), 0.0).otherwise(F.exp(F.coalesce("log_s", F.lit(0.0))))
    half_width = F.lit(z) * F.try_divide(F.sqrt("spread"), F.col("log_s"))

    def bound(sign: int) -> Column:
        edge = F.when(F.col("log_s") < 0, F.pow(F.exp("log_s"), F.exp(F.lit(float(sign)) * half_width))).otherwise(1.0)
        return F.when(~F.col("extinct"), edge)

    return table.withColumns(
        {"survival": survival, "ci_lower": bound(-1), "ci_upper": bound(1), "cumulative_density": 1.0 - survival}
    ).select(
        *by, "duration", "at_risk", "events", "censored", "survival", "ci_lower", "ci_upper", "cumulative_density"
    )


def survival_points(curve: DataFrame, times: Sequence[int] = (7, 15, 30, 90), by: Sequence[str] = ()) -> DataFrame:
    """Median survival time (null if half never have the event) and survival at given days."""
    return curve.groupBy(*by).agg(
        F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("duration"))).alias("median_survival"),
        *[
            F.coalesce(F.min(F.when(F.col("duration") <= t, F.col("survival"))), F.lit(1.0)).alias(f"survival_at_{t}")
            for t in times
        ],
    )


def nelson_aalen(df: DataFrame, duration: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative hazard: running sum of events over at-risk."""
    so_far = Window.partitionBy(*by).orderBy("duration")
    hazard = F.col("events") / F.col("at_risk")
    return at_risk_table(df, duration, event, by).withColumns(
        {"hazard": hazard, "cumulative_hazard": F.sum(hazard).over(so_far)}
    )


def life_table(df: DataFrame, duration: str, event: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """The same over intervals of ``width`` days, named by their first day."""
    binned = df.withColumn("_interval", (F.floor(F.col(duration) / width) * width).cast("int"))
    return nelson_aalen(binned, "_interval", event, by).withColumnRenamed("duration", "interval_start")


def logrank_pairs(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """Two-group log-rank test of every pair of groups, for any number of groups.

    Subjects are folded to (day, group) first and every group's at-risk count
    is carried to each day with an event. Pairs of groups are formed per event
    day on those small rows, from pairs with an event only: elsewhere neither
    the expected events nor the variance move.
    """
    kept = whole_days(df, duration).filter(F.col(group).isNotNull())
    died = F.count_if(F.col(event) == 1).alias("d")
    cells = reused(kept.groupBy(F.col(group).alias("g"), F.col(duration).alias("day")).agg(F.count("*").alias("n"), died))
    groups = cells.select("g").distinct()
    days = cells.filter("d > 0").select("day").distinct()
    # Each group's row on each event day: its own cells, and empty ones for the days it lacks.
    grid = days.withColumn("groups", groups.agg(F.sort_array(F.collect_set("g"))).scalar()).select("day", F.explode("groups").alias("g"))
    full = grid.unionByName(cells, allowMissingColumns=True).groupBy("g", "day").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("d")
    )
    from_here = Window.partitionBy("g").orderBy(F.desc("day"))
    risk = full.withColumn("r", F.sum("n").over(from_here)).filter((F.col("r") > 0)).join(days, "day", "left_semi")
    row = F.sort_array(F.collect_list(F.struct("g", "d", "r")))  # a row for each group, as the result has for each pair
    day = risk.groupBy("day").agg(row.alias("rows"))
    # A group that nobody is left in at a day adds nothing to a pair there.
    left = day.select("day", "rows", F.posexplode("rows").alias("i", "a"))
    pairs = left.select(F.col("a"), F.explode(F.filter("rows", lambda b: b["g"] > F.col("a.g"))).alias("b"))
    events, both = F.col("a.d") + F.col("b.d"), F.col("a.r") + F.col("b.r")
    expected = events * F.col("a.r") / both
    variance = F.try_divide(
        F.col("a.r").cast("double") * F.col("b.r") * events * (both - events), both.cast("double") * both * (both - 1)
    )
    sums = pairs.groupBy(F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b")).agg(
        F.sum(F.col("a.d") - expected).alias("diff"), F.sum(F.coalesce(variance, F.lit(0.0))).alias("var")
    )
    every = groups.select(F.col("g").alias("group_a")).withColumn("groups", groups.agg(F.sort_array(F.collect_set("g"))).scalar())
    every = every.select("group_a", F.explode(F.filter("groups", lambda b: b > F.col("group_a"))).alias("group_b"))
    tested = every.join(sums, ["group_a", "group_b"], "left").select(
        "group_a", "group_b", F.try_divide(F.pow("diff", F.lit(2.0)), F.col("var")).alias("statistic")
    )
    return tested.withColumn("p_value", chi_square_tail(F.col("statistic")))


# Chebyshev fit of the complementary error function (relative error below 1.2e-7).
ERFC_FIT = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223,
    0.17087277,
]


def chi_square_tail(statistic: Column) -> Column:
    """Upper tail probability of a chi-square value at one degree of freedom."""
    root = F.sqrt(statistic / F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * root)
    fit = F.lit(ERFC_FIT[-1])
    for coefficient in reversed(ERFC_FIT[:-1]):
        fit = F.lit(coefficient) + t * fit
    return t * F.exp(fit - root * root)


def gamma_tail(a: float, x: Column, steps: int = 200) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0; 1 for x of 0 or less, null for null.

    Below a + 1 the series of the lower function, above it the continued
    fraction from its end backwards. ``steps`` terms give 12 digits for a up to 100.
    """
    scale = F.exp(F.lit(float(a)) * F.log(x) - x - F.lit(math.lgamma(a)))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(1.0 / a).alias("term"), F.lit(1.0 / a).alias("sum")),
        lambda s, n: F.struct((s["term"] * x / (F.lit(float(a)) + n)).alias("term"), (s["sum"] + s["term"] * x / (F.lit(float(a)) + n)).alias("sum")),
        lambda s: s["sum"],
    )
    start = x + F.lit(2.0 * steps + 1.0 - a)
    fraction = F.aggregate(
        F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), start, lambda s, n: x + (2.0 * n - F.lit(1.0 + a)) + n * (F.lit(float(a)) - n) / s
    )
    below = F.greatest(F.lit(0.0), 1.0 - scale * series)
    return F.when(x <= 0, 1.0).when(x < a + 1, below).when(x.isNotNull(), scale / fraction)


def chi_square_upper(statistic: Column, degrees: int) -> Column:
    """Upper tail probability of a chi-square value at any number of degrees of freedom."""
    return gamma_tail(degrees / 2.0, statistic.cast("double") / 2.0)


def dense_ranks(values: DataFrame, column: str) -> DataFrame:
    """Each distinct value of a column with its rank from 0, by ranges: a sort within each and an offset before it."""
    ranged = values.select(column).distinct().repartitionByRange(column).withColumn("_range", F.spark_partition_id())
    ranged = reused(ranged.sortWithinPartitions(column))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.withColumn("_place", within).join(before, "_range").select(column, (F.col("_before") + F.col("_place") - 1).alias("step"))


def concordance_index(df: DataFrame, duration: str, event: str, score: str) -> DataFrame:
    """Share of comparable pairs whose scores order as their durations do; score ties count half.

    A pair is comparable when the earlier duration is an event, or at equal
    durations one is an event and the other is not. Pairs are counted, not
    formed: scores are replaced by their dense ranks, and two different ranks
    split at exactly one binary digit, so at each digit the rows sharing all
    higher digits are compared as a 0-side and a 1-side through running counts
    over durations. Groups there hold one row per day.
    """
    rows = whole_days(df, duration).filter(F.col(score).isNotNull())
    cells = reused(
        rows.groupBy(F.col(score).alias("score"), F.col(duration).alias("day"), (F.col(event) == 1).alias("died")).agg(
            F.count("*").alias("n")
        )
    )
    ranks = dense_ranks(cells, "score")
    span = ranks.agg(F.length(F.bin(F.coalesce(F.max("step"), F.lit(0)))).alias("digits")).select(
        F.struct(F.lit(0).alias("low"), "digits").alias("span")
    )
    cells = cells.join(ranks, "score").drop("score")
    place = F.col("step") - F.col("span.low")
    spread = (
        cells.withColumn("span", span.scalar())
        .withColumn("offset", place)
        .withColumn("digit", F.explode(F.sequence(F.lit(-1), F.col("span.digits") - 1)))
    )
    # Digit -1 stands for equal scores: the whole value is shared.
    above = F.expr("shiftright(offset, digit + 1)")
    side = F.when(F.col("digit") < 0, F.lit(0)).otherwise(F.expr("shiftright(offset, digit) & 1").cast("int"))
    sided = spread.withColumns({"above": above, "side": side})
    zero, one, died = F.col("side") == 0, F.col("side") == 1, F.col("died")

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    table = sided.groupBy("digit", "above", "day").agg(
        total(zero, "n0"), total(one, "n1"), total(zero & died, "d0"), total(one & died, "d1")
    )
    later = Window.partitionBy("digit", "above").orderBy("day").rowsBetween(1, Window.unboundedFollowing)

    def beaten(side_name: str) -> Column:
        after = F.coalesce(F.sum(f"n{side_name}").over(later), F.lit(0))
        return (after + F.col(f"n{side_name}") - F.col(f"d{side_name}")).cast("double")

    counted = table.select(
        "digit", (F.col("d0") * beaten("1")).alias("up"), (F.col("d1") * beaten("0")).alias("down"),
        (F.col("d0") * beaten("0")).alias("level"),
    )
    split = F.col("digit") >= 0
    return counted.agg(
        F.sum(F.when(split, F.col("up")).otherwise(0.0)).cast("long").alias("concordant"),
        F.sum(F.when(split, F.col("down")).otherwise(0.0)).cast("long").alias("discordant"),
        F.sum(F.when(~split, F.col("level")).otherwise(0.0)).cast("long").alias("tied"),
    ).withColumn(
        "concordance_index",
        F.try_divide(
            F.col("concordant") + F.col("tied") * 0.5, F.col("concordant") + F.col("discordant") + F.col("tied")
        ),
    )


def brier_score(df: DataFrame, duration: str, event: str, survival: str, at: int) -> DataFrame:
    """Mean squared error of predicted survival at a day, over subjects whose state is known then."""
    gone = (F.col(duration) <= at) & (F.col(event) == 1)
    known = gone | (F.col(duration) > at)
    alive = F.when(gone, 0.0).otherwise(1.0)
    return df.filter(known).agg(
        F.count("*").alias("subjects"), F.avg(F.pow(F.col(survival) - alive, F.lit(2.0))).alias("brier_score")
    )


def censored_mae(df: DataFrame, duration: str, event: str, prediction: str) -> DataFrame:
    """Mean absolute error; a censored subject only errs when predicted too early."""
    error = F.col(duration) - F.col(prediction)
    loss = F.when(F.col(event) == 1, F.abs(error)).otherwise(F.greatest(error, F.lit(0.0)))
    return df.agg(F.count(loss).alias("subjects"), F.avg(loss).alias("censored_mae"))


def censoring_curve(df: DataFrame, duration: str, event: str) -> DataFrame:
    """Chance of not being censored: (duration, free, free_before), with events and censoring exchanged.

    ``free`` holds from the day on, ``free_before`` is its value up to the day.
    """
    exchanged = df.withColumn("_censored", F.when(F.col(event) == 1, 0).otherwise(1))
    curve = kaplan_meier(exchanged, duration, "_censored").select("duration", F.col("survival").alias("free"))
    before = F.lag("free", 1, 1.0).over(Window.orderBy("duration"))  # one row for each day of the log
    return curve.withColumn("free_before", before)


def brier_scores(df: DataFrame, duration: str, event: str, survival: dict[int, str]) -> DataFrame:
    """Squared error of predicted survival at each given day, with censoring weights: (day, subjects, brier_score).

    ``survival`` names the column that holds the prediction for a day. A subject
    gone by the day counts by the inverse chance of being uncensored just
    before its event, one still there by that at the day, and one censored
    before has no weight of its own. Without censoring this is the plain mean.
    Subjects are folded to one row for each duration before anything is joined.
    """
    rows = whole_days(df, duration)
    days = sorted(survival)
    gone = F.col(event) == 1
    parts = [F.count("*").alias("n")]
    for t in days:
        s = F.col(survival[t]).cast("double")
        parts += [F.sum(F.when(gone, s * s).otherwise(0.0)).alias(f"gone_{t}"), F.sum((1.0 - s) * (1.0 - s)).alias(f"there_{t}")]
    cells = rows.groupBy(F.col(duration).alias("duration")).agg(*parts)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("day"), F.col(f"gone_{t}").alias("gone"), F.col(f"there_{t}").alias("there")) for t in days]))
    curve = reused(censoring_curve(rows, duration, event))
    cells = cells.join(curve, "duration").select("duration", "n", "free_before", each.alias("e")).select("duration", "n", "free_before", "e.*")
    at = curve.agg(*[F.coalesce(F.max_by("free", F.when(F.col("duration") <= t, F.col("duration"))), F.lit(1.0)).alias(f"d{t}") for t in days])
    at = at.select(F.explode(F.array(*[F.struct(F.lit(t).alias("day"), F.col(f"d{t}").alias("free")) for t in days])).alias("a")).select("a.*")
    error = F.when(F.col("duration") <= F.col("day"), F.try_divide(F.col("gone"), F.col("free_before"))).otherwise(F.try_divide(F.col("there"), F.col("free")))
    return cells.join(at, "day").groupBy("day").agg(
        F.sum("n").alias("subjects"), F.try_divide(F.sum(F.coalesce(error, F.lit(0.0))), F.sum("n").cast("double")).alias("brier_score")
    )


def integrated(scores: DataFrame, day: str, value: str) -> DataFrame:
    """Mean of a value over the days between the first and last row, by trapezoids; one row with that value (null for one day)."""
    following = Window.orderBy(day)  # a row for each given day
    steps = scores.select(F.col(day).alias("t"), F.col(value).alias("v"), F.lead(day).over(following).alias("t2"), F.lead(value).over(following).alias("v2"))
    area = F.sum((F.col("t2") - F.col("t")) * (F.col("v") + F.col("v2")) / 2.0)
    return steps.agg(F.try_divide(area, F.sum(F.col("t2") - F.col("t"))).alias(f"integrated_{value}"))


def auc_over_time(df: DataFrame, duration: str, event: str, score: str, days: Sequence[int]) -> DataFrame:
    """Area under the curve of each day: (day, cases, controls, auc).

    Cases had their event by the day and count by the inverse chance of being
    uncensored just before it; controls are still there after it. The area is the share of
    (case, control) weight in which the case has the higher score, ties by half. No pair is
    formed: scores are sorted over all tasks, and the controls below a
    score are those of its range so far and of all ranges before. Null without a case or a control.
    """
    rows = whole_days(df, duration).filter(F.col(score).isNotNull())
    curve = censoring_curve(rows, duration, event).select(F.col("duration").alias("_day"), "free_before")
    weighed = rows.select(F.col(score).alias("score"), F.col(duration).alias("_day"), (F.col(event) == 1).alias("gone")).groupBy("score", "_day", "gone").agg(F.count("*").alias("n"))
    weighed = weighed.join(curve, "_day")
    case, control = [], []
    for t in days:
        case.append(F.sum(F.when(F.col("gone") & (F.col("_day") <= t), F.col("n") / F.col("free_before")).otherwise(0.0)))
        control.append(F.sum(F.when(F.col("_day") > t, F.col("n")).otherwise(0)))
    named = [c.alias(f"case_{i}") for i, c in enumerate(case)] + [c.alias(f"control_{i}") for i, c in enumerate(control)]
    ranged = reused(weighed.groupBy("score").agg(*named).repartitionByRange("score").withColumn("_range", F.spark_partition_id()))
    each = F.explode(F.array(*[F.struct(F.lit(int(t)).alias("day"), F.col(f"case_{i}").alias("case"), F.col(f"control_{i}").alias("control")) for i, t in enumerate(days)]))
    long = ranged.select("score", "_range", each.alias("e")).select("score", "_range", "e.*")
    so_far = Window.partitionBy("day", "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inner = long.withColumn("below", F.coalesce(F.sum("control").over(so_far), F.lit(0)))
    ranges = inner.groupBy("day", "_range").agg(
        F.sum("case").alias("case"), F.sum("control").alias("control"), F.sum(F.col("case") * (F.col("below") + F.col("control") / 2.0)).alias("won")
    )
    before = Window.partitionBy("day").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.withColumn("won", F.col("won") + F.col("case") * F.coalesce(F.sum("control").over(before), F.lit(0)))
    return ranges.groupBy("day").agg(
        F.sum("case").alias("cases"), F.sum("control").alias("controls"), F.try_divide(F.sum("won"), F.sum("case") * F.sum("control")).alias("auc")
    )


def mean_auc(areas: DataFrame, curve: DataFrame) -> DataFrame:
    """Concordance as the mean of the areas, weighted by the survival lost in the interval that ends at each day.

    ``areas`` come from ``auc_over_time``, ``curve`` from ``kaplan_meier``. Days without an area take no part.
    """
    known = areas.select("day", "auc", F.lit(None).cast("double").alias("survival"), F.lit(1).alias("turn"))
    steps = curve.select(F.col("duration").cast("int").alias("day"), F.lit(None).cast("double").alias("auc"), "survival", F.lit(0).alias("turn"))
    so_far = Window.orderBy("day", "turn")  # a row for each day of the log, and for each given day
    both = known.unionByName(steps).withColumn("level", F.coalesce(F.last("survival", True).over(so_far), F.lit(1.0))).filter("turn = 1")
    lost = F.lag("level", 1, 1.0).over(Window.orderBy("day")) - F.col("level")
    weighed = both.withColumn("lost", lost).filter("auc is not null")
    return weighed.agg(F.try_divide(F.sum(F.col("auc") * F.col("lost")), F.sum("lost")).alias("mean_auc"))
