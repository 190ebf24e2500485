import math
import random

import pytest

from ledgerlife.functions import columns as C
from ledgerlife.operators import metrics
from pyspark.sql import functions as F


def test_regression_report_buckets(spark):
    actual = [0, 2, 3, 5, 6, 10, 11, 39, 51, None]
    frame = spark.createDataFrame([(a, None if i == 1 else float((a or 0) + 3)) for i, a in enumerate(actual)], "a int, p double")
    rows = {r.bucket: r for r in metrics.regression_report(frame, "p", "a").collect()}
    assert list(rows) == ["Overall", "0-2", "3-5", "6-10", "11-39", "40-50"]
    assert rows["Overall"].total_records == 8 and rows["Overall"].rmse == 3.0  # 51 lies outside every bucket
    assert rows["0-2"].total_records == 1 and rows["3-5"].mae == 3.0
    assert (rows["40-50"].total_records, rows["40-50"].rmse) == (0, None)


def test_inactive_bucket_edges(spark):
    values = [0, 2, 3, 5, 6, 10, 11, 39, 40, 50, 51, -1]
    frame = spark.createDataFrame([(v,) for v in values], "v int").select("v", C.inactivity_bucket(F.col("v")).alias("b"))
    assert [r.b for r in frame.collect()] == ["0-2"] * 2 + ["3-5"] * 2 + ["6-10"] * 2 + ["11-39"] * 2 + ["40-50"] * 4


def test_classes_never_predicted_or_never_true(spark):
    frame = spark.createDataFrame([(0, 0), (0, 2), (1, 0), (0, 0)], "t int, p int")
    rows = {r["class"]: r for r in metrics.classification_report(frame, "t", "p").collect()}
    assert (rows[0].precision, rows[0].recall) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert (rows[1].precision, rows[1].recall, rows[1].f1, rows[1].support) == (0.0, 0.0, 0.0, 1)
    assert (rows[2].precision, rows[2].support) == (0.0, 0)
    assert [r["class"] for r in metrics.never_predicted(frame, "t", "p").collect()] == [1]
    matrix = metrics.confusion_matrix(frame, "t", "p").collect()
    assert sum(r.rows for r in matrix) == 4
    assert {(r.label, r.prediction): r.share_of_label for r in matrix}[0, 0] == pytest.approx(2 / 3)
    summary = metrics.classification_summary(frame, "t", "p").first()
    assert (summary.accuracy, summary.support) == (0.5, 4)


def test_profiles(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 1), (None, 2), ("b", None)], "c string, n int")
    counts = {(r["column"], r["value"]): r["count"] for r in metrics.feature_value_counts(frame).collect()}
    assert counts == {("c", "a"): 1, ("c", "b"): 2, ("n", "1"): 2, ("n", "2"): 1}
    assert {r["column"]: r["mode"] for r in metrics.column_modes(frame).collect()} == {"c": "b", "n": "1"}
    assert {r["column"]: r["nulls"] for r in metrics.null_profile(frame).collect()} == {"c": 1, "n": 1}
    assert metrics.columns_of_type(frame, "int") == ["n"]
    assert metrics.random_sample(frame, 2, 1).count() == 2


def test_density_integrates_to_one(spark):
    values = [1, 1, 2, 4, 8]
    frame = spark.createDataFrame([(v,) for v in values], "v int")
    grid = [x / 4 for x in range(-60, 120)]
    rows = {r.x: r.density for r in metrics.density(frame, "v", grid).collect()}
    assert sum(rows.values()) / 4 == pytest.approx(1.0, abs=1e-3)
    mean = sum(values) / 5
    width = math.sqrt(sum((v - mean) ** 2 for v in values) / 4) * 5**-0.2
    direct = sum(math.exp(-0.5 * ((2.0 - v) / width) ** 2) for v in values) / (5 * width * math.sqrt(2 * math.pi))
    assert rows[2.0] == pytest.approx(direct)


def test_column_helpers(spark):
    frame = spark.createDataFrame([("NEW DELHI", ["a", "", None], "12x", float("nan"))], "c string, a array<string>, t string, d double")
    row = frame.select(
        C.capitalized(F.col("c")).alias("city"),
        C.non_blank(F.col("a")).alias("kept"),
        C.item_count(C.non_blank(F.col("a"))).alias("n"),
        C.item_count(F.lit(None).cast("array<string>")).alias("none"),
        C.to_number(F.col("t")).alias("number"),
        C.nan_or_null_to(F.col("d"), 1.0).alias("filled"),
        C.event_within(F.lit(None).cast("int")).alias("unseen"),
        C.age_bucket(F.lit(None).cast("double")).alias("no_age"),
        C.blank_to_null(F.lit("  ")).alias("blank"),
        C.row_stddev(F.lit(2.0), F.lit(2.0), F.lit(2.0)).alias("flat"),
        C.gap_label_days(F.lit("Quarter")).alias("label"),
    ).first()
    assert tuple(row) == ("New delhi", ["a"], 1, None, None, 1.0, 0, 3, None, 0.0, 90)


def test_density_equals_the_plain_sum(spark):
    rng = random.Random(6)
    values = [rng.gauss(3, 2) for _ in range(2000)] + [1e6, -1e6, 0.0]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    grid = [-4.0, 0.0, 2.9, 3.0, 7.5, 60.0, 1e6]
    for h in (0.05, 0.7):
        found = {r.x: r.density for r in metrics.density(frame, "v", grid, h).collect()}
        for x in grid:
            plain = sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
            assert found[x] == pytest.approx(plain, rel=1e-9, abs=1e-13 / h)
    one = metrics.density(frame.filter("v = 0"), "v", [0.0]).collect()
    assert [r.density for r in one] == [None]
