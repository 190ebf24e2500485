import pytest
from pyspark.sql import functions as F

from ledgerlife.operators import base
from ledgerlife import session
from ledgerlife.sources import readers, sample_tables, schemas

from conftest import day


def trades(make):
    return make.trades([(1, "2021-12-01", "EQ", 2, 5.0), (2, "2021-12-02", "", 1, None)])


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


def test_round_trips(spark, make, tmp_path):
    frame = trades(make)
    readers.write_orc(frame, f"{tmp_path}/orc")
    readers.write_parquet(frame, f"{tmp_path}/parquet", partition_by=["sauda_date"])
    readers.write_csv(frame, f"{tmp_path}/csv")
    assert same(frame, readers.read_orc(spark, f"{tmp_path}/orc"))
    assert same(frame, readers.read_parquet(spark, f"{tmp_path}/parquet"))
    typed = readers.read_csv(spark, f"{tmp_path}/csv", schemas.TRADE_LOG)
    assert typed.dtypes == frame.dtypes and typed.filter("party_code = 2").first().INST_TYPE is None
    assert dict(readers.read_csv(spark, f"{tmp_path}/csv").dtypes)["sauda_date"] == "date"


def test_table_and_views(spark, make):
    frame = trades(make)
    readers.register(frame, "log_view")
    assert same(frame, readers.read_table(spark, "log_view"))
    picked = readers.define_view(spark, "one_day", "SELECT * FROM log_view WHERE sauda_date = CAST(:d AS DATE)", d="2021-12-01")
    assert [r.party_code for r in picked.collect()] == [1]
    assert spark.table("one_day").count() == 1
    readers.release(spark)


def test_dates_and_blanks(spark, make):
    frame = trades(make)
    assert [r[0] for r in readers.date_choices(frame, "sauda_date", last="2021-12-01").collect()] == [day("2021-12-01")]
    assert readers.has_rows(frame) and not readers.has_rows(frame.filter("party_code = 9"))
    assert readers.blanks_to_null(frame).filter("INST_TYPE is null").count() == 1
    text = spark.createDataFrame([("2021-12-01",)], "dt string")
    assert readers.with_date(text, "dt").dtypes == [("dt", "date")]


def test_date_filter_reaches_the_scan(spark, make, tmp_path):
    readers.write_orc(trades(make), f"{tmp_path}/orc")
    plan = base.around(readers.read_orc(spark, f"{tmp_path}/orc"), ["2021-12-01"], 30, 1)
    text = plan.select("party_code")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(sauda_date,2021-11-01)" in text and "LessThanOrEqual(sauda_date,202" in text
    assert "T_O" not in text.split("ReadSchema")[1]


def test_one_row_per_key_and_append(make):
    frame = make.trades([(1, "2021-12-01", "EQ", 1), (1, "2021-12-02", "FUT", 5), (2, "2021-12-01", "EQ", 3)])
    last = {r.party_code: r.OC for r in base.one_per_key(frame, ["party_code"], "sauda_date", last=True).collect()}
    first = {r.party_code: r.OC for r in base.one_per_key(frame, ["party_code"], "sauda_date").collect()}
    assert (last, first) == ({1: 5, 2: 3}, {1: 1, 2: 3})
    both = base.append_all(frame.select("party_code"), frame.select("party_code", "OC"))
    assert both.count() == 6 and both.filter(F.col("OC").isNull()).count() == 3


def test_reused_frames_go_to_the_named_folder(spark, tmp_path, monkeypatch):
    frame = spark.range(10).withColumn("k", F.col("id") % 3).groupBy("k").count()
    monkeypatch.setattr(session, "checkpoint_folder", lambda _: None)
    assert session.reused(frame).is_cached
    frame.unpersist()
    monkeypatch.setattr(session, "checkpoint_folder", lambda _: str(tmp_path))
    kept = session.reused(frame)
    assert any(tmp_path.iterdir()) and kept.count() == 3
    assert "HashAggregate" not in kept._jdf.queryExecution().executedPlan().toString()


def order_tables(spark, folder, orders):
    """Orders of four lines each, and one order that has no lines."""
    line = spark.range(4 * orders).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"))
    line.withColumns({"l_partkey": F.col("l_orderkey"), "l_suppkey": F.col("l_orderkey"), "l_quantity": F.lit(20.0), "l_returnflag": F.lit("A"), "l_linestatus": F.lit("O")}).write.parquet(f"{folder}/lineitem.parquet")
    head = spark.range(orders + 1).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.lit("2000-01-01").cast("date").alias("o_orderdate"))
    head.write.parquet(f"{folder}/orders.parquet")
    return sample_tables.SampleTables(spark, str(folder))


@pytest.mark.parametrize("orders", [500, 4_000])
def test_lines_of_a_task_do_not_grow_with_the_table(spark, tmp_path, monkeypatch, orders):
    monkeypatch.setattr(sample_tables, "LINES_PER_TASK", 200, raising=False)
    detail = order_tables(spark, tmp_path, orders).order_detail
    tasks = [r["count"] for r in detail.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 4 * orders and max(tasks) <= 2 * 200
