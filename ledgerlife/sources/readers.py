"""Scans, named views, parameterised queries and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from ledgerlife.functions import columns as C


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


#: Quotes are doubled within quotes, as most programs write them; white space at the ends of a cell is kept.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header row; without a schema the types are inferred (one extra pass).

    Cells with line breaks need ``multiline``; a file is then read by one task. An empty cell is null, quoted or not.
    """
    reader = spark.read.options(**CSV).option("multiLine", multiline)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Every text cell that is empty or only white space becomes null."""
    return df.select(
        *[C.blank_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
          for f in df.schema.fields]
    )


def with_date(df: DataFrame, column: str) -> DataFrame:
    """Cast a text or timestamp column to date once, at ingest, so filters reach the scan."""
    return df.withColumn(column, F.col(column).cast("date"))


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def define_view(spark: SparkSession, name: str, query: str, **parameters) -> DataFrame:
    """A temporary view from SQL text with named ``:parameters`` (no text splicing)."""
    return register(spark.sql(query, args=parameters), name)


def date_choices(df: DataFrame, column: str, first=None, last=None) -> DataFrame:
    """The distinct dates of a column in order, as offered for a run parameter."""
    dates = df.select(F.col(column).cast("date").alias(column))
    if first is not None:
        dates = dates.filter(F.col(column) >= C.as_date(first))
    if last is not None:
        dates = dates.filter(F.col(column) <= C.as_date(last))
    return dates.distinct().orderBy(column)


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_orc(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).orc(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Unpersist the given frames, or drop the whole cache when none is given."""
    for frame in frames:
        frame.unpersist()
    if not frames:
        spark.catalog.clearCache()
