"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "ledgerlife") -> SparkSession:
    """A single-machine session for tests and the benchmark.

    On a cluster the caller brings its own session; nothing in the library
    depends on the values set here.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The folder for reliable checkpoints that the session names, if any."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared checkpoint folder; a single-process session without one takes a folder of its own."""
    folder = checkpoint_folder(spark)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerlife-")
    return f"{folder.rstrip('/')}/ledgerlife-{label}-{uuid.uuid4().hex}"


def reused(df: DataFrame) -> DataFrame:
    """Materialise a reduced frame that several jobs are going to read.

    Where the session names a checkpoint folder the frame is written there as a
    table and read back: it is computed once, later jobs prune its columns, and
    a lost executor costs no recomputation of what lies before. Without a
    folder it is cached with its lineage.
    """
    folder = checkpoint_folder(df.sparkSession)
    if folder is None:
        return df.persist()
    path = f"{folder.rstrip('/')}/ledgerlife-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(table)] = (table, path)
    return table


#: Tables written by reused() that are still there, by the frame that reads them.
_paths: dict[int, tuple[DataFrame, str]] = {}


def release(df: DataFrame) -> None:
    """Give up a frame from reused(): its table is deleted, or its cache dropped."""
    _, path = _paths.pop(id(df), (None, None))
    if path is None:
        df.unpersist()
        return
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
