"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlife.session import checkpoint_folder

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A machine-local folder is taken only by a single-process session that names none.
    """
    folder = checkpoint_folder(spark)
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlife-"))
        folder = checkpoint_folder(spark)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/ledgerlife-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a reduced frame to the shared folder and read it back.

    It is computed once, its lineage ends there, and a lost executor costs
    nothing that lies before it.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table that stored() and new_path() have placed in shared folders.

    Frames that read those tables can't be used afterwards.
    """
    while _written:
        spark, path = _written.pop()
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as long, without keeping them: runs of gaps between the outer ones, plus one."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{GAP}|{GAP}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def arrow_type(kind: T.DataType) -> pa.DataType:
    """Arrow's type for the types that operators add."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind])
    return {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
        T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(),
    }[type(kind)]


def free(columns: list[str], *names: str) -> list[str]:
    """Working names that are no columns yet: each name, with underscores before it as needed."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mapped(df: DataFrame, text_col: str, added: list[T.StructField], make: Callable[[list], list], most: int = 4_000_000) -> DataFrame:
    """Add columns computed from one text column, batch by batch.

    ``make`` gets a list with the texts of a part of a batch (None for null)
    and returns one list or Arrow array for each added column. Parts hold
    about ``most`` bytes, so memory doesn't grow with batches of long texts.
    A column that has the name of an added one already is replaced.
    """
    new = {f.name.lower() for f in added}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    schema = T.StructType([df.schema.fields[i] for i in kept] + added)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [arrow_type(f.dataType) for f in added]
        for whole in batches:
            for batch in parts(whole, at, most):
                made = make(batch.column(at).to_pylist())
                columns = [batch.column(i) for i in kept]
                columns += [values if isinstance(values, pa.Array) else pa.array(values, kind) for kind, values in zip(kinds, made, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                del made, columns, batch
            del whole
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks, beside the executor's heap."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def parts(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of the text column each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
