"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The word of operators 1 and 3: what stands between ASCII characters that are neither letters nor digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. A local session without that setting gets a temporary one; a
    cluster without it is an error, as executors would write to disks of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="frameflow-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/frameflow-{spark.sparkContext.applicationId}"


#: Tables stored inside the open temporary() blocks, the innermost last.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that are stored inside are deleted at the end, but for those stored with keep=True."""
    _OPEN.append([])
    try:
        yield
    finally:
        for df in _OPEN.pop():
            forget(df)


#: Shuffle files go at the end of the action that made them; else they stay until the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """For actions inside whose shuffles no later action can use."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def stored(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """df written as a table in the shared folder and read again: later steps do not repeat the work before it. The table stays
    until forget(), the end of a temporary() block around it, or clear()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    if _OPEN and not keep:
        _OPEN[-1].append(out)
    return out


def deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored; results that still read them are lost."""
    deleted(spark, shared_dir(spark))


def positional(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: names of the caller's columns cannot clash with others then."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def forget(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame that stored() returned."""
    path = getattr(df, "_stored_path", None)
    if path:
        deleted(df.sparkSession, path)


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n).cast("long"))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list | tuple | None]], schema: StructType, chunk: int = 2048) -> DataFrame:
    """Each row through a function, in Arrow batches. make() runs once per task and returns the function,
    which takes the row's values and returns a list of output tuples. Memory: one batch in and `chunk` rows out."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, rows = make(), []
        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                rows += fn(*(c[i].as_py() for c in columns))
                if len(rows) >= chunk:
                    yield packed(rows, arrow)
                    rows = []
        if rows:
            yield packed(rows, arrow)

    return df.mapInArrow(run, schema)


def packed(rows: list, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
