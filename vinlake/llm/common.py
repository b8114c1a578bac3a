"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word of a text: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where none is set and all run in one process, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder as a reliable checkpoint, without the lineage before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession) -> str:
    """A folder of the shared one that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def as_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder as Parquet and read again: small on disk, and Spark knows its size. A path is for those who remove it later."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it has max_rows rows at most (counted, stopping one row beyond); else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def give_back() -> None:
    """Returns memory that this process has freed to the system: Spark keeps Python workers for later tasks, beside those that need memory by then."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def map_texts(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str, rows: int = 256) -> DataFrame:
    """mapInArrow in small slices. make() runs once a task and returns a function from the lists of df's columns to the lists (or Arrow arrays) of the result's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what tasks before this one have left
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, arrow)], schema=arrow)
        fn = batch = part = out = None  # noqa: F841
        give_back()

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def learns(doc_id: Column, mod: int, held: int) -> Column:
    """True for rows that may teach: crc32 of the id as text, mod `mod`, is not `held`. A null id never teaches."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod != held, F.lit(False))


def draw_order(*cols: str) -> list[Column]:
    """A fixed pseudo-random order of rows: by a hash of the columns, then by the columns."""
    return [F.xxhash64(*(F.col(c) for c in cols)), *(F.col(c) for c in cols)]


def removed(spark: SparkSession, path: str) -> None:
    """Removes a written folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
