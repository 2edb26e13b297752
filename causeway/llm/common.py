"""Shared pieces: stage tables in the cluster's shared folder, row keys, Arrow functions with bounded memory."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a null id sorts as: after every other id.
NULL_ID = 9223372036854775807
#: Batches by bytes rather than rows: the default of 10,000 (4,096 in the scan) whole texts is tens of MB in the JVM and again in Python.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def handed_back() -> None:
    """Gives a Python worker's free memory back to the system: workers are used again by later stages, and so are their free lists."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mapped(df: DataFrame, function: Callable, ddl: str) -> DataFrame:
    """``mapInArrow`` with batches that are bounded by bytes; a worker keeps no memory beyond its partition."""
    for key, value in BATCHES.items():
        df.sparkSession.conf.set(key, value)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            handed_back()

    return df.mapInArrow(run, ddl)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or for one machine's tests, where it is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="causeway-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: the folder belongs to the cluster's job space, and the session may already be gone."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/causeway/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def without_reserved(df: DataFrame) -> DataFrame:
    """Names that begin with an underscore are the operators' own."""
    return df.drop(*(c for c in df.columns if c.startswith("_")))


def sortable_id(col: str) -> Column:
    """The id as a long that sorts nulls last."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def slices(batches: Iterator[pa.RecordBatch], size_of: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column ``size_of`` holds about ``most`` bytes; one longer value is a batch of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(size_of)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
