"""Tables between the steps of a plan, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _remove(spark: SparkSession, path: str) -> None:
    """At the end of the job; nothing is lost if the session has gone first."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under spark.checkpoint.dir and read again: no lineage, safe against a lost executor."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="causeway-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/causeway/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``, 0 to n - 1 in the given order: sorted by ranges and written, then each part's rows are counted on from those before it."""
    low = (1 << 33) - 1
    parts = stage(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(low)}), "numbered")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each part
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")
