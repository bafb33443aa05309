"""Where queries keep tables that they write."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a local master (tests) and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="patchlake-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_end_with_their_write(spark: SparkSession):
    """A write's shuffle files are of no use once its table stands; Spark then drops them itself."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage of iterative operators."""
    path = new_path(df.sparkSession, tag)
    with _shuffles_end_with_their_write(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_index(df: DataFrame, by: list[str], out: str = "idx", kind: str = "int") -> DataFrame:
    """Adds the row's number from 0 in order of `by`, without a task that sees all rows.

    Rows are dealt to ranges and written with their range's number; only the ranges' counts are added up in one place.
    """
    dealt = materialize(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1)
    return own.join(before, "_range").withColumn(out, (F.col("_before") + F.col("_own")).cast(kind)).drop("_range", "_before", "_own")
