"""Incremental voxel maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.operators.voxels import VOXEL, cells


def accumulate_voxels(stream: DataFrame, size: float = 0.05, value: str = "f") -> DataFrame:
    """Running (scene, vx, vy, vz, cnt, total) of a stream of points; the state is one row per occupied voxel.

    There is no event time, hence no watermark: write it in update mode and keep the latest row of each voxel. Sums are
    added in any order, so the result of all batches is that of one batch.
    """
    return cells(stream, size).groupBy("scene", *VOXEL).agg(F.count("*").alias("cnt"), F.sum(value).alias("total"))


def run_available(stream: DataFrame, table: str, checkpoint: str, size: float = 0.05, value: str = "f") -> None:
    """Folds all that is available into the table at path `table`: each micro-batch writes the state of the voxels it changed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number:08d}")

    query = accumulate_voxels(stream, size, value).writeStream.outputMode("update").foreachBatch(write)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark, table: str) -> DataFrame:
    """The newest state of each voxel."""
    rows = spark.read.parquet(table)
    return rows.groupBy("scene", *VOXEL).agg(F.max_by(F.struct("cnt", "total"), "batch").alias("s")).select("scene", *VOXEL, "s.*")
