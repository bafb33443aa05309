"""Voxel maps with feature vectors from a stream: one state per occupied voxel, and a table of changes with snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from patchlake.functions import kernels
from patchlake.operators.voxels import VOXEL, cells

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["scene", *VOXEL]
STATE = "cnt long, total array<double>"


class VoxelSums(StatefulProcessor):
    """Number of points and sum of their features of one voxel; a changed voxel gives its new state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.sums.get()
        count, total = (0, None) if held is None else (held[0], np.array(held[1], float))
        for pdf in rows:
            more = kernels.rows(pdf["total"]).sum(0)
            if total is not None and len(total) != len(more):
                raise ValueError(f"vectors of different dimensions: {len(total)} and {len(more)}")
            count, total = count + int(pdf["cnt"].sum()), more if total is None else total + more
        self.sums.update((count, total.tolist()))
        yield pd.DataFrame({**{k: [v] for k, v in zip(KEY, key, strict=True)}, "cnt": [count], "total": [total.tolist()]})

    def close(self) -> None:
        pass


def accumulate_features(stream: DataFrame, size: float = 0.05, feat: str = "feat") -> DataFrame:
    """Running (scene, vx, vy, vz, cnt, total) of a stream of points (scene, x, y, z, feat), for update mode; total is the sum of the feature vectors.

    Points are added up within each Arrow batch first, so a voxel that holds many of them sends few rows to its state. The state is kept by RocksDB, whose
    provider the session must name (PROVIDER); run_features sets it. Points with a null scene, place or feature are left out.
    """
    kind = stream.schema["scene"].dataType.simpleString()
    schema = f"scene {kind}, vx long, vy long, vz long, {STATE}"

    def partial(batches):
        for pdf in batches:
            if len(pdf):
                places = pdf.groupby(KEY, sort=False).ngroup().to_numpy()
                x = kernels.rows(pdf["feat"])
                total = np.zeros((places.max() + 1, x.shape[1]))
                np.add.at(total, places, x)
                _, first = np.unique(places, return_index=True)
                yield pdf[KEY].iloc[first].assign(cnt=np.bincount(places), total=list(total))

    placed = cells(stream.select("scene", "x", "y", "z", F.col(feat).cast("array<double>").alias("feat")).dropna(), size).select(*KEY, "feat")
    sums = placed.mapInPandas(partial, schema)
    return sums.groupBy(*KEY).transformWithStateInPandas(VoxelSums(), schema, "Update", "None")


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the folders name=N that have been written to the end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith(f"{name}=")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _parts(spark: SparkSession, table: str, upto: int | None = None) -> tuple[int | None, list[int]]:
    """The newest snapshot and the numbers of the changes after it, up to a number if one is given."""
    inside = lambda xs: [x for x in xs if upto is None or x <= upto]
    snapshots = inside(_numbers(spark, f"{table}/snapshots", "upto"))
    last = snapshots[-1] if snapshots else None
    return last, [n for n in inside(_numbers(spark, f"{table}/changes", "batch")) if last is None or n > last]


def latest_features(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    """The newest state of each voxel of the table at path `table`: the newest snapshot and the changes after it are read, nothing before.

    A table without any change is an error.
    """
    last, changes = _parts(spark, table, upto)
    paths = [f"{table}/snapshots/upto={last:08d}"] if last is not None else []
    paths += [f"{table}/changes/batch={n:08d}" for n in changes]
    if not paths:
        raise ValueError(f"no change has been written to {table}")
    rows = spark.read.parquet(*paths)
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("cnt", "total"), "number").alias("s")).select(*KEY, "s.*")


def run_features(stream: DataFrame, table: str, checkpoint: str, size: float = 0.05, feat: str = "feat", every: int = 10) -> None:
    """Folds all that is available into the table: each micro-batch writes the voxels that it changed, each `every` of them a snapshot of all.

    A batch that is run again after a loss writes the same folders anew, and only folders that have been written to the end are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/changes/batch={number:08d}")
        if (number + 1) % every == 0:
            last, changes = _parts(spark, table, number)
            if changes:
                whole = latest_features(spark, table, number).withColumn("number", F.lit(number).cast("long"))
                whole.write.mode("overwrite").parquet(f"{table}/snapshots/upto={number:08d}")

    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        query = accumulate_features(stream, size, feat).writeStream.outputMode("update").foreachBatch(write)
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
