"""The stateful voxel map against one batch over all points, with restarts and snapshots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.operators.voxels import cells
from patchlake.streaming import features

SCHEMA = "scene int, x double, y double, z double, feat array<double>"


def points(rng, n):
    return [(int(rng.integers(0, 2)), *(rng.random(3) * 0.2).tolist(), rng.standard_normal(3).tolist()) for _ in range(n)]


def whole(spark, rows):
    df = cells(spark.createDataFrame(rows, SCHEMA).dropna(), 0.05)
    dims = [F.sum(F.col("feat")[i]).alias(f"d{i}") for i in range(3)]
    return {(r.scene, r.vx, r.vy, r.vz): (r.n, [r.d0, r.d1, r.d2]) for r in df.groupBy("scene", "vx", "vy", "vz").agg(F.count("*").alias("n"), *dims).collect()}


def check(spark, table, rows):
    want, got = whole(spark, rows), features.latest_features(spark, table).collect()
    assert len(got) == len(want)
    for r in got:
        n, total = want[r.scene, r.vx, r.vy, r.vz]
        assert r.cnt == n and np.allclose(r.total, total, atol=1e-9)


def test_stream_equals_batch_over_restarts_and_reads_one_snapshot(spark, tmp_path):
    rng, rows = np.random.default_rng(1), []
    place, table, checkpoint = (str(tmp_path / n) for n in ("points", "table", "checkpoint"))
    for turn in range(3):
        new = points(rng, 200) + [(None, 0.1, 0.1, 0.1, [1.0, 1.0, 1.0]), (1, None, 0.1, 0.1, [1.0, 1.0, 1.0]), (1, 0.1, 0.1, 0.1, None)] * (turn == 0)
        spark.createDataFrame(new, SCHEMA).repartition(2).write.mode("append").parquet(place)
        rows += new
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(place)
        features.run_features(stream, table, checkpoint, every=4)
        check(spark, table, rows)
    last, later = features._parts(spark, table)
    assert last == 3 and later == [4, 5]
    files = features.latest_features(spark, table).inputFiles()
    assert files and not any(f"batch={n:08d}" in f for f in files for n in range(4))


def test_nothing_written_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no change"):
        features.latest_features(spark, str(tmp_path / "none"))
