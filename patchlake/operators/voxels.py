"""Voxel maps of 3-D scenes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.sources.storage import materialize

VOXEL = ["vx", "vy", "vz"]


def sample_frames(points: DataFrame, skip: int = 10) -> DataFrame:
    """Points of the frames with frame % skip = 0."""
    return points.filter(F.col("frame") % skip == 0)


def cap_points(points: DataFrame, n: int = -1, by: tuple[str, ...] = ("scene", "frame"), order: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """At most n points of each frame, in order of a hash of `order` and then of order itself; -1 keeps all."""
    if n < 0:
        return points
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in order]).cast("binary")), *order)
    return points.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def cells(points: DataFrame, size: float = 0.05) -> DataFrame:
    return points.withColumns({f"v{c}": F.floor(F.col(c) / size) for c in "xyz"})


def voxelize(points: DataFrame, size: float = 0.05, value: str = "f") -> DataFrame:
    """(scene, vx, vy, vz, cnt, value): points and mean feature of each cell floor(coordinate / size)."""
    return cells(points, size).groupBy("scene", *VOXEL).agg(F.count("*").alias("cnt"), F.avg(value).alias(value))


def knn_voxels(gt: DataFrame, pred: DataFrame, k: int = 5, radius: int | None = None) -> DataFrame:
    """(gt columns, rank, px, py, pz): the k nearest predicted voxels of each truth voxel of the scene, by distance, then coordinates.

    k = 0 asks for equal coordinates only. Voxels are joined by cubes of `radius` cells a side (by default one that holds about 2 k predicted voxels of a scene
    at even density) with the 27 around; a truth voxel
    whose k-th candidate is not within the radius is tried again with twice the radius, until the cubes reach across the whole space; only
    voxels of scenes with fewer than k predicted ones, and far outliers, come to that.
    """
    p = pred.select("scene", *[F.col(c).alias(f"p{c[1]}") for c in VOXEL])
    if k == 0:
        return gt.join(p, (gt.scene == p.scene) & (gt.vx == p.px) & (gt.vy == p.py) & (gt.vz == p.pz)).drop(p.scene).withColumn("rank", F.lit(1))
    key = ["scene", *VOXEL]
    w = Window.partitionBy(*key).orderBy("_d", "px", "py", "pz")
    cube = lambda names, r: [F.floor(F.col(c) / r).alias(f"_{c[1]}") for c in names]
    ends = [f(c).alias(f"{n}{c}") for c in VOXEL for n, f in (("a", F.min), ("b", F.max))]
    both = gt.select("scene", *VOXEL, F.lit(0).alias("_p")).unionByName(pred.select("scene", *VOXEL, F.lit(1).alias("_p")))
    span = both.agg(*ends, F.sum("_p").alias("n"), F.count_distinct("scene").alias("scenes")).first()
    sides = [span[f"b{c}"] - span[f"a{c}"] + 1 for c in VOXEL if span[f"a{c}"] is not None]
    widest = max(sides, default=1)
    if radius is None:
        radius = max(1, math.ceil((2 * k * math.prod(sides) * max(1, span["scenes"]) / max(1, span["n"] or 0)) ** (1 / 3)))
    done, left = [], gt
    while True:
        last = radius >= widest
        around = left
        for c, b in zip(VOXEL, cube(VOXEL, radius), strict=True):
            around = around.withColumn(f"_{c[1]}", F.explode(F.array(b - 1, b, b + 1)))
        near = around.join(p.select("*", *cube(["px", "py", "pz"], radius)), ["scene", "_x", "_y", "_z"]).drop("_x", "_y", "_z")
        near = near.withColumn("_d", sum(((F.col(f"v{c}") - F.col(f"p{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
        ranked = materialize(near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "near")
        if last:
            done.append(ranked)
            break
        sure = ranked.groupBy(*key).agg(F.max("_d").alias("_m"), F.count("*").alias("_c")).filter((F.col("_c") >= k) & (F.col("_m") <= radius**2)).select(*key)
        done.append(ranked.join(sure, key, "left_semi"))
        left = materialize(left.join(sure, key, "left_anti"), "left")
        if left.isEmpty():
            break
        radius *= 2
    return reduce(DataFrame.unionByName, done).drop("_d")


def query_voxels(probs: DataFrame, pred_thresh: float = 0.1, denoise: float = 0.5) -> DataFrame:
    """(scene, vx, vy, vz, class_id, p) from class probabilities of voxels: denoised over the scene, best class, low ones ignored."""
    from patchlake.operators import rowmath, windows

    clean = windows.denoise_prompts(probs, denoise, "scene")
    return rowmath.apply_ignore(windows.argmax_class(clean, ["scene", *VOXEL]), pred_thresh)


def evaluate_scenes(pred: DataFrame, gt: DataFrame, k: int = 0, excluded: DataFrame | None = None) -> DataFrame:
    """IoU rows by scene of voxel classes; a truth voxel takes the majority class of its k nearest (then the nearest), k = 0: its own."""
    from patchlake.operators.aggregates import iou_metrics

    if excluded is not None:
        gt = gt.join(excluded, "class_id", "left_anti")
    near = knn_voxels(gt.select("scene", *VOXEL, F.col("class_id").alias("gt")), pred, k)
    named = near.join(pred.select("scene", *[F.col(c).alias(f"p{c[1]}") for c in VOXEL], F.col("class_id").alias("pred")), ["scene", "px", "py", "pz"])
    votes = named.groupBy("scene", *VOXEL, "gt", "pred").agg(F.count("*").alias("n"), F.min("rank").alias("r"))
    won = votes.groupBy("scene", *VOXEL, "gt").agg(F.max_by("pred", F.struct("n", -F.col("r"))).alias("pred"))
    return iou_metrics(won.groupBy("scene", "gt", "pred").agg(F.count("*").alias("n")), ["scene"])


def exclude_classes(df: DataFrame, ignored: DataFrame) -> DataFrame:
    return df.join(ignored, "class_id", "left_anti")
