"""Aggregations over vectors, probabilities, label maps and regions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.functions import columns, kernels


def _dims(df: DataFrame, keys: list[str], col, value: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("dim", value))


def mean_vectors(df: DataFrame, keys: list[str], col: str = "feat", unit: bool = True, eps: float = 1e-12) -> DataFrame:
    """(keys, dim, v): elementwise mean of (unit) vectors, not normalised again; partial sums absorb hot keys."""
    if unit:
        from patchlake.operators.rowmath import l2_normalize

        df = l2_normalize(df.select(*keys, col), col, eps)
    return _dims(df, keys, col).groupBy(*keys, "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))


def gather(df: DataFrame, keys: list[str], out: str = "feat") -> DataFrame:
    """(keys, dim, v) rows back to one array per key."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("_p")).select(*keys, F.col("_p.v").alias(out))


def stitch_tiles(tile_feats: DataFrame, col: str = "feat") -> DataFrame:
    """(image_id, y, x, dim, v): mean of the overlapping tile features of each location.

    One group an image: vectors are shuffled whole and added there, as nearly every location has keys of its own.
    """
    cell = ["image_id", "y", "x"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = group["y"].to_numpy(np.int64) * (int(group["x"].max()) + 1) + group["x"].to_numpy(np.int64)
        place, first, own = np.unique(at, return_index=True, return_inverse=True)
        total = np.zeros((len(place), len(group[col].iloc[0])))
        np.add.at(total, own, kernels.rows(group[col]))
        return group[cell].iloc[first].assign(feat=list(total / np.bincount(own)[:, None]))

    schema = ", ".join(f"{c} {tile_feats.schema[c].dataType.simpleString()}" for c in cell) + ", feat array<double>"
    return _dims(tile_feats.select(*cell, col).groupBy("image_id").applyInPandas(run, schema), cell, "feat")


def max_per_class(probs: DataFrame) -> DataFrame:
    return probs.groupBy("image_id", "class_id").agg(F.max("p").alias("max_p"))


def region_stats(df: DataFrame) -> DataFrame:
    """Of cells (image_id, class_id, region_id, y, x, p): area, mean score, inclusive box, and the first best point in raster order."""
    best = F.max_by(F.struct("x", "y"), F.struct(F.col("p"), -F.col("y"), -F.col("x")))
    out = df.groupBy("image_id", "class_id", "region_id").agg(F.count("*").alias("area"), F.avg("p").alias("score"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), best.alias("_b"))
    return out.select("*", F.col("_b.x").alias("px"), F.col("_b.y").alias("py")).drop("_b")


def filter_regions(stats: DataFrame, class_max: DataFrame, coarse_thresh: float, min_area: int = 225) -> DataFrame:
    """Regions of at least min_area cells whose class's greatest probability in the image is not under coarse_thresh."""
    strong = class_max.filter(~(F.col("max_p") < coarse_thresh)).select("image_id", "class_id")
    return stats.filter(F.col("area") >= min_area).join(strong, ["image_id", "class_id"], "left_semi")


def confusion_matrix(pred: DataFrame, gt: DataFrame, ignore: int = 255) -> DataFrame:
    """(gt, pred, n) over cells of both maps; ignored truth is dropped before the join."""
    p = pred.select("image_id", "y", "x", F.col("class_id").alias("pred"))
    return gt.filter(F.col("gt") != ignore).join(p, ["image_id", "y", "x"]).groupBy("gt", "pred").agg(F.count("*").alias("n"))


def iou_metrics(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, class_id, intersect, gt_n, pred_n, iou, acc) for each class; iou is null for a class without cells."""
    by = by or []
    rows = confusion.groupBy(*by, F.col("gt").alias("class_id")).agg(F.sum("n").alias("gt_n"))
    cols = confusion.groupBy(*by, F.col("pred").alias("class_id")).agg(F.sum("n").alias("pred_n"))
    hits = confusion.filter("gt = pred").groupBy(*by, F.col("gt").alias("class_id")).agg(F.sum("n").alias("intersect"))
    keys = [*by, "class_id"]
    out = rows.join(cols, keys, "full").join(hits, keys, "left").fillna(0, ["gt_n", "pred_n", "intersect"])
    iou = F.try_divide("intersect", F.col("gt_n") + F.col("pred_n") - F.col("intersect"))
    return out.withColumns({"iou": iou, "acc": F.try_divide("intersect", "gt_n")})


def summary_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, metric, value) with mIoU, mAcc over classes that the truth holds, and aAcc."""
    own = metrics.filter("gt_n > 0")
    grouped = own.groupBy(*(by or [])).agg(F.avg("iou").alias("mIoU"), F.avg("acc").alias("mAcc"), F.try_divide(F.sum("intersect"), F.sum("gt_n")).alias("aAcc"))
    return grouped.select(*(by or []), F.explode(F.create_map(*[x for m in ("mIoU", "mAcc", "aAcc") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))


def metric_report(*metrics: DataFrame) -> DataFrame:
    """Mean value of each metric by dataset and resolution over all runs."""
    return reduce(DataFrame.unionByName, metrics).groupBy("dataset", "resolution", "metric").agg(F.avg("value").alias("value"), F.count("*").alias("runs"))


def merge_masks(masks: DataFrame, probs: DataFrame, thresh: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Refined scores (image_id, y, x, class_id, p) and map (…, class_id) of masks (logit per cell).

    Per class and cell: the greatest sigmoid(logit) * probability over the masks where any of them is on, else 0; the class of a
    cell is the one of the greatest score, ties to the lowest, and 0 where all scores are 0.
    """
    keys = ["image_id", "y", "x", "class_id"]
    joined = masks.join(probs, keys).withColumn("s", columns.sigmoid("logit") * F.col("p"))
    scores = joined.groupBy(*keys).agg(F.when(F.max(F.col("logit") > thresh), F.max("s")).otherwise(0.0).alias("p"))
    best = F.when(F.max("p") > 0, columns.pick("class_id", "p", "class_id")).otherwise(0).alias("class_id")
    return scores, scores.groupBy("image_id", "y", "x").agg(best)
