"""Computations over groups that keep the rows: softmax, scaling, denoising, argmax."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.functions import columns
from patchlake.sources.storage import materialize


def softmax(df: DataFrame, keys: list[str], value: str = "sim", temp: float = 100.0, out: str = "p") -> DataFrame:
    """exp(temp * value) over its sum within keys, shifted by the maximum; groups are the classes of one row."""
    w = Window.partitionBy(*keys)
    e = df.withColumn("_e", F.exp(temp * (F.col(value) - F.max(value).over(w))))
    return e.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def contrast_prob(df: DataFrame, positive: str, negative: str, temp: float = 50.0) -> DataFrame:
    """p of the positive column in a softmax of two."""
    return df.withColumn("p", columns.sigmoid(temp * (F.col(positive) - F.col(negative))))


def _joined(df: DataFrame, keys: list[str], *aggregates) -> DataFrame:
    """df with aggregates over keys; joined instead of a window, as a group here is a whole image."""
    return df.join(df.groupBy(*keys).agg(*aggregates), keys)


def scale_by_max(df: DataFrame, value: str = "sim") -> DataFrame:
    """value over its maximum in the image (null where that is 0). The rows are written as a table, as they are read for the maxima and again."""
    return _joined(materialize(df, "scores"), ["image_id"], F.max(value).alias("_m")).withColumn("scaled", F.try_divide(value, "_m")).drop("_m")


def minmax_scale(df: DataFrame, value: str = "v", eps: float = 1e-8, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    wide = _joined(df, list(keys), F.min(value).alias("_a"), F.max(value).alias("_b"))
    return wide.withColumn("scaled", (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a") + eps)).drop("_a", "_b")


def denoise_prompts(probs: DataFrame, thresh: float = 0.5, scope: str = "image_id") -> DataFrame:
    """Probability 0 everywhere for a class whose maximum over the image (or scene) is under thresh."""
    return _joined(probs, [scope, "class_id"], F.max("p").alias("_m")).withColumn("p", F.when(F.col("_m") < thresh, 0.0).otherwise(F.col("p"))).drop("_m")


def argmax_class(probs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class_id, p): the best class, ties to the lowest."""
    return probs.groupBy(*keys).agg(columns.pick("class_id", "p", "class_id").alias("class_id"), F.max("p").alias("p"))
