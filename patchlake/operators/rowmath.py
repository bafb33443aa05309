"""Projections and per-row arithmetic: normalising, planning of sizes, thresholds, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.functions import columns


def l2_normalize(df: DataFrame, col: str = "feat", eps: float = 1e-12) -> DataFrame:
    """col as a unit vector of doubles; a zero vector stays zero."""
    return df.withColumn("_n", F.greatest(columns.norm(col), F.lit(eps))).withColumn(col, F.transform(col, lambda x: x.cast("double") / F.col("_n"))).drop("_n")


def normalize_pixels(df: DataFrame, mean: list[float], std: list[float], col: str = "rgb", swap_rb: bool = False, scale: float = 1.0) -> DataFrame:
    """(v * scale - mean) / std by channel; channels are reversed first if asked."""
    v = F.reverse(col) if swap_rb else F.col(col)
    pairs = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, std, strict=True)])
    return df.withColumn(col, F.zip_with(v, pairs, lambda x, p: (x.cast("double") * scale - p["m"]) / p["s"]))


def _up(c, step: int):
    return F.ceil(c / step).cast("int") * step


def resize_plan(df: DataFrame, stride: int = 224, crop: int = 336) -> DataFrame:
    """new_h, new_w: as they are if both divide by stride; else the longer side goes up to a multiple of it, the other along, both up again, and crop at least."""
    longer = F.greatest("h", "w")
    target = _up(longer, stride)
    side = lambda c: F.greatest(_up((F.col(c) * target / longer).cast("int"), stride), F.lit(crop))
    fits = (F.col("h") % stride == 0) & (F.col("w") % stride == 0)
    return df.withColumns({f"new_{c}": F.when(fits, F.col(c)).otherwise(side(c)) for c in ("h", "w")})


def cap_resolution(df: DataFrame, res: int) -> DataFrame:
    """new_h, new_w scaled down so that the longer side is at most res, then down to multiples of 16; smaller images stay."""
    longer = F.greatest("h", "w")
    side = lambda c: F.floor((F.col(c) * (F.lit(float(res)) / longer)).cast("int") / 16).cast("int") * 16
    return df.withColumns({f"new_{c}": F.when(longer > res, side(c)).otherwise(F.col(c)) for c in ("h", "w")})


def square_fit_plan(df: DataFrame, target: int = 1024) -> DataFrame:
    """new_h, new_w: the longer side becomes target, the other int(side * (target / 16) / longer) * 16."""
    other = lambda a, b: (F.col(a) * (target // 16) / F.col(b)).cast("int") * 16
    tall = F.col("h") >= F.col("w")
    return df.withColumns({"new_h": F.when(tall, F.lit(target)).otherwise(other("h", "w")), "new_w": F.when(tall, other("w", "h")).otherwise(F.lit(target))})


def coarse_background(df: DataFrame, thresh: float, num_classes: int) -> DataFrame:
    """class_id becomes num_classes where p (the best) is under a positive thresh."""
    return df.withColumn("class_id", F.when(F.col("p") < thresh, F.lit(num_classes)).otherwise(F.col("class_id"))) if thresh > 0 else df


def apply_ignore(df: DataFrame, thresh: float) -> DataFrame:
    """Classes move up by one, and class 0 stands where p (the best, before refinement) is under thresh."""
    return df.withColumn("class_id", F.when(F.col("p") < thresh, F.lit(0)).otherwise(F.col("class_id") + 1))


def prepend_ignore_plane(probs: DataFrame) -> DataFrame:
    """Class probabilities (image_id, y, x, class_id, p) with classes moved up by one and a zero plane as class 0."""
    zero = probs.select("image_id", "y", "x").distinct().select("*", F.lit(0).alias("class_id"), F.lit(0.0).alias("p"))
    return probs.withColumn("class_id", F.col("class_id") + 1).unionByName(zero)


def reduce_zero_label(df: DataFrame, col: str = "gt", ignore: int = 255) -> DataFrame:
    """Label 0 becomes ignore, others move down by one, ignore stays."""
    return df.withColumn(col, F.when(F.col(col).isin(0, ignore), F.lit(ignore)).otherwise(F.col(col) - 1))


def mask_prompt(df: DataFrame, thresh: float, coeff: float = 0.005) -> DataFrame:
    return df.withColumn("p", F.when(F.col("p") > thresh, F.col("p") * coeff).otherwise(0.0))


def rescale_boxes(df: DataFrame, sx: float, sy: float) -> DataFrame:
    """Box corners, and the point (px, py) where there is one, on another grid."""
    sides = {c: s for c, s in (("x1", sx), ("x2", sx), ("px", sx), ("y1", sy), ("y2", sy), ("py", sy)) if c in df.columns}
    return df.withColumns({c: F.col(c) * s for c, s in sides.items()})


def sigmoid_scores(df: DataFrame, thresh: float = 0.0) -> DataFrame:
    """p = sigmoid(logit), on = logit > thresh."""
    return df.withColumns({"p": columns.sigmoid("logit"), "on": F.col("logit") > thresh})


def onehot_encode(df: DataFrame, class_map: DataFrame, name: str = "name", eps: float = 1e-10) -> DataFrame:
    """onehot: eps everywhere, 1 at the name's class_id; an unknown name is an error when the rows are read."""
    sized = class_map.groupBy("name").agg(F.max("class_id").alias("_id")).crossJoin(class_map.agg((F.max("class_id") + 1).alias("_n")))
    out = df.join(sized.withColumnRenamed("name", "_name"), F.col(name) == F.col("_name"), "left")
    vector = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.when(i == F.col("_id"), 1.0).otherwise(eps))
    unknown = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(name), F.lit("null"))))
    vector = F.when(F.col("_id").isNull(), unknown).otherwise(vector)
    return out.withColumn("onehot", vector).drop("_name", "_id", "_n")
