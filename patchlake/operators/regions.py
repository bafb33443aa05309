"""Connected regions, boxes and their suppression. Groups are single images (or image and class), tiles or cells of them, never a corpus."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlake.functions import kernels
from patchlake.sources.storage import materialize


def connected_regions(mask: DataFrame, keys: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    """(keys, y, x, region_id) of the cells in mask: 8-connected regions, numbered from 1 in raster order of the first cell."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y, x = group["y"].to_numpy(), group["x"].to_numpy()
        field = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        field[y - y.min(), x - x.min()] = True
        return group.assign(region_id=kernels.components(field)[y - y.min(), x - x.min()])

    cells = mask.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    schema = ", ".join(f"{k} long" for k in keys) + ", y int, x int, region_id int"
    return cells.groupBy(*keys).applyInPandas(run, schema)


def heatmap_boxes(grid: DataFrame, min_frac: float = 0.005, value: str = "v") -> DataFrame:
    """(image_id, k, x1, y1, x2, y2, score): rectangles (exclusive x2, y2) around outer regions at eight thresholds.

    Those of more than min_frac of the grid's area stay; score is the greatest value inside the whole rectangle.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        h, w = group["y"].max() + 1, group["x"].max() + 1
        heat = np.full((h, w), -np.inf)
        heat[group["y"], group["x"]] = group[value]
        low, high = group[value].min(), group[value].max()
        out = []
        for k in range(2, 10):
            label = kernels.outer_components(heat > low + k * 0.1 * (high - low))
            for i in np.unique(label[label > 0]):
                y, x = np.nonzero(label == i)
                y1, x1, y2, x2 = y.min(), x.min(), y.max() + 1, x.max() + 1
                if (y2 - y1) * (x2 - x1) > min_frac * h * w:
                    out.append((group["image_id"].iloc[0], k, x1, y1, x2, y2, heat[y1:y2, x1:x2].max()))
        return pd.DataFrame(out, columns=["image_id", "k", "x1", "y1", "x2", "y2", "score"])

    cells = grid.select(F.col("image_id").cast("long").alias("image_id"), "y", "x", F.col(value).cast("double").alias(value))
    return cells.groupBy("image_id").applyInPandas(run, "image_id long, k int, x1 int, y1 int, x2 int, y2 int, score double")


def box_iou_pairs(boxes: DataFrame) -> DataFrame:
    """(image_id, a, b, iou) of the overlapping pairs a < b of each image's boxes."""
    side = lambda n: boxes.select("image_id", *[F.col(c).alias(f"{n}_{c}") for c in ("box_id", "x1", "y1", "x2", "y2")])
    j = side("a").join(side("b"), "image_id").filter("a_box_id < b_box_id AND a_x1 < b_x2 AND b_x1 < a_x2 AND a_y1 < b_y2 AND b_y1 < a_y2")
    both = (F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")) * (F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1"))
    area = lambda n: (F.col(f"{n}_x2") - F.col(f"{n}_x1")) * (F.col(f"{n}_y2") - F.col(f"{n}_y1"))
    return j.select("image_id", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), F.try_divide(both, area("a") + area("b") - both).alias("iou"))


#: Side of the tiles of a grid, and boxes, that one task answers at once.
SIDE, BOXES = 2048, 500_000


def box_max_score(boxes: DataFrame, grid: DataFrame, value: str = "v", side: int = SIDE) -> DataFrame:
    """(image_id, box_id, score): greatest value of the cells x1 <= x < x2, y1 <= y < y2; boxes without a cell drop out.

    Grids go in tiles of side x side cells and a box to the tiles that it meets; a tile answers its boxes from a table of maxima by
    four reads each, whatever their area. Tiles of very many boxes are dealt to several tasks. Null values don't count; rows of
    boxes that share image_id and box_id give their common greatest value.
    """
    cells = grid.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias("v")).dropna()
    cells = cells.withColumns({"ty": F.floor(F.col("y") / side), "tx": F.floor(F.col("x") / side)})
    asked = boxes.select("image_id", "box_id", *[F.ceil(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")]).dropna().filter("x1 < x2 AND y1 < y2")
    ends = cells.groupBy("image_id").agg(*[f(c).alias(f"_{n}{c}") for c in "yx" for n, f in (("a", F.min), ("b", F.max))])
    asked = asked.join(ends, "image_id")
    for c in "yx":
        asked = asked.withColumns({f"{c}1": F.greatest(f"{c}1", f"_a{c}"), f"{c}2": F.least(f"{c}2", F.col(f"_b{c}") + 1)})
    asked = asked.filter("x1 < x2 AND y1 < y2")
    for c in "yx":
        asked = asked.withColumn(f"t{c}", F.explode(F.sequence(F.floor(F.col(f"{c}1") / side), F.floor((F.col(f"{c}2") - 1) / side))))
    tile = ["image_id", "ty", "tx"]
    asked = asked.select(*tile, "box_id", "x1", "y1", "x2", "y2")
    parts = asked.groupBy(*tile).agg((F.expr(f"count(*) DIV {BOXES}") + 1).alias("_parts"))
    asked = asked.join(parts, tile).withColumn("part", F.pmod(F.xxhash64("box_id"), F.col("_parts"))).drop("_parts")
    cells = cells.join(parts, tile).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    kinds = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in ("image_id", "box_id"))

    def answer(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(held):
            return own[["image_id", "box_id"]].iloc[:0].assign(score=0.0)
        y, x = held["y"].to_numpy(), held["x"].to_numpy()
        top, left = y.min(), x.min()
        field = np.full((y.max() - top + 1, x.max() - left + 1), -np.inf)
        np.maximum.at(field, (y - top, x - left), held["v"].to_numpy())
        y1, x1 = (np.clip(own[f"{c}1"].to_numpy() - o, 0, n) for c, o, n in (("y", top, len(field)), ("x", left, field.shape[1])))
        y2, x2 = (np.clip(own[f"{c}2"].to_numpy() - o, 0, n) for c, o, n in (("y", top, len(field)), ("x", left, field.shape[1])))
        some = (y1 < y2) & (x1 < x2)
        out = own.loc[some, ["image_id", "box_id"]].assign(score=kernels.range_max(field, y1[some], x1[some], y2[some], x2[some]))
        return out[out["score"] != -np.inf]

    both = asked.groupBy(*tile, "part").cogroup(cells.groupBy(*tile, "part"))
    return both.applyInPandas(answer, f"{kinds}, score double").groupBy("image_id", "box_id").agg(F.max("score").alias("score"))


def nms(boxes: DataFrame, iou: float = 0.2) -> DataFrame:
    """Boxes (image_id, box_id, x1, y1, x2, y2, score) that stay per image; equal scores go by box_id."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keep = kernels.nms(group[["x1", "y1", "x2", "y2"]].to_numpy(float), group["score"].to_numpy(float), group["box_id"].to_numpy(), iou)
        return group[keep]

    names = ["image_id", "box_id", "x1", "y1", "x2", "y2", "score"]
    rows = boxes.select(*[F.col(c).cast("long" if c.endswith("id") else "double").alias(c) for c in names])
    return rows.groupBy("image_id").applyInPandas(run, "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double, score double")


#: Best boxes of a cell that a round compares with each other.
CELL_BEST = 24


def _over(p: Column, q: Column, iou: float) -> Column:
    """Whether two boxes (structs) overlap by more than iou."""
    w, h = F.least(p["x2"], q["x2"]) - F.greatest(p["x1"], q["x1"]), F.least(p["y2"], q["y2"]) - F.greatest(p["y1"], q["y1"])
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    return (w > 0) & (h > 0) & (w * h / (area(p) + area(q) - w * h) > iou)


def nms_rounds(boxes: DataFrame, iou: float = 0.2, best: int = CELL_BEST) -> DataFrame:
    """What nms gives, for any number of boxes in an image: rounds that keep boxes without a better overlapping neighbour and drop what those suppress.

    A box (its longer side between 2^l and 2^(l+1)) stands in the square cells of side 2^l that it meets and, as visitor, in those of the
    coarser levels up to 1 / iou times the side, beyond which nothing overlaps enough; so two boxes that may suppress each other share a cell. A round looks
    at the `best` boxes of every cell. One that is among them in all its cells and overlaps no better one there is kept; boxes that
    overlap a kept one go. The best box left of an image is always kept, so rounds come to an end. Only a cell's best boxes meet in one
    place, and what is dropped is found by a semi-join. Boxes without an area stay, as do those with a null or non-finite corner; equal
    scores go by box_id, null and NaN scores come last.
    """
    if iou < 0:
        raise ValueError(f"an overlap under 0: {iou}")
    names = ["image_id", "box_id", "x1", "y1", "x2", "y2", "score"]
    rows = boxes.select(*[F.col(c).cast("long" if c.endswith("id") else "double").alias(c) for c in names])
    held = materialize(rows.withColumn("num", F.monotonically_increasing_id()), "boxes")
    finite = reduce(lambda p, q: p & q, [F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) for c in ("x1", "y1", "x2", "y2")])
    real = finite & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    level = F.floor(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))))
    alive = held.filter(real).withColumn("l", level)
    span = alive.agg(F.min("l"), F.max("l")).first()
    kept = [held.filter(~real).select(*names)]
    if span[0] is None:
        return kept[0]
    reach = span[1] - span[0] if iou == 0 else min(span[1] - span[0], math.ceil(-math.log2(min(iou, 1))) + 1)
    # greatest first: score (nulls and NaN last), then the smaller id, then the order in which the rows were read
    worth = F.struct(F.coalesce(F.nanvl("score", F.lit(None).cast("double")), F.lit(float("-inf"))).alias("s"), (-F.col("box_id")).alias("i"), (-F.col("num")).alias("n"))
    alive = alive.select("image_id", F.col("l"), F.struct("x1", "y1", "x2", "y2").alias("b"), worth.alias("w"), "num")
    cell = ["image_id", "g", "cy", "cx"]
    at = lambda c, g: F.floor(F.col(c) / F.pow(F.lit(2.0), g))
    placed = alive.withColumn("g", F.explode(F.sequence(F.col("l"), F.least(F.col("l") + reach, F.lit(span[1])))))
    for c in "yx":
        placed = placed.withColumn(f"c{c}", F.explode(F.sequence(at(f"b.{c}1", F.col("g")), at(f"b.{c}2", F.col("g")))))
    members = materialize(placed.select(*cell, "num", "b", "w"), "members")
    chosen = []
    while True:
        rank = Window.partitionBy(*cell).orderBy(F.desc("w"))
        top = members.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= best)
        lists = top.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("w", "num", "b")), asc=False).alias("t"))
        # a box of the list is beaten by one that stands before it and overlaps it
        told = F.transform("t", lambda o, i: F.struct(o["num"].alias("num"), F.exists(F.slice(F.col("t"), F.lit(1), i), lambda x: _over(x["b"], o["b"], iou)).alias("no")))  # noqa: B023
        free = lists.select(F.explode(told).alias("o")).select("o.*").groupBy("num").agg(F.count("*").alias("c"), F.max("no").alias("no")).filter("not no")
        cells = members.groupBy("num").agg(F.count("*").alias("all"))
        won = materialize(free.join(cells, "num").filter(F.col("c") == F.col("all")).select("num"), "won")
        if won.isEmpty():
            break
        chosen.append(won)
        winners = members.join(won, "num", "left_semi").select(*cell, F.col("b").alias("k"))
        beside = reduce(lambda p, q: p & q, [F.col(c) == F.col(f"_{c}") for c in cell])
        gone = members.join(winners.withColumnsRenamed({c: f"_{c}" for c in cell}), beside & _over(F.col("b"), F.col("k"), iou), "left_semi")
        dead = gone.select("num").distinct().unionByName(won)
        members = materialize(members.join(dead, "num", "left_anti"), "members")
    kept.append(held.join(reduce(DataFrame.unionByName, chosen), "num", "left_semi").select(*names))
    return reduce(DataFrame.unionByName, kept)


def top_k(boxes: DataFrame, k: int = 10) -> DataFrame:
    """The k best boxes of each image with their rank from 1."""
    ranked = boxes.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "box_id")))
    return ranked.filter(F.col("rank") <= k)


def union_regions(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_by_mask_score(regions: DataFrame, thresh: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Regions whose score is over thresh, and the failed rest (a null score fails)."""
    good = F.coalesce(F.col("score") > thresh, F.lit(False))
    return regions.filter(good), regions.filter(~good)


def fallback_prediction(scores: DataFrame, refined: DataFrame, coarse: DataFrame) -> DataFrame:
    """(image_id, y, x, class_id): the refined class where refined scores sum to more than 0, else the coarse one.

    An image without a refined row keeps its coarse map whole.
    """
    keys = ["image_id", "y", "x"]
    told = scores.groupBy(*keys).agg(F.sum("p").alias("_s")).filter("_s <> 0")
    new = refined.join(told, keys, "left_semi").select(*keys, F.col("class_id").alias("_new"))
    return coarse.join(new, keys, "left").select(*keys, F.coalesce("_new", "class_id").alias("class_id"))


def restore_failed(scores: DataFrame, failed: DataFrame, coarse: DataFrame) -> DataFrame:
    """Scores (image_id, y, x, class_id, p): in cells of failed regions the greater of refined and coarse; elsewhere as they are.

    The class map never changes: scores are raised to the failed ones before the two maxima are compared.
    """
    keys = ["image_id", "y", "x"]
    area = coarse.join(failed.select(*keys).distinct(), keys, "left_semi").select(*keys, "class_id", F.col("p").alias("_c"))
    out = scores.join(area, [*keys, "class_id"], "full")
    return out.select(*keys, "class_id", F.greatest(F.coalesce("p", F.lit(0.0)), F.coalesce("_c", F.lit(0.0))).alias("p"))
