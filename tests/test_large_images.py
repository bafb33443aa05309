"""Operators that part one image over tasks: against those that hold it whole, or brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.functions import kernels
from patchlake.operators import grids, regions, rowmath, windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("h", "w", "strip"), [(11, 9, 1), (11, 9, 4), (30, 7, 8), (3, 2, 1), (5, 7, 100), (40, 3, 3)])
def test_strips_equal_the_four_operators_in_a_row(spark, h, w, strip):
    rng = np.random.default_rng(h)
    shapes, given = {0: (5, 7), 1: (1, 3), 2: (13, 2), 3: (4, 1)}, []
    for i, (n, m) in shapes.items():
        p = rng.dirichlet([0.3, 0.5, 0.1, 0.4], (n, m))
        given += [(i, y, x, k, float(p[y, x, k])) for y in range(n) for x in range(m) for k in range(4)]
    probs = spark.createDataFrame(given, "image_id long, y int, x int, class_id int, p double")
    arrays = probs.groupBy("image_id", "y", "x").agg(F.sort_array(F.collect_list(F.struct("class_id", "p"))).alias("z"))
    arrays = arrays.select("image_id", "y", "x", F.col("z.class_id").alias("class_ids"), F.col("z.p").alias("probs"), F.lit(1).alias("tops"))
    up = grids.bilinear_resize(probs.withColumnRenamed("p", "v"), h, w, keys=("class_id",)).withColumnRenamed("v", "p")
    best = windows.argmax_class(windows.denoise_prompts(up, 0.8), ["image_id", "y", "x"])
    for ignore in (None, 0.5):
        want = best if ignore is None else rowmath.apply_ignore(best, ignore)
        got = grids.upsample_labels(arrays, h, w, 0.8, ignore, strip)
        assert got.columns == ["image_id", "y", "x", "class_id", "p"]
        assert rows(got) == rows(want.select("image_id", "y", "x", "class_id", "p"))


def test_strips_ask_for_full_grids_and_take_null_for_0(spark):
    kind = "image_id long, y int, x int, class_ids array<int>, probs array<double>"
    hole = spark.createDataFrame([(1, 0, 0, [4, 6], [0.1, 0.9]), (1, 1, 1, [4, 6], [0.1, 0.9])], kind)
    with pytest.raises(Exception, match="not full"):
        grids.upsample_labels(hole, 4, 4).collect()
    empty = spark.createDataFrame([], kind)
    assert grids.upsample_labels(empty, 4, 4).collect() == []
    nulls = spark.createDataFrame([(1, 0, 0, [4, 6], [None, 0.9])], kind)
    assert rows(grids.upsample_labels(nulls, 1, 2)) == [(1, 0, 0, 6, 0.9), (1, 0, 1, 6, 0.9)]


@pytest.mark.parametrize(("stride", "crop"), [(3, 5), (5, 5), (2, 7), (4, 3)])
def test_tile_numbers_equal_the_range_join(spark, stride, crop):
    images = spark.createDataFrame([(1, 13, 9), (2, 4, 30), (3, 5, 5), (4, 8, 6)], "image_id long, h int, w int")
    cells = spark.createDataFrame([(i, y, x, "f") for i in range(1, 6) for y in range(14) for x in range(31)], "image_id long, y int, x int, h string")
    want = grids.assign_tiles(cells, grids.make_tiles(images, stride, crop, 1)).select("image_id", "y", "x", "h_idx", "w_idx")
    got = grids.tile_patches(cells, images, stride, crop, 1)
    assert got.columns == ["image_id", "y", "x", "h", "h_idx", "w_idx"]
    assert rows(got.drop("h")) == rows(want)


def test_tile_numbers_in_patches_of_pixels(spark):
    images = spark.createDataFrame([(1, 672, 336), (2, 224, 448)], "image_id long, h int, w int")
    cells = spark.createDataFrame([(i, y, x) for i in (1, 2) for y in range(42) for x in range(28)], "image_id long, y int, x int")
    want = grids.assign_tiles(cells, grids.make_tiles(images)).select("image_id", "y", "x", "h_idx", "w_idx")
    assert rows(grids.tile_patches(cells, images)) == rows(want)


def boxes_of(rng, n, wide=40.0):
    x1, y1 = rng.random(n) * wide, rng.random(n) * wide
    return x1, y1, x1 + rng.exponential(6, n), y1 + rng.exponential(6, n)


@pytest.mark.parametrize(("side", "most"), [(2048, 500_000), (7, 500_000), (1, 3)])
def test_greatest_value_of_boxes(spark, monkeypatch, side, most):
    monkeypatch.setattr(regions, "BOXES", most)
    rng = np.random.default_rng(7)
    grid = {(i, y, x): float(rng.integers(-50, 50)) for i in range(2) for y in range(23) for x in range(31) if rng.random() < 0.8}
    boxes = [(i, k, *map(float, b)) for i in range(3) for k, b in enumerate(zip(*(v - 4 for v in boxes_of(rng, 60)), strict=True))]
    boxes += [(0, 900, 3.0, 3.0, 3.0, 9.0), (0, 901, None, 0.0, 5.0, 5.0), (0, 902, 2.0, 2.0, 3.0, 3.0), (0, 902, 8.0, 8.0, 9.5, 9.5), (0, 903, -1e9, -1e9, 1e9, 1e9)]
    want = {}
    for i, k, x1, y1, x2, y2 in boxes:
        inside = [v for (j, y, x), v in grid.items() if j == i and x1 is not None and x1 <= x < x2 and y1 <= y < y2]
        if inside:
            want[i, k] = max([*inside, want.get((i, k), -np.inf)])
    b = spark.createDataFrame([(*r, "a") for r in boxes], "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double, v string")
    g = spark.createDataFrame([(i, y, x, v, 0) for (i, y, x), v in grid.items()] + [(0, 1, 1, None, 0)], "image_id long, y int, x int, v double, box_id int")
    got = regions.box_max_score(b, g, side=side).collect()
    assert {(r.image_id, r.box_id): r.score for r in got} == want and len(got) == len(want)


def test_table_of_maxima_equals_slices():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (1, 9), (17, 1), (13, 29)):
        grid = rng.random((h, w))
        y1, x1 = rng.integers(0, h, 200), rng.integers(0, w, 200)
        y2, x2 = y1 + 1 + rng.integers(0, h - y1), x1 + 1 + rng.integers(0, w - x1)
        assert kernels.range_max(grid, y1, x1, y2, x2).tolist() == [grid[a:c, b:d].max() for a, b, c, d in zip(y1, x1, y2, x2, strict=True)]


@pytest.mark.parametrize(("iou", "best"), [(0.2, 24), (0.2, 1), (0.5, 3), (0.0, 8)])
def test_rounds_equal_greedy_suppression(spark, iou, best):
    rng = np.random.default_rng(11)
    given = []
    for i, n in ((0, 120), (1, 1), (2, 40)):
        score = np.round(rng.random(n), 1)
        given += [(i, k, *map(float, b), float(s)) for k, (*b, s) in enumerate(zip(*boxes_of(rng, n), score, strict=True))]
    given += [(3, k, 0.0, 0.0, 10.0, 10.0, 0.5) for k in range(30)] + [(3, 90, 5.0, 5.0, 5.0, 9.0, 0.1), (3, 91, 0.0, 0.0, 300.0, 0.01, 0.9)]
    given += [(4, k, float(k), 0.0, float(k) + 10, 10.0, 1.0 - k / 100) for k in range(40)]  # a chain in which every box depends on the one before
    df = spark.createDataFrame(given, "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double, score double")
    got = regions.nms_rounds(df, iou, best)
    assert got.columns == df.columns
    assert rows(got) == rows(regions.nms(df, iou))


def test_rounds_with_nulls_and_without_boxes(spark):
    kind = "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double, score double"
    df = spark.createDataFrame([(1, 1, None, 0.0, 1.0, 1.0, 0.5), (1, 2, 0.0, 0.0, 1.0, 1.0, None), (1, 3, 0.0, 0.0, 1.0, 1.0, float("nan")), (1, 4, 0.0, 0.0, 1.0, 1.0, -5.0), (1, 4, 0.0, 0.0, 1.0, 1.0, -5.0)], kind)
    assert sorted(r.box_id for r in regions.nms_rounds(df).collect()) == [1, 4]
    assert regions.nms_rounds(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="under 0"):
        regions.nms_rounds(df, -1.0)
