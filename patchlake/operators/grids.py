"""Tiles, grids, resampling and table-generating operators over (image_id, y, x)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions import kernels

CELL = ["image_id", "y", "x"]


def _starts(size: str, crop: int, stride: int) -> Column:
    count = F.floor(F.greatest(F.col(size) - crop + stride - 1, F.lit(0)) / stride).cast("int")
    return F.sequence(F.lit(0), count)


def make_tiles(images: DataFrame, stride: int = 224, crop: int = 336, patch: int = 16) -> DataFrame:
    """(image_id, h_idx, w_idx, y1, x1, y2, x2) in patch units of images (image_id, h, w).

    The last tile is moved back to end at the edge; a smaller image gives one clipped tile. A corner that does not divide by
    patch is an error when the rows are read.
    """
    t = images.select("image_id", "h", "w", F.explode(_starts("h", crop, stride)).alias("h_idx"))
    t = t.select("*", F.explode(_starts("w", crop, stride)).alias("w_idx"))
    t = t.withColumns({"y2": F.least(F.col("h_idx") * stride + crop, "h"), "x2": F.least(F.col("w_idx") * stride + crop, "w")})
    t = t.withColumns({"y1": F.greatest(F.col("y2") - crop, F.lit(0)), "x1": F.greatest(F.col("x2") - crop, F.lit(0))})
    unit = lambda c: F.when(F.col(c) % patch != 0, F.raise_error(F.format_string("tile corner %s does not divide by " + str(patch), c))).otherwise(F.floor(F.col(c) / patch).cast("int"))
    return t.select("image_id", "h_idx", "w_idx", *[unit(c).alias(c) for c in ("y1", "x1", "y2", "x2")])


def flatten_map(df: DataFrame, col: str = "map") -> DataFrame:
    """(image_id, pos, y, x, feat) of nested maps [y][x] -> vector, with pos = y * W + x."""
    t = df.select("image_id", F.posexplode(col).alias("y", "_row"))
    t = t.select("image_id", "y", F.size("_row").alias("_w"), F.posexplode("_row").alias("x", "feat"))
    return t.select("image_id", (F.col("y") * F.col("_w") + F.col("x")).alias("pos"), "y", "x", "feat")


def unflatten_map(df: DataFrame, col: str = "feat") -> DataFrame:
    """(image_id, map) back from one row per location."""
    rows = df.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", col))).alias("_r")).select("image_id", "y", F.col(f"_r.{col}").alias("_row"))
    return rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "_row"))).alias("_m")).select("image_id", F.col("_m._row").alias("map"))


def _tile_numbers(place: str, size: str, crop: int, stride: int, patch: int) -> Column:
    """Numbers of the tiles along an axis that hold a patch: those whose untouched range does, and the last one, which is moved back to the edge."""
    last = F.floor(F.greatest(F.col(size) - crop + stride - 1, F.lit(0)) / stride)
    low = F.greatest(F.floor((F.col(place) * patch + patch - 1 - crop) / stride) + 1, F.lit(0))
    high = F.least(F.floor((F.col(place) * patch) / stride), last - 1)
    inner = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    moved = (F.col(place) * patch + patch > F.greatest(F.col(size) - crop, F.lit(0))) & (F.col(place) * patch < F.col(size))
    return F.when(moved, F.concat(inner, F.array(last))).otherwise(inner)


def tile_patches(patches: DataFrame, images: DataFrame, stride: int = 224, crop: int = 336, patch: int = 16) -> DataFrame:
    """Each patch with h_idx and w_idx of the tiles of make_tiles(images, stride, crop, patch) that hold it.

    The tiles' numbers follow from the patch's place by inverse stride arithmetic, so the only join is by image, with one row each; patches without an
    image or outside it have no row. Corners must divide by patch, as make_tiles asks too.
    """
    sized = patches.join(images.select("image_id", F.col("h").alias("_h"), F.col("w").alias("_w")), "image_id")
    wide = sized.withColumn("h_idx", F.explode(_tile_numbers("y", "_h", crop, stride, patch)))
    wide = wide.withColumn("w_idx", F.explode(_tile_numbers("x", "_w", crop, stride, patch)))
    return wide.select(patches.columns + [F.col(c).cast("int").alias(c) for c in ("h_idx", "w_idx")])


def assign_tiles(patches: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each patch in each tile of its image that holds it (half-open bounds)."""
    p, t = patches.alias("p"), tiles.alias("t")
    inside = (F.col("p.image_id") == F.col("t.image_id")) & (F.col("p.y") >= F.col("t.y1")) & (F.col("p.y") < F.col("t.y2")) & (F.col("p.x") >= F.col("t.x1")) & (F.col("p.x") < F.col("t.x2"))
    return p.join(t, inside).select("p.*", "t.h_idx", "t.w_idx")


def _cells(grid: DataFrame, h: int, w: int) -> DataFrame:
    """All target cells of each image, with the size of its source grid."""
    sizes = grid.groupBy("image_id").agg((F.max("y") + 1).alias("in_h"), (F.max("x") + 1).alias("in_w"))
    return sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("tx"))


def nearest_resize(grid: DataFrame, h: int, w: int) -> DataFrame:
    """Target cell takes source cell floor(target * in / out).

    Each source cell names its target cells, those from place * out / in on that come before the next place's, so the only join is by image, with one row each: a
    table of all target cells would seem as small as that of the images, and be broadcast.
    """
    sizes = grid.groupBy("image_id").agg((F.max("y") + 1).alias("in_h"), (F.max("x") + 1).alias("in_w"))
    begin = lambda c, size, out: F.expr(f"(({c}) * {out}L + {size} - 1) DIV {size}")

    def targets(c: str, size: str, out: int) -> Column:
        first, last = begin(c, size, out), begin(f"{c} + 1L", size, out) - 1
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    t = grid.filter("y >= 0 AND x >= 0").join(sizes, "image_id")
    t = t.withColumn("ty", targets("y", "in_h", h)).withColumn("tx", targets("x", "in_w", w))
    return t.select("image_id", F.col("ty").cast("int").alias("y"), F.col("tx").cast("int").alias("x"), *[c for c in grid.columns if c not in CELL])


def bilinear_resize(grid: DataFrame, h: int, w: int, value: str = "v", keys: tuple[str, ...] = (), partial: bool = False) -> DataFrame:
    """(image_id, keys, y, x, value) on an h x w grid: half-pixel centres, clamped at the edges; the four weights of a cell sum to one.

    One group an image, all its keys (classes) in it. A source grid with a missing cell is an error, unless it may be partial: then the target cells
    of which one of the four source cells is missing have no row, even if its weight is 0, and cells without an image or a place, or with one under 0, don't
    count. A cell that stands twice is an error in any case.
    """
    names = ["image_id", *keys]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n, m = int(group["y"].max()) + 1, int(group["x"].max()) + 1
        group = group.sort_values([*keys, "y", "x"])
        place = group["y"].to_numpy() * m + group["x"].to_numpy()
        whole = not len(group) % (n * m) and (place == np.tile(np.arange(n * m), len(group) // (n * m))).all()
        if not whole and not partial:
            raise ValueError(f"the grid of image {group['image_id'].iloc[0]} is not full")
        if whole:
            heads, source, there = group[names].iloc[:: n * m], group[value].to_numpy(float).reshape(-1, n, m), None
        else:
            own = group.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(group), np.int64)
            heads = group[names].iloc[np.unique(own, return_index=True)[1]]
            source, times = np.zeros((len(heads), n * m)), np.zeros((len(heads), n * m), np.int64)
            np.add.at(times, (own, place), 1)
            if times.max() > 1:
                raise ValueError(f"a cell of image {group['image_id'].iloc[0]} stands twice")
            source[own, place] = group[value].to_numpy(float)
            source, there = source.reshape(-1, n, m), kernels.all_corners(times.reshape(-1, n, m) > 0, h, w).ravel()
        out = kernels.bilinear(source, h, w)
        rows = heads.loc[heads.index.repeat(h * w)].reset_index(drop=True)
        y, x = np.divmod(np.arange(h * w, dtype=np.int32), w)
        rows = rows.assign(y=np.tile(y, len(heads)), x=np.tile(x, len(heads)), **{value: out.ravel()})
        return rows if there is None else rows[there]

    cells = grid.select(*names, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias(value))
    if partial:
        cells = cells.filter("image_id IS NOT NULL AND y >= 0 AND x >= 0")
    schema = ", ".join(f"{c} {grid.schema[c].dataType.simpleString()}" for c in names) + f", y int, x int, {value} double"
    return cells.groupBy("image_id").applyInPandas(run, schema)


#: Values of an upsampled strip that a task holds at once, about.
STRIP_VALUES = 8_000_000


def _strips(probs: DataFrame, h: int, rows: int) -> DataFrame:
    """Source rows with the strips of target rows that read them: those of the row itself and of the halo of one row on either side."""
    sizes = probs.groupBy("image_id").agg((F.max("y") + 1).alias("_n"), (F.max("x") + 1).alias("_m"))
    place = lambda c, slack: F.floor(((c + 0.5) * h / F.col("_n") - 0.5 + slack) / rows)
    last = F.lit((h - 1) // rows)
    first = F.when(F.col("y") <= 1, F.lit(0)).otherwise(F.greatest(place(F.col("y") - 1, -1e-6), F.lit(0)))
    end = F.when(F.col("y") == F.col("_n") - 1, last).otherwise(F.least(place(F.col("y") + 1, 1e-6), last))
    return probs.join(sizes, "image_id").withColumn("_strip", F.explode(F.when(first <= end, F.sequence(first.cast("int"), end.cast("int")))))


def _upsampled(group: pd.DataFrame, h: int, w: int, rows: int):
    """Target rows of a strip and their probabilities (class, row, x), a row at a time."""
    strip, n, m = int(group["_strip"].iloc[0]), int(group["_n"].iloc[0]), int(group["_m"].iloc[0])
    group = group.sort_values(["y", "x"])
    y, x = group["y"].to_numpy(np.int64), group["x"].to_numpy(np.int64)
    top, many = int(y[0]), len(group)
    if many % m or (y * m + x != top * m + np.arange(many)).any():
        raise ValueError(f"the grid of image {group['image_id'].iloc[0]} is not full")
    held = np.nan_to_num(kernels.rows(group["probs"])).T.reshape(-1, many // m, m)
    for t in range(strip * rows, min(h, (strip + 1) * rows)):
        yield t, kernels.bilinear_rows(held, top, n, h, w, np.array([t]))[:, 0]


def upsample_labels(probs: DataFrame, h: int, w: int, denoise: float = 0.5, ignore: float | None = None, rows: int | None = None) -> DataFrame:
    """(image_id, y, x, class_id, p) on an h x w grid, of probabilities as arrays (image_id, y, x, class_ids, probs): bilinear resizing, classes whose
    maximum over the resized image is under `denoise` set to 0, best class (ties to the first), and, if `ignore` is given, classes moved up by one
    with 0 where p is under it.

    The result of bilinear_resize, denoise_prompts, argmax_class and apply_ignore one after the other, without a row per class. Images go in strips of
    `rows` target rows (by default as many as STRIP_VALUES allows), each with the source rows it reads; strips are resized twice, once for the classes'
    maxima, which are merged by image, and once for the labels, so nothing of class depth is written at the output's size. A null probability counts
    as 0; a source grid with a missing cell is an error; class_ids must be the same in all rows of an image.
    """
    if rows is None:
        most = probs.agg(F.max(F.size("probs"))).first()[0] or 1
        rows = max(1, min(h, STRIP_VALUES // (w * most)))
    kind, ids = (probs.schema[c].dataType.simpleString() for c in ("image_id", "class_ids"))
    cut = _strips(probs.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "class_ids", F.col("probs").cast("array<double>").alias("probs")), h, rows)

    def maxima(group: pd.DataFrame) -> pd.DataFrame:
        top = None
        for _, p in _upsampled(group, h, w, rows):
            top = p.max(1) if top is None else np.maximum(top, p.max(1))
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "_strip": group["_strip"].iloc[0], "place": np.arange(len(top)), "top": top})

    tops = cut.groupBy("image_id", "_strip").applyInPandas(maxima, f"image_id {kind}, _strip int, place int, top double")
    kept = tops.groupBy("image_id", "place").agg(F.max("top").alias("top")).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", "top"))).alias("_t"))
    strips = kept.select("image_id", F.col("_t.top").alias("tops"), F.explode(F.sequence(F.lit(0), F.lit((h - 1) // rows))).alias("_strip"))

    def label(group: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"image_id": [], "y": [], "x": [], "class_id": [], "p": []})
        off, classes, made = np.asarray(held["tops"].iloc[0]) < denoise, np.asarray(group["class_ids"].iloc[0]), []
        for t, p in _upsampled(group, h, w, rows):
            p[off] = 0
            best = p.argmax(0)
            made.append((t, classes[best], p[best, np.arange(w)]))
        y = np.repeat(np.array([t for t, _, _ in made], np.int32), w)
        out, p = np.concatenate([c for _, c, _ in made]), np.concatenate([p for _, _, p in made])
        if ignore is not None:
            out = np.where(p < ignore, 0, out + 1)
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "y": y, "x": np.tile(np.arange(w, dtype=np.int32), len(made)), "class_id": out, "p": p})

    both = cut.groupBy("image_id", "_strip").cogroup(strips.groupBy("image_id", "_strip"))
    return both.applyInPandas(label, f"image_id {kind}, y int, x int, class_id {ids[6:-1]}, p double")


def pad_grid(grid: DataFrame, h: int, w: int, value: str = "v", fill: float = 0.0) -> DataFrame:
    """(image_id, y, x, value) on an h x w grid: cells that the image lacks hold fill."""
    t = _cells(grid, h, w).select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"))
    return t.join(grid.select(*CELL, value), CELL, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def threshold_sweep(grid: DataFrame, value: str = "v") -> DataFrame:
    """Each cell at eight thresholds min + k * 0.1 * (max - min), k = 2..9: k, on (value over the threshold)."""
    ends = grid.groupBy("image_id").agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    wide = grid.join(ends, "image_id").select("*", F.explode(F.sequence(F.lit(2), F.lit(9))).alias("k"))
    return wide.withColumn("on", F.col(value) > F.col("_a") + F.col("k") * F.lit(0.1) * (F.col("_b") - F.col("_a"))).drop("_a", "_b")
