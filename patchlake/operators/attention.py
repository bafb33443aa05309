"""Self-similarity and attention of images with more tokens than one task should hold: blocks of token pairs with mergeable softmax states.

An image's tokens are dealt to blocks of raster places. A task takes one block of queries against a run of key blocks, one after the other,
and keeps per query the greatest score, the sum of exponentials and the weighted sum of values (an online softmax). The states of a query
block's runs are merged in one small group, so no group holds more than RUN blocks' states and no task more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.functions import kernels
from patchlake.sources.storage import materialize

BLOCK, RUN = 1024, 8  # tokens of a block, key blocks of a run
_CELL = ["image_id", "y", "x"]


def block_scores(q: np.ndarray, k: np.ndarray, scale: float, mean: float, cut: bool) -> np.ndarray:
    """Scaled products less the mean; with cut, those under -1e-12 weigh nothing."""
    s = (q @ k.T - mean) * scale
    return np.where(s < -1e-12, -np.inf, np.maximum(s, 0)) if cut else s


class SoftmaxState:
    """Softmax-weighted sums of values that have been seen so far: most, total and summed of each query and head."""

    def __init__(self, most: np.ndarray, total: np.ndarray, summed: np.ndarray):
        self.most, self.total, self.summed = most, total, summed

    @classmethod
    def empty(cls, queries: int, heads: int, width: int) -> SoftmaxState:
        return cls(np.full((heads, queries), -np.inf), np.zeros((heads, queries)), np.zeros((queries, width)))

    def add(self, other: SoftmaxState) -> None:
        most = np.maximum(self.most, other.most)
        flat = np.where(np.isfinite(most), most, 0)
        a, b = np.exp(self.most - flat), np.exp(other.most - flat)
        wide = lambda w: np.repeat(w.T, self.summed.shape[1] // len(most), axis=1)
        self.summed = self.summed * wide(a) + other.summed * wide(b)
        self.total = self.total * a + other.total * b
        self.most = most

    @classmethod
    def of(cls, q: np.ndarray, k: np.ndarray, v: np.ndarray, heads: int, scale: float, mean: float, cut: bool) -> SoftmaxState:
        out = cls.empty(len(q), heads, v.shape[1])
        d, w = q.shape[1] // heads, v.shape[1] // heads
        for h in range(heads):
            s = block_scores(q[:, h * d : (h + 1) * d], k[:, h * d : (h + 1) * d], scale, mean, cut)
            out.most[h] = s.max(1)
            e = np.exp(s - np.where(np.isfinite(out.most[h]), out.most[h], 0)[:, None])
            out.total[h] = e.sum(1)
            out.summed[:, h * w : (h + 1) * w] = e @ v[:, h * w : (h + 1) * w]
        return out

    def result(self) -> np.ndarray:
        """The weighted means; of a query that no value weighs for, NaN."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.summed / np.repeat(self.total.T, self.summed.shape[1] // len(self.total), axis=1)


def _bytes(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, np.float64).tobytes()


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(rows, -1)


def _blocks(df: DataFrame, cols: list[str], block: int, unit: bool) -> DataFrame:
    """(image_id, block, n, ys, xs, col_0, ...): one row per block of raster places, matrices as bytes."""
    width = df.groupBy("image_id").agg((F.max("x") + 1).alias("_w"))
    dealt = df.join(width, "image_id").withColumn("block", F.floor((F.col("y").cast("long") * F.col("_w") + F.col("x")) / block)).drop("_w")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "x"])
        made = {f"col_{i}": [_bytes(kernels.rows(group[c]))] for i, c in enumerate(cols)}
        if unit:
            made["unit"] = [_bytes(kernels.unit(kernels.rows(group[cols[0]])))]
        return pd.DataFrame({"image_id": group["image_id"].iloc[:1].to_numpy(), "block": group["block"].iloc[:1].to_numpy(), "n": len(group), "ys": [group["y"].to_numpy(np.int32)], "xs": [group["x"].to_numpy(np.int32)], **made})

    kinds = "".join(f", col_{i} binary" for i in range(len(cols))) + ", unit binary" * unit
    schema = f"image_id {df.schema['image_id'].dataType.simpleString()}, block long, n int, ys array<int>, xs array<int>{kinds}"
    return materialize(dealt.groupBy("image_id", "block").applyInPandas(pack, schema), "blocks")


def _attend(blocks: DataFrame, q: str, k: str, v: str, heads: int, scale: str, cut: bool, means: DataFrame | None = None, run: int = RUN) -> DataFrame:
    """(image_id, block, out): weighted means of the values v for the queries q over all key blocks of the image.

    scale: an SQL number of the row. means: (image_id, mean) to be taken off every product.
    """
    key = blocks.select("image_id", F.col("block").alias("kb"), F.col("n").alias("kn"), F.col(k).alias("k"), F.col(v).alias("v"))
    query = blocks.select("image_id", "block", "n", F.col(q).alias("q"))
    if means is None:
        query = query.withColumn("mean", F.lit(0.0))
    else:
        query = query.join(means, "image_id")
    pairs = query.join(key, "image_id").withColumns({"run": F.floor(F.col("kb") / run), "scale": F.expr(scale).cast("double")})
    kind = blocks.schema["image_id"].dataType.simpleString()
    names = ["image_id", "block", "n", "most", "total", "summed"]

    def packed(head, state: SoftmaxState):
        return (*head, _bytes(state.most), _bytes(state.total), _bytes(state.summed))

    def partial(batches):
        """States of runs of pairs that come sorted by query block and run."""
        at, state = None, None
        for pdf in batches:
            out = []
            for image, b, n, qm, mean, kn, km, vm, r, s in zip(*(pdf[c] for c in ("image_id", "block", "n", "q", "mean", "kn", "k", "v", "run", "scale")), strict=True):
                new = SoftmaxState.of(_matrix(qm, n), _matrix(km, kn), _matrix(vm, kn), heads, s, mean, cut)
                if at == (image, b, n, r):
                    state.add(new)
                    continue
                if at is not None:
                    out.append(packed(at[:3], state))
                at, state = (image, b, n, r), new
            yield pd.DataFrame(out, columns=names)
        if at is not None:
            yield pd.DataFrame([packed(at[:3], state)], columns=names)

    ordered = pairs.repartition("image_id", "block", "run").sortWithinPartitions("image_id", "block", "run", "kb")
    states = ordered.mapInPandas(partial, f"image_id {kind}, block long, n int, most binary, total binary, summed binary")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        n, state = int(group["n"].iloc[0]), None
        for most, total, summed in zip(group["most"], group["total"], group["summed"], strict=True):
            new = SoftmaxState(_matrix(most, heads), _matrix(total, heads), _matrix(summed, n))
            if state is None:
                state = new
            else:
                state.add(new)
        return pd.DataFrame({"image_id": group["image_id"].iloc[:1].to_numpy(), "block": group["block"].iloc[:1].to_numpy(), "out": [_bytes(state.result())]})

    return states.groupBy("image_id", "block").applyInPandas(merge, f"image_id {kind}, block long, out binary")


def _tokens(blocks: DataFrame, out: DataFrame) -> DataFrame:
    """(image_id, y, x, feat) of blocks' results."""

    def split(batches):
        for pdf in batches:
            for image, ys, xs, raw in zip(pdf["image_id"], pdf["ys"], pdf["xs"], pdf["out"], strict=True):
                yield pd.DataFrame({"image_id": image, "y": ys, "x": xs, "feat": list(_matrix(raw, len(ys)))})

    kind = blocks.schema["image_id"].dataType.simpleString()
    return blocks.select("image_id", "block", "ys", "xs").join(out, ["image_id", "block"]).select("image_id", "ys", "xs", "out").mapInPandas(split, f"image_id {kind}, y int, x int, feat array<double>")


def self_correlate_blocks(df: DataFrame, scaling: float = 10.0, center: bool = True, col: str = "feat", block: int = BLOCK) -> DataFrame:
    """What similarity.self_correlate gives, for images of any number of tokens (image_id, y, x, col).

    The mean of all cosines of an image is the squared length of its mean unit vector, which comes from sums of each block. Places must be distinct.
    """
    blocks = _blocks(df.select(*_CELL, col), [col], block, unit=True)

    def sums(batches):
        for pdf in batches:
            for image, n, raw in zip(pdf["image_id"], pdf["n"], pdf["unit"], strict=True):
                s = _matrix(raw, n).sum(0)
                yield pd.DataFrame({"image_id": image, "dim": np.arange(len(s)), "s": s, "n": np.where(np.arange(len(s)) == 0, n, 0)})

    means = None
    if center:
        kind = blocks.schema["image_id"].dataType.simpleString()
        parts = blocks.select("image_id", "n", "unit").mapInPandas(sums, f"image_id {kind}, dim int, s double, n long")
        whole = parts.groupBy("image_id", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        means = whole.groupBy("image_id").agg((F.sum(F.col("s") * F.col("s")) / F.pow(F.sum("n").cast("double"), 2.0)).alias("mean"))
    return _tokens(blocks, _attend(blocks, "unit", "unit", "col_0", 1, str(float(scaling)), True, means))


def recursive_attention_blocks(df: DataFrame, heads: int, scaling: float = 10.0, q: str = "q", k: str = "k", v: str = "v", block: int = BLOCK) -> DataFrame:
    """What similarity.recursive_attention gives, for images of any number of tokens: attention first, then similarity of its outputs over v."""
    blocks = _blocks(df.select(*_CELL, *dict.fromkeys((q, k, v))), [q, k, v], block, unit=False)
    mixed = _attend(blocks, "col_0", "col_1", "col_2", heads, f"1 / sqrt(octet_length(q) DIV (8 * n * {heads}))", False)

    def unit(batches):
        for pdf in batches:
            yield pdf.assign(unit=[_bytes(kernels.unit(_matrix(raw, n))) for raw, n in zip(pdf["out"], pdf["n"], strict=True)]).drop(columns="out")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select("image_id", "block", "n", "ys", "xs", "col_2").schema) + ", unit binary"
    second = materialize(blocks.select("image_id", "block", "n", "ys", "xs", "col_2").join(mixed, ["image_id", "block"]).mapInPandas(unit, schema), "mixed")
    return _tokens(second, _attend(second, "unit", "unit", "col_2", 1, str(float(scaling)), True))
