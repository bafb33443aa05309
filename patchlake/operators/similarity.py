"""Cosine scoring, self-similarity, clustering and projection: Spark deals the rows, numpy does the products."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.functions import kernels
from patchlake.sources.storage import global_index, materialize

#: Most values of a class matrix that is sent to every task; larger ones are scored block by block.
BROADCAST_VALUES = 4_000_000


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _cosines(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of rows, NaN where either is zero."""
    if x.shape[1] != c.shape[1]:
        raise ValueError(f"vectors of different dimensions: {x.shape[1]} and {c.shape[1]}")
    whole = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)
    return np.divide(x @ c.T, whole, out=np.full(whole.shape, np.nan), where=whole > 0)


def _values(classes: DataFrame, embed: str) -> tuple[int, int]:
    """Number of classes and of all values of their vectors."""
    size = classes.agg(F.coalesce(F.sum(F.size(embed)), F.lit(0)).alias("n"), F.count("*").alias("c")).first()
    return size["c"], size["n"]


def _nullable(v: np.ndarray):
    return pd.array(v, dtype=pd.ArrowDtype(_double())) if np.isnan(v).any() else v


def cos_sim(features: DataFrame, classes: DataFrame, keys: list[str], feat: str = "feat", embed: str = "embed") -> DataFrame:
    """(keys, class_id, sim) for all features x classes (class_id, embed); null where either vector is zero.

    Different dimensions are an error. The class matrix goes to the tasks only up to BROADCAST_VALUES; more classes are scored in
    blocks of that size, one pass over the features each, and nothing is shuffled.
    """
    schema = f"{_ddl(features, keys)}, class_id {classes.schema['class_id'].dataType.simpleString()}, sim double"
    count, values = _values(classes, embed)
    if not count:
        return features.sparkSession.createDataFrame([], schema)

    def scored(block: DataFrame) -> DataFrame:
        rows = block.select("class_id", embed).orderBy("class_id").collect()
        held = features.sparkSession.sparkContext.broadcast((np.array([r["class_id"] for r in rows]), kernels.rows([r[embed] for r in rows])))

        def run(batches):
            ids, matrix = held.value
            for pdf in batches:
                if len(pdf):
                    sim = _cosines(kernels.rows(pdf[feat]), matrix).ravel()
                    yield pdf[keys].loc[pdf.index.repeat(len(ids))].reset_index(drop=True).assign(class_id=np.tile(ids, len(pdf)), sim=_nullable(sim))

        return features.select(*keys, feat).mapInPandas(run, schema)

    blocks = max(1, -(-values // BROADCAST_VALUES))
    part = F.pmod(F.xxhash64("class_id"), F.lit(blocks))
    held = [classes.filter(part == b) for b in range(blocks)] if blocks > 1 else [classes]
    return reduce(DataFrame.unionByName, [scored(b) for b in held if blocks == 1 or not b.isEmpty()])


def _class_blocks(classes: DataFrame, key: str, vec: str, size: int) -> list[DataFrame]:
    """classes in their order by key, in blocks of `size` rows."""
    placed = materialize(global_index(classes.select(key, vec), [key], "_at", "long"), "classes")
    count = placed.count()
    return [placed.filter(F.expr(f"_at DIV {size}") == b).drop("_at") for b in range(-(-count // size))]


def _numbered_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows with a number of their own, written as a table, as several passes read them."""
    return materialize(df.select(*dict.fromkeys(names), F.monotonically_increasing_id().alias("_row")), "rows")


def _softmax_best(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of scores (NaN where there is none) and the place of the best; equal ones go to the first."""
    told = ~np.isnan(s)
    with np.errstate(invalid="ignore"):
        e = np.where(told, np.exp(s - np.where(told, s, -np.inf).max(1, keepdims=True)), 0)
        p = np.where(told, e / e.sum(1, keepdims=True), np.nan)
    return p, np.where(told, p, -1).argmax(1)


def class_probs(features: DataFrame, classes: DataFrame, keys: list[str], temp: float = 100.0, feat: str = "feat", embed: str = "embed") -> DataFrame:
    """(keys, class_ids, probs, class_id, p): softmax of temp * cosine over the classes as an array, its best class and probability.

    Probabilities stand in the order of class_ids. A class or feature that is a zero vector has null probabilities; ties go to the lowest class, which
    also stands, with a null p, for a zero feature. Class vectors of up to BROADCAST_VALUES values go to the tasks whole, in one pass without a shuffle;
    more go in blocks of that size, each one pass over the features, whose cosines meet as arrays by row.
    """
    count, values = _values(classes, embed)
    kind = classes.schema["class_id"].dataType.simpleString()
    schema = f"{_ddl(features, keys)}, class_ids array<{kind}>, probs array<double>, class_id {kind}, p double"
    if not count:
        return features.sparkSession.createDataFrame([], schema)

    def told(pdf: pd.DataFrame, ids: list, s: np.ndarray) -> pd.DataFrame:
        p, best = _softmax_best(s)
        whole = not np.isnan(p).any()
        probs = list(p) if whole else [[None if np.isnan(v) else v for v in r] for r in p]
        return pdf[keys].assign(class_ids=ids, probs=probs, class_id=[i[b] for i, b in zip(ids, best, strict=True)], p=_nullable(p[np.arange(len(p)), best]))

    def matrix(block: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = block.select("class_id", embed).orderBy("class_id").collect()
        return np.array([r["class_id"] for r in rows]), kernels.rows([r[embed] for r in rows])

    if values <= BROADCAST_VALUES:
        ids, held = matrix(classes)

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield told(pdf, [ids] * len(pdf), temp * _cosines(kernels.rows(pdf[feat]), held))

        return features.select(*keys, feat).mapInPandas(run, schema)

    def scored(number: int, block: DataFrame) -> DataFrame:
        ids, held = matrix(block)

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    s = _cosines(kernels.rows(pdf[feat]), held)
                    yield pdf[["_row"]].assign(block=number, ids=[ids] * len(pdf), sims=[r.tobytes() for r in s])

        return rows.select("_row", feat).mapInPandas(run, f"_row long, block int, ids array<{kind}>, sims binary")

    rows = _numbered_rows(features, [*keys, feat])
    parts = reduce(DataFrame.unionByName, [scored(i, b) for i, b in enumerate(_class_blocks(classes, "class_id", embed, max(1, BROADCAST_VALUES * count // values)))])
    joined = parts.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("block", "ids", "sims"))).alias("_s"))
    joined = joined.select("_row", F.flatten("_s.ids").alias("_ids"), F.col("_s.sims").alias("_sims"))

    def merge(batches):
        for pdf in batches:
            if len(pdf):
                s = np.array([np.frombuffer(b"".join(map(bytes, r))) for r in pdf["_sims"]])
                yield told(pdf, list(pdf["_ids"]), temp * s)

    return rows.select("_row", *keys).join(joined, "_row").drop("_row").mapInPandas(merge, schema)


def long_probs(probs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class_id, p): one row for each class of class_probs."""
    return probs.select(*keys, F.explode(F.arrays_zip("class_ids", "probs")).alias("_z")).select(*keys, F.col("_z.class_ids").alias("class_id"), F.col("_z.probs").alias("p"))


def _double():
    import pyarrow as pa

    return pa.float64()


def map_features(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], keys: list[str], in_col: str = "feat", out_col: str = "feat") -> DataFrame:
    """(keys, out_col): a user's batch function, matrix in and matrix out, called once per Arrow batch."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[keys].assign(**{out_col: list(np.asarray(fn(kernels.rows(pdf[in_col])), np.float64))})

    return df.select(*dict.fromkeys([*keys, in_col])).mapInPandas(run, f"{_ddl(df, keys)}, {out_col} array<double>")


def project_features(df: DataFrame, weights: np.ndarray | None, bias: np.ndarray | None, keys: list[str], col: str = "feat") -> DataFrame:
    """Linear map x @ weights.T + bias; without weights the features pass as they are."""
    if weights is None:
        return df.select(*keys, F.col(col).cast("array<double>").alias(col))
    return map_features(df, lambda x: x @ weights.T + (0 if bias is None else bias), keys, col, col)


def _per_image(df: DataFrame, cols: list[str], fn: Callable[..., np.ndarray]) -> DataFrame:
    """(image_id, y, x, feat): fn over the matrices of an image's columns, locations in raster order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "x"])
        return group[["image_id", "y", "x"]].assign(feat=list(fn(*(kernels.rows(group[c]) for c in cols))))

    return df.select("image_id", "y", "x", *dict.fromkeys(cols)).groupBy("image_id").applyInPandas(run, f"{_ddl(df, ['image_id', 'y', 'x'])}, feat array<double>")


def self_correlate(df: DataFrame, scaling: float = 10.0, center: bool = True, col: str = "feat") -> DataFrame:
    """Each patch as the softmax-weighted sum of its image's patches by cosine, less the mean cosine, times scaling."""
    return _per_image(df, [col], lambda x: kernels.self_correlate(x, scaling, center))


def recursive_attention(df: DataFrame, heads: int, scaling: float = 10.0, q: str = "q", k: str = "k", v: str = "v") -> DataFrame:
    return _per_image(df, [q, k, v], lambda a, b, c: kernels.recursive_attention(a, b, c, heads, scaling))


def _centers(centers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and unit vectors of centers (cluster, center) by cluster."""
    rows = centers.select("cluster", "center").orderBy("cluster").collect()
    return np.array([r["cluster"] for r in rows], np.int64), kernels.unit(kernels.rows([r["center"] for r in rows]))


def _center_blocks(centers: DataFrame) -> list[DataFrame]:
    count, values = _values(centers, "center")
    return [centers] if values <= BROADCAST_VALUES else _class_blocks(centers, "cluster", "center", max(1, BROADCAST_VALUES * count // values))


def assign_clusters(df: DataFrame, centers: DataFrame, keys: list[str], col: str = "feat") -> DataFrame:
    """(keys, cluster): nearest center (cluster, center) by cosine, ties to the lowest.

    Centers of up to BROADCAST_VALUES values go to the tasks whole; more go in blocks, one pass over the rows each, and a row's best of all
    blocks is taken. Without a center there is no row.
    """
    blocks = _center_blocks(centers)
    if len(blocks) == 1:
        ids, c = _centers(blocks[0])
        if not len(ids):
            return df.sparkSession.createDataFrame([], f"{_ddl(df, keys)}, cluster int")

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf[keys].assign(cluster=ids[(kernels.unit(kernels.rows(pdf[col])) @ c.T).argmax(1)].astype(np.int32))

        return df.select(*dict.fromkeys([*keys, col])).mapInPandas(run, f"{_ddl(df, keys)}, cluster int")
    rows = _numbered_rows(df, [*keys, col])

    def nearest(block: DataFrame) -> DataFrame:
        ids, c = _centers(block)

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    s = kernels.unit(kernels.rows(pdf[col])) @ c.T
                    yield pdf[["_row"]].assign(cluster=ids[s.argmax(1)].astype(np.int32), s=s.max(1))

        return rows.select("_row", col).mapInPandas(run, "_row long, cluster int, s double")

    best = reduce(DataFrame.unionByName, [nearest(b) for b in blocks]).groupBy("_row").agg(F.max_by("cluster", F.struct("s", -F.col("cluster"))).alias("cluster"))
    return rows.select("_row", *keys).join(best, "_row").drop("_row")


def seeded_centers(df: DataFrame, k: int, keys: list[str], seed: int = 0, col: str = "feat") -> DataFrame:
    """(cluster, center): the k different vectors whose keys have the smallest hashes, numbered in that order.

    The choice does not depend on how the rows are dealt to partitions. Fewer than k different vectors give fewer centers; null vectors are left out.
    """
    first = df.filter(F.col(col).isNotNull()).select(F.struct(F.md5(F.concat_ws(",", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])).alias("h"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]).alias("_h"), F.col(col).cast("array<double>").alias("center"))
    least = first.groupBy("center").agg(F.min("_h").alias("_h")).orderBy("_h").limit(k)
    return least.select((F.row_number().over(Window.orderBy("_h")) - 1).alias("cluster"), "center")


def spherical_kmeans(df: DataFrame, init: DataFrame, keys: list[str], iters: int = 100, tol: float = 1e-4, col: str = "feat") -> tuple[DataFrame, DataFrame]:
    """Centers (cluster, center) and labels (keys, cluster) of the assignment made before the last update.

    init: (cluster, center), explicit or from seeded_centers. It ends after iters rounds, or when one less the mean cosine of old and new centers is under tol.
    The unit vectors are written once as a table that every round reads. An empty cluster gets a zero center. With centers of up to BROADCAST_VALUES values
    a round sends k x D partial sums; with more, centers stay tables: rows are assigned block by block and summed by (cluster, dim).
    """
    if _values(init, "center")[1] > BROADCAST_VALUES:
        return _kmeans_tables(df, init, keys, iters, tol, col)
    spark, (ids, c) = df.sparkSession, _centers(init)
    units = materialize(map_features(df, kernels.unit, keys, col, "_unit"), "units")
    before = c
    for _ in range(iters):
        before = c

        def sums(batches, c=c):
            total = np.zeros_like(c)
            for pdf in batches:
                if len(pdf):
                    u = kernels.rows(pdf["_unit"])
                    np.add.at(total, (u @ c.T).argmax(1), u)
            yield pd.DataFrame({"k": np.repeat(np.arange(len(c)), c.shape[1]), "d": np.tile(np.arange(c.shape[1]), len(c)), "v": total.ravel()})

        new = np.zeros_like(c)
        for r in units.select("_unit").mapInPandas(sums, "k int, d int, v double").groupBy("k", "d").agg(F.sum("v").alias("v")).collect():
            new[r["k"], r["d"]] = r["v"]
        new = kernels.unit(new)
        shift = 1 - (c * new).sum(1).mean()
        c = new
        if shift < tol:
            break
    frame = lambda m: spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m, strict=True)], "cluster int, center array<double>")
    return frame(c), assign_clusters(units, frame(before), keys, "_unit")


def _kmeans_tables(df: DataFrame, init: DataFrame, keys: list[str], iters: int, tol: float, col: str) -> tuple[DataFrame, DataFrame]:
    """spherical_kmeans for more centers than go to a task."""
    units = materialize(map_features(df.withColumn("_n", F.monotonically_increasing_id()), kernels.unit, [*keys, "_n"], col, "_unit"), "units")
    names = init.select(F.col("cluster").cast("int").alias("cluster"))
    c = materialize(map_features(init.withColumn("cluster", F.col("cluster").cast("int")), kernels.unit, ["cluster"], "center", "center"), "centers")
    dims = c.select(F.max(F.size("center"))).first()[0]
    before = c
    for _ in range(iters):
        before = c
        own = assign_clusters(units, c, ["_n"], "_unit").join(units.select("_n", "_unit"), "_n")
        sums = own.select("cluster", F.posexplode("_unit").alias("d", "v")).groupBy("cluster", "d").agg(F.sum("v").alias("v"))
        full = sums.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("_v")).select("cluster", F.col("_v.v").alias("_v"))
        zero = F.array_repeat(F.lit(0.0), dims)
        c = materialize(map_features(names.join(full, "cluster", "left").withColumn("center", F.coalesce("_v", zero)), kernels.unit, ["cluster"], "center", "center"), "centers")
        dot = F.aggregate(F.zip_with("center", "_old", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        if 1 - c.join(before.withColumnRenamed("center", "_old"), "cluster").agg(F.avg(dot)).first()[0] < tol:
            break
    return c, assign_clusters(units, before, keys, "_unit")


def cluster_images(df: DataFrame, k: int = 8, iters: int = 100, tol: float = 1e-4, col: str = "feat") -> DataFrame:
    """(image_id, y, x, cluster, center): spherical k-means within each image from its first k patches; fewer patches give fewer clusters."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "x"])
        x = kernels.rows(group[col])
        c, label = kernels.kmeans(x, x[:k], iters, tol)
        return group[["image_id", "y", "x"]].assign(cluster=label.astype(np.int32), center=list(c[label]))

    return df.select("image_id", "y", "x", col).groupBy("image_id").applyInPandas(run, f"{_ddl(df, ['image_id', 'y', 'x'])}, cluster int, center array<double>")


def _moments(df: DataFrame, col: str) -> DataFrame:
    """(i, j, v) sums over all rows: of products for j >= 0, of values for j = -1, and the count at i = j = -1."""

    def run(batches):
        n, s, ss = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = kernels.rows(pdf[col])
                n, s, ss = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if ss is None else ss)
        if n:
            d = len(s)
            i = np.concatenate((np.repeat(np.arange(d), d), np.arange(d), [-1]))
            j = np.concatenate((np.tile(np.arange(d), d), np.full(d, -1), [-1]))
            yield pd.DataFrame({"i": i, "j": j, "v": np.concatenate((ss.ravel(), s, [n]))})

    return df.select(col).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def mean_covariance(df: DataFrame, col: str = "feat") -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (over n - 1) of the features; only D x D sums reach the driver."""
    rows = _moments(df, col).collect()
    d = max((r["i"] for r in rows), default=-1) + 1
    n, s, ss = 0.0, np.zeros(d), np.zeros((d, d))
    for r in rows:
        if r["i"] < 0:
            n = r["v"]
        elif r["j"] < 0:
            s[r["i"]] = r["v"]
        else:
            ss[r["i"], r["j"]] = r["v"]
    mean = s / max(n, 1)
    return mean, (ss - n * np.outer(mean, mean)) / max(n - 1, 1)


def covariance(df: DataFrame, col: str = "feat") -> DataFrame:
    """(i, j, cov) of the features."""
    _, cov = mean_covariance(df, col)
    i, j = np.indices(cov.shape)
    return df.sparkSession.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "cov": cov.ravel()}), "i int, j int, cov double")


def principal_axes(cov: np.ndarray, k: int) -> np.ndarray:
    """The k leading eigenvectors as rows, the loading of the greatest size made positive."""
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k].T
    return axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]


def pca_rgb(df: DataFrame, keys: list[str], k: int = 3, col: str = "feat", eps: float = 1e-8) -> DataFrame:
    """(keys, dim, v): centred features on the corpus's k leading axes, each scaled to [0, 1] within the image (keys hold image_id)."""
    from patchlake.operators.windows import minmax_scale

    mean, cov = mean_covariance(df, col)
    axes = principal_axes(cov, k)
    flat = map_features(df, lambda x: (x - mean) @ axes.T, keys, col, "_p").select(*keys, F.posexplode("_p").alias("dim", "v"))
    return minmax_scale(flat, "v", eps, ("image_id", "dim")).select(*keys, "dim", F.col("scaled").alias("v"))


#: Side of the blocks in which covariances of long vectors are summed.
COV_BLOCK = 512


def _summed(parts: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """(keys, n, v): sums of counts n and of matrices v (bytes of doubles) by key, one block in memory at a time."""

    def run(batches):
        at, n, total = None, 0, None
        for pdf in batches:
            out = []
            for key, count, raw in zip(zip(*(pdf[k] for k in keys), strict=True), pdf["n"], pdf["v"], strict=True):
                v = np.frombuffer(raw, np.float64)
                if key != at:
                    if at is not None:
                        out.append((*at, n, total.tobytes()))
                    at, n, total = key, 0, np.zeros_like(v)
                if len(v) != len(total):
                    raise ValueError("vectors of different dimensions")
                n, total = n + count, total + v
            yield pd.DataFrame(out, columns=[*keys, "n", "v"])
        if at is not None:
            yield pd.DataFrame([(*at, n, total.tobytes())], columns=[*keys, "n", "v"])

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def covariance_blocks(df: DataFrame, col: str = "feat", block: int | None = None) -> DataFrame:
    """(i, j, cov): what covariance gives, for vectors of any length: no D x D rows reach the driver and no pair of dimensions is a row of a shuffle.

    Each task sums products of block x block dimensions on and under the diagonal, which meet by block as bytes; the means come first, in a pass of their
    own, so that no digits are lost. Null vectors are left out.
    """
    side = block or COV_BLOCK
    given = df.select(col).filter(F.col(col).isNotNull())

    def totals(batches):
        n, s = 0, None
        for pdf in batches:
            if len(pdf):
                x = kernels.rows(pdf[col])
                n, s = n + len(x), x.sum(0) + (0 if s is None else s)
        if n:
            yield pd.DataFrame({"k": [0], "n": [n], "v": [s.tobytes()]})

    whole = _summed(given.mapInPandas(totals, "k int, n long, v binary"), ["k"], "k int, n long, v binary").first()
    if whole is None:
        return df.sparkSession.createDataFrame([], "i int, j int, cov double")
    count, mean = whole["n"], np.frombuffer(whole["v"]) / whole["n"]
    dims = len(mean)

    def products(batches):
        held = None
        for pdf in batches:
            if len(pdf):
                z = kernels.rows(pdf[col]) - mean
                made = {(a, b): z[:, a : a + side].T @ z[:, b : b + side] for a in range(0, dims, side) for b in range(0, a + 1, side)}
                held = made if held is None else {k: held[k] + m for k, m in made.items()}
        for (a, b), m in (held or {}).items():
            yield pd.DataFrame({"a": [a], "b": [b], "n": [0], "v": [m.tobytes()]})

    def spread(batches):
        for pdf in batches:
            for a, b, raw in zip(pdf["a"], pdf["b"], pdf["v"], strict=True):
                m = np.frombuffer(raw).reshape(min(side, dims - a), -1) / max(count - 1, 1)
                i, j = np.indices(m.shape, dtype=np.int32)
                yield pd.DataFrame({"i": i.ravel() + a, "j": j.ravel() + b, "cov": m.ravel()})
                if a != b:
                    yield pd.DataFrame({"i": j.ravel() + b, "j": i.ravel() + a, "cov": m.ravel()})

    blocks = _summed(given.mapInPandas(products, "a int, b int, n long, v binary"), ["a", "b"], "a int, b int, n long, v binary")
    return blocks.mapInPandas(spread, "i int, j int, cov double")


def leading_axes(df: DataFrame, k: int = 3, col: str = "feat", extra: int = 61, rounds: int = 60, tol: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k leading axes of the features (the loading of the greatest size made positive) without a D x D matrix.

    Subspace iteration on k + extra directions from a seeded start: a round is one pass that sums x (x . Q) per task, and only D x (k + extra) numbers come to
    the driver. It ends when the k axes move by less than tol, or after `rounds`.
    """
    given = df.select(col).filter(F.col(col).isNotNull())

    def passed(fn, shape):
        def run(batches):
            n, total = 0, None
            for pdf in batches:
                if len(pdf):
                    x = kernels.rows(pdf[col])
                    n, total = n + len(x), fn(x) + (0 if total is None else total)
            if n:
                yield pd.DataFrame({"k": [0], "n": [n], "v": [np.ascontiguousarray(total, np.float64).tobytes()]})

        found = _summed(given.mapInPandas(run, "k int, n long, v binary"), ["k"], "k int, n long, v binary").first()
        return (0, None) if found is None else (found["n"], np.frombuffer(found["v"]).reshape(shape))

    n, total = passed(lambda x: x.sum(0), -1)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    mean = total / n
    dims, wide = len(mean), min(k + extra, len(mean))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, wide)))[0]
    axes = None
    for _ in range(rounds):
        _, y = passed(lambda x, q=q: (x - mean).T @ ((x - mean) @ q), (dims, wide))
        low, turn = np.linalg.eigh(q.T @ y)  # the best axes inside the subspace
        before, axes = axes, (q @ turn[:, np.argsort(-low)])[:, :k].T
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        if before is not None and np.abs(axes - before).max() < tol:
            break
        q = np.linalg.qr(y)[0]
    return mean, axes


def pca_rgb_long(df: DataFrame, keys: list[str], k: int = 3, col: str = "feat", eps: float = 1e-8) -> DataFrame:
    """What pca_rgb gives, by leading_axes: for vectors of any length."""
    from patchlake.operators.windows import minmax_scale

    mean, axes = leading_axes(df, k, col)
    if not len(axes):
        return df.sparkSession.createDataFrame([], f"{_ddl(df, keys)}, dim int, v double")
    flat = map_features(df, lambda x: (x - mean) @ axes.T, keys, col, "_p").select(*keys, F.posexplode("_p").alias("dim", "v"))
    return minmax_scale(flat, "v", eps, ("image_id", "dim")).select(*keys, "dim", F.col("scaled").alias("v"))
