"""Embedding near-duplicates by NN-descent.

Equal vectors are folded into one node first. Neighbour lists of K start from buckets of random hyperplane signs and are refined by
neighbours-of-neighbours joins: the members of each node's neighbourhood (its list and the closest that list it) are compared with
one another, and what improves a list replaces its worst. After each round the recall of links is audited against
brute force for nodes drawn until enough of them have a link; rounds go on until it reaches the target. Only edges at or over
the threshold are kept. A list whose K places are all links is saturated, and may lack any further link: clusters are joined by the links between
saturated nodes, sought among all balls of such nodes whose centres and radii allow one, and the lists of a cluster with such a member are
enlarged to the cluster: members near its pivot link with one another by the triangle inequality, all others are compared with the cluster's members in
pairs of blocks, which are separate tasks. If then less than the target of all
links of the audited nodes is found, the start is repeated with as many tables as a pair at the threshold needs, and in the last resort
all pairs of nodes are compared.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.llm.common import connected_components, group_starts, materialize, whole_groups
from patchlake.sources.storage import shared_dir

BLOCK = 512
SALT = 4096  # members of a cluster that a join of what holds for the cluster reaches together, about


def _valid(column, dim: int) -> list[bytes | None]:
    out = []
    for v in column:
        x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
        ok = x is not None and len(x) == dim and np.isfinite(x).all() and x.any()
        out.append(x.tobytes() if ok else None)
    return out


def nodes(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, key, vec (unit vector in doubles) of each row; key and vec are null where a vector links with nothing."""

    def run(batches):
        for pdf in batches:
            raw = _valid(pdf["embedding"], dim)
            unit = [None if r is None else (x := np.frombuffer(r) / np.abs(np.frombuffer(r)).max()) / np.linalg.norm(x) for r in raw]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "key": [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw], "vec": [None if u is None else u.tobytes() for u in unit]})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id long, key binary, vec binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _bits(n: int, bucket: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n / bucket)))))


def _start(reps: DataFrame, n: int, dim: int, k: int, tables: int, bucket: int, seed: int) -> DataFrame:
    bits = _bits(n, bucket)

    def signs(batches):
        planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))
        for pdf in batches:
            x = _matrix(pdf["vec"], dim)
            for t in range(tables):
                code = ((x @ planes[t].T > 0) @ (1 << np.arange(bits))) if bits else np.zeros(len(x), np.int64)
                yield pd.DataFrame({"u": pdf["u"], "code": code.astype(np.int64) * tables + t})

    codes = materialize(reps.select("u", "vec").mapInPandas(signs, "u long, code long"), "codes")
    parts = codes.groupBy("code").agg(F.ceil(F.count("*") / (2 * bucket)).alias("parts"))
    dealt = codes.join(parts, "code").withColumn("part", F.pmod(F.xxhash64("u", "code"), F.col("parts"))).join(reps.select("u", "vec"), "u")

    def compare(batches):
        for pdf in whole_groups(batches, ["code", "part"]):
            at, u, x = group_starts(pdf, ["code", "part"]), pdf["u"].to_numpy(), _matrix(pdf["vec"], dim)
            out = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                s = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(s, -2)
                top = np.argsort(-s, 1)[:, : min(k, hi - lo - 1)]
                out.append((np.repeat(u[lo:hi], top.shape[1]), u[lo:hi][top].ravel(), np.take_along_axis(s, top, 1).ravel()))
            yield pd.DataFrame(dict(zip("uvs", map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return dealt.repartition("code", "part").sortWithinPartitions("code", "part").select("code", "part", "u", "vec").mapInPandas(compare, "u long, v long, s double")


def _best(edges: DataFrame, k: int) -> DataFrame:
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v")))
    return ranked.filter(F.col("r") <= k).drop("r")


def _refine(lists: DataFrame, reps: DataFrame, dim: int, k: int) -> DataFrame:
    """One round: neighbours of neighbours."""
    around = _best(lists.union(lists.select("v", "u", "s")), 2 * k).select(F.col("u").alias("c"), F.col("v").alias("u"))
    around = around.union(lists.select(F.col("u").alias("c"), "u").distinct())
    worst = lists.groupBy("u").agg(F.min("s").alias("low"), F.count("*").alias("have")).select("u", F.when(F.col("have") < k, F.lit(-2.0)).otherwise(F.col("low")).alias("low"))
    held = around.join(reps.select("u", "vec").join(worst, "u"), "u").repartition("c").sortWithinPartitions("c")

    def compare(batches):
        for pdf in whole_groups(batches, ["c"]):
            at, u, low, x = group_starts(pdf, ["c"]), pdf["u"].to_numpy(), pdf["low"].to_numpy(), _matrix(pdf["vec"], dim)
            out = [(u[:0], u[:0], low[:0])]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                s = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(s, -3)
                i, j = np.nonzero(s > low[lo:hi, None])
                out.append((u[lo + i], u[lo + j], s[i, j]))
            yield pd.DataFrame(dict(zip("uvs", map(np.concatenate, zip(*out, strict=True)), strict=True))).drop_duplicates(["u", "v"])

    return _best(lists.unionByName(held.select("c", "u", "low", "vec").mapInPandas(compare, "u long, v long, s double")), k)


def _add(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def true_links(reps: DataFrame, n: int, dim: int, threshold: float, least: int = 64, first: int = 512, block: int = 4096) -> DataFrame:
    """(u, links, weight) by brute force for audited nodes that have a link: all nodes near them, and the rows these stand for.

    Nodes are drawn in blocks by hash until `least` of them have a link or all are drawn, so rare links are never taken for found ones.
    """
    path, place = f"{shared_dir(reps.sparkSession)}/truth-{uuid.uuid4().hex}", F.xxhash64("u") / F.lit(2.0**64) + 0.5
    lo, step, seen = 0.0, first, 0
    while True:
        hi = lo + step / max(1, n)
        picked = reps.filter((place >= lo) & ((place < hi) | F.lit(hi >= 1))).select("u", "vec").collect()
        ids, q = np.array([r["u"] for r in picked], np.int64), _matrix([r["vec"] for r in picked], dim)

        def brute(batches, ids=ids, q=q):
            for pdf in batches:
                u, w, x = pdf["u"].to_numpy(), pdf["w"].to_numpy(), _matrix(pdf["vec"], dim)
                links, weight = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                for at in range(0, len(u), 1024):
                    near = (x[at : at + 1024] @ q.T >= threshold) & (u[at : at + 1024, None] != ids)
                    links += near.sum(0)
                    weight += w[at : at + 1024] @ near
                yield pd.DataFrame({"u": ids, "links": links, "weight": weight})[links > 0]

        part = reps.select("u", "w", "vec").mapInPandas(brute, "u long, links long, weight long").groupBy("u").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
        part = materialize(part, "true")
        seen += part.count()
        _add(part, path)
        if seen >= least or hi >= 1:
            return reps.sparkSession.read.schema(part.schema).parquet(path)
        lo, step = hi, block


def _share(true: DataFrame, found: DataFrame, most: int | None = None) -> float:
    """Of the true numbers (u, n) of audited nodes, at most `most` each, the share that is found; 1 if no node of the table has a link."""
    cap = (lambda c: F.least(c, F.lit(most))) if most else (lambda c: c)
    both = true.select("u", cap(F.col("n")).alias("t")).join(found.select("u", F.col("n").alias("f")), "u", "left")
    row = both.agg(F.sum("t").alias("t"), F.sum(F.least(F.coalesce("f", F.lit(0)), "t")).alias("f")).first()
    return 1.0 if not row["t"] else row["f"] / row["t"]


def _meeting(points: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, of the ids of points (u, id, cluster, r, vec) of two clusters whose balls of angle r (points, if 0) may hold a link.

    All pairs are compared, a block of points against the table at a time.
    """
    size = max(1, min(4096, (1 << 22) // dim))
    blocks = max(1, -(-points.count() // size))
    points = materialize(points.withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks))), "points")
    path, wide, schema = f"{shared_dir(points.sparkSession)}/meeting-{uuid.uuid4().hex}", float(np.arccos(threshold)), "a long, b long"
    for i in range(blocks):
        own = points.filter(F.col("block") == i).select("id", "cluster", "r", "vec").collect()
        ids, of, r, q = np.array([o["id"] for o in own], np.int64), np.array([o["cluster"] for o in own], np.int64), np.array([o["r"] for o in own]), _matrix([o["vec"] for o in own], dim)

        def compare(batches, ids=ids, of=of, r=r, q=q):
            for pdf in batches:
                x, out = _matrix(pdf["vec"], dim), [np.zeros((0, 2), np.int64)]
                for at in range(0, len(x), 1024):
                    reach = pdf["r"].to_numpy()[at : at + 1024, None] + r
                    need = np.where(reach > 0, np.cos(np.minimum(np.pi, wide + reach)) - 1e-9, threshold)
                    k, j = np.nonzero((x[at : at + 1024] @ q.T >= need) & (pdf["cluster"].to_numpy()[at : at + 1024, None] != of))
                    out.append(np.unique(np.sort(np.stack((pdf["id"].to_numpy()[at + k], ids[j]), 1), 1), axis=0))
                both = np.unique(np.concatenate(out), axis=0)
                yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

        if own:
            _add(points.filter(F.col("block") <= i).select("id", "cluster", "r", "vec").mapInPandas(compare, schema), path)
        else:
            _add(points.sparkSession.createDataFrame([], schema), path)
    return points.sparkSession.read.schema(schema).parquet(path).distinct()


def _crossing(full: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of clusters with a link between their saturated nodes (u, cluster, vec).

    Nodes of a cluster are gathered in balls; balls of two clusters whose centres and radii allow a link are compared node by node.
    """
    sized = full.join(full.groupBy("cluster").agg(F.ceil(F.count("*") / 2048).alias("parts")), "cluster")
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts"))).repartition("cluster", "part").sortWithinPartitions("cluster", "part", "u")

    def gather(batches):
        for pdf in whole_groups(batches, ["cluster", "part"]):
            at, u, x = group_starts(pdf, ["cluster", "part"]), pdf["u"].to_numpy(), _matrix(pdf["vec"], dim)
            ball, r, centre = np.full(len(u), -1), np.zeros(len(u)), [None] * len(u)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                left = np.arange(lo, hi)
                while len(left):
                    near = x[left] @ x[left[0]] >= threshold
                    near[0] = True
                    own, left = left[near], left[~near]
                    c = x[own].sum(0)
                    c /= np.linalg.norm(c)
                    ball[own], centre[own[0]] = own[0], c.tobytes()
                    r[own] = np.arccos(np.clip(x[own] @ c, -1, 1)).max() + 1e-6
            yield pd.DataFrame({"u": u, "cluster": pdf["cluster"], "id": u[ball], "r": r, "vec": pdf["vec"], "centre": centre})

    held = dealt.select("cluster", "part", "u", "vec").mapInPandas(gather, "u long, cluster long, id long, r double, vec binary, centre binary")
    held = materialize(held, "balls")
    balls = held.filter("centre is not null").select("u", "id", "cluster", "r", F.col("centre").alias("vec"))
    pairs = materialize(_meeting(balls, dim, threshold), "pairs")
    side = lambda c: pairs.join(held.select(F.col("id").alias(c), "cluster", "vec"), c).select("a", "b", F.lit(c).alias("side"), "cluster", "vec")
    both = side("a").unionByName(side("b")).repartition("a", "b").sortWithinPartitions("a", "b", "side")

    def compare(batches):
        for pdf in whole_groups(batches, ["a", "b"]):
            at, x, cluster, first = group_starts(pdf, ["a", "b"]), _matrix(pdf["vec"], dim), pdf["cluster"].to_numpy(), (pdf["side"] == "a").to_numpy()
            out = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                mid = lo + int(first[lo:hi].sum())
                if (x[lo:mid] @ x[mid:hi].T >= threshold).any():
                    out.append((cluster[lo], cluster[mid]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return both.mapInPandas(compare, "a long, b long").distinct()


def _spread(df: DataFrame, m: str) -> DataFrame:
    """One row per cluster as often as the cluster's members have salts."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"{m} DIV {SALT}"))))


def _by_pairs(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(u, n): weights of links between outer members and all members (cluster, u, m, w, vec, inner, outer: number of outer ones) of a cluster, block by block."""
    hashed = lambda n: F.pmod(F.xxhash64("u"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    df = members.withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("no", F.ceil(F.col("outer") / BLOCK).cast("int"))
    names, keys = ["cluster", "bi", "bj", "side", "u", "w", "inner", "vec"], ["cluster", "bi", "bj"]
    every = df.withColumn("bi", hashed("nb")).withColumn("bj", each("no")).withColumn("side", F.lit(0)).select(names)
    outer = df.filter("not inner").withColumn("bj", hashed("no")).withColumn("bi", each("nb")).withColumn("side", F.lit(1)).select(names)

    def compare(batches):
        for pdf in whole_groups(batches, keys):
            at, u, w, inner, x = group_starts(pdf, keys), pdf["u"].to_numpy(), pdf["w"].to_numpy(), pdf["inner"].to_numpy(), _matrix(pdf["vec"], dim)
            side, n = pdf["side"].to_numpy(), np.zeros(len(pdf), np.int64)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                mid = lo + int((side[lo:hi] == 0).sum())
                near = (x[lo:mid] @ x[mid:hi].T >= threshold) & (u[lo:mid, None] != u[mid:hi])
                n[lo:mid] = near @ w[mid:hi]
                n[mid:hi] = (w[lo:mid] * inner[lo:mid]) @ near  # links of two outer ones are counted on the first side
            yield pd.DataFrame({"u": u, "n": n})[n > 0]

    dealt = every.unionByName(outer).repartition(*keys).sortWithinPartitions(*keys, "side")
    return dealt.select(names).mapInPandas(compare, "u long, n long")


def _enlarged(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(u, n): for members (cluster, u, m, w, vec) the weight of all links within the cluster.

    The member that names the cluster is its pivot. Members within half the threshold's angle of it all link with one another, so only the outer ones
    are compared with the cluster's members, block by block.
    """
    half = float(np.arccos(threshold)) / 2 - 1e-7
    pivots = _spread(members.filter("u = cluster").select("cluster", "m", F.col("vec").alias("pivot")), "m").drop("m")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("u"), F.expr(f"m DIV {SALT} + 1")))

    def place(batches):
        for pdf in batches:
            near = (_matrix(pdf["vec"], dim) * _matrix(pdf["pivot"], dim)).sum(1)
            yield pdf.drop(columns="pivot").assign(inner=np.arccos(np.clip(near, -1, 1)) <= half)

    names = ["cluster", "salt", "u", "m", "w", "vec"]
    placed = salted.join(pivots, ["cluster", "salt"]).select(*names, "pivot").mapInPandas(place, "cluster long, salt long, u long, m long, w long, vec binary, inner boolean")
    placed = materialize(placed, "placed")
    sums = placed.groupBy("cluster").agg(F.max("m").alias("_m"), F.coalesce(F.sum(F.when(F.col("inner"), F.col("w"))), F.lit(0)).alias("weight"), F.count(F.when(~F.col("inner"), 1)).alias("outer"))
    told = placed.join(_spread(sums, "_m").drop("_m"), ["cluster", "salt"])
    sure = told.filter("inner").select("u", (F.col("weight") - F.col("w")).alias("n"))
    return sure.unionByName(_by_pairs(told.filter("outer > 0"), dim, threshold)).groupBy("u").agg(F.sum("n").alias("n"))


def _enough(n: int, bucket: int, threshold: float, target: float) -> int:
    """Number of start tables in which a pair at the threshold shares a bucket at least once with the chance `target`."""
    p = (1 - np.arccos(threshold) / np.pi) ** _bits(n, bucket)
    return 1 if p >= 1 else int(np.ceil(np.log(1 - target) / np.log(1 - p)))


def _merged(clusters: DataFrame, joined: DataFrame) -> DataFrame:
    low = connected_components(joined).select(F.col("node").alias("cluster"), F.col("comp").alias("low"))
    return materialize(clusters.join(low, "cluster", "left").select("u", F.coalesce("low", "cluster").alias("cluster")), "clusters")


def _counted(clusters: DataFrame, full: DataFrame, reps: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(u, n) for the nodes of the clusters of full: all links within the cluster."""
    sized = clusters.join(full, "cluster").join(clusters.groupBy("cluster").agg(F.count("*").alias("m")), "cluster")
    return _enlarged(sized.join(reps.select("u", "w", "vec"), "u"), dim, threshold)


def _degrees(lists: DataFrame, reps: DataFrame, dim: int, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Clusters (u, cluster) of the lists' links and of those between saturated nodes, and the weight (u, n) of each node's links."""
    links = materialize(lists.filter(F.col("s") >= threshold), "links")
    clusters = materialize(connected_components(links, "u", "v").select(F.col("node").alias("u"), F.col("comp").alias("cluster")), "clusters")
    saturated = materialize(links.groupBy("u").count().filter(F.col("count") >= k).select("u"), "saturated")
    clusters = _merged(clusters, _crossing(saturated.join(clusters, "u").join(reps.select("u", "vec"), "u"), dim, threshold))
    full = saturated.join(clusters, "u").select("cluster").distinct()
    big = _counted(clusters, full, reps, dim, threshold)
    both = links.select("u", "v").union(links.select("v", "u")).distinct().join(clusters, "u").join(full, "cluster", "left_anti")
    small = both.join(reps.select(F.col("u").alias("v"), "w"), "v").groupBy("u").agg(F.sum("w").alias("n"))
    return clusters, materialize(big.unionByName(small), "degrees")


def _all_links(clusters: DataFrame, reps: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The same from all pairs of nodes, block by block."""
    all_nodes = materialize(reps.select("u", "vec").join(clusters, "u", "left").select("u", F.coalesce("cluster", "u").alias("cluster"), "vec"), "nodes")
    points = all_nodes.select("u", F.col("cluster").alias("id"), "cluster", F.lit(0.0).alias("r"), "vec")
    clusters = _merged(all_nodes.select("u", "cluster"), _meeting(points, dim, threshold))
    return clusters, _counted(clusters, clusters.groupBy("cluster").count().filter("count > 1").select("cluster"), reps, dim, threshold)


def link_vectors(vectors: DataFrame, threshold: float = 0.95, k: int = 10, tables: int = 4, bucket: int = 64, rounds: int = 6, target: float = 0.98, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall (one number: the share of the audited nodes' true links that was found) for each row of vectors (vec_id, embedding).

    Cosines are computed in doubles; pairs at or over the threshold are links. Vectors that are null, zero, hold a null or non-finite
    component, or differ in length from most, link with nothing. Rows with a null vec_id are left out; rows that repeat a vec_id
    with the same vector link with one another, and rows that repeat it with another vector are vectors of their own.
    """
    vectors = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 1
    own = materialize(nodes(vectors, dim), "vectors")
    reps = own.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("u"), F.count("*").alias("w"), F.first("vec").alias("vec"))
    reps = materialize(reps.withColumn("own", F.col("u")), "reps")
    if not reps.groupBy("u").count().filter("count > 1").isEmpty():  # different vectors share an id: nodes get numbers in the order of the ids
        ranged = reps.drop("u").repartitionByRange("own", "key").sortWithinPartitions("own", "key")
        reps = materialize(ranged.withColumn("u", F.monotonically_increasing_id()), "reps")
    n = reps.count()
    true = true_links(reps, n, dim, threshold)
    lists, found, recall = None, None, 0.0
    for turn, many in enumerate((tables, max(tables, _enough(n, bucket, threshold, target)))):
        start = _start(reps, n, dim, k, many, bucket, seed + turn)
        lists = materialize(_best(start if lists is None else lists.unionByName(start), k), "lists")
        for _ in range(rounds):
            lists = materialize(_refine(lists, reps, dim, k), "lists")
            held = lists.filter(F.col("s") >= threshold).groupBy("u").agg(F.count("*").alias("n"))
            listed = _share(true.select("u", F.col("links").alias("n")), held, k)
            if listed >= target:
                break
        clusters, found = _degrees(lists, reps, dim, k, threshold)
        recall = _share(true.select("u", F.col("weight").alias("n")), found)
        if listed >= target and recall >= target:
            break
    else:
        recall = 1.0
        clusters, found = _all_links(clusters, reps, dim, threshold)
    out = reps.select("key", "u", "w").join(found, "u", "left").join(clusters, "u", "left")
    out = out.select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("cluster", "u").alias("low"))
    out = out.join(reps.select(F.col("u").alias("low"), "own"), "low").select("key", "n_links", F.col("own").alias("low"))
    out = own.select("vec_id", "key").join(out, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumn("audited_recall", F.lit(float(recall)))
