"""MinHash near-duplicates by a signature-coordinate inverted join.

Equal shingle sets are folded into one class first. Each class posts its signature's (coordinate, value)
pairs; pairs that only one class holds are dropped, and of the shared ones only the rarest go into the
posting lists: two signatures that agree on `least` of `coords` places must meet in a prefix of
(shared - least + 1) pairs taken in order of frequency. Within a list, collisions are counted on whole
signatures and classes above the match threshold are tied into candidate clusters. In each cluster links are confirmed on the full shingle sets.

Groups (lists and clusters) of more than LIST_BLOCK and BLOCK members are never compared pair by pair: `tied` deals their members to random blocks,
each one task's work, lets one row stand for each component of a block, and goes on with these representatives until they fit one block, which ties the members of a dense
group together in linear work. What is then still apart is compared exactly: members outside their group's largest component, in blocks, with all members
of the group. Each task returns a forest, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.common import byte_blocks, connected_components, gram_hashes, group_starts, local_stars, materialize, numbered, sliced, whole_groups, word_hashes

BLOCK = 256  # members of a cluster compared on full sets at once, by block
LIST_BLOCK = 1024  # the same for signatures in a posting list
LEVELS = 4  # of representatives in larger groups, at most


def _sets(texts: list[str], k: int):
    """Sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    for lo, hi in byte_blocks(raw):
        words, at = word_hashes(raw[lo:hi])
        for i in range(hi - lo):
            w = words[at[i] : at[i + 1]]
            yield np.unique(gram_hashes(w, min(k, len(w)))) if len(w) else w


def _coefficients(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 2**63, coords, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, coords, dtype=np.uint64)


def signatures(docs: DataFrame, k: int, coords: int) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set), sig (coords little-endian 32-bit minima; null for empty sets)."""

    def run(batches):
        a, b = _coefficients(coords)
        for pdf in sliced(batches):
            n, keys, sigs = [], [], []
            for s in _sets(list(pdf["text"]), k):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                low = np.full(coords, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(s), 4096):
                    low = np.minimum(low, (s[i : i + 4096, None] * a + b).min(0))
                sigs.append((low >> np.uint64(32)).astype("<u4").tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "key": keys, "sig": sigs})

    return docs.select("doc_id", "text").filter("doc_id is not null").mapInPandas(run, "doc_id long, n_shingles long, key binary, sig binary")


def _postings(classes: DataFrame, coords: int, least: int) -> DataFrame:
    def spread(batches):
        for pdf in batches:
            sig = np.frombuffer(b"".join(pdf["sig"]), "<u4").reshape(len(pdf), coords) if len(pdf) else np.zeros((0, coords), "<u4")
            elem = (np.arange(coords, dtype=np.int64)[None, :] << 32) | sig.astype(np.int64)
            yield pd.DataFrame({"doc": np.repeat(pdf["doc"].to_numpy(), coords), "elem": elem.ravel()})

    pairs = classes.select("doc", "sig").mapInPandas(spread, "doc long, elem long")
    shared = pairs.groupBy("elem").agg(F.count("*").alias("df")).filter("df > 1")
    own = pairs.join(shared, "elem").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "elem"))).alias("es"))
    own = own.filter(F.size("es") >= least)
    return own.select("doc", F.explode(F.slice("es", F.lit(1), F.size("es") - least + 1)).alias("e")).select("doc", "e.elem", "e.df")


def _signature_match(coords: int, least: int) -> Callable[[list, list], np.ndarray]:
    def match(a: list, b: list) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(v), "<u4").reshape(len(v), coords) for v in (a, b))
        return np.stack([(y == row).sum(1) >= least for row in x])

    return match


def _set_match(percent: int) -> Callable[[list, list], np.ndarray]:
    def match(a: list, b: list) -> np.ndarray:
        rows, others = ([np.frombuffer(x, np.uint64) for x in v] for v in (a, b))
        names, ids = np.unique(np.concatenate([*rows, *others]), return_inverse=True)
        own, n = np.array([len(x) for x in rows]), np.array([len(x) for x in others])
        at, first = np.cumsum(own) - own, np.cumsum(n) - n
        ids, theirs = ids[: own.sum()], ids[own.sum() :]
        mark, near = np.zeros(len(names), np.int32), np.zeros((len(rows), len(others)), bool)
        for i in range(len(rows)):
            mark[ids[at[i] : at[i] + own[i]]] = 1
            both = np.add.reduceat(mark[theirs], first)
            mark[ids[at[i] : at[i] + own[i]]] = 0
            near[i] = 100 * both >= percent * (n + own[i] - both)
        return near

    return match


def _labels(df: DataFrame, key: str, match: Callable[[list, list], np.ndarray]) -> DataFrame:
    """(key, doc, rep): each row of the groups (key, part) of df (doc, items) and the row that stands for its component of matching rows in the group."""
    groups = [key, "part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, groups):
            at, doc, items = group_starts(pdf, groups), pdf["doc"].to_numpy(), pdf["items"].tolist()
            rep = doc.copy()
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo > 1:
                    rep[lo:hi] = doc[lo:hi][local_stars(match(items[lo:hi], items[lo:hi]))]
            yield pd.DataFrame({key: pdf[key], "doc": doc, "rep": rep})

    dealt = df.repartition(*groups).sortWithinPartitions(*groups)
    return dealt.select(*groups, "doc", "items").mapInPandas(run, f"{key} long, doc long, rep long")


def _across(rows: DataFrame, keys: list[str], block: int, match: Callable[[list, list], np.ndarray]) -> DataFrame:
    """Edges between components: members outside the largest component of their group (keys, doc, items, comp, m) against all of the group."""
    sizes = rows.groupBy(*keys, "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy(*keys).agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), (F.sum("n") - F.max("n")).alias("rest"))
    rows = rows.join(largest, keys).withColumn("nb", F.ceil(F.col("m") / block).cast("int")).withColumn("nr", F.ceil(F.col("rest") / block).cast("int"))
    hashed = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = [*keys, "bi", "bj", "side", "comp", "doc", "items"]
    every = rows.withColumn("bi", hashed("nb")).withColumn("bj", each("nr")).withColumn("side", F.lit(1)).select(names)
    rest = rows.filter("comp <> largest").withColumn("bj", hashed("nr")).withColumn("bi", each("nb")).withColumn("side", F.lit(0)).select(names)
    groups = [*keys, "bi", "bj"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, groups):
            at, doc, comp, items = group_starts(pdf, groups), pdf["doc"].to_numpy(), pdf["comp"].to_numpy(), pdf["items"].tolist()
            side, out = pdf["side"].to_numpy(), [np.zeros((0, 2), np.int64)]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                mid = lo + int((side[lo:hi] == 0).sum())
                if lo < mid < hi:
                    i, j = np.nonzero(match(items[lo:mid], items[mid:hi]) & (comp[lo:mid, None] != comp[mid:hi]))
                    two = np.stack((comp[lo + i], comp[mid + j]), 1)
                    out.append(np.unique(np.sort(two, 1), axis=0))
            both = np.concatenate(out)
            yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    dealt = every.unionByName(rest).repartition(*groups).sortWithinPartitions(*groups, "side")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def tied(members: DataFrame, key: str, block: int, match: Callable[[list, list], np.ndarray]) -> DataFrame:
    """Edges (a, b) whose components are those of all matching pairs within groups (key) of members (key, m: size of the group, doc, items)."""
    pairs = lambda labels: labels.filter("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    edges = [pairs(_labels(members.filter(F.col("m") <= block).withColumn("part", F.lit(0)), key, match))]
    many = materialize(members.filter(F.col("m") > block), "many")
    if many.isEmpty():
        return edges[0]
    level, told = many, many.select(key, "doc", F.col("doc").alias("comp"))
    for turn in range(LEVELS):
        sized = level.join(level.groupBy(key).agg(F.count("*").alias("_r")), key)
        labels = materialize(_labels(sized.withColumn("part", F.pmod(F.xxhash64("doc", F.lit(turn)), F.ceil(F.col("_r") / block)).cast("int")), key, match), "labels")
        edges.append(pairs(labels))
        told = told.join(labels.select(key, F.col("doc").alias("comp"), "rep"), [key, "comp"]).select(key, "doc", F.col("rep").alias("comp"))
        if labels.groupBy(key).count().filter(F.col("count") > block).isEmpty():
            break
        level = labels.filter("doc = rep").select(key, "doc").join(many.select(key, "doc", "items"), [key, "doc"])
    told = materialize(told, "told")
    apart = told.groupBy(key).agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a <> _b").select(key)
    left = materialize(many.join(told.join(apart, key, "left_semi"), [key, "doc"]), "left")
    if not left.isEmpty():
        edges.append(materialize(_across(left, [key], block, match), "ties"))
    return reduce(DataFrame.unionByName, edges)


def candidate_edges(classes: DataFrame, coords: int, least: int) -> DataFrame:
    """Edges (a, b) that tie together all classes whose signatures agree on at least `least` coordinates."""
    post = materialize(_postings(classes, coords, least), "postings")
    held = post.join(classes.select("doc", F.col("sig").alias("items")), "doc").withColumnRenamed("df", "m")
    return tied(held, "elem", LIST_BLOCK, _signature_match(coords, least))


def confirmed_edges(docs: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) that tie together all classes of a cluster with 100 * intersection >= percent * union."""
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("m")), "cluster")
    # a merge join whatever the sizes: both sides grow with the corpus
    texts = sized.hint("merge").join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").dropDuplicates(["doc"])  # a repeated row is one member

    def sets(batches):
        for pdf in sliced(batches):
            yield pd.DataFrame({"cluster": pdf["cluster"], "m": pdf["m"], "doc": pdf["doc"], "items": [s.tobytes() for s in _sets(list(pdf["text"]), k)]})

    held = texts.select("cluster", "m", "doc", "text").mapInPandas(sets, "cluster long, m long, doc long, items binary")
    return tied(held, "cluster", BLOCK, _set_match(percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, coords: int = 64, sigmas: float = 3.3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text, and any further columns).

    A text's set is its distinct k-word shingles of lower-cased (A-Z) words; with fewer words the whole
    sequence as one; null, empty or blank texts have an empty set, link with nothing and are kept. Rows with a
    null doc_id are left out. Repeated rows come out as often as they went in. Different texts of one doc_id are documents of their own, in the order of a hash
    of their texts; the first of a group is kept. Links need
    100 * intersection >= percent * union and are confirmed on full sets; a pair reaches that step if its
    signatures agree on `coords * percent% - sigmas` standard deviations of places.
    """
    named, numbers = numbered(docs.select("doc_id", "text"))
    docs = named.select(F.col("_num").alias("doc_id"), "text")
    p = percent / 100
    least = max(1, int(coords * p - sigmas * (coords * p * (1 - p)) ** 0.5))
    sig = materialize(signatures(docs, k, coords), "sig")
    classes = sig.filter("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "sig")).alias("x")).select("key", F.col("x.doc_id").alias("doc"), "x.sig")
    classes = materialize(classes, "classes")
    clusters = connected_components(candidate_edges(classes, coords, least)).select(F.col("node").alias("doc"), F.col("comp").alias("cluster"))
    links = connected_components(confirmed_edges(docs, clusters, k, percent))
    low = classes.select("key", "doc").join(links, classes.doc == links.node, "left").select("key", F.coalesce("comp", "doc").alias("low"))
    out = sig.select("doc_id", "n_shingles", "key").join(low, "key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if numbers is None:
        return out
    own = numbers.select(F.col("doc_id").alias("_id"), F.col("_num").alias("doc_id"))
    low = numbers.select(F.col("doc_id").alias("_low"), F.col("_num").alias("component_id"))
    return out.join(own, "doc_id").join(low, "component_id").select(F.col("_id").alias("doc_id"), "n_shingles", F.col("_low").alias("component_id"), "kept")
