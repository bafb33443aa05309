"""Shared pieces of the corpus operators: durable intermediates, components, word hashing, batching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.sources.storage import materialize


def ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of the edges; comp is the smallest node of its component.

    Contraction with random priorities: each node hooks to the neighbour of the smallest hashed
    priority, hooks are shortened by pointer jumping, and the edges are relabelled until none is left.
    Only sums and equi-joins are used, so a hub is pre-aggregated or split by adaptive skew joins.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct()
    e = materialize(e, "edges")
    both = e.select("a").union(e.select("b")).distinct().select(F.col("a").alias("node"))
    label = both.withColumn("comp", F.col("node"))
    turn = 0
    while not e.isEmpty():
        turn += 1
        pr = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("v"))  # noqa: E731, B023
        d = e.select("a", "b").union(e.select("b", "a"))
        hook = d.groupBy("a").agg(F.least(F.min(pr("b")), pr("a")).getField("v").alias("up"))
        hook = materialize(hook.withColumnRenamed("a", "u"), "hook")
        up = hook.select(F.col("u").alias("x"), F.col("up").alias("y"))
        for _ in range(2):
            hook = hook.join(up, hook.up == up.x).select("u", F.col("y").alias("up"))
        hook = materialize(hook, "jump")
        left, right = hook.select(F.col("u").alias("a"), F.col("up").alias("na")), hook.select(F.col("u").alias("b"), F.col("up").alias("nb"))
        e = materialize(e.join(left, "a").join(right, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).filter("a <> b").distinct(), "edges")
        label = label.join(hook, label.comp == hook.u, "left").select("node", F.coalesce("up", "comp").alias("comp"))
        label = materialize(label, "label")
    least = label.groupBy("comp").agg(F.min("node").alias("low"))
    return label.join(least, "comp").select("node", F.col("low").alias("comp"))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of docs (doc_id, text, ...) that have a doc_id with _num, one number for each text of a doc_id, and (doc_id, _num) where some id has several.

    Ids that stand for one text each are their own numbers, and no table of numbers comes back; else numbers go by doc_id, then by a hash of the text.
    """
    named = docs.filter("doc_id is not null").withColumn("_hash", F.coalesce(F.xxhash64("text"), F.lit(0)))
    ids = materialize(named.select(F.col("doc_id").cast("long").alias("doc_id"), "_hash").distinct(), "ids")
    if ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return named.withColumn("_num", F.col("doc_id").cast("long")).drop("_hash"), None
    ids = ids.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").withColumn("_num", F.monotonically_increasing_id())
    ids = materialize(ids, "numbers")
    return materialize(named.hint("merge").join(ids, ["doc_id", "_hash"]).drop("_hash"), "numbered"), ids.select("doc_id", "_num")


def sliced(batches: Iterator[pd.DataFrame], rows: int = 1024) -> Iterator[pd.DataFrame]:
    """The frames in slices of at most `rows` rows, so that of long texts a task holds copies and results of a few at a time."""
    for pdf in batches:
        for lo in range(0, len(pdf), rows):
            yield pdf.iloc[lo : lo + rows].reset_index(drop=True)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups only; the rows of a partition must come sorted by keys."""
    rest: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        cut = len(pdf) - int(last[::-1].argmin() or len(pdf)) if not last.all() else 0
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        rest = pdf.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def group_starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Row numbers at which groups of a sorted frame begin, and its length at the end."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(pdf))


def local_stars(adjacent: np.ndarray) -> np.ndarray:
    """For a boolean adjacency matrix, each row's smallest connected row."""
    lab = np.arange(len(adjacent))
    reach = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        new = np.where(reach, lab[None, :], len(lab)).min(1)
        new = np.minimum(new, new[new])
        if (new == lab).all():
            return lab
        lab = new


def byte_blocks(texts: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Slices of the texts of about `most` bytes each; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+`, and for each text the number where its words begin (plus the total)."""
    buf = b"\n".join(texts) + b"\n"
    arr = np.frombuffer(buf, np.uint8)
    ink = ~_SPACE[arr]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ink)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    pos = np.arange(int(size.sum())) - np.repeat(first, size)
    power = np.multiply.accumulate(np.full(int(size.max()), _BASE, np.uint64))
    return _mix(np.add.reduceat(_BYTE[arr[ink]] * power[pos], first) + size.astype(np.uint64)), bounds


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of n consecutive word hashes, one for each start."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    return _mix(out)
