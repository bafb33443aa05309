"""Prefix trie of conversations, counted in flat arrays behind minimal perfect hashes.

A node is a distinct sequence of turns (role, text); its key is a 128-bit digest, the sums of two 64-bit hashes of (place, role, text) over its
turns, and each row (conversation, depth) of the rebuilt conversations knows its node's and its parent's key. Rows are dealt to shards by ranges
of (conv_id, depth), so a long conversation is parted like any other. A shard lists its distinct keys, gives each a slot by a minimal perfect hash (every
slot is checked against the key it holds), scatters its counts into flat arrays and sums subtrees through the array of parent slots, deepest nodes
first. Shards' partial nodes meet by key; that all rows of a node agree on parent and depth is checked there.

Subtree sums count every node once, for its owner, the smallest member. Where a conversation goes on in a later range that part is a shard of its own,
and what is owned there is added where the conversation leaves its earlier ranges.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.llm.common import _mix, group_starts, materialize, whole_groups

SHARD = 200_000  # rows of a shard, about
KEY, UP = ["k1", "k2"], ["p1", "p2"]
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class PerfectHash:
    """Slots 0..n-1 for n distinct 128-bit keys: buckets, largest first, each with the first seed that sends its keys to free slots."""

    def __init__(self, a: np.ndarray, b: np.ndarray, load: int = 4):
        n = self.n = len(a)
        self.buckets = max(1, n // load)
        self.seed = np.zeros(self.buckets, np.int64)
        self.key = np.zeros((2, n), np.uint64)
        if not n:
            return
        bucket = self._bucket(a, b)
        size = np.bincount(bucket, minlength=self.buckets)
        order = np.argsort(bucket, kind="stable")
        first = np.cumsum(size) - size
        taken = np.zeros(n, bool)
        for s in range(int(size.max()), 1, -1):
            left = np.flatnonzero(size == s)
            seed = 1
            while len(left):  # all buckets of one size try one seed after the other together
                rows = order[first[left][:, None] + np.arange(s)]
                slot = self._slot(a[rows], b[rows], seed)
                own = np.sort(slot, 1)
                good = ~taken[slot].any(1) & (own[:, 1:] != own[:, :-1]).all(1)
                count = np.bincount(slot[good].ravel(), minlength=n)
                clash = good & (count[slot] > 1).any(1)
                firsts = np.flatnonzero(clash)[:1]  # of buckets that want one slot the first gets it
                good &= ~clash
                good[firsts] = True
                taken[slot[good]] = True
                self.seed[left[good]] = seed
                left = left[~good]
                seed += 1
        free = np.flatnonzero(~taken)
        single = np.flatnonzero(size == 1)
        self.seed[single] = -1 - free[: len(single)]  # a key that is alone in its bucket names its slot
        slot = self._where(a, b)
        if len(np.unique(slot)) != n:
            raise RuntimeError("two keys share a slot")
        self.key[:, slot] = a, b

    def _bucket(self, a, b):
        return (_mix(a ^ (b * _STEP[0])) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, a, b, seed):
        return (_mix((a + np.asarray(seed).astype(np.uint64) * _STEP[1]) ^ b) % np.uint64(self.n)).astype(np.int64)

    def _where(self, a, b):
        seed = self.seed[self._bucket(a, b)]
        return np.where(seed < 0, -1 - seed, self._slot(a, b, np.maximum(seed, 0)))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where the slot holds another key."""
        if not self.n:
            return np.full(len(a), -1)
        slot = self._where(a, b)
        return np.where((self.key[0][slot] == a) & (self.key[1][slot] == b), slot, -1)


def _u(column: pd.Series) -> np.ndarray:
    return column.to_numpy(dtype=np.int64).view(np.uint64)


def _numbered(df: DataFrame, conv: str, order: list, ranges: int | None = None) -> DataFrame:
    """df sorted by conv and order over ranges, with range, pos (row of the conversation, from 1) and begun (rows of it in earlier ranges).

    One conversation may fill many ranges: each counts its own rows and the earlier ranges' counts are added.
    """
    by = [F.col(conv), *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    fields = [f for f in df.columns if not f.startswith("_")]
    schema = ", ".join(f"{f} {df.schema[f].dataType.simpleString()}" for f in fields) + ", own long"

    def count(batches):
        last, at = None, 0
        for pdf in batches:
            if len(pdf):
                c = pdf[conv].to_numpy()
                first = np.flatnonzero(np.concatenate(([c[0] != last], c[1:] != c[:-1])))
                own = np.arange(1, len(c) + 1) + at
                for lo, hi in zip(first, np.append(first[1:], len(c)), strict=True):
                    own[lo:hi] = np.arange(1, hi - lo + 1)
                last, at = c[-1], own[-1]
                yield pdf[fields].assign(own=own)

    rows = materialize(dealt.sortWithinPartitions(*by).mapInPandas(count, schema).withColumn("range", F.spark_partition_id()), "ranges")
    ends = rows.groupBy(conv, "range").agg(F.max("own").alias("n"))
    parted = ends.groupBy(conv).agg(F.count("*").alias("c")).filter("c > 1").select(conv)
    earlier = Window.partitionBy(conv).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = ends.join(parted, conv, "left_semi").withColumn("begun", F.sum("n").over(earlier)).filter("begun is not null").select(conv, "range", "begun")
    joined = rows.join(begun, [conv, "range"], "left").withColumn("begun", F.coalesce("begun", F.lit(0)).cast("long"))
    return joined.withColumn("pos", F.col("own") + F.col("begun")).drop("own")


def rebuild(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv, size) of all and (conv, d, a, b, words) of their turns, a and b hashes of role and text.

    Conversation c begins with the first h turns of conversation c - c % every, h = crc32(decimal c) % most, and goes on with its own after the first h.
    Turns stand by turn (null first), then role and text; null roles and texts are empty ones; rows with a null conv_id are left out.
    """
    own = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_id"))
    own = own.withColumns({"a": F.xxhash64("_role", "_text"), "b": F.xxhash64(F.lit("b"), "_text", "_role"), "words": F.regexp_count("_text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")})
    order = [F.col("turn").asc_nulls_first(), F.substring("_role", 1, 64), F.substring("_text", 1, 64), F.col("_id")]
    held = materialize(_numbered(own, "conv", order).select("conv", "pos", "a", "b", "words"), "turns")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = held.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": h, "root": F.col("conv") - F.col("conv") % every})
    tops = held.filter((F.col("conv") % every == 0) & (F.col("pos") < most))
    length = tops.groupBy(F.col("conv").alias("root")).agg(F.count("*").alias("r"))
    convs = convs.join(length, "root", "left").withColumn("given", F.least("h", F.coalesce("r", F.lit(0))))
    convs = materialize(convs.select("conv", "root", "h", "given", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "convs")
    first = tops.withColumnRenamed("conv", "root").join(convs, "root").filter("pos <= given").select("conv", F.col("pos").alias("d"), "a", "b", "words")
    rest = held.join(convs, "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("d"), "a", "b", "words")
    return convs.select("conv", "size"), first.unionByName(rest)


def _keyed(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(shard, conv, d, words, last, left, keys of node and parent): a row for every conversation and depth, from 0 on.

    Shards come in the order of their conversations: in a range first the part of one begun before, then the others. last: the conversation ends here; left: it goes on in another shard.
    """
    top = convs.select("conv", F.lit(0).cast("long").alias("d"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "words")])
    every = materialize(top.unionByName(rows), "rebuilt")
    ranges = every.count() // SHARD + 1
    placed = _numbered(every, "conv", [F.col("d")], ranges)
    kept = ["conv", "d", "words", "range", "begun"]
    schema = "conv long, d long, words long, range int, begun long, h1 long, h2 long, k1 long, k2 long"

    def sums(batches):
        for pdf in whole_groups(batches, ["range"]):
            d = pdf["d"].to_numpy().astype(np.uint64)
            cut = group_starts(pdf, ["range", "conv"])
            group, made = np.repeat(cut[:-1], np.diff(cut)), {}
            for i, f in enumerate("ab"):
                h = np.where(d > 0, _mix(_u(pdf[f]) + d * _STEP[i]), np.uint64(0))
                run = np.cumsum(h)
                run -= (run - h)[group]
                made |= {f"h{i + 1}": h.view(np.int64), f"k{i + 1}": run.view(np.int64)}
            yield pdf[kept].assign(**made)

    ordered = placed.select("conv", "d", "a", "b", "words", "range", "begun").repartition("range").sortWithinPartitions("range", "conv", "d")
    local = materialize(ordered.mapInPandas(sums, schema), "sums")

    def before(batches):
        """Sums of a parted conversation's earlier ranges, added modulo 2**64 range by range."""
        last, at = None, np.zeros(2, np.uint64)
        for pdf in batches:
            out = np.zeros((len(pdf), 2), np.uint64)
            for i, (c, *k) in enumerate(zip(pdf["conv"].to_numpy(), _u(pdf["k1"]), _u(pdf["k2"]), strict=True)):
                if c != last:
                    last, at = c, np.zeros(2, np.uint64)
                out[i] = at
                at = at + np.array(k, np.uint64)
            yield pdf[["conv", "range"]].assign(a1=out[:, 0].view(np.int64), a2=out[:, 1].view(np.int64))

    parted = local.filter("begun > 0").select("conv").distinct()
    ends = local.join(parted, "conv", "left_semi").groupBy("conv", "range").agg(F.max_by(F.struct("k1", "k2"), "d").alias("k"), F.max("d").alias("left_at"))
    ends = materialize(ends.select("conv", "range", "k.*", "left_at"), "ends")
    earlier = ends.select("conv", "range", "k1", "k2").repartition("conv").sortWithinPartitions("conv", "range").mapInPandas(before, "conv long, range int, a1 long, a2 long")
    shift = earlier.join(ends.select("conv", "range", "left_at"), ["conv", "range"])
    joined = local.join(shift, ["conv", "range"], "left").join(convs, "conv")

    def keys(batches):
        for pdf in batches:
            out = {}
            for i in "12":
                k = _u(pdf[f"k{i}"]) + _u(pdf[f"a{i}"])
                out |= {f"k{i}": k.view(np.int64), f"p{i}": (k - _u(pdf[f"h{i}"])).view(np.int64)}
            yield pdf[["shard", "conv", "d", "words", "last", "left"]].assign(**out)

    shard = (F.col("range").cast("long") * 2 + (F.col("begun") == 0).cast("int")).alias("shard")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    named = joined.select(shard, "conv", "d", "words", "h1", "h2", "k1", "k2", zero("a1"), zero("a2"), (F.col("d") == F.col("size")).alias("last"), F.coalesce((F.col("d") == F.col("left_at")) & (F.col("d") < F.col("size")), F.lit(False)).alias("left"))
    return materialize(named.mapInPandas(keys, "shard long, conv long, d long, words long, last boolean, left boolean, k1 long, k2 long, p1 long, p2 long"), "keyed")


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack((a, b), 1), axis=0)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _partial_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes: keys, parents, depth, words, n (members that stand here), low (the smallest), inner (some member goes on), ends (ids of those that end)."""
    a, b, pa, pb = (_u(pdf[c]) for c in (*KEY, *UP))
    d, conv = pdf["d"].to_numpy(), pdf["conv"].to_numpy()
    slots = PerfectHash(*_distinct(a, b))
    at, up = slots(a, b), slots(pa, pb)
    n, low = np.bincount(at, minlength=slots.n), np.full(slots.n, np.iinfo(np.int64).max)
    np.minimum.at(low, at, conv)
    depth, words, parent = np.zeros(slots.n, np.int64), np.zeros(slots.n, np.int64), np.zeros((2, slots.n), np.uint64)
    depth[at], words[at] = d, pdf["words"].to_numpy()
    parent[:, at] = pa, pb
    if (depth[at] != d).any() or (parent[0][at] != pa).any() or (parent[1][at] != pb).any():
        raise ValueError("two prefixes share a digest")
    inner = np.zeros(slots.n, bool)
    inner[at[~pdf["last"].to_numpy()]] = True
    last = np.flatnonzero(pdf["last"].to_numpy())
    last = last[np.lexsort((conv[last], at[last]))]
    ends: list[bytes | None] = [None] * slots.n
    if len(last):
        cut = np.flatnonzero(np.diff(at[last])) + 1
        for s, ids in zip(at[last[np.concatenate(([0], cut))]], np.split(conv[last], cut), strict=True):
            ends[s] = ",".join(map(str, ids.tolist())).encode()
    i64 = lambda x: x.view(np.int64)
    return pd.DataFrame({"shard": pdf["shard"].iloc[0], "k1": i64(slots.key[0]), "k2": i64(slots.key[1]), "p1": i64(parent[0]), "p2": i64(parent[1]), "d": depth, "words": words, "n": n, "low": low, "inner": inner, "ends": ends})


def _subtree_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's part of every node's sums over its subtree: leaves and saved (of nodes owned here and what joins them), kids of its own.

    A parent that stands in another shard gets its kids only.
    """
    a, b, pa, pb = (_u(pdf[c]) for c in (*KEY, *UP))
    slots = PerfectHash(*_distinct(a, b))
    at = slots(a, b)
    depth, up, kids = np.zeros(slots.n, np.int64), np.full(slots.n, -1), np.zeros(slots.n, np.int64)
    sums = np.zeros((2, slots.n), np.int64)
    depth[at] = pdf["d"].to_numpy()
    up[at] = np.where(pdf["d"].to_numpy() > 0, slots(pa, pb), -1)
    np.add.at(sums, (0, at), pdf["leaf"].to_numpy())
    np.add.at(sums, (1, at), pdf["saved"].to_numpy())
    owned = pdf["owned"].to_numpy() & (pdf["d"].to_numpy() > 0)
    here = owned & (up[at] >= 0)
    np.add.at(kids, up[at[here]], 1)
    order = np.argsort(-depth, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        rows = rows[up[rows] >= 0]
        np.add.at(sums, (slice(None), up[rows]), sums[:, rows])
    out = pd.DataFrame({"k1": slots.key[0].view(np.int64), "k2": slots.key[1].view(np.int64), "leaves": sums[0], "saved": sums[1], "kids": kids})
    far = np.flatnonzero(owned & (up[at] < 0))
    return pd.concat([out, pd.DataFrame({"k1": pa[far].view(np.int64), "k2": pb[far].view(np.int64), "leaves": 0, "saved": 0, "kids": 1})], ignore_index=True)


def _digests(batches):
    """SHA-256 of each key's parts in the order of the shards, joined by commas; a hot key's parts stream through."""
    last, h = None, None
    for pdf in batches:
        rows = []
        for k1, k2, part in zip(pdf["k1"], pdf["k2"], pdf["ends"], strict=True):
            if (k1, k2) != last:
                if last is not None:
                    rows.append((*last, h.hexdigest()))
                last, h = (k1, k2), hashlib.sha256(bytes(part))
            else:
                h.update(b"," + bytes(part))
        yield pd.DataFrame(rows, columns=["k1", "k2", "ends_sha256"])
    if last is not None:
        yield pd.DataFrame([(*last, h.hexdigest())], columns=["k1", "k2", "ends_sha256"])


def prefix_nodes(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text), the root at depth 0 included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. saved_tokens sums over the subtree
    (members - 1) times the words of a node's last text. Turns of equal number go by role and text (then rows are alike, or differ beyond 64 characters
    and stand as stored); rows with a null conv_id are left out; an empty table has no node. Other columns are not read.
    """
    convs, rows = rebuild(turns, every, most)
    keyed = _keyed(rows, convs)
    partial = keyed.groupBy("shard").applyInPandas(_partial_nodes, "shard long, k1 long, k2 long, p1 long, p2 long, d long, words long, n long, low long, inner boolean, ends binary")
    partial = materialize(partial, "partial")
    same = [F.min(c).alias(c) for c in (*UP, "d", "words")]
    alike = F.min(F.struct(*UP, "d")) == F.max(F.struct(*UP, "d"))
    nodes = partial.groupBy(*KEY).agg(*same, F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), (~F.max("inner")).alias("leaf"), alike.alias("alike"))
    checked = F.when(F.col("alike"), F.col("conv_id")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    nodes = materialize(nodes.withColumn("conv_id", checked).drop("alike"), "nodes")
    held = partial.select("shard", *KEY, *UP, "d", "low").join(nodes.select(*KEY, "conv_id", "n_convs", "leaf", "words"), KEY)
    owned = F.col("low") == F.col("conv_id")
    value = lambda v: F.when(owned, v).otherwise(0).cast("long")
    held = materialize(held.select("shard", *KEY, *UP, "d", "conv_id", owned.alias("owned"), value(F.col("leaf").cast("long")).alias("leaf"), value((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "held")
    gone = keyed.filter("left").select("shard", F.col("conv").alias("conv_id"), *KEY, *UP, "d")
    parted = gone.select("conv_id").distinct()
    later = Window.partitionBy("conv_id").orderBy("shard").rowsBetween(1, Window.unboundedFollowing)
    parts = held.filter("owned").join(parted, "conv_id", "left_semi").groupBy("conv_id", "shard").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    steps = gone.select("conv_id", "shard").unionByName(parts.select("conv_id", "shard")).distinct().join(parts, ["conv_id", "shard"], "left")
    after = steps.select("conv_id", "shard", F.coalesce(F.sum("leaf").over(later), F.lit(0)).alias("leaf"), F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("saved"))
    joining = gone.join(after, ["conv_id", "shard"]).select("shard", *KEY, *UP, "d", "conv_id", F.lit(False).alias("owned"), "leaf", "saved")
    sums = held.unionByName(joining).groupBy("shard").applyInPandas(_subtree_sums, "k1 long, k2 long, leaves long, saved long, kids long")
    total = sums.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("kids").alias("n_children"))
    ends = partial.filter("ends is not null").select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard").mapInPandas(_digests, "k1 long, k2 long, ends_sha256 string")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_up"))
    out = nodes.join(total, KEY).join(ends, KEY, "left").join(above, UP, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", F.col("d").alias("depth"), F.when(F.col("d") > 0, F.col("_up")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))

