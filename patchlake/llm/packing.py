"""Packing of token sequences by linear grouping and few-size configurations, with best-fit for small pieces.

Piece lengths are at most `capacity`, so the corpus enters the plan as a histogram of lengths. Large lengths
are put into groups of equal cardinality and rounded up to their group's maximum; a linear
program over configurations of these few sizes (column generation with a knapsack for pricing) says how often each
configuration is used. Actual lengths replace the rounded ones, what the rounded-down counts leave over and
all small lengths follow by best fit, longest first. The plan is a list of bin kinds (contents, number of
bins), bounded by the number of distinct lengths and not by the corpus; documents get their places by rank within
their length, which Spark computes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.llm.common import materialize
from patchlake.llm.wordbpe import tokenizer

GROUPS = (8, 12, 16, 24, 32, 48)
PART = 50_000  # pieces that are ranked together, about


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's ids followed by end_id."""

    def run(batches):
        tok, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw = tok.encode(text) + end
                for k, lo in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[lo : lo + 4 * capacity]
                    rows.append((doc, k, lo // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _price(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest worth that fits into capacity."""
    most = capacity // int(sizes.min())
    value, takes = np.zeros(capacity + 1), []
    for _ in range(most):
        new, take = value.copy(), np.full(capacity + 1, -1)
        for g, s in enumerate(sizes):
            with_it = value[:-s] + worth[g]
            better = with_it > new[s:] + 1e-12
            new[s:][better] = with_it[better]
            take[s:][better] = g
        takes.append(take)
        value = new
    made, room = np.zeros(len(sizes), int), capacity
    for take in reversed(takes):
        g = take[room]
        if g >= 0:
            made[g] += 1
            room -= sizes[g]
    return float(value[capacity]), made


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of uses that together ask for no more than the demand."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        use = np.linalg.solve(basis, demand)
        worth = np.linalg.solve(basis.T, np.ones(k))
        gain, column = _price(sizes, worth, capacity)
        if gain <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(move > 1e-9, use / np.where(move > 1e-9, move, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(ratio.argmin())] = column
    use = np.floor(np.linalg.solve(basis, demand) + 1e-9).astype(int)
    return [(basis[:, j].astype(int), int(use[j])) for j in range(k) if use[j] > 0]


def _groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count) of equal-cardinality groups, longest first."""
    total = sum(counts.values())
    out, room = [[]], -(-total // groups)
    size, left = room, room
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not left:
                out.append([])
                left = size
            put = min(n, left)
            out[-1].append((length, put))
            n, left = n - put, left - put
    return [g for g in out if g]


def plan(histogram: dict[int, int], capacity: int, groups: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin kinds: contents (piece lengths, in order) and number of such bins; they hold exactly the histogram."""
    bins: list[tuple[tuple[int, ...], int]] = []
    full = histogram.get(capacity, 0)
    if full:
        bins.append(((capacity,), full))
    rest = {s: n for s, n in histogram.items() if n and s != capacity}
    large = {s: n for s, n in rest.items() if s > capacity // 8}
    left = {s: n for s, n in rest.items() if s <= capacity // 8}
    if large:
        runs = _groups(large, groups)
        by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for g in runs:
            by_size[g[0][0]] += g
        sizes = np.array(sorted(by_size, reverse=True))
        queue = {s: list(reversed(by_size[int(s)])) for s in sizes}  # the next actual length last
        demand = np.array([sum(n for _, n in by_size[int(s)]) for s in sizes], float)
        for column, use in configurations(sizes, demand, capacity):
            slots = [int(s) for s, c in zip(sizes, column, strict=True) for _ in range(c)]
            kinds = [((), use)]
            for s in slots:
                new = []
                for contents, n in kinds:
                    while n and queue[s]:
                        length, m = queue[s].pop()
                        put = min(n, m)
                        if m > put:
                            queue[s].append((length, m - put))
                        new.append(((*contents, length), put))
                        n -= put
                    if n:
                        new.append((contents, n))
                kinds = new
            bins += kinds
        for q in queue.values():
            for length, n in q:
                left[length] = left.get(length, 0) + n
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for contents, n in bins:
        open_bins[capacity - sum(contents)].append((contents, n))
    rooms = np.zeros(capacity + 1, bool)
    rooms[[r for r, b in open_bins.items() if b]] = True
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fit = int(rooms[length:].argmax()) + length if rooms[length:].any() else capacity
            if not open_bins[fit]:  # a fresh kind: as many new bins as it takes, one piece each at first
                each = capacity // length
                whole, more = divmod(n, each)
                made = [((length,) * each, whole)] * bool(whole) + [((length,) * more, 1)] * bool(more)
                n = 0
                for contents, m in made:
                    room = capacity - sum(contents)
                    open_bins[room].append((contents, m))
                    rooms[room] = True
                continue
            contents, m = open_bins[fit].pop()
            put = min(n, m)
            if m > put:
                open_bins[fit].append((contents, m - put))
            rooms[fit] = bool(open_bins[fit])
            open_bins[fit - length].append(((*contents, length), put))
            rooms[fit - length] = True
            n -= put
    return [b for bs in open_bins.values() for b in bs]


def _places(bins: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Runs of ranks of each length: from, the sequence of the first, and the offset within the sequences."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for contents, n in bins:
        offset = 0
        for length in contents:
            rows.append((length, used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    return pd.DataFrame(rows, columns=["length", "rank", "base", "offset"], dtype="int64").sort_values(["length", "rank"])


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length <= capacity, ...).

    Only the counts of the at most `capacity` distinct lengths reach the driver. Pieces are ranked within their length in parts of about
    PART, whose number grows with the table. An empty table stays empty.
    """
    held = materialize(cut.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    parts = held.count() // PART + 1
    dealt = held.withColumn("part", F.pmod(F.xxhash64("_at"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = _places(min((plan(histogram, capacity, g) for g in GROUPS), key=lambda bins: sum(n for _, n in bins)))
    key = table["length"].to_numpy() * (1 << 44) + table["rank"].to_numpy()
    base, first, offset = table["base"].to_numpy(), table["rank"].to_numpy(), table["offset"].to_numpy()
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part", "length").orderBy("_at")) - 1)
    ranked = own.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("before", "own", "part", "_at")
    fields = ranked.drop("rank").columns

    def place(batches):
        for pdf in batches:
            rank = pdf["rank"].to_numpy(dtype=np.int64)
            at = np.searchsorted(key, pdf["length"].to_numpy(dtype=np.int64) * (1 << 44) + rank, side="right") - 1
            yield pdf[fields].assign(sequence_id=base[at] + rank - first[at], offset=offset[at])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A null or empty text has the end id alone. Only documents of more than capacity tokens are cut. Repeated rows are
    packed as often as they stand. A null doc_id is packed too.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    return pack(pieces(docs, path, end_id, capacity, with_ids), capacity).select(columns)
