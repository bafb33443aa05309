"""Order-preserving packing: windows over the stream of documents, cut by dynamic programming.

Documents follow each other in the table's order. A window may end at a document's end for nothing, at a sentence's end for SENTENCE tokens, and
in a part of over LONG tokens without such an end at every STEP-th token for INSIDE tokens; it also costs its padding. Of sentences that end within the
same NEAR tokens of a document the last one counts. The least cost up to a
place is that of the window before it, whose start is the least of (cost + place) among the starts within `capacity`: a monotone queue keeps that
minimum. Windows as long as a power of two need no padding, so their at most log2(capacity) starts are looked at by themselves.

Every task packs the documents it reads, so no text moves. It settles windows whenever about CHUNK tokens have been read and keeps the last
ones open, so that memory is bounded by a chunk and the longest document.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from patchlake.llm.bytebpe import byte_tokenizer

SENTENCE, INSIDE = 4, 24
NEAR, LONG, STEP = 16, 64, 8
CHUNK, OPEN = 1 << 20, 8  # tokens between two settlements; windows that stay open


def padding(length: int, capacity: int) -> int:
    """Tokens that fill a window: up to capacity, or none at a power of two."""
    return 0 if length & (length - 1) == 0 else capacity - length


def cut_places(ids: np.ndarray, ends: np.ndarray, near: int = NEAR, long: int = LONG, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a document's tokens after which a window may end, and the cost of each; its end is the last."""
    ends = ends[(ends > 0) & (ends < len(ids))]
    cell = ends // near
    marks = np.concatenate(([0], ends[np.append(cell[1:] != cell[:-1], True)[: len(ends)]], [len(ids)]))
    wide = np.flatnonzero(np.diff(marks) > long)
    inner = [np.arange(marks[g] + step, marks[g + 1], step) for g in wide]
    places = np.concatenate((marks[1:], *inner))
    cost = np.full(len(places), INSIDE, np.int64)
    cost[: len(marks) - 1] = SENTENCE
    cost[len(marks) - 2] = 0
    order = np.argsort(places, kind="stable")
    return places[order], cost[order]


def best_cuts(places: np.ndarray, cost: np.ndarray, capacity: int) -> tuple[int, list[int]]:
    """Least cost of cutting [places[0], places[-1]) into windows that end at places, and the places (numbers) at which they end.

    No two neighbouring places lie farther apart than capacity. Of equal starts the earliest is taken.
    """
    m = len(places)
    at, to = [], []
    for k in range(capacity.bit_length()):
        if 1 << k <= capacity:
            i = np.searchsorted(places, places - (1 << k))
            hit = np.flatnonzero(places[i] == places - (1 << k))
            at.append(hit)
            to.append(i[hit])
    at, to = np.concatenate(at), np.concatenate(to)
    order = np.lexsort((to, at))
    at, to = [*at[order].tolist(), m], to[order].tolist()
    p, c = places.tolist(), cost.tolist()
    least, back, e = [0] * m, [0] * m, 0
    queue, worth = deque([0]), [p[0]] * m  # places by rising worth; worth = least cost up to the place + place
    for j in range(1, m):
        here = p[j]
        while here - p[queue[0]] > capacity:
            queue.popleft()
        i = queue[0]
        best = worth[i] + capacity - here
        while at[e] == j:
            if least[to[e]] < best:
                i = to[e]
                best = least[i]
            e += 1
        best += c[j]
        least[j], back[j] = best, i
        w = worth[j] = best + here
        while queue and worth[queue[-1]] > w:
            queue.pop()
        queue.append(j)
    cuts, j = [], m - 1
    while j:
        cuts.append(j)
        j = back[j]
    return least[m - 1], cuts[::-1]


class _Stream:
    """The open end of a task's documents: their ids, and the places at which windows may end."""

    def __init__(self, capacity: int, first_sequence: int, with_ids: bool):
        self.capacity, self.sequence, self.with_ids = capacity, first_sequence, with_ids
        self.docs: deque[tuple] = deque()  # document, its bytes, the place of its first token
        self.begin = self.end = 0  # places: of the first open token, after the last one
        self.places, self.cost = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]

    def feed(self, doc, ids: np.ndarray, places: np.ndarray, cost: np.ndarray):
        base = self.end
        self.docs.append((doc, ids.tobytes(), base))
        lo = 0
        while lo < len(places):
            hi = max(lo + 1, int(np.searchsorted(places, self.begin + CHUNK - base, side="right")))
            self.places.append(places[lo:hi] + base)
            self.cost.append(cost[lo:hi])
            self.end = base + int(places[min(hi, len(places)) - 1])
            lo = hi
            if self.end - self.begin >= CHUNK:
                yield from self.settle(OPEN * self.capacity)

    def settle(self, keep: int):
        """Pieces of the windows that end at least `keep` tokens before the end."""
        places, cost = np.concatenate(self.places), np.concatenate(self.cost)
        at = 0
        for j in best_cuts(places, cost, self.capacity)[1] if len(places) > 1 else ():
            if places[j] > self.end - keep:
                break
            yield from self._window(int(places[at]), int(places[j]))
            at = j
        self.places, self.cost, self.begin = [places[at:]], [cost[at:]], int(places[at])

    def _window(self, lo: int, hi: int):
        at = lo
        while at < hi:
            doc, raw, base = self.docs[0]
            total = len(raw) // 4
            start, end = at - base, min(hi - base, total)
            part = raw[4 * start : 4 * end]
            yield (doc, start, end - start, zlib.crc32(part), total, self.sequence, at - lo, *([part] if self.with_ids else []))
            at = base + end
            if end == total:
                self.docs.popleft()
        self.sequence += 1


def pack_in_order(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, (ids).

    A document's ids are followed by end_id; a null or empty text has that one alone. Every id lies in one piece, pieces of a document and documents
    of a sequence keep their order, and the windows of a task are numbered on from its own first number. Repeated rows are packed as often as
    they stand, null doc_ids too; other columns are not read.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches):
        tok, end = byte_tokenizer(path), np.array([end_id], "<u4")
        stream = _Stream(capacity, TaskContext.get().partitionId() << 40, with_ids)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = tok.encode(text)
                places, cost = cut_places(own := np.concatenate((ids, end)), tok.sentence_ends(ids), long=min(LONG, capacity), step=min(STEP, capacity))
                rows += stream.feed(doc, own, places, cost)
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(list(stream.settle(0)), columns=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInPandas(run, schema)
