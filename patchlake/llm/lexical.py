"""Ranked lexical search by NRA: sorted reads only, with a lower and an upper score for every document met.

Each item's list of a term holds the documents with the term, by falling share of the score (impact). The lists are read
from the top, all to the same depth. What has been read of a document is its lower score; its upper score adds, for each list in which it
hasn't been met, the impact at which that list stands. A document whose upper score is under the k-th best lower score is out, and
reading goes on until no document outside can enter or tie and every score inside is exact.

Documents are dealt to shards as they are stored, each with lists of its own, so nothing is shuffled but the best k of an item from each task. A task
starts a shard with the k-th best score that its earlier shards have reached. Items go to the tasks in blocks of at most
about BLOCK characters of text, one pass over the documents each.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.llm.common import materialize

BLOCK = 8_000_000  # characters of items whose terms are sent to the tasks at once
SHARD, MOST = 4_000_000, 200_000  # postings and documents of a shard, about
DEPTH = 64  # first reads of each list; every further round reads as many as have been read
_LAST = (1 << 63) - 1
#: ASCII letters in lower case, digits and all bytes beyond ASCII are kept; every other byte parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with at least one term: all its terms counted in n, those of `number` listed."""
    held = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        known = held.value.get
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = terms(text)
                if words:
                    found = Counter(map(known, words))
                    found.pop(None, None)
                    rows.append((doc, len(words), list(found), list(found.values())))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"])

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id")
    return docs.select(ids, "text").mapInPandas(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _best(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in ids) of the k best scores, ties to the smaller id, and the scores, from lists of places and falling impacts.

    Documents that stay under `floor` may be left out.
    """
    n, width = len(ids), len(lists)
    lower, seen = np.zeros(n, np.int64), np.zeros((width, n), bool)
    alive = np.ones(n, bool)
    end = np.array([len(d) for d, _ in lists])
    at, bound = np.zeros(width, np.int64), np.array([g[0] for _, g in lists], np.int64)
    closed, depth = False, DEPTH
    while True:
        for t in np.flatnonzero(at < end):
            d, g = (x[at[t] : depth] for x in lists[t])
            if closed:
                on = alive[d]
                d, g = d[on], g[on]
            lower[d] += g
            seen[t, d] = True
            at[t] = min(end[t], depth)
            bound[t] = lists[t][1][at[t]] if at[t] < end[t] else 0
        if not closed:
            met = np.flatnonzero(lower)
            low = lower[met]
            least = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else 0)
            closed = int(bound.sum()) < max(least, 1)  # nothing that hasn't been met can enter or tie
            if closed:
                alive = np.zeros(n, bool)
                alive[met] = True
        if closed:
            held = np.flatnonzero(alive)
            low = lower[held]
            open_ = ~seen[:, held]
            top = low + bound @ open_
            least = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else 0)
            stay = top >= least
            alive[held[~stay]] = False
            held, low, top, open_ = held[stay], low[stay], top[stay], open_[:, stay]
            if (low == top).all():
                order = np.lexsort((ids[held], -low))[:k]
                return held[order], low[order]
            at[~open_.any(1)] = end[~open_.any(1)]  # a list in which all that stay have been met tells nothing more
            bound[at >= end] = 0
        depth *= 2


class _Shard:
    """Impact-sorted lists of a run of documents."""

    def __init__(self, rows: list[tuple], weight: np.ndarray, docs: int, length: int):
        self.ids = np.array([r[0] for r in rows], np.int64)
        n = np.array([r[1] for r in rows], np.int64)
        size = np.array([len(r[2]) for r in rows])
        term = np.concatenate([np.asarray(r[2], np.int64) for r in rows])
        tf = np.concatenate([np.asarray(r[3], np.int64) for r in rows])
        place = np.repeat(np.arange(len(rows), dtype=np.int64), size)
        m = 75 + 25 * n * docs // length
        gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[place]))
        order = np.lexsort((-gain, term))
        self.place, self.gain = place[order], gain[order]
        self.first = np.searchsorted(term[order], np.arange(len(weight) + 1))

    def lists(self, item: list[tuple[int, int]]):
        for t, times in item:
            lo, hi = self.first[t], self.first[t + 1]
            if lo < hi and self.gain[lo] > 0:
                gain = self.gain[lo:hi]
                hi = int(np.searchsorted(-gain, 0))  # an impact of 0 adds nothing
                yield self.place[lo : lo + hi], gain[:hi] * times


def _ranked(postings: DataFrame, items: list[list[tuple[int, int]]], weight: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of every item in each task."""
    held = postings.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches):
        items, weight = held.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        rows, size = [], 0

        def work():
            shard = _Shard(rows, weight, docs, length)
            for i, item in enumerate(items):
                lists = list(shard.lists(item))
                if not lists:
                    continue
                ids, score = best[i]
                places, more = _best(lists, shard.ids, k, int(score[-1]) if len(score) == k else 0)
                ids, score = np.concatenate((ids, shard.ids[places])), np.concatenate((score, more))
                order = np.lexsort((ids, -score))[:k]
                best[i] = ids[order], score[order]

        for pdf in batches:
            for row in zip(pdf["doc_id"], pdf["n"], pdf["terms"], pdf["tfs"], strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= SHARD or len(rows) >= MOST:
                    work()
                    rows, size = [], 0
        if rows:
            work()
        many = [len(d) for d, _ in best]
        yield pd.DataFrame({"item": np.repeat(np.arange(len(best)), many), "doc_id": np.concatenate([d for d, _ in best]), "score": np.concatenate([s for _, s in best])})

    return postings.mapInPandas(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of the highest score above 0 for each row of items (item_id, text).

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. A term's weight is floor(1000 * ln((2N + 2) / (2df + 1)));
    a document scores weight * (10^9 tf div (1000 tf + 12 m)) for each occurrence of a term in the item, m = 75 + 25 n N div L. Every row of
    docs with a term is a document, repeated ids and rows included; equal scores go by doc_id, a null one (it comes back null) after all others.
    Null texts and texts without a term have no postings and aren't counted. Every row of items is a query, with a null or repeated item_id too; one without
    terms, and any on an empty table, has no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = materialize(items.select("item_id", "text", F.monotonically_increasing_id().alias("num")), "items")
    blocks = int(asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)) / BLOCK).first()[0]) + 1
    totals, parts = None, []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("num"), F.lit(blocks)) == b).collect()
        counts = [Counter(terms(r["text"])) for r in rows]
        number = {t: i for i, t in enumerate(sorted(set().union(*counts)))} if counts else {}
        if not number:
            continue
        postings = materialize(_postings(docs, number), "postings")
        if totals is None:
            totals = postings.agg(F.count("*"), F.sum("n")).first()
        if not totals[0]:
            break
        df = np.zeros(len(number), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect():
            df[r["t"]] = r["c"]
        weight = np.floor(1000 * np.log((2.0 * totals[0] + 2) / (2.0 * df + 1))).astype(np.int64)
        sets = [[(number[t], c) for t, c in sorted(x.items())] for x in counts]
        found = _ranked(postings.filter(F.size("terms") > 0), sets, weight, totals[0], totals[1], k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        parts.append(best.join(named, "item").select("item_id", "rank", F.expr(f"nullif(doc_id, {_LAST})").alias("doc_id"), "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)


#: The same search as DuckDB SQL over documents and benchmark.
SEARCH_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT doc_id, len(ws) AS n, ws FROM t WHERE len(ws) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
p AS (SELECT doc_id, n, w, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS w FROM d) GROUP BY doc_id, n, w),
q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY item_id, w),
k AS (SELECT w, CAST(floor(1000 * ln((2.0 * any_value(docs) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS weight FROM p, c WHERE w IN (SELECT w FROM q) GROUP BY w),
g AS (SELECT p.doc_id, p.w, k.weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS gain FROM p JOIN k ON p.w = k.w, c),
s AS (SELECT item_id, doc_id, CAST(sum(times * gain) AS BIGINT) AS score FROM q JOIN g ON q.w = g.w GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
