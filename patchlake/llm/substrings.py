"""Removal of repeated word windows with a compressed FM-index per shard.

Windows are dealt to shards by content: the smallest hashed gram of a window (its anchor) is the
same wherever the window's words stand, so the consecutive windows that share an anchor form one segment and all
occurrences of a window meet in the shard of its anchor. Anchors that occur once in the corpus are dropped
before anything else moves. Byte-equal segments are folded into a class, the first occurrence standing for it and each member keeping its link, so
a passage held by a third of all documents reaches a shard once. Every class enters a shard: the shard builds an FM-index of its
classes' words and streams them through backward search, and the suffixes in a window's interval give the window's first occurrence. What a
shard reports of a class is joined back to its members, in parts of at most about SALT rows; a member loses the windows that start earlier somewhere.

Anchors are grams of GRAMS[0] words. One with more than SPLIT classes (a common line in many contexts) is dealt anew by the next longer
gram, which parts its windows over many shards; the last grams are whole windows, of which each has one class.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.common import _mix, byte_blocks, ddl, group_starts, materialize, numbered, sliced, whole_groups, word_hashes
from patchlake.llm.fmindex import FMIndex

GRAMS = (6, 12)  # and then whole windows
SPLIT = 512
SALT = 4096
SHARD = 1000
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 32) - 1)  # positions; no text has more words
KEYS = ["anchor", "content", "n"]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _A + b)


def _powers(words: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of 1, 2, 4, 8 and 16 consecutive words."""
    out, n = {1: words}, 1
    while n < 64 and len(out[n]) > n:
        out[2 * n] = _join(out[n][:-n], out[n][n:])
        n *= 2
    return out


def _grams(powers: dict[int, np.ndarray], length: int) -> np.ndarray:
    """Hashes of `length` consecutive words, put together from powers of two."""
    total = len(powers[1]) - length + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    out, at = None, 0
    for n in sorted((1 << i for i in range(7) if length >> i & 1), reverse=True):
        part = powers[n][at : at + total]
        out = part if out is None else _join(out, part)
        at += n
    return out


def _cut(words: np.ndarray, at: np.ndarray, window: int, gram: int):
    """Text number, first window, windows, anchor and content hash of each segment of texts whose words begin at `at`."""
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 5
    powers = _powers(words)
    whole, anchor = _grams(powers, window), _grams(powers, gram)
    low = (anchor & ~_LOW) | np.arange(len(anchor), dtype=np.uint64)
    span = window - gram + 1
    n, size = low, 1
    while size * 2 <= span:
        n, size = np.minimum(n[:-size], n[size:]), size * 2
    least = np.minimum(n[: len(whole)], n[span - size : span - size + len(whole)])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(whole)]
    start = np.arange(len(whole))
    ok = start + window <= at[1:][text]
    start, text = start[ok], text[ok]
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    place = (least[start] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    size = np.diff(np.append(first, len(start)))
    rel = np.arange(len(start)) - np.repeat(first, size)
    content = np.add.reduceat(_mix(whole[start] ^ (rel.astype(np.uint64) * _B)), first)
    return text[first], start[first] - at[text[first]], size, anchor[place[first]].view(np.int64), content.view(np.int64)


def _raw(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column]


def segments(docs: DataFrame, window: int, anchors_only: bool = False) -> DataFrame:
    """The segments of whole texts: anchor, content (hash), n (windows), doc, start (word)."""

    def run(batches):
        for pdf in sliced(batches):
            doc, raw = pdf["doc_id"].to_numpy(), _raw(pdf["text"])
            for lo, hi in byte_blocks(raw):
                text, start, size, anchor, content = _cut(*word_hashes(raw[lo:hi]), window, min(GRAMS[0], window))
                if anchors_only:
                    yield pd.DataFrame({"anchor": anchor})
                else:
                    yield pd.DataFrame({"anchor": anchor, "content": content, "n": size.astype(np.int32), "doc": doc[lo:hi][text], "start": start.astype(np.int32)})

    out = "anchor long" if anchors_only else "anchor long, content long, n int, doc long, start int"
    return docs.select("doc_id", "text").mapInPandas(run, out)


def _recut(contents: DataFrame, window: int, gram: int) -> DataFrame:
    """The segments of segments' words by another gram."""

    def run(batches):
        for pdf in batches:
            rows = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
            if rows:
                text, start, size, anchor, content = _cut(np.concatenate(rows), np.cumsum([0, *map(len, rows)]), window, gram)
                yield pd.DataFrame({"anchor": anchor, "content": content, "n": size.astype(np.int32), "doc": pdf["doc"].to_numpy()[text], "start": (pdf["start"].to_numpy()[text] + start).astype(np.int32)})

    return contents.select("doc", "start", "items").mapInPandas(run, "anchor long, content long, n int, doc long, start int")


def _contents(docs: DataFrame, reps: DataFrame, window: int) -> DataFrame:
    """reps (KEYS, c, doc, start, many) with items, the word hashes of the segment."""
    wanted = reps.groupBy("doc").agg(F.collect_list(F.struct(*KEYS, "c", "start", "many")).alias("parts"))

    def cut(batches):
        for pdf in batches:
            raw = _raw(pdf["text"])
            for lo, hi in byte_blocks(raw):
                words, at = word_hashes(raw[lo:hi])
                rows = [(p["anchor"], p["content"], p["n"], p["c"], d, p["start"], p["many"], words[at[i] + p["start"] : at[i] + p["start"] + p["n"] + window - 1].tobytes()) for i, (d, ps) in enumerate(zip(pdf["doc"].iloc[lo:hi], pdf["parts"].iloc[lo:hi], strict=True)) for p in ps]
                yield pd.DataFrame(rows, columns=[*KEYS, "c", "doc", "start", "many", "items"])

    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc")
    return texts.select("doc", "text", "parts").mapInPandas(cut, "anchor long, content long, n int, c long, doc long, start int, many boolean, items binary")


def _search(contents: DataFrame, window: int, shards: int) -> DataFrame:
    """What the shards' indexes say of each class: KEYS, c, doc and start of its first member, and gone: word offsets (from, to, from, to, ...) of runs of windows that start earlier in another class."""
    dealt = contents.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard")

    def run(batches):
        for pdf in whole_groups(batches, ["shard"]):
            at = group_starts(pdf, ["shard"])
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                own = pdf.iloc[lo:hi]
                rows = [np.frombuffer(x, np.uint64) for x in own["items"]]
                size = np.array([len(r) for r in rows])
                names, ids = np.unique(np.concatenate(rows), return_inverse=True)
                first = np.cumsum(size) - size + np.arange(len(rows))
                text = np.zeros(int(size.sum()) + len(rows), np.int64)  # 0 parts the segments
                text[np.arange(len(ids)) + np.repeat(np.arange(len(rows)), size)] = ids + 1
                n = size - window + 1
                begin = np.cumsum(n) - n
                rel = np.arange(int(n.sum())) - np.repeat(begin, n)
                row = np.repeat(np.arange(len(rows)), n)
                hit, group = FMIndex(text, window).repeated(text, first[row] + rel, window)
                doc, start = own["doc"].to_numpy()[row[hit]], own["start"].to_numpy()[row[hit]] + rel[hit]
                order = np.lexsort((start, doc, group))
                hit, doc, start, group = hit[order], doc[order], start[order], group[order]
                head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[: len(group)]
                head = np.repeat(head, np.diff(np.append(head, len(group))))
                late = np.zeros(len(row) + 1, bool)
                late[hit[(doc != doc[head]) | (start != start[head])]] = True
                late[-1] = False
                open_ = late[:-1] & ~np.where(rel > 0, late[np.arange(len(row)) - 1], False)
                shut = late[:-1] & ~np.where(rel + 1 < n[row], late[1:], False)
                pairs = np.stack((rel[open_], rel[shut] + window), 1)
                gone = np.split(pairs.ravel(), 2 * np.searchsorted(row[open_], np.arange(1, len(rows))))
                yield own[[*KEYS, "c", "doc", "start"]].assign(gone=[g.astype(np.int32) for g in gone])

    return dealt.select("shard", *KEYS, "c", "doc", "start", "items").mapInPandas(run, "anchor long, content long, n int, c long, doc long, start int, gone array<int>")


def _reported(shared: DataFrame, report: DataFrame, window: int) -> DataFrame:
    """Word spans (doc, start, end) that members of classes lose: all of a segment that is not its class's first, of the first what is gone."""
    report = report.select(*KEYS, F.struct("doc", "start").alias("e"), "gone", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"c DIV {SALT}"))).alias("salt"))
    joined = shared.join(report, [*KEYS, "salt"])
    own = F.expr("transform(sequence(0, CAST(size(gone) DIV 2 - 1 AS INT)), i -> struct(start + get(gone, 2 * i) AS start, start + get(gone, 2 * i + 1) AS end))")
    part = F.when(F.struct("doc", "start") > F.col("e"), F.array(F.struct("start", (F.col("start") + F.col("n") + (window - 1)).alias("end"))))
    return joined.filter((F.struct("doc", "start") > F.col("e")) | (F.size("gone") > 0)).select("doc", F.explode(part.otherwise(own)).alias("s")).select("doc", "s.*")


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """Word spans (doc, start, end) that cover exactly the words of all windows whose words also start earlier."""
    anchors, rows, spans = segments(docs, window, anchors_only=True), segments(docs, window), []
    for gram in (*[g for g in GRAMS[1:] if g < window], window, None):
        counts = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1"), "anchors")
        salt = F.expr(f"pmod(xxhash64(doc, start), c DIV {SALT} + 1)")
        shared = materialize(rows.join(counts, "anchor").withColumn("salt", salt), "shared")
        classes = materialize(shared.groupBy(KEYS).agg(F.min(F.struct("doc", "start")).alias("e"), F.max("c").alias("c")), "classes")
        spread = classes.groupBy("anchor").agg(F.count("*").alias("d"))
        many = F.lit(False) if gram is None else F.col("d") > SPLIT
        reps = classes.join(spread, "anchor").select(*KEYS, "c", "e.doc", "e.start", many.alias("many"))
        contents = materialize(_contents(docs, reps, window), "contents")
        cold, hot = contents.filter("not many"), contents.filter("many")
        report = _search(cold, window, max(1, cold.count() // SHARD)).unionByName(hot.select(*KEYS, "c", "doc", "start", F.expr("CAST(array() AS array<int>)").alias("gone")))
        spans.append(materialize(_reported(shared, report, window), "spans"))
        if gram is None or hot.isEmpty():
            break
        rows = materialize(_recut(hot, window, gram), "recut")
        anchors = rows.select("anchor")
    return reduce(DataFrame.unionByName, spans)


def remove_repeats(docs: DataFrame, window: int = 20, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, text (kept words), n_words, n_removed, kept_sha256 for each row of docs.

    Words are runs without white space (space and \\x09-\\x0D), unchanged. A word goes if a window of `window`
    consecutive words covers it whose words also start earlier: in a smaller doc_id, or earlier in the same
    document. Texts without a removed word come back as they are, others as their kept words joined by one
    space. Null texts have no words and come back null; texts shorter than a window stay. Rows with a
    null doc_id are left out. Rows that repeat a doc_id with the same text are one document and come out once each; different texts of one
    doc_id are documents of their own, in the order of a hash of their texts.
    """
    docs, _ = numbered(docs.select(*dict.fromkeys((*carry, "doc_id", "text"))))
    marks = repeated_spans(docs.select(F.col("_num").alias("doc_id"), "text"), window).groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("_spans")).withColumnRenamed("doc", "_doc")

    def run(batches):
        for pdf in sliced(batches):
            out = []
            for text, parts in zip(pdf["text"], pdf["_spans"], strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                if parts is None:
                    kept = words
                else:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, [p["start"] for p in parts], 1)
                    np.add.at(step, [p["end"] for p in parts], -1)
                    gone = np.cumsum(step)[:-1] > 0
                    kept = [w for w, g in zip(words, gone, strict=True) if not g]
                joined = b" ".join(kept)
                out.append((text if len(kept) == len(words) else joined.decode("utf-8"), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()))
            made = pd.DataFrame(out, columns=["text", "n_words", "n_removed", "kept_sha256"])
            yield pd.concat([pdf[list(carry)].reset_index(drop=True), made], axis=1)

    joined = docs.join(marks, docs._num == marks._doc, "left").drop("_doc", "_num")
    return joined.mapInPandas(run, ddl(docs, list(carry)) + ", text string, n_words long, n_removed long, kept_sha256 string")
