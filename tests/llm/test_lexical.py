"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from patchlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            score = 0
            for t, times in Counter(TERM.findall((text or "").translate(LOWER))).items():
                df = sum(t in x for _, x in held)
                if t in c:
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                found.append((-score, d is None, d or 0, d))
        found.sort(key=lambda r: r[:3])
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize(("shard", "depth", "block"), [(4_000_000, 64, 8_000_000), (50, 1, 40), (7, 2, 8_000_000)])
def test_equals_brute_force_for_every_size_of_shard(spark, monkeypatch, shard, depth, block):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "DEPTH", depth)
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = np.random.default_rng(5)
    names = ["Ab", "ab", "Éa", "éa", "x1", "the", "of", "cat", "dog", "z", "straße", "i"]
    text = lambda n: " ".join(rng.choice(names, n, p=np.array([8, 8, 1, 1, 2, 9, 9, 2, 2, 1, 1, 4]) / 48))
    docs = [(i, text(int(rng.integers(1, 30)))) for i in range(150)]
    docs += [(5, docs[5][1]), (5, "other cat-dog"), (None, docs[9][1]), (None, docs[9][1]), (900, None), (901, ""), (902, " .,\x7f\n"), (903, "the " * 5000 + "cat"), (904, "unmatched")]
    items = [(1, "the cat, the DOG"), (2, "straße Éa"), (2, "of of of"), (None, "x1 z"), (4, None), (5, "--"), (6, "nowhere"), (7, text(60))]
    got = lexical.search(*frames(spark, docs, items), k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 7)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.filter("doc_id > 5"), items.filter("item_id > 5")).collect() == []


def test_reads_stop_before_the_ends_of_long_lists():
    """A clear winner needs no reading to the end, and ties are told apart by ids."""
    ids = np.arange(10_000)[::-1].copy()
    place, gain = np.arange(10_000), np.maximum(5000 - np.arange(10_000), 1)
    docs, score = lexical._best([(place, gain)], ids, 3, 0)
    assert docs.tolist() == [0, 1, 2] and score.tolist() == [5000, 4999, 4998]
    docs, score = lexical._best([(place, np.full(10_000, 7)), (place[::-1], np.full(10_000, 2))], ids, 3, 0)
    assert ids[docs].tolist() == [0, 1, 2] and score.tolist() == [9, 9, 9]
