import hashlib
import random

import pandas as pd
import pytest

from patchlake.llm import minhash
from patchlake.llm.common import sliced
from patchlake.llm.minhash import near_duplicates
from patchlake.llm.substrings import remove_repeats


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(30, 120))] for _ in range(12)]
    texts = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        if i % 7 == 0:
            w = w[:10] + rng.choice(base)[:45] + w[10:]
        texts.append(" ".join(w))
    texts += ["", "   \n", "One", "one", "two words", "a a a " * 40, "a a a " * 40, texts[0].upper(), texts[0]]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    return [*rows, (len(rows), None, None, None), (None, "null id", "x", 1)]


SCHEMA = "doc_id long, text string, key string, start long"  # extra columns with clashing names


def components(rows, k):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k).collect()
    want = components([r for r in rows if r[0] is not None], k)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(want)


@pytest.mark.parametrize("levels", [0, 4])
def test_large_groups_are_tied_as_by_all_pairs(spark, monkeypatch, levels):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "LIST_BLOCK", 3)
    monkeypatch.setattr(minhash, "LEVELS", levels)
    rows = corpus(5)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components([r for r in rows if r[0] is not None], 4)


def test_a_large_cluster_of_near_copies_takes_linear_work(spark, monkeypatch):
    rng, dealt = random.Random(7), []
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base, f"x{i}", f"y{rng.randrange(9)}"])) for i in range(1500)]
    labels = minhash._labels
    monkeypatch.setattr(minhash, "_labels", lambda df, key, match: dealt.append(df.count()) or labels(df, key, match))
    monkeypatch.setattr(minhash, "_across", lambda rows, *_: pytest.fail("left apart"))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4)
    assert got.filter("component_id = 0").count() == 1500
    assert max(dealt) <= 1500 * 64  # a posting row each at most, in every round


def test_near_duplicates_of_a_very_long_text(spark):
    long = " ".join(map(str, range(200_000)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(3, long), (1, long + " more"), (2, "9 8 7 6 5 4 3")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_duplicates(spark.createDataFrame([(1, "a b c d e f", "", 0)] * 3, SCHEMA)).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(1, 1, True)] * 3


def brute_repeats(rows, window):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1]) for r in rows if r[0] is not None):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("split, salt", [(512, 4096), (2, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, split, salt):
    from patchlake.llm import substrings

    monkeypatch.setattr(substrings, "SPLIT", split)
    monkeypatch.setattr(substrings, "SALT", salt)
    rows = corpus(2)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), 20).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeats(rows, 20)


def test_repeats_keep_clean_texts_and_nulls(spark):
    rows = [(1, "a  b\tc", "", 0), (2, None, "", 0), (3, "", "", 0)]
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("a  b\tc", 3, 0), 2: (None, 0, 0), 3: ("", 0, 0)}
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = remove_repeats(spark.createDataFrame([(1, " ".join(map(str, range(30))), "", 0)] * 2, SCHEMA)).collect()
    assert [r.n_removed for r in twice] == [0, 0]


def test_different_texts_of_one_id(spark):
    """Each is a document of its own; brute force over (doc_id, text) with the numbers that the operators give."""
    from pyspark.sql import functions as F

    passage = " ".join(f"p{i}" for i in range(40))
    other = " ".join(f"q{i}" for i in range(60))
    given = [(7, f"start {passage} end"), (7, f"{other} more {passage}"), (7, f"{other} more {passage}"), (9, f"{other} more {passage} x"), (8, passage), (7, None), (3, other)]
    df = spark.createDataFrame(given, "doc_id long, text string")
    named = df.withColumn("h", F.coalesce(F.xxhash64("text"), F.lit(0))).distinct().orderBy("doc_id", "h").collect()
    number = {(r.doc_id, r.text): i for i, r in enumerate(named)}
    rows = [(i, t) for (_, t), i in number.items()]
    want = brute_repeats(rows, 20)
    got = remove_repeats(df, 20, carry=("doc_id",))
    counts = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())
    assert counts == sorted((d, *want[number[d, t]]) for d, t in given)
    links, ids = components(rows, 4), {i: d for (d, _), i in number.items()}
    near = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k=4).collect())
    assert near == sorted((d, links[i][0], ids[links[i][1]], links[i][1] == i) for d, t in given for i in [number[d, t]])


def test_repeated_rows_are_one_member_of_their_cluster(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(minhash, "tied", lambda members, *_: seen.append(members.select("cluster", "doc", "m").collect()) or members)
    docs = spark.createDataFrame([(1, "a b c d e")] * 50 + [(2, "a b c d f")], "doc_id long, text string")
    minhash.confirmed_edges(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc long, cluster long"), 4, 80)
    assert sorted(map(tuple, seen[0])) == [(1, 1, 2), (1, 2, 2)]


def test_long_batches_are_taken_in_slices():
    frames = [pd.DataFrame({"doc_id": range(n), "text": ["x"] * n}) for n in (5, 0, 2)]
    assert [p["doc_id"].tolist() for p in sliced(iter(frames), 2)] == [[0, 1], [2, 3], [4], [0, 1]]
