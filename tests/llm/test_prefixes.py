"""The conversation trie against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from patchlake.llm import prefixes


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, v in built.items():
        for k in range(len(v) + 1):
            nodes[tuple(v[:k])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(nodes, key=len, reverse=True):
        w = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = (len(nodes[k]) - 1) * w + sum(saved[x] for x in kids[k])
    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 45), 61, 75, 80, 99, -3, -20, -41]:
        turns = [] if c == 20 else range(int(rng.integers(1, 9)))
        rows += [(c, t, ("user", "assistant")[t % 2], f"w{rng.integers(0, 3)}  x\t{'y ' * int(rng.integers(0, 3))}") for t in turns]
    rows += [(5, None, None, "null turn first"), (7, 2, "user", None), (7, 2, None, ""), (7, 2, None, ""), (None, 1, "user", "lost"), (200, 1, "", "")]
    rows += [(300 + i, t, "user", f"hot {t}") for i in range(30) for t in range(4)]
    rows += [(c, t, "user", f"long {t // 7}") for c in (41, 401) for t in range(150)]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("shard", [200_000, 60])
def test_equals_brute_force_where_conversations_are_parted_too(spark, monkeypatch, shard):
    monkeypatch.setattr(prefixes, "SHARD", shard)
    rows = rows_of(shard)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, depth int")
    got = prefixes.prefix_nodes(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table_has_no_node(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn int, role string, text string")
    assert prefixes.prefix_nodes(df).collect() == []
    assert prefixes.prefix_nodes(df.limit(0)).collect() == []


def test_slots_are_a_permutation_and_strangers_are_told():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 100, 20_000):
        a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        table = prefixes.PerfectHash(a, b)
        assert np.array_equal(np.sort(table(a, b)), np.arange(n))
        assert (table(b, a) == -1).all()


def test_a_shared_digest_is_an_error():
    import pandas as pd

    rows = pd.DataFrame({"shard": [0, 0], "conv": [1, 2], "d": [1, 2], "words": [1, 1], "last": [True, True], "k1": [5, 5], "k2": [6, 6], "p1": [0, 1], "p2": [0, 1]})
    with pytest.raises(ValueError, match="share a digest"):
        prefixes._partial_nodes(rows)
