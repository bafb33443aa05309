"""Order-preserving packing: tokens against the library, cuts against a plain search, pieces against the stream."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from patchlake.llm import ordered
from patchlake.llm.bytebpe import ByteTokenizer, byte_tokenizer
from patchlake.llm.queries import tokenizer_path

TEXTS = ["", " ", "a  b", " a\n\tb ", "Yes. No! 3.5 is it? Yes.\nNew line.\n\nNew part.", "\n\n\nx\n y \nz", "\n\nx", "x\n\n", "x\n", "日本語のテキスト、です。", "a" * 3000, "  " * 50, "😀👩‍👩‍👧 x", "()();;;\"\")", "Don't  stop!!!\r\n\r\n==>  {@x}",
         "<|endoftext|> x", "it's we'll 'S", "\x1c\x85 q", "a\xa0b c d", "one two. " * 3000 + "end", "Ünïcödé ﬁ Ａ é​z ﻿", "é é", "12 345,6.7", None]


def test_byte_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), byte_tokenizer(path)
    assert own.fast is not None
    slow = ByteTokenizer(path)
    slow.fast = None
    for t in TEXTS[:-1]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids and slow.encode(t).tolist() == ids, t
    ids = own.encode("It is. 3.5 more! So?\nYes")
    assert ["".join(library.decode(ids[lo:hi])) for lo, hi in zip([0, *own.sentence_ends(ids)], [*own.sentence_ends(ids), len(ids)], strict=True)] == ["It is.", " 3.5 more!", " So?", "\n", "Yes"]


def plain_cost(places, cost, capacity):
    least = [0] + [np.inf] * (len(places) - 1)
    for j in range(1, len(places)):
        least[j] = cost[j] + min(least[i] + ordered.padding(int(places[j] - places[i]), capacity) for i in range(j) if places[j] - places[i] <= capacity)
    return least[-1]


def test_cuts_have_the_least_cost():
    rng = np.random.default_rng(3)
    for capacity in (8, 13, 64):
        for _ in range(60):
            places = np.concatenate(([0], np.cumsum(rng.integers(1, max(2, capacity // int(rng.integers(1, 9))), 40))))
            cost = rng.integers(0, 6, len(places))
            found, cuts = ordered.best_cuts(places, cost, capacity)
            assert found == plain_cost(places, cost, capacity)
            ends = [0, *cuts]
            sizes = np.diff(places[ends])
            assert ends[-1] == len(places) - 1 and sizes.max() <= capacity
            assert found == sum(ordered.padding(int(s), capacity) for s in sizes) + cost[cuts].sum()


@pytest.mark.parametrize(("chunk", "parts", "capacity"), [(1 << 20, 1, 2048), (300, 1, 64), (50, 3, 16)])
def test_pieces_hold_every_token_once_and_in_order(spark, monkeypatch, chunk, parts, capacity):
    from tokenizers import Tokenizer

    monkeypatch.setattr(ordered, "CHUNK", chunk)
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*enumerate(TEXTS), (3, "again and again. Yes"), (3, "again and again. Yes"), (None, "no id")]
    df = spark.createDataFrame([(d, t, 5) for d, t in texts], "doc_id long, text string, length int").repartition(parts) if parts > 1 else spark.createDataFrame([(d, t, 5) for d, t in texts], "doc_id long, text string, length int").coalesce(1)
    rows = ordered.pack_in_order(df, path, capacity=capacity, with_ids=True).collect()
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
        assert r.length > 0 and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert b[-1].offset + b[-1].length <= capacity
        assert [r.offset for r in b] == np.cumsum([0, *[r.length for r in b[:-1]]]).tolist()
    want = defaultdict(list)
    for d, t in texts:
        want[d].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    for d, found in docs.items():
        found.sort(key=lambda r: (r.sequence_id, r.offset))
        joined = b"".join(r.ids for r in found)
        assert sorted(joined) == sorted(b"".join(want[d]))
        if len(want[d]) == 1:
            assert joined == want[d][0]
            assert {r.doc_tokens for r in found} == {len(joined) // 4}
            assert [r.start for r in found] == np.cumsum([0, *[r.length for r in found[:-1]]]).tolist()
    assert set(docs) == set(want)


def test_little_padding_and_few_cuts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = ordered.pack_in_order(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.sequence_id] += r.length
    total = sum(size.values())
    assert total == sum(r.doc_tokens for r in rows if r.start == 0)
    assert sum(ordered.padding(s, 2048) for s in size.values()) < 0.01 * total


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ordered.pack_in_order(df, tokenizer_path("byte_bpe_50k.json")).collect() == []
