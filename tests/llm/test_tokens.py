import zlib

import numpy as np
import pytest

from patchlake.llm.queries import tokenizer_path

TEXTS = ["", " ", "a  b", " a\n\tb ", "▁a ▁", "　x ﬁ Ａ é", "日本語のテキスト、です。", "a" * 3000, "  " * 50, "😀👩‍👩‍👧 x", "()();;;\"\")", "Don't  stop!!!\r\n\r\n==>  {@x}", "<|endoftext|> x", "ÀÉ naïve İΣς ΑΣ", "1234 5,6.7", "it's we'll 'S", "\x1c\x85 q", "word " * 9000]


def test_prefix_table_equals_the_library(spark):
    import sentencepiece

    from patchlake.llm import pieces

    path = tokenizer_path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path)
    for t in TEXTS:
        ids = library.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids)
        assert own.digest(t) == (len(ids), ",".join(map(str, ids)), library.decode(ids))
    df = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string")
    assert pieces.round_trip_digests(df, path).filter("n_tokens > 0").count() == len(TEXTS) - 1
    ids = pieces.encode_documents(df, path)
    assert {r.doc_id: r.text for r in pieces.decode_ids(ids, path).collect()}[2] == "a  b"


def test_word_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    from patchlake.llm.wordbpe import tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokenizer(path)
    for t in TEXTS:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_plan_holds_the_histogram_and_no_bin_overflows():
    from patchlake.llm.packing import plan

    rng = np.random.default_rng(1)
    for groups in (1, 8, 24):
        for n in (0, 1, 40, 3000):
            lengths = np.minimum(rng.geometric(0.002, n), 4096)
            histogram = {int(s): int(c) for s, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
            bins, seen = plan(histogram, 4096, groups), {}
            for contents, m in bins:
                assert sum(contents) <= 4096 and m > 0
                for s in contents:
                    seen[s] = seen.get(s, 0) + m
            assert seen == histogram
            assert n < 3000 or groups < 8 or sum(m for _, m in bins) <= 1.03 * -(-lengths.sum() // 4096)


@pytest.mark.parametrize("parts", [1, 5])
def test_packing(spark, parts):
    from tokenizers import Tokenizer

    from patchlake.llm.packing import pack_documents

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [*enumerate([*TEXTS, None]), (5, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(parts)
    got = pack_documents(df, path, with_ids=True).toPandas()
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if i is None else i, k, lo, len(p := ids[lo : lo + 4096]), zlib.crc32(p.tobytes())) for k, lo in enumerate(range(0, len(ids), 4096))]
    got["doc_id"] = got["doc_id"].fillna(-1)
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).to_numpy())) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096
    assert pack_documents(df.limit(0), path).count() == 0
