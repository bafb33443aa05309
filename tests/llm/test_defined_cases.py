"""Rows that every operator must take: repeated ones, null ids, shared ids, empty tables, extra columns with clashing names, long texts, ties."""

import hashlib
import json

import numpy as np
import pytest

from patchlake.llm import langid, neardup, pieces, pii, toolcalls, toxicity
from patchlake.llm.queries import tokenizer_path


def test_toxicity_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(0)
    words = ["vile", "hat", "blue", "Run,", "día", "x" * 40]
    texts = [" ".join(rng.choice(words, int(n))) for n in (0, 1, 3, 39, 40, 41, 72, 73, 105, 300)]
    raw = toxicity._raw(texts)
    p = toxicity.initial(4, 5)
    p["words"] *= 5
    hashes = np.unique(toxicity._words(raw, None)[0])
    vocabulary = toxicity.Vocabulary(hashes[:3])
    sig = lambda v: 1 / (1 + np.exp(-v))
    h = toxicity.HIDDEN
    edge = bytes(32 if toxicity._EDGE[i] else i for i in range(256))
    for text, got in zip(raw, toxicity.score_texts(p, vocabulary, raw), strict=True):
        own, scores = text.translate(edge).split(), []
        for start in range(0, max(len(own) - (toxicity.WIDTH - toxicity.STRIDE), 1), toxicity.STRIDE):
            window = own[start : start + toxicity.WIDTH]
            pre = {d: [p["words"][vocabulary(toxicity._words([w], None)[0])[0]] @ p[f"w{d}"] + p["chars"][list(w)].mean(0) @ p[f"k{d}"] + p[f"c{d}"] for w in window] for d in "fb"}
            states = {}
            for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
                s, states[d] = np.zeros(h), [None] * len(window)
                for t in order:
                    g = sig(pre[d][t][: 2 * h] + s @ p[f"u{d}"][:, : 2 * h])
                    s = s + g[:h] * (np.tanh(pre[d][t][2 * h :] + (g[h:] * s) @ p[f"u{d}"][:, 2 * h :]) - s)
                    states[d][t] = s
            both = np.array([np.concatenate((f, b)) for f, b in zip(states["f"], states["b"], strict=True)]).reshape(len(window), 2 * h)
            e = np.exp(both @ p["attend"])
            pooled = (e[:, None] * both).sum(0) / e.sum() if len(window) else np.zeros(2 * h)
            scores.append(sig(pooled @ p["out"] + p["bias"][0]))
        assert got == pytest.approx(max(scores), abs=1e-5)


def test_toxicity_of_shared_ids_and_two_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "_fit", lambda texts, toxic, *_: (texts, toxic.tolist()))
    docs = spark.createDataFrame([(1, "b", 0), (1, "a", 0), (1, "a", 0), (2, "c", 0), (3, None, 0), (None, "n", 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (9, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) == (["a", "c", None], [True, False, True])
    monkeypatch.undo()
    got = toxicity.score(docs, toxicity.initial(1, 0), toxicity.Vocabulary(np.zeros(0, np.uint64))).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "3", "None"] and all(0 <= r.score <= 1 for r in got)


LANGS = {"aa": b"the of and with from this that was for are ", "bb": b"der die und von mit ist nicht ein zu den "}


def test_language_predictions_equal_plain_compression(spark):
    import zstandard

    rng = np.random.default_rng(1)
    dictionaries = {k: v * 40 for k, v in LANGS.items()}
    pool = [w.decode() for v in LANGS.values() for w in v.split()]
    texts = [" ".join(rng.choice(pool, int(n))) for n in rng.integers(1, 400, 30)] + ["Über & Ñandú 12", "x"]
    rows = [*enumerate(texts), (None, "the of and"), (1, "the of and"), (1, "the of and")]
    got = langid.classify(spark.createDataFrame(rows, "doc_id long, text string"), dictionaries).collect()
    want = []
    for i, t in rows:
        raw = langid._OTHER.sub(" ", t.lower()).encode()
        size = {}
        for name, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            size[name] = sum(len(c.compress(raw[k : k + langid.BLOCK])) for k in range(0, len(raw), langid.BLOCK))
        best = min(size, key=lambda n: (size[n], n))
        other = min(v for n, v in size.items() if n != best)
        want.append((str(i), best, round((other - size[best]) / other, 9)))
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in got) == sorted(want)


def test_language_dictionaries_take_pieces_from_anywhere(spark):
    text = "".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " for i in range(9000))
    docs = spark.createDataFrame([(i, text, "aa") for i in range(30)], "doc_id long, text string, lang string")
    made = langid.train(docs, per_language=60)["aa"].decode()
    at = [text.index(w) for w in made.split() if len(w) == 4 and f"{w} " in text]
    assert min(at) < 0.1 * len(text) and max(at) > 0.9 * len(text)
    assert langid.train(docs.limit(0)) == {}
    with pytest.raises(ValueError):
        langid.train(docs, most_languages=0)


def test_pieces_of_odd_tables_and_models(spark, monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = [(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, "a b", 8, "y"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids_sha256 string")
    got = pieces.round_trip_digests(df, path).collect()
    assert len(got) == 4 and len({r.ids_sha256 for r in got}) == 2 and sum(r.doc_id is None for r in got) == 1
    assert pieces.round_trip_digests(df.limit(0), path).count() == 0
    monkeypatch.setattr(pieces.PieceCodec, "encode", lambda self, text: [])
    with pytest.raises(ValueError):
        pieces.PieceCodec(path)


def test_vectors_that_share_an_id_and_ties(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [1.0, 0.01])] + [(10 + i, [0.0, 1.0]) for i in range(15)]
    got = neardup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links) for r in got if r.vec_id < 10) == [(1, 3), (1, 3), (2, 3), (3, 3), (3, 15)], got
    assert {r.n_links for r in got if r.vec_id >= 10} == {15} and all(r.audited_recall >= 0.98 for r in got)
    spread = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(np.linspace(0, 0.3, 40))]  # many more ties than places in a list
    got = {r.vec_id: r.n_links for r in neardup.link_vectors(spark.createDataFrame(spread, "vec_id long, embedding array<double>")).collect()}
    u = np.array([v for _, v in spread])
    assert got == dict(enumerate(((u @ u.T >= 0.95).sum(1) - 1).tolist()))


def test_personal_data_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "call a.b@c.de", "n", 3)] * 2 + [(1, "other 1.2.3.4", "n", 3), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip long")
    got = pii.detect(df, pii.initial(), mask=True).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("1", "call <email>"), ("1", "call <email>"), ("1", "other <ip>"), ("None", "None")]
    assert {r.base_sha256 for r in got if r.n_email} == {hashlib.sha256(b"email:5:13").hexdigest()}


def test_calls_that_tie_take_the_smallest_text(spark):
    calls = [(1, "c", 1, "search", json.dumps({"limit": n, "query": q})) for n, q in ((2, "b"), (1, "z" * 300_000), (1, "a"))]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string")
    r = spark.createDataFrame([(1, "c", 2, "y"), (1, "c", 2, "x"), (1, "c", 2, None)], "conv_id long, call_id string, turn long, content string")
    got = toolcalls.link_calls(c, r, toolcalls.TOOLS).collect()
    assert len(got) == 1 and (got[0].n_calls, got[0].n_results, got[0].valid) == (3, 3, True)
    assert json.loads(got[0].message)["arguments"] == {"limit": 1, "query": "a"} and json.loads(got[0].message)["result"] is None
