import os
import re

import pytest

import corpus_pipeline
from patchlake.llm import langid, pii

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark, tmp_path):
    from tests.llm.test_minhash_substrings import brute_repeats, components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, read = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, read, SF).write.parquet(str(tmp_path / str(k)))
        read = spark.read.parquet(str(tmp_path / str(k)))
        steps[name] = read
        if name != "packing":
            assert read.columns == docs.columns and read.dtypes == docs.dtypes
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    start, one, two, three, four = texts(docs), *(texts(steps[n]) for n in ("language_id", "minhash_dedup", "substring_dedup", "personal_data"))
    rejected = {r.doc_id for r in langid.identify(docs).collect() if r.rejected}
    assert set(one) == set(start) - rejected
    assert set(two) == {i for i, (_, c) in components(list(one.items()), 5).items() if c == i}
    want = brute_repeats(list(two.items()), 20)
    assert set(three) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    assert all(three[i] == two[i] if not want[i][1] else len(three[i].split()) == want[i][0] - want[i][1] for i in three)
    assert set(four) == set(three) and not any(pii.base_spans(t) for t in four.values() if t and len(t) < 2000)
    assert {r.doc_id for r in steps["packing"].select("doc_id").distinct().collect()} == set(four)


def test_near_dedup_keeps_null_ids_and_each_text_of_an_id(spark):
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(None, words[0]), (None, words[1]), (3, words[1]), (3, words[1]), (5, words[1] + " more"), (5, words[2]), (7, words[3]), (7, words[3].upper()), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(None, words[0]), (None, words[1]), (3, words[1]), (5, words[2]), (7, words[3]), (8, "")], key=str)
    unique = docs.filter("doc_id in (3, 8)").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))
    assert corpus_pipeline.near_dedup(spark, unique, "").count() == 4
    left = corpus_pipeline.substring_dedup(spark, docs.filter("doc_id is null or doc_id in (3, 5, 8)").dropDuplicates(["doc_id", "text"]), "")
    assert [r.text for r in left.filter("doc_id is null").orderBy("text").collect()] == words[:2]
    # of "words more" of doc 5 only the last word is new, and the other text of doc 5 stays whole
    got = sorted((r.doc_id, r.text) for r in left.filter("doc_id in (3, 5)").collect())
    assert got == [(3, words[1]), (5, words[2]), (5, "more")]


def test_near_dedup_shuffles_texts_once(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 9) for i in (1, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L?, h#", plan)  # not once more by id and text
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3]


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    words = lambda c, n: " ".join(f"{c}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(n))
    rows = [(1, words("k", 400), "aa"), (2, words("zo", 400), "bb"), (2, words("zo", 400), "bb"), (3, None, "aa"), (4, "", None), (5, "12 !!", None), (6, words("k", 60_000), "aa"), (None, words("k", 30) + " a.b@c.de", None), (7, words("q", 300), None)]
    docs = spark.createDataFrame([(i, t, lang, None, None, "x", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, piece string, keep int")
    read, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, read, "").write.parquet(str(tmp_path / str(k)))
        read = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = read
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0 and empty.columns == read.columns
    ids = lambda name: sorted(str(r.doc_id) for r in seen[name].select("doc_id").collect())
    assert not {"3", "4", "5"} & set(ids("language_id")) and ids("language_id").count("2") == 2
    assert ids("minhash_dedup").count("2") == 1 and "None" in ids("minhash_dedup")
    assert [r.text.endswith("<email>") for r in seen["personal_data"].filter("doc_id is null").collect()] == [True]
    assert set(ids("packing")) == set(ids("personal_data")) and seen["packing"].filter("doc_id = 6").count() > 1
