import hashlib
import json
import re

import numpy as np
import pytest

from patchlake.llm import fingerprints, neardup, toolcalls
from patchlake.llm.common import connected_components


def test_components_of_chains_stars_and_circles(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    perm = {n: int(v) for n, v in zip({x for e in edges for x in e}, rng.permutation(1000), strict=False)}
    df = spark.createDataFrame([(perm[a], perm[b]) for a, b in edges], "a long, b long")
    got = {r.node: r.comp for r in connected_components(df).collect()}
    for group in (range(41), range(100, 130), range(200, 203)):
        assert {got[perm[i]] for i in group} == {min(perm[i] for i in group)}
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, salt", [(512, 4096), (16, 5)])
def test_links_equal_brute_force(spark, monkeypatch, block, salt):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SALT", salt)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[50:110] = x[0] + 0.02 * rng.standard_normal((60, 16))
    x[120] = x[121]
    x[122] = 3 * x[123]
    x[130:135] = x[129]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [1.0] * 15 + [None], 1), (904, [1.0] * 3, 1), (None, x[0].tolist(), 1)]
    got = {r.vec_id: r for r in neardup.link_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, key int").repartition(3)).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i].n_links for i in range(300)] == (near.sum(1) - 1).tolist()
    root = np.arange(300)
    for _ in range(20):
        root = np.where(near, root[None], 999).min(1)
    assert [got[i].component_id for i in range(300)] == root.tolist()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 905)) and len(got) == 305


def test_a_large_cluster_of_near_copies_needs_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    x = np.concatenate((base + 0.02 * rng.standard_normal((2500, 16)), rng.standard_normal((50, 16))))
    asked, pairs = [], neardup._by_pairs
    monkeypatch.setattr(neardup, "_by_pairs", lambda members, *a: asked.append(members.count()) or pairs(members, *a))
    got = {r.vec_id: r for r in neardup.link_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert all((got[i].n_links, got[i].component_id) == (2499, 0) for i in range(2500)) and sum(asked) == 0


def test_links_of_nothing(spark):
    assert neardup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_first_class_of_each_order_stands_where_firsts_says():
    n, signed = fingerprints.ORDERS, lambda v: v - (v & 16) * 2
    sorted_classes, leads = sorted(range(n), key=signed), fingerprints._leads()
    for b, place in enumerate(fingerprints._firsts()):
        assert sorted_classes[place] == min(range(n), key=lambda c: signed(leads[b * n + c]))  # noqa: B023


def test_fingerprints(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", None, "", "x", "a a a a a a a a", "é" * 51, " ".join(map(str, range(500))), " ".join(map(str, reversed(range(500))))]
    ids = [3, 1, 7, 5, 20, 11, 40, 60, 50]
    rows = [(i, t, "z") for i, t in zip(ids, texts, strict=True)] + [(None, "left out", "z")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, half string").repartition(3)).collect()}
    order = sorted(zip(ids, texts, strict=True))
    assert sorted(got) == [i for i, _ in order]
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[3].fingerprint == got[1].fingerprint and got[1].near_next == 1 and got[5].near_edited == 1
    assert got[50].near_next == 0 and got[60].near_edited > 0  # the same words in another order are not alike
    assert fingerprints.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_likeness_follows_the_edit_distance(spark):
    words = [str(i * 7919 % 10007) for i in range(2000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:1700])), (2, " ".join(words[:1000])), (3, "none of this")]
    df = fingerprints.with_signature(spark.createDataFrame(rows, "doc_id long, text string"), "text", "sig")
    a = df.filter("doc_id = 0").selectExpr("sig AS a")
    near = [r.n for r in df.crossJoin(a).orderBy("doc_id").select(fingerprints.likeness("a", "sig").alias("n")).collect()]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] == 0


def slow_signature(text):
    """Order MinHash one order at a time over all elements; hashes as Spark has them."""
    import xxhash

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    xx = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)

    def chained(chars, seed=42):
        for c in chars:
            seed = xx(c.encode(), seed)
        return seed

    tokens = re.findall(f"[^\\x20\\x09-\\x0D]{{1,{fingerprints.TOKEN}}}", text)
    grams = [(i, tokens[i : i + fingerprints.K]) for i in range(max(len(tokens) - fingerprints.K + 1, 1))] if tokens else []
    seen, elements = {}, []
    for place, gram in grams:
        h = signed(chained(gram)) >> 31
        n = seen[h] = seen.get(h, -1) + 1
        if n:
            h = signed(xx((n - 1).to_bytes(4, "little"), xx(h.to_bytes(8, "little", signed=True)))) >> 31
        elements.append(((h << 31) | place, place, gram))
    out, leads = [], fingerprints._leads()
    for b in range(fingerprints.ORDERS):
        best = sorted(elements, key=lambda e: signed((e[0] & ((1 << 59) - 1)) | (leads[32 * b + (e[0] >> 59) % 32] << 59)))[: fingerprints.PICK]
        seed = 42
        for _, _, gram in sorted(best, key=lambda e: e[1]):
            seed = chained(gram, seed)
        out.append(signed(seed) if best else None)
    return out


def test_signatures_equal_order_minhash_one_order_at_a_time(spark):
    rng = np.random.default_rng(9)
    texts = ["", "a", "abcdef", "abcdefg", "aaaaaaaaaaaaaaaa", "ab" * 400, "é😀日" * 30, "the hat of the man " * 9, " " * 50, "a b", "one two three\nfour"]
    texts += ["".join(rng.choice(list("abc é"), int(n))) for n in rng.integers(1, 4000, 12)]
    df = fingerprints.with_signature(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "sig")
    assert {r.doc_id: r.sig for r in df.collect()} == {i: slow_signature(t) for i, t in enumerate(texts)}


def test_each_order_begins_with_another_class_of_leading_bits():
    n, leads = fingerprints.ORDERS, fingerprints._leads()
    assert all(sorted(leads[b * n : b * n + n]) == list(range(n)) and leads[b * n + b] == 0 for b in range(n))
    assert len({tuple(leads[b * n : b * n + n]) for b in range(n)}) == n


def test_fingerprints_of_short_texts_repeated_ids_and_long_texts(spark):
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9))))
    short = [" ".join(word() for _ in range(5)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(short)] + [(50, "same id, one text"), (50, "same id, another"), (60, "z" * 600_000), (60, "z" * 600_000)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == 24 and np.mean([r.near_edited > 0 for r in got if r.doc_id < 20]) >= 0.4
    assert [r.n_chars for r in got if r.doc_id == 60] == [600_000] * 2 and len({r.fingerprint for r in got if r.doc_id == 60}) == 1
    edited = {r.edited_sha256 for r in got if r.doc_id == 50}
    one, two = "same id, one text", "same id, another"
    want = lambda t, after: hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    z = "z" * 600_000
    assert edited in ({want(one, two), want(two, z)}, {want(two, one), want(one, z)})  # they follow each other


SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "number", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}}, "c": {"enum": ["x"]}}}}


def test_tool_calls(spark):
    ref = lambda i: {"$ref": i}
    calls = [
        (1, "c1", 1, "add", json.dumps({"b": ["é"], "a": 1.0})),
        (1, "c1", 9, "add", "{}"),
        (1, "c2", 2, "add", json.dumps({"a": ref("c1")})),
        (1, "c3", 3, "add", json.dumps({"a": ref("c2"), "b": [ref("c1")]})),
        (1, "l1", 4, "add", json.dumps({"a": ref("l2")})),
        (1, "l2", 4, "add", json.dumps({"a": ref("l1")})),
        (2, "c1", 1, "add", json.dumps({"a": ref("c3")})),
        (2, "bad", 1, "add", "{"),
        (2, "nan", 1, "add", '{"a": NaN}'),
        (2, "who", 1, "other", "{}"),
        (2, "neg", 1, "add", json.dumps({"a": -1, "b": [1], "c": "y", "d": 0})),
        (2, "null", 1, None, None),
        (None, "c1", 1, "add", "{}"),
    ]
    results = [(1, "c1", 2, "later"), (1, "c1", 1, "first"), (2, "lone", 5, None)]
    c = spark.createDataFrame([(*x, 0) for x in calls], "conv_id long, call_id string, turn long, name string, arguments string, level int")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    got = {(x.conv_id, x.call_id): x for x in toolcalls.link_calls(c, r, SCHEMAS).collect()}
    assert len(got) == 12
    assert [got[1, i].level for i in ("c1", "c2", "c3", "l1")] == [0, 1, 2, None]
    assert (got[1, "c1"].n_calls, got[1, "c1"].n_results, got[1, "c1"].status, got[1, "c1"].valid) == (2, 2, "linked", True)
    assert got[1, "c1"].message == '{"arguments":{"a":1,"b":["é"]},"errors":[],"id":"c1","level":0,"name":"add","result":"first","status":"linked"}'
    assert got[1, "l2"].status == "circular" and not got[1, "l2"].valid
    assert got[2, "lone"].status == "orphan" and got[2, "c1"].status == "unanswered"
    errors = lambda i: json.loads(got[2, i].message)["errors"]
    assert errors("c1") == ["$ref c3: unknown"] and errors("bad") == errors("nan") == errors("null") == ["$: not JSON"] and errors("who") == ["$: unknown tool"]
    assert errors("neg") == ["$.a: under minimum", "$.b[0]: not string", "$.c: not in enum", "$.d: unknown"]
    assert toolcalls.link_calls(c.limit(0), r.limit(0), SCHEMAS).count() == 0


def test_levels_of_long_chains_and_several_references(spark):
    refs = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(300)} | {"m1": ["c299", "c5"], "m2": ["m1", "c0"], "t": ["m2"], "k1": ["k2"], "k2": ["k1"], "b": ["k1"], "bm": ["k1", "c0"]}
    df = spark.createDataFrame([(1, k, v) for k, v in refs.items()], "conv_id long, call_id string, refs array<string>")
    got = {r.call_id: r.level for r in toolcalls._levels(df).collect()}
    assert got == {f"c{i}": i for i in range(300)} | {"m1": 300, "m2": 301, "t": 302}


def _linked_groups():
    """Two tight groups of 30 whose members all have more than ten partners nearer than any of the other group."""
    rng = np.random.default_rng(4)
    a = np.zeros(32)
    a[0] = 1
    b = np.zeros(32)
    b[0], b[1] = np.cos(0.3176), np.sin(0.3176)
    x = np.concatenate([c + 0.006 * rng.standard_normal((30, 32)) for c in (a, b)]).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return x, u, u @ u.T >= 0.95


def test_links_between_saturated_groups(spark):
    x, u, near = _linked_groups()
    assert 0 < near[:30, 30:].sum() < 900
    s = u @ u.T - 2 * np.eye(60)
    top = np.argsort(-s, 1)[:, :10]
    assert ((top < 30) == (np.arange(60) < 30)[:, None]).all()  # exact lists hold no link across
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    reps = spark.createDataFrame([(i, 1, v.tobytes()) for i, v in enumerate(u)], "u long, w long, vec binary")
    lists = spark.createDataFrame([(i, int(j), float(s[i, j])) for i in range(60) for j in top[i]], "u long, v long, s double")
    clusters, found = neardup._degrees(lists, reps, 32, 10, 0.95)
    assert {r.u: r.n for r in found.collect()} == dict(enumerate((near.sum(1) - 1).tolist()))
    assert {r.cluster for r in clusters.collect()} == {0} and clusters.count() == 60
    got = {r.vec_id: r for r in neardup.link_vectors(df).collect()}
    assert [got[i].n_links for i in range(60)] == (near.sum(1) - 1).tolist() and [i for i in got if got[i].kept] == [0]


def test_rare_links_are_audited_and_never_lost(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16))
    for i in range(0, 1400, 100):  # fewer than one in fifty
        x[i + 1] = x[i] + 0.15 * rng.standard_normal(16)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(1500, dtype=bool)
    reps = spark.createDataFrame([(i, 1, v.tobytes()) for i, v in enumerate(u)], "u long, w long, vec binary")
    true = {r.u: r.links for r in neardup.true_links(reps, 1500, 16, 0.95, first=8, block=400).collect()}
    assert true == {i: int(n) for i, n in enumerate(near.sum(1)) if n}  # a first block without a link doesn't end the audit
    monkeypatch.setattr(neardup, "_refine", lambda lists, *_: lists.filter("s > 2"))  # all lists are lost
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in neardup.link_vectors(df).collect()}
    assert [got[i].n_links for i in range(1500)] == near.sum(1).tolist()
    assert neardup._enough(1_000_000, 64, 0.95, 0.98) == 16
