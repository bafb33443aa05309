"""Attention by blocks against the kernels that hold a whole image."""

import numpy as np
import pytest

from patchlake.operators import attention, similarity


def compare(got, want):
    a, b = ({(r.image_id, r.y, r.x): r.feat for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) == got.count()
    for k in a:
        assert np.allclose(np.array(a[k], float), np.array(b[k], float), atol=1e-9, equal_nan=True), k


def images(rng, width, zero=True):
    rows = [(0, y, x, rng.standard_normal(width)) for y in range(9) for x in range(11)]
    rows += [(1, y, 0, rng.standard_normal(width) * 100) for y in range(5)] + [(2, 0, 0, rng.standard_normal(width))]
    rows += [(3, y, x, np.ones(width)) for y in range(3) for x in range(4)]
    rows += [(4, 0, x, -np.eye(width)[x % width]) for x in range(0, 14, 2)]
    return rows + [(0, 9, 3, np.zeros(width))] * zero


@pytest.mark.parametrize(("block", "center"), [(1, True), (7, True), (7, False), (1024, True)])
def test_self_similarity_for_every_block_size(spark, block, center):
    rows = images(np.random.default_rng(1), 6)
    df = spark.createDataFrame([(i, y, x, v.tolist(), "extra") for i, y, x, v in rows], "image_id long, y int, x int, feat array<double>, block string")
    compare(attention.self_correlate_blocks(df, 10.0, center, block=block), similarity.self_correlate(df, 10.0, center))


@pytest.mark.parametrize("block", [4, 1024])
def test_attention_for_every_block_size(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, y, x, *(m.tolist() for m in (v, rng.standard_normal(8), rng.standard_normal(8)))) for i, y, x, v in images(rng, 8, zero=False)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, q array<double>, k array<double>, v array<double>")
    compare(attention.recursive_attention_blocks(df, 2, block=block), similarity.recursive_attention(df, 2))


def test_states_merge_in_any_order():
    rng = np.random.default_rng(3)
    q, k, v = rng.standard_normal((5, 4)), rng.standard_normal((30, 4)) * 40, rng.standard_normal((30, 4))
    whole = attention.SoftmaxState.of(q, k, v, 2, 1.0, 0.0, False).result()
    for order in ([0, 1, 2], [2, 0, 1]):
        state = attention.SoftmaxState.empty(5, 2, 4)
        for i in order:
            state.add(attention.SoftmaxState.of(q, k[i * 10 : i * 10 + 10], v[i * 10 : i * 10 + 10], 2, 1.0, 0.0, False))
        assert np.allclose(state.result(), whole)


def test_empty_table(spark):
    df = spark.createDataFrame([], "image_id long, y int, x int, feat array<double>")
    assert attention.self_correlate_blocks(df).count() == 0
