import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchlake.functions import kernels


def flood(mask, corners):
    label, n = np.zeros(mask.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if corners or abs(a) + abs(b) == 1]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        label[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy, dx in steps:
                p = (a + dy, b + dx)
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not label[p]:
                    label[p] = n
                    todo.append(p)
    return label


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**20), st.booleans())
def test_components_equal_flood_fill(h, w, seed, corners):
    mask = np.random.default_rng(seed).random((h, w)) < 0.5
    assert (kernels.components(mask, corners) == flood(mask, corners)).all()


def test_outer_components_skip_a_region_in_a_hole():
    m = np.zeros((7, 7), bool)
    m[0, :] = m[6, :] = m[:, 0] = m[:, 6] = True
    m[3, 3] = True
    out = kernels.outer_components(m)
    assert out[3, 3] == 0 and out[0, 0] == 1
    m[0, 3] = m[1, 3] = False
    m[6, 6] = True
    assert kernels.outer_components(m)[3, 3] > 0


def test_nms_keeps_iou_at_the_threshold():
    boxes = np.array([[0, 0, 6, 1], [4, 0, 10, 1], [0, 0, 6, 1], [1, 0, 6, 1]], float)  # IoU of the first two is exactly 0.2
    keep = kernels.nms(boxes, np.array([0.9, 0.8, 0.9, 0.7]), np.arange(4), 0.2)
    assert keep.tolist() == [True, True, False, False]


def test_self_correlate_identical_patches_average():
    x = np.tile([[3.0, 4.0]], (5, 1))
    assert np.allclose(kernels.self_correlate(x, 10.0, True), x)


def test_self_correlate_blocks_agree():
    x = np.random.default_rng(1).standard_normal((37, 6))
    assert np.allclose(kernels.self_correlate(x, 10.0, True, block=8), kernels.self_correlate(x, 10.0, True))


def test_kmeans_empty_cluster_gets_a_zero_center_and_labels_precede_the_update():
    x = np.array([[1.0, 0.0], [1.0, 0.1]])
    c, label = kernels.kmeans(x, np.array([[1.0, 0.0], [-1.0, 0.0]]), 3, 1e-4)
    assert (c[1] == 0).all() and label.tolist() == [0, 0]


def test_rows_refuses_mixed_dimensions():
    with pytest.raises(ValueError):
        kernels.rows([[1.0], [1.0, 2.0]])
