"""Covariance and principal axes that need no D x D matrix in one place, against numpy."""

import numpy as np
import pytest

from patchlake.operators import similarity


@pytest.mark.parametrize(("dims", "block"), [(7, 3), (7, 7), (5, 100), (1, 1)])
def test_covariance_in_blocks(spark, dims, block):
    x = np.random.default_rng(dims).standard_normal((60, dims)) * 3 + 1000
    df = spark.createDataFrame([(v.tolist(), 1) for v in x] + [(None, 1)], "feat array<double>, a int").repartition(3)
    got = {(r.i, r.j): r.cov for r in similarity.covariance_blocks(df, block=block).collect()}
    want = np.cov(x.T).reshape(dims, dims)
    assert len(got) == dims * dims and all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(dims) for j in range(dims))
    assert similarity.covariance_blocks(df.limit(0)).count() == 0


def test_leading_axes_of_long_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 4)) * [9, 5, 3, 1] @ np.linalg.qr(rng.standard_normal((600, 4)))[0].T + rng.standard_normal((80, 600)) * 0.01 + 2
    df = spark.createDataFrame([(v.tolist(),) for v in x], "feat array<double>").repartition(3)
    mean, axes = similarity.leading_axes(df, 3)
    want = similarity.principal_axes(np.cov(x.T), 3)
    assert np.allclose(mean, x.mean(0)) and np.allclose(axes, want, atol=1e-7)
    again = similarity.leading_axes(df.repartition(5), 3)[1]
    assert np.allclose(axes, again, atol=1e-7)
    assert similarity.pca_rgb_long(spark.createDataFrame([], "image_id long, feat array<double>"), ["image_id"]).count() == 0
