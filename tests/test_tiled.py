"""Regions over tiles against the kernel of one grid."""

import numpy as np
import pytest

from patchlake.operators import regions, tiled


def spiral(n):
    """One long region that winds through every tile, and the gap beside it."""
    field = np.zeros((n, n), bool)
    lo, hi = 0, n - 1
    while lo <= hi:
        field[lo, lo : hi + 1] = field[lo : hi + 1, hi] = field[hi, lo : hi + 1] = True
        field[lo + 2 : hi + 1, lo] = True
        if lo + 1 < n:
            field[lo + 2, lo + 1] = lo + 2 <= hi
        lo, hi = lo + 2, hi - 2
    return field


def cells(fields):
    return [(i, k, int(y), int(x), 0.5) for (i, k), f in fields.items() for y, x in zip(*np.nonzero(f), strict=True)]


@pytest.mark.parametrize("tile", [1, 3, 8, 64])
def test_tiles_of_any_size_give_the_same_regions(spark, tile):
    rng = np.random.default_rng(4)
    fields = {(0, 0): spiral(21), (0, 1): rng.random((17, 30)) < 0.45, (1, 0): np.ones((9, 9), bool), (1, 1): np.eye(20, dtype=bool)[::-1], (2, 5): rng.random((25, 4)) < 0.3}
    given = cells(fields) + [(3, 0, 70, 2, 0.1), (3, 0, 70, 2, 0.1), (3, 0, 0, 900, 0.1), (None, 0, 1, 1, 0.2)]
    df = spark.createDataFrame(given, "image_id long, class_id int, y int, x int, piece double")
    want = regions.connected_regions(df.filter("image_id is not null"))
    got = tiled.connected_regions_tiled(df, tile=tile)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_cell_no_region(spark):
    df = spark.createDataFrame([], "image_id long, class_id int, y int, x int")
    assert tiled.connected_regions_tiled(df).collect() == []


def test_contraction_of_a_long_path(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(300)] + [(2, 5, 9), (2, 9, 5), (2, 7, 7)], "k int, a long, b long")
    got = tiled.least_connected(edges, ["k"]).collect()
    assert {(r.k, r.node, r.least) for r in got} == {(1, i, 0) for i in range(301)} | {(2, 5, 5), (2, 9, 5)}
    assert len(got) == 303


def test_regions_across_blocks_of_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(tiled, "BLOCK", 2)
    fields = {(0, 0): spiral(23), (0, 1): rng.random((19, 33)) < 0.42, (5, 1): np.ones((14, 13), bool)}
    given = [(i, k, y - 9, x - 11, 0.5) for i, k, y, x, _ in cells(fields)] * 2
    df = spark.createDataFrame(given, "image_id long, class_id int, y int, x int, v double")
    want = regions.connected_regions(df)
    assert sorted(map(tuple, tiled.connected_regions_tiled(df, tile=3).collect())) == sorted(map(tuple, want.collect()))


def test_small_images_need_no_contraction_rounds(spark, monkeypatch):
    """All tiles of an image within a block are joined by one pass, so many small images take no rounds over their borders."""
    seen, plain = [], tiled.least_connected
    monkeypatch.setattr(tiled, "least_connected", lambda edges, ks: (seen.append(edges.count()), plain(edges, ks))[1])
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(cells({(i, k): rng.random((20, 20)) < 0.4 for i in range(6) for k in range(2)}), "image_id long, class_id int, y int, x int, v double")
    got = tiled.connected_regions_tiled(df, tile=8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, regions.connected_regions(df).collect())) and seen == [0]


def test_tiles_cut_by_batches_are_labelled_whole(monkeypatch):
    """Many tiles in one call, whatever the batches that they arrive in."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    places = sorted({(int(k), int(y), int(x)) for k, y, x in zip(rng.integers(0, 40, 3000), *rng.integers(0, 16, (2, 3000)), strict=True)})
    places = sorted(places + places[::7], key=lambda p: (p[0], p[1] // 8, p[2] // 8))
    k, y, x = (np.array(c) for c in zip(*places, strict=True))
    table = pa.table({"k": k, "_ty": y // 8, "_tx": x // 8, "y": y.astype(np.int32), "x": x.astype(np.int32)})
    found = []
    for least, size in ((10**6, 10**6), (50, 13), (1, 1)):
        monkeypatch.setattr(tiled, "ROWS", least)
        out = pa.Table.from_batches(list(tiled._label_tiles(iter(table.to_batches(size)), ["k"], 8))).to_pylist()
        assert sorted((r["k"], a, b) for r in out for a, b in zip(r["ys"], r["xs"], strict=True)) == sorted(places)
        found.append(sorted((r["k"], r["piece"], tuple(r["bys"]), tuple(r["bxs"])) for r in out))
    assert found[0] == found[1] == found[2]
    rim = {(int(a), int(b), int(c)) for a, b, c in places if b % 8 in (0, 7) or c % 8 in (0, 7)}
    assert sorted((r[0], a, b) for r in found[0] for a, b in zip(*r[2:], strict=True)) == sorted(rim)


def test_labels_are_never_broadcast(spark):
    """Files of labels that repeat from image to image seem small, whatever their rows."""
    import io
    from contextlib import redirect_stdout

    df = spark.createDataFrame(cells({(0, 0): spiral(21), (1, 0): np.ones((9, 9), bool)}), "image_id long, class_id int, y int, x int, v double")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(9)], "k int, a long, b long")
    for made in (lambda: tiled.connected_regions_tiled(df, tile=3), lambda: tiled.least_connected(edges, ["k"])):
        out = io.StringIO()
        with redirect_stdout(out):
            made().explain("simple")
        assert "Broadcast" not in out.getvalue() and "SortMergeJoin" in out.getvalue()
