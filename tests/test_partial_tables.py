"""Images of which only some places are there, and plans that don't send the cells of all images to one place."""

import io
from contextlib import redirect_stdout

import duckdb
import numpy as np
import pytest

from patchlake.operators import grids
from patchlake.plans import catalog
from patchlake.sources import tables as sources

SF = "/root/testdata/sf0.001"


def test_partial_maps_come_back_with_the_places_that_they_have(spark, tmp_path):
    places = [(1, 0, 0), (1, 0, 2), (1, 3, 1), (1, 3, 4), (2, 5, 5), (3, 0, 0), (3, 0, 1), (None, 1, 0)]
    cells = spark.createDataFrame([(*p, [float(i), 0.5]) for i, p in enumerate(places)], "image_id long, y int, x int, feat array<double>")
    kept = lambda df: {(r.image_id, r.y, r.x, tuple(r.feat)) for r in df.collect()}
    for nested in (True, False):
        sources.write_maps(cells, f"{tmp_path}/{nested}", nested, partial=True)
        got = sources.read_maps(spark, f"{tmp_path}/{nested}")
        assert kept(got) == kept(cells) and got.count() == len(places)
        for n, more in enumerate(([(1, 0, 2, [9.0, 9.0])], [(3, 0, -1, [9.0, 9.0])], [(3, None, 0, [9.0, 9.0])])):
            with pytest.raises(Exception, match="twice or outside"):
                sources.write_maps(cells.union(spark.createDataFrame(more, cells.schema)), f"{tmp_path}/odd-{n}-{nested}", nested, partial=True)


@pytest.mark.parametrize("name", ["s3_flat_maps", "s3_nested_maps"])
def test_map_queries_take_an_image_that_ends_within_a_row(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 256 AND vec_id <> 17").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name]).fetchall()
    assert len(want) == 255 * 64 and sorted(map(tuple, got.collect())) == sorted(want)


def test_resizing_leaves_out_cells_that_miss_a_corner(spark):
    rng = np.random.default_rng(5)
    full = [(1, y, x, k, float(rng.random())) for y in range(5) for x in range(4) for k in range(2)]
    g = spark.createDataFrame(full, "image_id long, y int, x int, class_id int, v double")
    some = g.filter("NOT (class_id = 0 AND y = 1 AND x = 1) AND NOT (class_id = 1 AND y = 4 AND x > 1)")
    want = {(r.class_id, r.y, r.x): r.v for r in grids.bilinear_resize(g, 9, 7, keys=("class_id",)).collect()}
    got = {(r.class_id, r.y, r.x): r.v for r in grids.bilinear_resize(some, 9, 7, keys=("class_id",), partial=True).collect()}
    gone = {0: [(1, 1)], 1: [(4, 2), (4, 3)]}
    src = lambda t, n, out: (lambda s: {int(s), min(int(s) + 1, n - 1)})(max((t + 0.5) * n / out - 0.5, 0))
    assert got == {(k, y, x): v for (k, y, x), v in want.items() if not any(a in src(y, 5, 9) and b in src(x, 4, 7) for a, b in gone[k])}
    with pytest.raises(Exception, match="stands twice"):
        grids.bilinear_resize(some.union(some.limit(1)), 9, 7, keys=("class_id",), partial=True).collect()


def test_search_takes_images_with_missing_patches(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 283 AND vec_id NOT IN (144, 109, 199)").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["search_regions"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["search_regions"]).fetchall()
    assert {r[0] for r in want} == {0, 1, 2} and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(("h", "w"), [(30, 30), (7, 3), (1, 64), (11, 5)])
def test_nearest_resize_equals_the_definition(spark, h, w):
    rng = np.random.default_rng(6)
    given = [(i, y, x, int(rng.integers(9))) for i, n, m in ((1, 11, 5), (2, 1, 1), (3, 40, 37)) for y in range(n) for x in range(m) if rng.random() < 0.8 or (y, x) == (n - 1, m - 1)]
    given += [(1, 0, 0, 77), (1, -1, 2, 5), (None, 0, 0, 3), (3, None, 1, 4)]
    size = {1: (11, 5), 2: (1, 1), 3: (40, 37)}
    want = sorted((i, ty, tx, k) for i, y, x, k in given if i and y is not None for ty in range(h) for tx in range(w) if (ty * size[i][0] // h, tx * size[i][1] // w) == (y, x))
    got = grids.nearest_resize(spark.createDataFrame(given, "image_id long, y int, x int, class_id int"), h, w)
    assert got.columns == ["image_id", "y", "x", "class_id"] and got.schema["y"].dataType.simpleString() == got.schema["x"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.collect())) == want


def test_nearest_resize_joins_images_not_target_cells(spark):
    """What is joined has a row for each image: no target cell is made before the join, under which a broadcast would take all of them."""
    out = io.StringIO()
    with redirect_stdout(out):
        catalog.QUERIES["j3_nearest_resize"](spark, SF).explain("simple")
    plan = out.getvalue()
    assert "Join" in plan and "Generate" in plan and plan.rindex("Generate") < plan.index("Join")
