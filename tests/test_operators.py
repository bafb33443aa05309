import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.operators import aggregates, grids, prompts, regions, rowmath, similarity, voxels, windows
from patchlake.sources import tables as sources


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_zero_vectors(spark):
    f = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, feat array<double>")
    assert rows(rowmath.l2_normalize(f)) == [(1, [0.0, 0.0]), (2, [0.6, 0.8])]
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "class_id int, embed array<double>")
    got = {(r.id, r.class_id): r.sim for r in similarity.cos_sim(f, c, ["id"]).collect()}
    assert got[1, 0] is None and got[2, 1] is None and got[2, 0] == pytest.approx(0.6)


def test_cos_sim_blocks_equal_the_broadcast_form(spark, monkeypatch):
    rng = np.random.default_rng(0)
    f = spark.createDataFrame([(i, rng.random(4).tolist()) for i in range(9)], "id long, feat array<double>")
    c = spark.createDataFrame([(i, rng.random(4).tolist()) for i in range(7)], "class_id int, embed array<double>")
    whole = rows(similarity.cos_sim(f, c, ["id"]).withColumn("sim", F.round("sim", 9)))
    monkeypatch.setattr(similarity, "BROADCAST_VALUES", 8)
    assert rows(similarity.cos_sim(f, c, ["id"]).withColumn("sim", F.round("sim", 9))) == whole


def test_dimension_mismatch_is_an_error(spark):
    f = spark.createDataFrame([(1, [1.0, 0.0])], "id long, feat array<double>")
    c = spark.createDataFrame([(0, [1.0])], "class_id int, embed array<double>")
    with pytest.raises(Exception, match="dimensions"):
        similarity.cos_sim(f, c, ["id"]).collect()


def test_empty_inputs(spark):
    f = spark.createDataFrame([], "image_id long, y int, x int, feat array<double>")
    c = spark.createDataFrame([], "class_id int, embed array<double>")
    assert similarity.cos_sim(f, c, ["image_id"]).count() == 0
    assert similarity.self_correlate(f).count() == 0


def test_small_image_and_tile_guard(spark):
    plan = rowmath.resize_plan(spark.createDataFrame([(1, 224, 224), (2, 100, 500)], "image_id long, h int, w int"))
    assert [(r.new_h, r.new_w) for r in plan.orderBy("image_id").collect()] == [(224, 224), (336, 672)]
    tiles = grids.make_tiles(spark.createDataFrame([(1, 224, 224)], "image_id long, h int, w int"))
    assert rows(tiles) == [(1, 0, 0, 0, 0, 14, 14)]
    with pytest.raises(Exception, match="does not divide"):
        grids.make_tiles(spark.createDataFrame([(1, 225, 224)], "image_id long, h int, w int")).collect()


def test_tiles_cover_every_patch_and_stitching_a_constant_is_constant(spark):
    images = spark.createDataFrame([(1, 13, 9)], "image_id long, h int, w int")
    cells = spark.createDataFrame([(1, y, x, [2.0]) for y in range(13) for x in range(9)], "image_id long, y int, x int, feat array<double>")
    out = aggregates.stitch_tiles(grids.assign_tiles(cells, grids.make_tiles(images, 3, 5, 1)))
    assert out.count() == 117 and out.filter("v <> 2").count() == 0


def test_bilinear_of_a_constant_is_constant(spark):
    g = spark.createDataFrame([(1, y, x, 0.25) for y in range(3) for x in range(4)], "image_id long, y int, x int, v double")
    assert grids.bilinear_resize(g, 7, 5).filter("abs(v - 0.25) > 1e-12").count() == 0


def test_map_round_trip(spark):
    m = [[[1.0], [2.0]], [[3.0], [4.0]]]
    df = spark.createDataFrame([(7, m)], "image_id long, map array<array<array<double>>>")
    flat = grids.flatten_map(df)
    assert [r.pos for r in flat.orderBy("pos").collect()] == [0, 1, 2, 3]
    assert grids.unflatten_map(flat).first()["map"] == m


def test_prompt_lines_across_submissions(spark):
    df = spark.createDataFrame([(2, " dog\n\ncat \n"), (1, "\tcat\n bird"), (3, None)], "submission long, text string")
    assert [(r.prompt, r.idx) for r in prompts.clean_prompts(df).orderBy("idx").collect()] == [("cat", 0), ("bird", 1), ("dog", 2)]


def test_class_map_drops_only_a_leading_empty_name(spark):
    names = spark.createDataFrame([(0, ""), (1, "a"), (2, "b"), (3, "a"), (4, "")], "idx int, name string")
    got = prompts.build_class_map(names)
    assert rows(got) == [(0, ""), (1, "a"), (2, "b"), (3, "a"), (4, "")]
    assert dict(map(tuple, prompts.name_to_index(got).collect()))["a"] == 3


def test_encode_classes_guards(spark):
    names = spark.createDataFrame([("a",)], "name string")
    vectors = spark.createDataFrame([("a", [1.0])], "prompt string, vec array<double>")
    with pytest.raises(ValueError):
        prompts.encode_classes(names, vectors, "other")
    with pytest.raises(ValueError):
        prompts.encode_classes(names.limit(0), vectors, "prompts")
    assert rows(prompts.encode_classes(names, vectors, "prompts")) == [("a", 0, 1.0)]


def test_onehot_unknown_name(spark):
    classes = spark.createDataFrame([(0, ""), (1, "a"), (2, "b")], "class_id int, name string")
    ok = rowmath.onehot_encode(spark.createDataFrame([("b",)], "name string"), classes).first()
    assert ok["onehot"] == [1e-10, 1e-10, 1.0]
    with pytest.raises(Exception, match="unknown class"):
        rowmath.onehot_encode(spark.createDataFrame([("z",)], "name string"), classes).collect()


def test_strictness_of_thresholds(spark):
    p = spark.createDataFrame([(1, 0, 0, 0, 0.5), (1, 0, 0, 1, 0.5), (1, 0, 1, 0, 0.2), (1, 0, 1, 1, 0.1)], "image_id long, y int, x int, class_id int, p double")
    assert windows.denoise_prompts(p, 0.5).filter("p = 0").count() == 0
    assert windows.denoise_prompts(p, 0.51).filter("p <> 0").count() == 0
    best = windows.argmax_class(p, ["image_id", "y", "x"])
    assert rows(best.select("x", "class_id")) == [(0, 0), (1, 0)]
    assert rows(rowmath.apply_ignore(best, 0.5).select("x", "class_id")) == [(0, 1), (1, 0)]
    assert rows(rowmath.coarse_background(best, 0.0, 9).select("x", "class_id")) == [(0, 0), (1, 0)]


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(i, c, (i * c % 7) / 7) for i in range(5) for c in range(4)], "id long, class_id int, sim double")
    sums = windows.softmax(df, ["id"]).groupBy("id").agg(F.sum("p").alias("s"))
    assert sums.filter("abs(s - 1) > 1e-12").count() == 0


def test_zero_label(spark):
    df = spark.createDataFrame([(0,), (1,), (255,)], "gt int")
    assert [r.gt for r in rowmath.reduce_zero_label(df).collect()] == [255, 0, 255]


def test_regions_touch_at_corners_and_boxes_are_inclusive(spark):
    cells = [(1, 0, y, x) for y, x in ((0, 0), (1, 1), (3, 3), (0, 4))]
    out = regions.connected_regions(spark.createDataFrame(cells, "image_id long, class_id long, y int, x int"))
    assert {(r.y, r.x): r.region_id for r in out.collect()} == {(0, 0): 1, (1, 1): 1, (0, 4): 2, (3, 3): 3}
    stats = aggregates.region_stats(out.withColumn("p", F.lit(0.5))).filter("region_id = 1").first()
    assert (stats.area, stats.x1, stats.y1, stats.x2, stats.y2, stats.px, stats.py) == (2, 0, 0, 1, 1, 0, 0)


def test_nms_property(spark):
    rng = np.random.default_rng(5)
    boxes = [(int(i % 3), i, *(c := (rng.random(2) * 10).tolist()), c[0] + 1 + rng.random() * 4, c[1] + 1 + rng.random() * 4, float(rng.integers(0, 5))) for i in range(90)]
    df = spark.createDataFrame(boxes, "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double, score double")
    kept = {r.box_id for r in regions.nms(df, 0.2).collect()}
    score = {b[1]: (-b[6], b[1]) for b in boxes}
    pairs = [(r.a, r.b, r.iou) for r in regions.box_iou_pairs(df).collect() if r.iou > 0.2]
    assert not any(a in kept and b in kept for a, b, _ in pairs)
    for b in boxes:
        if b[1] not in kept:
            assert any({x, y} == {b[1], k} and score[k] < score[b[1]] for x, y, _ in pairs for k in kept if k in (x, y))


def test_heatmap_boxes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    heat = rng.random((8, 9))
    df = spark.createDataFrame([(1, y, x, float(heat[y, x])) for y in range(8) for x in range(9)], "image_id long, y int, x int, v double")
    from tests.test_kernels import flood

    want = []
    for k in range(2, 10):
        on = heat > heat.min() + k * 0.1 * (heat.max() - heat.min())
        label = flood(on, True)
        pad = flood(~np.pad(on, 1), False)
        for i in range(1, label.max() + 1):
            y, x = np.nonzero(label == i)
            near = {pad[a + 1 + dy, b + 1 + dx] for a, b in zip(y, x, strict=True) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))}
            if pad[0, 0] in near and (np.ptp(y) + 1) * (np.ptp(x) + 1) > 0.005 * 72:
                want.append((1, k, x.min(), y.min(), x.max() + 1, y.max() + 1, heat[y.min() : y.max() + 1, x.min() : x.max() + 1].max()))
    assert rows(regions.heatmap_boxes(df)) == sorted(want)


def test_restore_failed_never_lowers(spark):
    cols = "image_id long, y int, x int, class_id int, p double"
    scores = spark.createDataFrame([(1, 0, 0, 0, 0.2), (1, 0, 1, 0, 0.9)], cols)
    coarse = spark.createDataFrame([(1, 0, 0, 0, 0.6), (1, 0, 0, 1, 0.1), (1, 0, 1, 0, 0.95)], cols)
    failed = spark.createDataFrame([(1, 0, 0)], "image_id long, y int, x int")
    assert rows(regions.restore_failed(scores, failed, coarse)) == [(1, 0, 0, 0, 0.6), (1, 0, 0, 1, 0.1), (1, 0, 1, 0, 0.9)]


def test_iou_of_an_absent_class_is_null(spark):
    cm = spark.createDataFrame([(0, 0, 5)], "gt int, pred int, n long").unionByName(spark.createDataFrame([(2, 3, 0)], "gt int, pred int, n long"))
    got = {r.class_id: r.iou for r in aggregates.iou_metrics(cm).collect()}
    assert got[0] == 1.0 and got[2] is None and got[3] is None


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    gt = {(0, *map(int, rng.integers(0, 300, 3))) for _ in range(20)}
    pred = {(0, *map(int, rng.integers(0, 300, 3))) for _ in range(30)}
    names = "scene int, vx long, vy long, vz long"
    got = voxels.knn_voxels(spark.createDataFrame(sorted(gt), names), spark.createDataFrame(sorted(pred), names), 3)
    want = []
    for g in gt:
        near = sorted((sum((a - b) ** 2 for a, b in zip(g[1:], p[1:], strict=True)), *p[1:]) for p in pred)[:3]
        want += [(*g, *n[1:], i + 1) for i, n in enumerate(near)]
    assert rows(got.select("scene", "vx", "vy", "vz", "px", "py", "pz", "rank")) == sorted(want)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_partition_invariance(spark, parts):
    rng = np.random.default_rng(4)
    data = [(i // 25, i % 25 // 5, i % 5, i % 3, rng.standard_normal(4).tolist()) for i in range(100)]
    df = spark.createDataFrame(data, "image_id long, y int, x int, label int, feat array<double>")
    flat = lambda d: rows(d.select("*", F.posexplode("feat").alias("d", "v")).drop("feat").withColumn("v", F.round("v", 9)))
    assert flat(similarity.self_correlate(df.repartition(parts))) == flat(similarity.self_correlate(df))
    mean = lambda d: rows(aggregates.mean_vectors(d, ["label"]).withColumn("v", F.round("v", 9)))
    assert mean(df.repartition(parts)) == mean(df)
    init = df.filter("image_id = 0 AND y = 0 AND x < 3").select(F.col("x").alias("cluster"), F.col("feat").alias("center"))
    label = lambda d: rows(similarity.spherical_kmeans(d, init, ["image_id", "y", "x"], 5)[1])
    assert label(df.repartition(parts)) == label(df)


def test_pca(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 5)) * [5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(i // 20, i, r.tolist()) for i, r in enumerate(x)], "image_id long, id long, feat array<double>")
    mean, cov = similarity.mean_covariance(df)
    assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    axes = similarity.principal_axes(cov, 3)
    assert np.allclose(axes @ axes.T, np.eye(3))
    assert (np.diff(((x - mean) @ axes.T).var(0)) < 0).all()
    out = similarity.pca_rgb(df, ["image_id", "id"])
    assert out.count() == 120 and out.filter("v < 0 OR v > 1").count() == 0


def test_cap_points_and_class_names(spark):
    pts = spark.createDataFrame([(0, i % 2, float(i), 0.0, 0.0) for i in range(20)], "scene int, frame int, x double, y double, z double")
    assert voxels.cap_points(pts, 3).count() == 6 and voxels.cap_points(pts).count() == 20
    assert rows(voxels.cap_points(pts.repartition(5), 3)) == rows(voxels.cap_points(pts, 3))
    got = sources.class_names(spark.createDataFrame([("a, b\nc\n",)], "value string"))
    assert rows(got) == [("a", 0), ("b", 0), ("c", 1)]


def test_stream_equals_batch(spark, tmp_path):
    from patchlake.streaming.voxels import latest, run_available

    src = str(tmp_path / "in")
    data = [(i % 2, (i % 10) / 10, 0.0, 0.0, float(i)) for i in range(100)]
    df = spark.createDataFrame(data, "scene int, x double, y double, z double, f double")
    df.filter("f < 60").coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run_available(read(), str(tmp_path / "t1"), str(tmp_path / "c1"))
    df.filter("f >= 60").coalesce(1).write.mode("append").parquet(src)
    run_available(read(), str(tmp_path / "t2"), str(tmp_path / "c2"))
    batch = voxels.voxelize(df)
    got = {tuple(r)[:4]: (r.cnt, round(r.total / r.cnt, 9)) for r in latest(spark, str(tmp_path / "t2")).collect()}
    assert got == {tuple(r)[:4]: (r.cnt, round(r.f, 9)) for r in batch.collect()}


def test_attention_equals_the_formula(spark):
    rng = np.random.default_rng(7)
    q, k, v = rng.standard_normal((3, 6, 4))
    df = spark.createDataFrame([(1, i // 3, i % 3, q[i].tolist(), k[i].tolist(), v[i].tolist()) for i in range(6)], "image_id long, y int, x int, q array<double>, k array<double>, v array<double>")
    mixed = np.zeros((6, 4))
    for h in (slice(0, 2), slice(2, 4)):
        for i in range(6):
            w = np.exp([q[i, h] @ k[j, h] / 2**0.5 for j in range(6)])
            mixed[i, h] = w @ v[:, h] / w.sum()
    want = []
    for a in mixed:
        cos = np.array([a @ b / np.linalg.norm(a) / np.linalg.norm(b) for b in mixed]) * 10
        w = np.where(cos < 0, 0, np.exp(cos))
        want.append(w @ v / w.sum())
    got = [r.feat for r in similarity.recursive_attention(df, heads=2).orderBy("y", "x").collect()]
    assert np.allclose(got, want)


def test_images_are_clustered_one_by_one(spark):
    rng = np.random.default_rng(8)
    data = {i: rng.standard_normal((n, 3)) for i, n in ((0, 12), (1, 2))}
    df = spark.createDataFrame([(i, 0, x, v.tolist()) for i, m in data.items() for x, v in enumerate(m)], "image_id long, y int, x int, feat array<double>")
    got = similarity.cluster_images(df, k=4, iters=5, tol=0.0).toPandas().sort_values(["image_id", "x"])
    for i, m in data.items():
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        c = u[:4]
        for _ in range(5):
            label = np.array([max(range(len(c)), key=lambda j: (a @ c[j], -j)) for a in u])
            c = np.array([s / max(np.linalg.norm(s), 1e-12) for s in (u[label == j].sum(0) for j in range(len(c)))])
        own = got[got.image_id == i]
        assert own["cluster"].tolist() == label.tolist() and np.allclose(np.stack(own["center"]), c[label])


def test_global_index(spark):
    from patchlake.sources.storage import global_index

    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = global_index(df, ["v"]).orderBy("v").collect()
    assert [r.idx for r in got] == list(range(500))
    assert global_index(df.limit(0), ["v"]).count() == 0


def test_class_probs_equal_cosine_and_softmax_and_leave_zero_vectors_null(spark):
    f = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0])], "id long, feat array<double>")
    c = spark.createDataFrame([(4, [0.0, 1.0]), (2, [2.0, 0.0]), (9, [0.0, 0.0])], "class_id int, embed array<double>")
    got = {r.id: r for r in similarity.class_probs(f, c, ["id"], 2.0).collect()}
    assert got[1].class_ids == [2, 4, 9] and got[1].probs[2] is None and got[1].class_id == 2 and got[2].class_id == 2  # a tie goes to the lowest
    assert got[3].probs == [None] * 3 and (got[3].class_id, got[3].p) == (2, None)
    assert abs(got[1].p - 1 / (1 + np.exp(-2.0))) < 1e-12 and abs(got[2].p - 0.5) < 1e-12
    both = windows.softmax(similarity.cos_sim(f, c, ["id"]), ["id"], temp=2.0)
    assert {(r.id, r.class_id, None if r.p is None else round(r.p, 9)) for r in both.collect()} == {(r.id, r.class_id, None if r.p is None else round(r.p, 9)) for r in similarity.long_probs(similarity.class_probs(f, c, ["id"], 2.0), ["id"]).collect()}
    assert similarity.class_probs(f.limit(0), c, ["id"]).count() == 0 and similarity.class_probs(f, c.limit(0), ["id"]).count() == 0


def test_class_vectors_and_centers_give_the_same_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    f = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate([*rng.standard_normal((40, 4)), np.zeros(4), *np.eye(4)])], "id long, image_id int, feat array<double>")
    vectors = [*rng.standard_normal((9, 4)).tolist(), [0.0] * 4, [1.0, 0.0, 0.0, 0.0], [2.0, 0.0, 0.0, 0.0]]
    c = spark.createDataFrame([(int(i), v) for i, v in zip(rng.permutation(12) * 5, vectors, strict=True)], "class_id int, embed array<double>")
    centers = c.toDF("cluster", "center").filter("cluster % 2 = 0")
    told = lambda p: {r.id: (r.class_ids, [None if v is None else round(v, 9) for v in r.probs], r.class_id, None if r.p is None else round(r.p, 9)) for r in p.collect()}
    clean = f.filter("id <> 40")
    start = similarity.seeded_centers(clean, 5, ["id"], 3)

    def all_of():
        k, labels = similarity.spherical_kmeans(clean, start, ["id"], iters=30, tol=1e-4)
        rounded = {r.cluster: np.round(r.center, 9).tolist() for r in k.collect()}
        return told(similarity.class_probs(f, c, ["id"], 5.0)), rows(similarity.assign_clusters(f, centers, ["id", "image_id"])), rounded, rows(labels.select("id", "cluster"))

    whole = all_of()
    for values in (4, 9, 20):
        monkeypatch.setattr(similarity, "BROADCAST_VALUES", values)
        assert all_of() == whole
    assert similarity.assign_clusters(f, centers.limit(0), ["id"]).count() == 0


def test_seeded_starts_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(6)
    vectors = [rng.standard_normal(3).tolist() for _ in range(30)]
    f = spark.createDataFrame([(i, v) for i, v in enumerate([*vectors, *vectors[:10], None])], "id long, feat array<double>")
    one = rows(similarity.seeded_centers(f, 6, ["id"], 1))
    assert [c for c, _ in one] == list(range(6)) and len({tuple(v) for _, v in one}) == 6
    assert rows(similarity.seeded_centers(f.repartition(7), 6, ["id"], 1)) == one != rows(similarity.seeded_centers(f, 6, ["id"], 2))
    assert similarity.seeded_centers(f, 99, ["id"]).count() == 30


def test_more_templates_than_the_bound_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(prompts, "MOST_TEMPLATES", 1)
    with pytest.raises(ValueError):
        prompts.expand_templates(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([(0, "{c}"), (1, "{c}")], "template_id int, template string"))


def test_resizing_asks_for_full_grids_and_keeps_classes_apart(spark):
    g = spark.createDataFrame([(1, y, x, k, float(10 * k + y + x)) for y in range(2) for x in range(3) for k in range(2)], "image_id long, y int, x int, class_id int, v double")
    got = {(r.class_id, r.y, r.x): r.v for r in grids.bilinear_resize(g, 4, 6, keys=("class_id",)).collect()}
    assert len(got) == 48 and all(abs(got[1, y, x] - got[0, y, x] - 10) < 1e-12 for y in range(4) for x in range(6))
    assert got[0, 0, 0] == 0 and got[0, 3, 5] == 3 and abs(got[0, 1, 1] - 0.5) < 1e-12
    with pytest.raises(Exception, match="not full"):
        grids.bilinear_resize(g.filter("y + x < 3"), 4, 6, keys=("class_id",)).collect()


def test_neighbours_are_found_by_cubes_of_every_size(spark):
    rng = np.random.default_rng(3)
    rows = lambda n: [(int(s), *map(int, v)) for s, v in zip(rng.integers(0, 2, n), rng.integers(0, 60, (n, 3)), strict=True)]
    gt, pred = sorted(set(rows(60))), sorted(set([*rows(80), (1, 900, 900, 900)]))
    names = "scene int, vx long, vy long, vz long"
    want = {(g, k + 1, p[1:]) for g in gt for k, p in enumerate(sorted((p for p in pred if p[0] == g[0]), key=lambda p: (sum((a - b) ** 2 for a, b in zip(g[1:], p[1:], strict=True)), p))[:4])}
    for radius in (None, 1, 8):
        out = voxels.knn_voxels(spark.createDataFrame(gt, names), spark.createDataFrame(pred, names), 4, radius).collect()
        assert {((r.scene, r.vx, r.vy, r.vz), r["rank"], (r.px, r.py, r.pz)) for r in out} == want and len(out) == len(want)


def test_cells_without_any_score_take_class_0(spark):
    masks = spark.createDataFrame([(1, 0, 0, 3, 1, -5.0, 1.0), (1, 0, 1, 3, 1, 5.0, 1.0)], "image_id long, y int, x int, class_id int, mask_id int, logit double, score double")
    probs = spark.createDataFrame([(1, 0, x, 3, 0.5) for x in range(2)], "image_id long, y int, x int, class_id int, p double")
    assert {r.x: r.class_id for r in aggregates.merge_masks(masks, probs)[1].collect()} == {0: 0, 1: 3}


def test_maps_are_written_in_both_layouts(spark, tmp_path):
    cells = spark.createDataFrame([(i, y, x, [float(i), float(y * 10 + x)], 0) for i, h, w in ((1, 2, 3), (2, 1, 1)) for y in range(h) for x in range(w)], "image_id long, y int, x int, feat array<double>, w int")
    want = rows(cells.drop("w"))
    for nested in (True, False):
        sources.write_maps(cells, f"{tmp_path}/{nested}", nested)
        assert rows(sources.read_maps(spark, f"{tmp_path}/{nested}")) == want
        with pytest.raises(Exception, match="missing place"):
            sources.write_maps(cells.filter("NOT (image_id = 1 AND y = 0 AND x = 1)"), f"{tmp_path}/hole-{nested}", nested)


def test_folders_are_listed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/1.jpg", "2.jpg", "1.png"):
        (tmp_path / name).write_bytes(b"x")
    images, maps = (sources.list_files(spark, str(tmp_path), s) for s in ("jpg", "png"))
    assert images.count() == 2 and [r.stem for r in sources.pair_manifest(images, maps).collect()] == ["1"]
