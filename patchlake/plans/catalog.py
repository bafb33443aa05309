"""Registered queries over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchlake.operators import aggregates, attention, grids, prompts, regions, rowmath, similarity, tiled, voxels, windows
from patchlake.plans.views import table, view, with_views
from patchlake.sources import storage
from patchlake.sources import tables as sources
from patchlake.streaming.features import latest_features, run_features
from patchlake.streaming.voxels import latest, run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CELL = ["image_id", "y", "x"]
PATCH = [*CELL, "vec_id"]


def query(views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_views(views, sql)
        return fn

    return add


def r9(c):
    """Nine places, for lattice values that end in a 5 at the seventh."""
    return F.round(c, 9) + F.lit(0.0)


def r6(c):
    """Six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _long(df: DataFrame, keys: list[str], col: str, out: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("dim", "_v")).select(*keys, "dim", r6(F.col("_v").cast("double")).alias(out))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    means = aggregates.mean_vectors(view(spark, d, "patches").withColumnRenamed("label", "class_id"), ["class_id"], "feat")
    return aggregates.gather(means, ["class_id"], "embed")


def _sims(spark: SparkSession, d: str) -> DataFrame:
    return similarity.cos_sim(view(spark, d, "patches"), _classes(spark, d), PATCH)


PV = """pv AS (SELECT image_id, y, x, vec_id, label, unnest(range(len(feat))) AS dim, CAST(unnest(feat) AS DOUBLE) AS v FROM patches),
pn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM pv GROUP BY vec_id), pu AS (SELECT pv.*, v / greatest(n, 1e-12) AS u FROM pv JOIN pn USING (vec_id))"""
CV = PV + ", cv AS (SELECT label AS class_id, dim, avg(u) AS c FROM pu GROUP BY label, dim)"
CS = CV + """, cs AS (SELECT image_id, y, x, vec_id, label, class_id, sum(u * c) / min(cn) AS s FROM pu
JOIN (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY class_id)) AS cn FROM cv) USING (dim) GROUP BY image_id, y, x, vec_id, label, class_id)"""
SM = CS + """, se AS (SELECT *, exp(100 * (s - max(s) OVER (PARTITION BY vec_id))) AS e FROM cs),
sm AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM se)"""
BEST = SM + ", best AS (SELECT image_id, y, x, vec_id, label, arg_max(class_id, (p, -class_id)) AS pred FROM sm GROUP BY image_id, y, x, vec_id, label)"
IOU = """rw AS (SELECT gt AS class_id, sum(n) AS gt_n FROM cm GROUP BY gt), cl AS (SELECT pred AS class_id, sum(n) AS pred_n FROM cm GROUP BY pred),
hit AS (SELECT gt AS class_id, sum(n) AS i FROM cm WHERE gt = pred GROUP BY gt),
iou AS (SELECT class_id, CAST(coalesce(gt_n, 0) AS BIGINT) AS gt_n, CAST(coalesce(pred_n, 0) AS BIGINT) AS pred_n, CAST(coalesce(i, 0) AS BIGINT) AS inter_n
        FROM rw FULL JOIN cl USING (class_id) LEFT JOIN hit USING (class_id))"""
IOU_OUT = """SELECT CAST(class_id AS INT) AS class_id, gt_n, pred_n, inter_n, round(inter_n / CAST(nullif(gt_n + pred_n - inter_n, 0) AS DOUBLE), 6) AS iou,
round(inter_n / CAST(nullif(gt_n, 0) AS DOUBLE), 6) AS acc FROM iou"""


def _iou(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keys, F.col("class_id").cast("int").alias("class_id"), "gt_n", "pred_n", F.col("intersect").alias("inter_n"), r6("iou").alias("iou"), r6("acc").alias("acc"))


# vectors and scores


@query("patches", BEST + f", cm AS (SELECT label AS gt, pred, count(*) AS n FROM best GROUP BY label, pred), {IOU} {IOU_OUT}")
def classify_patches_iou(spark, d):
    pred = similarity.class_probs(view(spark, d, "patches"), _classes(spark, d), PATCH)
    gt = view(spark, d, "patches").select(*CELL, F.col("label").alias("gt"))
    return _iou(aggregates.iou_metrics(aggregates.confusion_matrix(pred, gt)))


@query("patches", PV + " SELECT vec_id, CAST(dim AS INT) AS dim, round(u, 6) + 0.0 AS v FROM pu")
def p1_l2_normalize(spark, d):
    return _long(rowmath.l2_normalize(view(spark, d, "patches")), ["vec_id"], "feat")


@query("patches", CV + " SELECT class_id, CAST(dim AS INT) AS dim, round(c, 6) + 0.0 AS v FROM cv")
def a1_mean_vectors(spark, d):
    means = aggregates.mean_vectors(view(spark, d, "patches").withColumnRenamed("label", "class_id"), ["class_id"])
    return means.select("class_id", "dim", r6("v").alias("v"))


@query("patches", CS + " SELECT vec_id, class_id, round(s, 6) + 0.0 AS sim FROM cs")
def j1_cos_sim(spark, d):
    return _sims(spark, d).select("vec_id", "class_id", r6("sim").alias("sim"))


@query("patches", SM + " SELECT vec_id, class_id, round(p, 6) + 0.0 AS p FROM sm")
def w1_softmax(spark, d):
    probs = similarity.class_probs(view(spark, d, "patches"), _classes(spark, d), PATCH)
    return similarity.long_probs(probs, ["vec_id"]).select("vec_id", "class_id", r6("p").alias("p"))


@query("class_probs", "SELECT image_id, y, x, class_id, round(exp(7 * (p - max(p) OVER w)) / sum(exp(7 * p)) OVER w * exp(7 * max(p) OVER w), 6) + 0.0 AS p FROM class_probs WINDOW w AS (PARTITION BY image_id, y, x)")
def w1_softmax_long(spark, d):
    """The softmax over long rows, for class sets that are too many for arrays."""
    return windows.softmax(view(spark, d, "class_probs"), CELL, "p", 7.0).select(*CELL, "class_id", r6("p").alias("p"))


@query("patches", CS + " SELECT a.vec_id, round(1 / (1 + exp(-50 * (a.s - b.s))), 6) + 0.0 AS p FROM cs a JOIN cs b USING (vec_id) WHERE a.class_id = 0 AND b.class_id = 1")
def w2_contrast_prob(spark, d):
    return _contrast(spark, d).select("vec_id", r6("p").alias("p"))


def _contrast(spark, d) -> DataFrame:
    """p of class 0 against class 1 for each patch."""
    pair = _sims(spark, d).filter("class_id in (0, 1)").groupBy(*PATCH).agg(F.max(F.when(F.col("class_id") == 0, F.col("sim"))).alias("a"), F.max(F.when(F.col("class_id") == 1, F.col("sim"))).alias("b"))
    return windows.contrast_prob(pair, "a", "b")


@query("patches", CS + " SELECT vec_id, class_id, round(s / nullif(max(s) OVER (PARTITION BY image_id), 0), 6) + 0.0 AS scaled FROM cs")
def w3_scale_by_max(spark, d):
    return windows.scale_by_max(_sims(spark, d)).select("vec_id", "class_id", r6("scaled").alias("scaled"))


@query("grid", "SELECT image_id, y, x, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8), 6) + 0.0 AS scaled FROM grid WINDOW w AS (PARTITION BY image_id)")
def w4_minmax_scale(spark, d):
    return windows.minmax_scale(view(spark, d, "grid")).select(*CELL, r6("scaled").alias("scaled"))


@query("class_probs", "SELECT image_id, y, x, class_id, round(CASE WHEN max(p) OVER (PARTITION BY image_id, class_id) < 0.7 THEN 0 ELSE p END, 6) + 0.0 AS p FROM class_probs")
def w5_denoise_prompts(spark, d):
    return windows.denoise_prompts(view(spark, d, "class_probs"), 0.7).select(*CELL, "class_id", r6("p").alias("p"))


@query("class_probs", "SELECT image_id, y, x, arg_max(class_id, (p, -class_id)) AS class_id, round(max(p), 6) AS p FROM class_probs GROUP BY image_id, y, x")
def w6_argmax_class(spark, d):
    return windows.argmax_class(view(spark, d, "class_probs"), CELL).select(*CELL, "class_id", r6("p").alias("p"))


@query("patches", CS + " SELECT vec_id, CAST(arg_max(class_id, (s, -class_id)) AS INT) AS cluster FROM cs GROUP BY vec_id")
def c4_assign_clusters(spark, d):
    centers = _classes(spark, d).select(F.col("class_id").alias("cluster"), F.col("embed").alias("center"))
    return similarity.assign_clusters(view(spark, d, "patches"), centers, ["vec_id"])


@query("patches", PV + " SELECT a.vec_id, CAST(a.dim AS INT) AS dim, round(a.v - coalesce(b.v, 0), 6) + 0.0 AS v FROM pv a LEFT JOIN pv b ON a.vec_id = b.vec_id AND b.dim = a.dim + 1")
def c6_project_features(spark, d):
    import numpy as np

    patches = view(spark, d, "patches")
    return _long(similarity.project_features(patches, np.eye(64) - np.eye(64, k=1), None, ["vec_id"]), ["vec_id"], "feat")


@query("patches", PV + " SELECT vec_id, CAST(dim AS INT) AS dim, round(2 * v + 1, 6) + 0.0 AS v FROM pv")
def x1_map_features(spark, d):
    return _long(similarity.map_features(view(spark, d, "patches"), lambda x: 2 * x + 1, ["vec_id"]), ["vec_id"], "feat")


COV = PV + ", m AS (SELECT dim, avg(v) AS m FROM pv GROUP BY dim), z AS (SELECT vec_id, dim, v - m AS z FROM pv JOIN m USING (dim)) SELECT CAST(a.dim AS INT) AS i, CAST(b.dim AS INT) AS j, round(sum(a.z * b.z) / (count(*) - 1), 6) + 0.0 AS cov FROM z a JOIN z b USING (vec_id) GROUP BY a.dim, b.dim"


@query("patches", COV)
def a10_covariance(spark, d):
    return similarity.covariance(view(spark, d, "patches")).select("i", "j", r6("cov").alias("cov"))


@query("patches", COV)
def a10_covariance_blocks(spark, d):
    """Covariance summed in blocks of 24 dimensions, as for long vectors."""
    return similarity.covariance_blocks(view(spark, d, "patches"), block=24).select("i", "j", r6("cov").alias("cov"))


def _pca_sql() -> str:
    """Leading axes by squaring the covariance until one axis is left, taken off before the next."""
    out = PV + """, dv AS (SELECT image_id, y, x, vec_id, dim, v - avg(v) OVER (PARTITION BY dim) AS z FROM pv), cov AS (SELECT a.dim AS i, b.dim AS j, sum(a.z * b.z) AS v FROM dv a JOIN dv b USING (vec_id) GROUP BY ALL)"""
    for n in (1, 2, 3):
        source = "cov" if n == 1 else f"cov{n}"
        out += f""", sq{n} AS (SELECT 0 AS it, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM {source} UNION ALL
SELECT it, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (SELECT a.it + 1 AS it, a.i, b.j, sum(a.v * b.v) AS v FROM sq{n} a JOIN sq{n} b ON a.j = b.i WHERE a.it < 22 GROUP BY ALL)),
ev{n} AS (SELECT i, v / sqrt(sum(v * v) OVER ()) AS a FROM (SELECT s.i, s.v FROM sq{n} s JOIN (SELECT j FROM sq{n} WHERE it = 22 AND i = j ORDER BY v DESC LIMIT 1) t USING (j) WHERE it = 22)),
ax{n} AS (SELECT i, a * (SELECT sign(a) FROM ev{n} ORDER BY abs(a) DESC LIMIT 1) AS a FROM ev{n}),
cov{n + 1} AS (SELECT i, j, c.v - x.a * y.a * (SELECT sum(p.a * c.v * q.a) FROM {source} c JOIN ax{n} p ON p.i = c.i JOIN ax{n} q ON q.i = c.j) AS v FROM {source} c JOIN ax{n} x USING (i) JOIN ax{n} y ON y.i = c.j)"""
    score = [f"SELECT image_id, y, x, vec_id, {n - 1} AS k, sum(z * a) AS v FROM dv JOIN ax{n} ON ax{n}.i = dv.dim GROUP BY image_id, y, x, vec_id" for n in (1, 2, 3)]
    return out + f""", pr AS ({" UNION ALL ".join(score)})
SELECT image_id, y, x, vec_id, CAST(k AS INT) AS dim, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8), 6) + 0.0 AS v FROM pr WINDOW w AS (PARTITION BY image_id, k)"""


@query("patches", _pca_sql())
def a11_pca_rgb(spark, d):
    return similarity.pca_rgb(view(spark, d, "patches"), PATCH).select(*PATCH, "dim", r6("v").alias("v"))


@query("patches", _pca_sql())
def a11_pca_long(spark, d):
    """The same colours by subspace iteration, without a covariance matrix."""
    return similarity.pca_rgb_long(view(spark, d, "patches"), PATCH).select(*PATCH, "dim", r6("v").alias("v"))


C1 = PV + """, ds AS (SELECT a.image_id, a.vec_id AS a, b.vec_id AS b, sum(a.u * b.u) AS s FROM pu a JOIN pu b USING (image_id, dim) GROUP BY a.image_id, a.vec_id, b.vec_id),
dm AS (SELECT a, b, (s - avg(s) OVER (PARTITION BY image_id)) * 10 AS t FROM ds), dk AS (SELECT a, b, t FROM dm WHERE t >= -1e-12),
de AS (SELECT a, b, exp(t - max(t) OVER (PARTITION BY a)) AS e FROM dk), dw AS (SELECT a, b, e / sum(e) OVER (PARTITION BY a) AS w FROM de)
SELECT dw.a AS vec_id, CAST(pv.dim AS INT) AS dim, round(sum(w * v), 6) + 0.0 AS v FROM dw JOIN pv ON pv.vec_id = dw.b GROUP BY dw.a, pv.dim"""


def _with_ids(out: DataFrame) -> DataFrame:
    return out.withColumn("vec_id", F.col("image_id") * 100 + F.col("y") * 10 + F.col("x"))


@query("patches", C1)
def c1_self_correlate(spark, d):
    return _long(_with_ids(similarity.self_correlate(view(spark, d, "patches"))), ["vec_id"], "feat")


@query("patches", C1)
def c1_self_correlate_blocks(spark, d):
    """Self-similarity over blocks of 30 tokens, as for images that one task should not hold."""
    return _long(_with_ids(attention.self_correlate_blocks(view(spark, d, "patches"), block=30)), ["vec_id"], "feat")


C2 = PV + """, hs AS (SELECT a.image_id, a.vec_id AS a, b.vec_id AS b, a.dim // 16 AS h, sum(a.v * b.v) * 0.25::DOUBLE AS s FROM pv a JOIN pv b USING (image_id, dim) GROUP BY ALL),
he AS (SELECT *, exp(s - max(s) OVER (PARTITION BY a, h)) AS e FROM hs), hw AS (SELECT a, b, h, e / sum(e) OVER (PARTITION BY a, h) AS w FROM he),
mx AS (SELECT hw.a AS vec_id, pv.image_id, pv.dim, sum(w * v) AS v FROM hw JOIN pv ON pv.vec_id = hw.b AND pv.dim // 16 = hw.h GROUP BY ALL), mn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM mx GROUP BY vec_id),
mu AS (SELECT vec_id, image_id, dim, v / greatest(n, 1e-12) AS u FROM mx JOIN mn USING (vec_id)),
mt AS (SELECT a.vec_id AS a, b.vec_id AS b, sum(a.u * b.u) * 10 AS t FROM mu a JOIN mu b USING (image_id, dim) GROUP BY ALL), mk AS (SELECT a, b, greatest(t, 0) AS t FROM mt WHERE t >= -1e-12),
me AS (SELECT a, b, exp(t - max(t) OVER (PARTITION BY a)) AS e FROM mk), mw AS (SELECT a, b, e / sum(e) OVER (PARTITION BY a) AS w FROM me),
mo AS (SELECT mw.a AS vec_id, pv.dim, sum(w * v) AS v FROM mw JOIN pv ON pv.vec_id = mw.b GROUP BY ALL)
SELECT p.image_id, p.y, p.x, CAST(dim AS INT) AS dim, round(v, 6) + 0.0 AS v FROM mo JOIN patches p USING (vec_id)"""


def _qkv(spark, d) -> DataFrame:
    return view(spark, d, "patches").select(*CELL, *[F.col("feat").alias(c) for c in "qkv"])


@query("patches", C2)
def c2_recursive_attention(spark, d):
    return _long(similarity.recursive_attention(_qkv(spark, d), heads=4), CELL, "feat")


@query("patches", C2)
def c2_recursive_attention_blocks(spark, d):
    return _long(attention.recursive_attention_blocks(_qkv(spark, d), heads=4, block=30), CELL, "feat")


def _kmeans_sql(k: int, rounds: int) -> str:
    out = PV + f", c0 AS (SELECT vec_id AS cluster, dim, u AS c FROM pu WHERE vec_id < {k})"
    for r in range(1, rounds + 1):
        out += f""", d{r} AS (SELECT vec_id, cluster, sum(u * c) AS s FROM pu JOIN c{r - 1} USING (dim) GROUP BY vec_id, cluster),
a{r} AS (SELECT vec_id, arg_max(cluster, (s, -cluster)) AS cluster FROM d{r} GROUP BY vec_id), t{r} AS (SELECT cluster, dim, sum(u) AS s FROM a{r} JOIN pu USING (vec_id) GROUP BY cluster, dim),
c{r} AS (SELECT cluster, dim, s / greatest(sqrt(sum(s * s) OVER (PARTITION BY cluster)), 1e-12) AS c FROM t{r})"""
    return out


def _kmeans(spark, d):
    patches = view(spark, d, "patches")
    init = patches.filter("vec_id < 8").select(F.col("vec_id").alias("cluster"), F.col("feat").alias("center"))
    return similarity.spherical_kmeans(patches, init, ["vec_id"], iters=3, tol=0.0)


@query("patches", _kmeans_sql(8, 3) + " SELECT vec_id, CAST(cluster AS INT) AS cluster FROM a3")
def c3_kmeans_labels(spark, d):
    return _kmeans(spark, d)[1]


@query("patches", _kmeans_sql(8, 3) + " SELECT CAST(cluster AS INT) AS cluster, CAST(dim AS INT) AS dim, round(c, 6) + 0.0 AS v FROM c3")
def c3_kmeans_centers(spark, d):
    return _long(_kmeans(spark, d)[0], ["cluster"], "center")


#: k-means of all patches from the eight whose numbers have the smallest hashes, until the mean shift is under the tolerance
C3 = PV + """, ul AS (SELECT vec_id, md5('0,' || vec_id) AS h, list(u ORDER BY dim) AS u FROM pu GROUP BY vec_id),
ks(it, old, new) AS (SELECT 0, CAST([] AS DOUBLE[][]), (SELECT list(u ORDER BY h) FROM (SELECT u, h FROM ul ORDER BY h LIMIT 8))
UNION ALL SELECT c.it, c.cur, list(list_transform(range(1, 65), lambda d: coalesce(m.s[d], 0) / greatest(sqrt(coalesce(m.q, 0)), 1e-12)) ORDER BY c.i)
FROM (SELECT it + 1 AS it, new AS cur, unnest(range(1, len(new) + 1)) AS i FROM ks WHERE it = 0 OR (it < 100 AND 1 - list_avg(list_transform(range(1, len(new) + 1), lambda i: list_dot_product(old[i], new[i]))) >= 1e-4)) c
LEFT JOIN (SELECT i, list(s ORDER BY d) AS s, sum(s * s) AS q FROM (SELECT i, d, sum(u[d]) AS s FROM (SELECT p.u, list_position(ds, list_max(ds)) AS i, unnest(range(1, 65)) AS d
FROM (SELECT ul.u, list_transform(ks.new, lambda z: list_dot_product(ul.u, z)) AS ds FROM ul, ks) p) GROUP BY i, d) GROUP BY i) m ON m.i = c.i GROUP BY c.it, c.cur),
kf AS (SELECT * FROM ks ORDER BY it DESC LIMIT 1)"""


def _kmeans_to_the_end(spark, d):
    patches = view(spark, d, "patches")
    return similarity.spherical_kmeans(patches, similarity.seeded_centers(patches, 8, ["vec_id"]), ["vec_id"])


@query("patches", C3 + " SELECT vec_id, CAST(list_position(ds, list_max(ds)) - 1 AS INT) AS cluster FROM (SELECT ul.vec_id, list_transform(kf.old, lambda z: list_dot_product(ul.u, z)) AS ds FROM ul, kf)")
def c3_seeded_labels(spark, d):
    """k-means from a seeded start until its tolerance ends it."""
    return _kmeans_to_the_end(spark, d)[1]


@query("patches", C3 + " SELECT CAST(i - 1 AS INT) AS cluster, CAST(d - 1 AS INT) AS dim, round(new[i][d], 6) + 0.0 AS v FROM (SELECT new, i, unnest(range(1, 65)) AS d FROM (SELECT new, unnest(range(1, len(new) + 1)) AS i FROM kf))")
def c3_seeded_centers(spark, d):
    return _long(_kmeans_to_the_end(spark, d)[0], ["cluster"], "center")


#: k-means within each image, round by round, until the mean shift is under the tolerance
C5 = PV + """, ul AS (SELECT image_id, y, x, vec_id, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS r, list(u ORDER BY dim) AS u FROM pu GROUP BY image_id, y, x, vec_id),
ks(image_id, it, old, new) AS (SELECT image_id, 0, CAST([] AS DOUBLE[][]), list(u ORDER BY r) FROM ul WHERE r <= 8 GROUP BY image_id
UNION ALL SELECT c.image_id, c.it, c.cur, list(list_transform(range(1, 65), lambda d: coalesce(m.s[d], 0) / greatest(sqrt(coalesce(m.q, 0)), 1e-12)) ORDER BY c.i)
FROM (SELECT image_id, it + 1 AS it, new AS cur, unnest(range(1, len(new) + 1)) AS i FROM ks WHERE it = 0 OR (it < 100 AND 1 - list_avg(list_transform(range(1, len(new) + 1), lambda i: list_dot_product(old[i], new[i]))) >= 1e-4)) c
LEFT JOIN (SELECT image_id, i, list(s ORDER BY d) AS s, sum(s * s) AS q FROM (SELECT image_id, i, d, sum(u[d]) AS s FROM (SELECT p.image_id, p.u, list_position(ds, list_max(ds)) AS i, unnest(range(1, 65)) AS d
FROM (SELECT ul.image_id, ul.u, list_transform(ks.new, lambda z: list_dot_product(ul.u, z)) AS ds FROM ul JOIN ks USING (image_id)) p) GROUP BY image_id, i, d) GROUP BY image_id, i) m ON m.image_id = c.image_id AND m.i = c.i
GROUP BY c.image_id, c.it, c.cur),
kf AS (SELECT * FROM ks QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY it DESC) = 1),
kl AS (SELECT image_id, y, x, list_position(ds, list_max(ds)) AS i, new FROM (SELECT ul.image_id, ul.y, ul.x, kf.new, list_transform(kf.old, lambda z: list_dot_product(ul.u, z)) AS ds FROM ul JOIN kf USING (image_id)))
SELECT image_id, y, x, CAST(i - 1 AS INT) AS cluster, CAST(unnest(range(0, 64)) AS INT) AS dim, round(unnest(new[i]), 6) + 0.0 AS v FROM kl"""


@query("patches", C5)
def c5_cluster_images(spark, d):
    return _long(similarity.cluster_images(view(spark, d, "patches")), [*CELL, "cluster"], "center")


# plans and grids


@query("images", """SELECT image_id, h, w, CAST(CASE WHEN h % 224 = 0 AND w % 224 = 0 THEN h ELSE greatest(CAST(ceil(floor(h * t / CAST(m AS DOUBLE)) / 224) AS INT) * 224, 336) END AS INT) AS new_h,
CAST(CASE WHEN h % 224 = 0 AND w % 224 = 0 THEN w ELSE greatest(CAST(ceil(floor(w * t / CAST(m AS DOUBLE)) / 224) AS INT) * 224, 336) END AS INT) AS new_w
FROM (SELECT *, greatest(h, w) AS m, CAST(ceil(greatest(h, w) / 224.0) AS INT) * 224 AS t FROM images)""")
def p3_resize_plan(spark, d):
    return rowmath.resize_plan(view(spark, d, "images"))


@query("images", """SELECT image_id, h, w, CAST(CASE WHEN greatest(h, w) > 640 THEN floor(floor(h * (CAST(640 AS DOUBLE) / greatest(h, w))) / 16) * 16 ELSE h END AS INT) AS new_h,
CAST(CASE WHEN greatest(h, w) > 640 THEN floor(floor(w * (CAST(640 AS DOUBLE) / greatest(h, w))) / 16) * 16 ELSE w END AS INT) AS new_w FROM images""")
def p4_cap_resolution(spark, d):
    return rowmath.cap_resolution(view(spark, d, "images"), 640)


@query("images", """SELECT image_id, h, w, CAST(CASE WHEN h >= w THEN 1024 ELSE floor(h * 64 / CAST(w AS DOUBLE)) * 16 END AS INT) AS new_h,
CAST(CASE WHEN h >= w THEN floor(w * 64 / CAST(h AS DOUBLE)) * 16 ELSE 1024 END AS INT) AS new_w FROM images""")
def p5_square_fit_plan(spark, d):
    return rowmath.square_fit_plan(view(spark, d, "images"))


@query("patches", PV + " SELECT vec_id, CAST(2 - dim AS INT) AS dim, round((v / 255 - CASE dim WHEN 2 THEN 0.5 WHEN 1 THEN 0.4 ELSE 0.3 END) / CASE dim WHEN 2 THEN 0.25 WHEN 1 THEN 0.2 ELSE 0.5 END, 6) + 0.0 AS v FROM pv WHERE dim < 3")
def p2_normalize_pixels(spark, d):
    rgb = view(spark, d, "patches").select("vec_id", F.slice("feat", 1, 3).alias("rgb"))
    return _long(rowmath.normalize_pixels(rgb, [0.5, 0.4, 0.3], [0.25, 0.2, 0.5], swap_rb=True, scale=1 / 255), ["vec_id"], "rgb")


TILES = """tl AS (SELECT image_id, CAST(hi AS INT) AS h_idx, CAST(wi AS INT) AS w_idx, greatest(least(hi * {s} + {c}, h) - {c}, 0) AS y1, greatest(least(wi * {s} + {c}, w) - {c}, 0) AS x1, least(hi * {s} + {c}, h) AS y2, least(wi * {s} + {c}, w) AS x2
FROM (SELECT image_id, h, w, hi, unnest(range(CAST(greatest(w - {c} + {s} - 1, 0) // {s} + 1 AS BIGINT))) AS wi
FROM (SELECT image_id, h, w, unnest(range(CAST(greatest(h - {c} + {s} - 1, 0) // {s} + 1 AS BIGINT))) AS hi FROM {t})))"""


@query("images", TILES.format(s=224, c=336, t="(SELECT image_id, h // 16 * 16 AS h, w // 16 * 16 AS w FROM images)") + " SELECT image_id, h_idx, w_idx, CAST(y1 // 16 AS INT) AS y1, CAST(x1 // 16 AS INT) AS x1, CAST(y2 // 16 AS INT) AS y2, CAST(x2 // 16 AS INT) AS x2 FROM tl")
def g1_make_tiles(spark, d):
    whole = lambda c: (F.floor(F.col(c) / 16) * 16).cast("int").alias(c)
    return grids.make_tiles(view(spark, d, "images").select("image_id", whole("h"), whole("w")))


def _tiled(spark, d) -> DataFrame:
    patches = view(spark, d, "patches")
    sizes = patches.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return grids.assign_tiles(patches, grids.make_tiles(sizes, stride=3, crop=5, patch=1))


TILED = TILES.format(s=3, c=5, t="(SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM patches GROUP BY image_id)")
INSIDE = "tl JOIN {p} p ON p.image_id = tl.image_id AND p.y >= tl.y1 AND p.y < tl.y2 AND p.x >= tl.x1 AND p.x < tl.x2"


@query("patches", TILED + f" SELECT p.vec_id, tl.h_idx, tl.w_idx FROM {INSIDE.format(p='patches')}")
def j2_assign_tiles(spark, d):
    return _tiled(spark, d).select("vec_id", "h_idx", "w_idx")


@query("patches", TILED + f" SELECT p.vec_id, tl.h_idx, tl.w_idx FROM {INSIDE.format(p='patches')}")
def j2_tile_patches(spark, d):
    """Tile numbers by inverse stride arithmetic instead of a range join."""
    patches = view(spark, d, "patches")
    sizes = patches.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return grids.tile_patches(patches, sizes, stride=3, crop=5, patch=1).select("vec_id", "h_idx", "w_idx")


@query("patches", PV + f", {TILED} SELECT p.image_id, p.y, p.x, CAST(p.dim AS INT) AS dim, round(avg(p.v * (1 + tl.h_idx + tl.w_idx)), 6) + 0.0 AS v FROM {INSIDE.format(p='pv')} GROUP BY p.image_id, p.y, p.x, p.dim")
def a2_stitch_tiles(spark, d):
    told = _tiled(spark, d).withColumn("feat", F.transform("feat", lambda v: v.cast("double") * (1 + F.col("h_idx") + F.col("w_idx"))))
    return aggregates.stitch_tiles(told).select(*CELL, "dim", r6("v").alias("v"))


SIZES = "sz AS (SELECT image_id, max(y) + 1 AS ih, max(x) + 1 AS iw FROM grid GROUP BY image_id), tg AS (SELECT image_id, ih, iw, ty, unnest(range({n})) AS tx FROM (SELECT *, unnest(range({n})) AS ty FROM sz))"


@query("grid", SIZES.format(n=30) + " SELECT tg.image_id, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, g.class_id FROM tg JOIN grid g ON g.image_id = tg.image_id AND g.y = floor(ty * ih / 30.0) AND g.x = floor(tx * iw / 30.0)")
def j3_nearest_resize(spark, d):
    return grids.nearest_resize(view(spark, d, "grid").select(*CELL, "class_id"), 30, 30)


J4 = SIZES.format(n=30) + """, sp AS (SELECT *, greatest((ty + 0.5) * ih / CAST(30 AS DOUBLE) - 0.5, 0) AS sy, greatest((tx + 0.5) * iw / CAST(30 AS DOUBLE) - 0.5, 0) AS sx FROM tg),
co AS (SELECT image_id, ty, tx, ih, iw, least(floor(sy), ih - 1) AS y0, least(floor(sx), iw - 1) AS x0, sy - least(floor(sy), ih - 1) AS fy, sx - least(floor(sx), iw - 1) AS fx FROM sp)"""
J4_OUT = """SELECT c.image_id, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, round(a.v * (1 - fy) * (1 - fx) + b.v * (1 - fy) * fx + e.v * fy * (1 - fx) + f.v * fy * fx, 9) + 0.0 AS v FROM co c
JOIN grid a ON a.image_id = c.image_id AND a.y = y0 AND a.x = x0 JOIN grid b ON b.image_id = c.image_id AND b.y = y0 AND b.x = least(x0 + 1, iw - 1)
JOIN grid e ON e.image_id = c.image_id AND e.y = least(y0 + 1, ih - 1) AND e.x = x0 JOIN grid f ON f.image_id = c.image_id AND f.y = least(y0 + 1, ih - 1) AND f.x = least(x0 + 1, iw - 1)"""


@query("grid", f"{J4} {J4_OUT}")
def j4_bilinear_resize(spark, d):
    return grids.bilinear_resize(view(spark, d, "grid"), 30, 30).select(*CELL, r9("v").alias("v"))


LABELS = J4.replace("grid", "class_probs") + """, up AS (SELECT c.image_id, ty, tx, a.class_id, a.p * (1 - fy) * (1 - fx) + b.p * (1 - fy) * fx + e.p * fy * (1 - fx) + f.p * fy * fx AS p FROM co c
JOIN class_probs a ON a.image_id = c.image_id AND a.y = y0 AND a.x = x0 JOIN class_probs b ON b.image_id = c.image_id AND b.y = y0 AND b.x = least(x0 + 1, iw - 1) AND b.class_id = a.class_id
JOIN class_probs e ON e.image_id = c.image_id AND e.y = least(y0 + 1, ih - 1) AND e.x = x0 AND e.class_id = a.class_id JOIN class_probs f ON f.image_id = c.image_id AND f.y = least(y0 + 1, ih - 1) AND f.x = least(x0 + 1, iw - 1) AND f.class_id = a.class_id),
dn AS (SELECT image_id, ty, tx, class_id, CASE WHEN max(p) OVER (PARTITION BY image_id, class_id) < 0.62::DOUBLE THEN 0 ELSE p END AS p FROM up),
bs AS (SELECT image_id, ty, tx, arg_max(class_id, (p, -class_id)) AS class_id, max(p) AS p FROM dn GROUP BY image_id, ty, tx)
SELECT image_id, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, CASE WHEN p < 0.3::DOUBLE THEN 0 ELSE class_id + 1 END AS class_id, round(p, 6) + 0.0 AS p FROM bs"""


@query("class_probs", LABELS)
def j4_upsampled_labels(spark, d):
    """Resizing, denoising, best class and ignore label in one pass over strips of rows, with probabilities as arrays."""
    cells = view(spark, d, "class_probs").groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("class_id", "p"))).alias("_z"))
    arrays = cells.select(*CELL, F.col("_z.class_id").alias("class_ids"), F.col("_z.p").alias("probs"))
    return grids.upsample_labels(arrays, 30, 30, denoise=0.62, ignore=0.3, rows=8).withColumn("p", r6("p"))


@query("grid", SIZES.format(n=32) + " SELECT tg.image_id, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, round(coalesce(g.v, 0), 9) + 0.0 AS v FROM tg LEFT JOIN grid g ON g.image_id = tg.image_id AND g.y = ty AND g.x = tx")
def j5_pad_grid(spark, d):
    return grids.pad_grid(view(spark, d, "grid"), 32, 32).select(*CELL, r9("v").alias("v"))


@query("patches", PV + " SELECT p.image_id, CAST(p.y * (1 + max(p.x) OVER (PARTITION BY p.image_id, p.y)) + p.x AS INT) AS pos, p.y, p.x, CAST(dim AS INT) AS dim, round(v, 6) + 0.0 AS v FROM patches p JOIN pv USING (vec_id)")
def g2_flatten_map(spark, d):
    flat = grids.flatten_map(grids.unflatten_map(view(spark, d, "patches")))
    return _long(flat.withColumn("feat", F.col("feat").cast("array<double>")), ["image_id", "pos", "y", "x"], "feat")


SWEEP = "sw AS (SELECT image_id, y, x, k, v > a + k * 0.1::DOUBLE * (b - a) AS \"on\" FROM (SELECT *, min(v) OVER (PARTITION BY image_id) AS a, max(v) OVER (PARTITION BY image_id) AS b, unnest(range(2, 10)) AS k FROM grid))"


@query("grid", SWEEP + ' SELECT image_id, y, x, CAST(k AS INT) AS k, "on" FROM sw')
def g3_threshold_sweep(spark, d):
    return grids.threshold_sweep(view(spark, d, "grid")).select(*CELL, "k", "on")


REGIONS = """cells AS (SELECT image_id, class_id, y, x, y * 20 + x AS pos, v FROM grid),
near AS (SELECT DISTINCT a.image_id, a.class_id, a.pos AS a, b.pos AS b FROM cells a JOIN cells b ON a.image_id = b.image_id AND a.class_id = b.class_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT image_id, class_id, a, b FROM near UNION SELECT r.image_id, r.class_id, r.a, n.b FROM reach r JOIN near n ON n.image_id = r.image_id AND n.class_id = r.class_id AND n.a = r.b),
roots AS (SELECT image_id, class_id, a AS pos, min(b) AS root FROM reach GROUP BY image_id, class_id, a),
rg AS (SELECT image_id, class_id, pos // 20 AS y, pos % 20 AS x, dense_rank() OVER (PARTITION BY image_id, class_id ORDER BY root) AS region_id FROM roots)"""


G4 = REGIONS + " SELECT image_id, CAST(class_id AS BIGINT) AS class_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(region_id AS INT) AS region_id FROM rg"


@query("grid", G4)
def g4_connected_regions(spark, d):
    return regions.connected_regions(view(spark, d, "grid"))


@query("grid", G4)
def g4_tiled_regions(spark, d):
    """The same regions from tiles of 8 x 8 cells whose border labels are contracted."""
    return tiled.connected_regions_tiled(view(spark, d, "grid"), tile=8)


STATS = REGIONS + """, st AS (SELECT rg.image_id, rg.class_id, rg.region_id, count(*) AS area, avg(g.v) AS score, min(g.x) AS x1, min(g.y) AS y1, max(g.x) AS x2, max(g.y) AS y2,
arg_max(g.x, (g.v, -g.y, -g.x)) AS px, arg_max(g.y, (g.v, -g.y, -g.x)) AS py FROM rg JOIN grid g USING (image_id, y, x) GROUP BY rg.image_id, rg.class_id, rg.region_id)"""


def _stats(spark, d) -> DataFrame:
    grid = view(spark, d, "grid")
    cells = regions.connected_regions(grid).join(grid.select(*CELL, F.col("v").alias("p")), CELL)
    return aggregates.region_stats(cells)


@query("grid", STATS + " SELECT image_id, CAST(class_id AS BIGINT) AS class_id, CAST(region_id AS INT) AS region_id, area, round(score, 9) AS score, x1, y1, x2, y2, px, py FROM st")
def a4_region_stats(spark, d):
    return _stats(spark, d).withColumn("score", r9("score"))


@query("grid", STATS + ", mx AS (SELECT image_id, class_id, max(v) AS m FROM grid GROUP BY image_id, class_id) SELECT image_id, CAST(class_id AS BIGINT) AS class_id, CAST(region_id AS INT) AS region_id, area FROM st JOIN mx USING (image_id, class_id) WHERE area >= 4 AND NOT m < 0.9")
def a5_filter_regions(spark, d):
    top = aggregates.max_per_class(view(spark, d, "grid").withColumnRenamed("v", "p"))
    return aggregates.filter_regions(_stats(spark, d), top, 0.9, 4).select("image_id", "class_id", "region_id", "area")


@query("class_probs", "SELECT image_id, class_id, round(max(p), 6) AS max_p FROM class_probs GROUP BY image_id, class_id")
def a3_max_per_class(spark, d):
    return aggregates.max_per_class(view(spark, d, "class_probs")).select("image_id", "class_id", r6("max_p").alias("max_p"))


# thresholds, labels and evaluation

TOP = "tp AS (SELECT image_id, y, x, arg_max(class_id, (p, -class_id)) AS class_id, max(p) AS p FROM class_probs GROUP BY image_id, y, x)"


@query("class_probs", TOP + " SELECT image_id, y, x, CASE WHEN p < 0.4 THEN 5 ELSE class_id END AS class_id FROM tp")
def p6_coarse_background(spark, d):
    return rowmath.coarse_background(windows.argmax_class(view(spark, d, "class_probs"), CELL), 0.4, 5).drop("p")


@query("class_probs", TOP + " SELECT image_id, y, x, CASE WHEN p < 0.4 THEN 0 ELSE class_id + 1 END AS class_id FROM tp")
def p7_apply_ignore(spark, d):
    return rowmath.apply_ignore(windows.argmax_class(view(spark, d, "class_probs"), CELL), 0.4).drop("p")


@query("class_probs", "SELECT image_id, y, x, class_id + 1 AS class_id, round(p, 6) AS p FROM class_probs UNION ALL SELECT DISTINCT image_id, y, x, 0, CAST(0 AS DOUBLE) FROM class_probs")
def p7_ignore_plane(spark, d):
    return rowmath.prepend_ignore_plane(view(spark, d, "class_probs")).withColumn("p", r6("p"))


@query("gt", "SELECT image_id, y, x, CASE WHEN gt IN (0, 255) THEN 255 ELSE gt - 1 END AS gt FROM gt")
def p8_reduce_zero_label(spark, d):
    return rowmath.reduce_zero_label(view(spark, d, "gt"))


@query("class_probs", "SELECT image_id, y, x, class_id, round(CASE WHEN p > 0.3 THEN p * 0.005 ELSE 0 END, 6) + 0.0 AS p FROM class_probs")
def p9_mask_prompt(spark, d):
    return rowmath.mask_prompt(view(spark, d, "class_probs"), 0.3).withColumn("p", r6("p"))


@query("boxes", "SELECT image_id, box_id, x1 * 2 AS x1, y1 * 0.5::DOUBLE AS y1, x2 * 2 AS x2, y2 * 0.5::DOUBLE AS y2 FROM boxes")
def p10_rescale_boxes(spark, d):
    return rowmath.rescale_boxes(view(spark, d, "boxes"), 2.0, 0.5).drop("score")


@query("masks", "SELECT image_id, y, x, class_id, mask_id, round(1 / (1 + exp(-logit)), 6) AS p, logit > 0 AS \"on\" FROM masks")
def p11_sigmoid(spark, d):
    return rowmath.sigmoid_scores(view(spark, d, "masks")).select(*CELL, "class_id", "mask_id", r6("p").alias("p"), "on")


NAMES = "nm AS (SELECT row_number() OVER (ORDER BY p_type) AS class_id, p_type AS name FROM (SELECT DISTINCT p_type FROM part))"


def _types(spark, d) -> DataFrame:
    names = table(spark, d, "part").select("p_type").distinct().select(F.col("p_type").alias("name"))
    return storage.global_index(names, ["name"], "_rank").select("name", (F.col("_rank") + 1).alias("idx"))


@query("", NAMES + ", e AS (SELECT p_partkey, nm.class_id, unnest(range(0, (SELECT max(class_id) + 1 FROM nm))) AS dim FROM part JOIN nm ON nm.name = part.p_type) SELECT p_partkey, CAST(dim AS INT) AS dim, CASE WHEN dim = class_id THEN CAST(1 AS DOUBLE) ELSE 1e-10 END AS v FROM e")
def p12_onehot_encode(spark, d):
    classes = prompts.build_class_map(_types(spark, d))
    out = rowmath.onehot_encode(table(spark, d, "part").select("p_partkey", "p_type"), classes, "p_type")
    return out.select("p_partkey", F.posexplode("onehot").alias("dim", "v"))


CM = "g8 AS (SELECT image_id, y, x, CASE WHEN gt IN (0, 255) THEN 255 ELSE gt - 1 END AS gt FROM gt), cm AS (SELECT g8.gt, grid.class_id AS pred, count(*) AS n FROM g8 JOIN grid USING (image_id, y, x) WHERE g8.gt <> 255 GROUP BY g8.gt, grid.class_id)"


def _confusion(spark, d) -> DataFrame:
    return aggregates.confusion_matrix(view(spark, d, "grid"), rowmath.reduce_zero_label(view(spark, d, "gt")))


@query("grid gt", CM + " SELECT gt, pred, n FROM cm")
def a6_confusion_matrix(spark, d):
    return _confusion(spark, d)


@query("grid gt", f"{CM}, {IOU} {IOU_OUT}")
def a7_iou_metrics(spark, d):
    return _iou(aggregates.iou_metrics(_confusion(spark, d)))


SUMMARY = """mt AS (SELECT avg(inter_n / CAST(nullif(gt_n + pred_n - inter_n, 0) AS DOUBLE)) AS miou, avg(inter_n / CAST(gt_n AS DOUBLE)) AS macc, sum(inter_n) / CAST(sum(gt_n) AS DOUBLE) AS aacc FROM iou WHERE gt_n > 0),
ms AS (SELECT 'mIoU' AS metric, miou AS value FROM mt UNION ALL SELECT 'mAcc', macc FROM mt UNION ALL SELECT 'aAcc', aacc FROM mt)"""


@query("grid gt", f"{CM}, {IOU}, {SUMMARY} SELECT metric, round(value, 6) AS value FROM ms")
def a7_summary_metrics(spark, d):
    return aggregates.summary_metrics(aggregates.iou_metrics(_confusion(spark, d))).select("metric", r6("value").alias("value"))


@query("grid gt", f"""{CM}, {IOU}, {SUMMARY}, rn AS (SELECT 'a' AS dataset, 'low' AS resolution, metric, value FROM ms UNION ALL SELECT 'a', 'low', metric, value / 2 FROM ms UNION ALL SELECT 'b', 'high', metric, value FROM ms)
SELECT dataset, resolution, metric, round(avg(value), 6) AS value, count(*) AS runs FROM rn GROUP BY dataset, resolution, metric""")
def a8_metric_report(spark, d):
    m = aggregates.summary_metrics(aggregates.iou_metrics(_confusion(spark, d)))
    run = lambda a, b, f: m.select(F.lit(a).alias("dataset"), F.lit(b).alias("resolution"), "metric", (F.col("value") * f).alias("value"))
    return aggregates.metric_report(run("a", "low", 1.0), run("a", "low", 0.5), run("b", "high", 1.0)).withColumn("value", r6("value"))


@query("grid gt", f"{CM} SELECT pred AS class_id, gt, n FROM cm WHERE pred NOT IN (1, 3)")
def j8_exclude_classes(spark, d):
    ignored = spark.createDataFrame([(1,), (3,)], "class_id int")
    return voxels.exclude_classes(_confusion(spark, d).withColumnRenamed("pred", "class_id"), ignored)


# boxes and refinement


@query("boxes", """SELECT image_id, a, b, round(i / (sa + sb - i), 6) AS iou FROM (SELECT a.image_id, a.box_id AS a, b.box_id AS b, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
(a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)""")
def j6_box_iou_pairs(spark, d):
    return regions.box_iou_pairs(view(spark, d, "boxes")).withColumn("iou", r6("iou"))


def _small_boxes(spark, d) -> DataFrame:
    boxes = view(spark, d, "boxes").withColumn("image_id", F.floor(F.col("image_id") / 8))
    return rowmath.rescale_boxes(boxes, 0.16, 0.16)


@query("boxes grid", "SELECT b.image_id, b.box_id, round(max(g.v), 9) AS score FROM (SELECT image_id // 8 AS image_id, box_id, x1 * 0.16::DOUBLE AS x1, y1 * 0.16::DOUBLE AS y1, x2 * 0.16::DOUBLE AS x2, y2 * 0.16::DOUBLE AS y2 FROM boxes) b JOIN grid g ON g.image_id = b.image_id AND g.x >= b.x1 AND g.x < b.x2 AND g.y >= b.y1 AND g.y < b.y2 GROUP BY b.image_id, b.box_id")
def j7_box_max_score(spark, d):
    return regions.box_max_score(_small_boxes(spark, d), view(spark, d, "grid")).withColumn("score", r9("score"))


#: boxes in order of score; one stays unless a kept one above it overlaps too much
K1 = """bx AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS r, (x2 - x1) * (y2 - y1) AS area FROM boxes),
hit AS (SELECT a.image_id, b.r, list(a.r) AS above FROM bx a JOIN bx b ON a.image_id = b.image_id AND a.r < b.r AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2
WHERE (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / (a.area + b.area - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) > 0.2::DOUBLE GROUP BY a.image_id, b.r),
ln AS (SELECT bx.*, coalesce(above, []) AS above FROM bx LEFT JOIN hit USING (image_id, r)),
kp AS (SELECT image_id, r, [r] AS kept FROM ln WHERE r = 1 UNION ALL SELECT ln.image_id, ln.r, CASE WHEN list_has_any(kept, ln.above) THEN kept ELSE list_append(kept, ln.r) END FROM kp JOIN ln ON ln.image_id = kp.image_id AND ln.r = kp.r + 1),
ke AS (SELECT ln.* FROM ln JOIN kp USING (image_id, r) WHERE list_contains(kept, r))"""


@query("boxes", K1 + " SELECT image_id, box_id, round(score, 9) AS score FROM ke")
def k1_nms(spark, d):
    return regions.nms(view(spark, d, "boxes")).select("image_id", "box_id", r9("score").alias("score"))


@query("boxes", K1 + " SELECT image_id, box_id, round(score, 9) AS score FROM ke")
def k1_nms_rounds(spark, d):
    """Suppression in rounds over cells, as for images of very many boxes."""
    return regions.nms_rounds(view(spark, d, "boxes")).select("image_id", "box_id", r9("score").alias("score"))


@query("boxes", "SELECT image_id, box_id, CAST(rank AS INT) AS rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rank FROM boxes) WHERE rank <= 10")
def k2_top_k(spark, d):
    return regions.top_k(view(spark, d, "boxes")).select("image_id", "box_id", "rank", r9("score").alias("score"))


#: runs of cells along a row, in and out of each threshold's mask; regions and the outside by contact of runs
G5 = """gz AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w, min(v) AS a, max(v) AS b FROM grid GROUP BY image_id), lv AS (SELECT *, unnest(range(2, 10)) AS k FROM gz),
mk AS (SELECT image_id, k, y, x FROM lv JOIN grid USING (image_id) WHERE v > a + k * 0.1::DOUBLE * (b - a)),
pd AS (SELECT image_id, k, y, unnest(range(-1, w + 1)) AS x FROM (SELECT *, unnest(range(-1, h + 1)) AS y FROM lv)),
al AS (SELECT image_id, k, y, x, true AS m FROM mk UNION ALL SELECT image_id, k, y, x, false FROM pd ANTI JOIN mk USING (image_id, k, y, x)),
rn AS (SELECT image_id, k, y, m, min(x) AS a, max(x) AS b, y * 100000 + min(x) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, k, y, m ORDER BY x) AS g FROM al) GROUP BY image_id, k, y, m, g),
nx AS (SELECT p.image_id, p.k, p.m, p.id AS p, q.id AS q FROM (SELECT *, unnest([-1, 1]) AS dy FROM rn) p JOIN rn q ON q.image_id = p.image_id AND q.k = p.k AND q.m = p.m AND q.y = p.y + dy AND q.a <= p.b + CAST(p.m AS INT) AND q.b >= p.a - CAST(p.m AS INT)),
ot AS (SELECT image_id, k, id FROM rn WHERE y = -1 AND a = -1 UNION SELECT nx.image_id, nx.k, nx.q FROM ot JOIN nx ON nx.image_id = ot.image_id AND nx.k = ot.k AND nx.p = ot.id AND NOT nx.m),
orn AS (SELECT rn.* FROM rn JOIN ot USING (image_id, k, id)),
cp(image_id, k, id, root) USING KEY (image_id, k, id) AS (SELECT image_id, k, id, id FROM rn WHERE m
UNION SELECT u.image_id, u.k, u.id, min(c.root) FROM cp c JOIN nx ON nx.image_id = c.image_id AND nx.k = c.k AND nx.p = c.id JOIN recurring.cp u ON u.image_id = nx.image_id AND u.k = nx.k AND u.id = nx.q WHERE c.root < u.root GROUP BY u.image_id, u.k, u.id),
fr AS (SELECT DISTINCT r.image_id, r.k, r.id FROM (SELECT *, unnest([-1, 0, 1]) AS dy FROM rn WHERE m) r JOIN orn o ON o.image_id = r.image_id AND o.k = r.k AND o.y = r.y + dy AND (dy = 0 AND (o.b = r.a - 1 OR o.a = r.b + 1) OR dy <> 0 AND o.a <= r.b AND o.b >= r.a)),
rc AS (SELECT cp.image_id, cp.k, root, min(y) AS y1, min(a) AS x1, max(y) + 1 AS y2, max(b) + 1 AS x2, bool_or(fr.id IS NOT NULL) AS free FROM cp JOIN rn USING (image_id, k, id) LEFT JOIN fr USING (image_id, k, id) GROUP BY cp.image_id, cp.k, root),
hb AS (SELECT rc.image_id, rc.k, x1, y1, x2, y2, max(v) AS score FROM rc JOIN gz USING (image_id) JOIN grid g ON g.image_id = rc.image_id AND g.y >= y1 AND g.y < y2 AND g.x >= x1 AND g.x < x2
WHERE free AND (y2 - y1) * (x2 - x1) > 0.005::DOUBLE * h * w GROUP BY rc.image_id, rc.k, root, x1, y1, x2, y2)"""
G5_OUT = "SELECT image_id, CAST(k AS INT) AS k, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2, round(score, 9) AS score FROM hb"


@query("grid", f"{G5} {G5_OUT}")
def g5_heatmap_boxes(spark, d):
    return regions.heatmap_boxes(view(spark, d, "grid")).withColumn("score", r9("score"))


SEARCH = CS + f""", heat AS (SELECT a.image_id, a.y, a.x, 1 / (1 + exp(-50 * (a.s - b.s))) AS v FROM cs a JOIN cs b USING (vec_id) WHERE a.class_id = 0 AND b.class_id = 1),
{J4.replace("grid", "heat")}, up AS ({J4_OUT.replace("grid", "heat")}), {G5.replace("grid", "up")},
boxes AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY k, y1, x1, y2, x2) AS box_id, x1, y1, x2, y2, score FROM hb), {K1}"""


@query("patches", SEARCH + """ SELECT image_id, box_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, round(score, 6) AS score, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rank FROM ke) WHERE rank <= 10""")
def search_regions(spark, d):
    """Text-to-region search: contrast of a query and a negative class, upsampled, boxes at eight thresholds, suppressed, the ten best of each image."""
    heat = _contrast(spark, d).select(*CELL, F.col("p").alias("v"))
    up = grids.bilinear_resize(heat, 30, 30, partial=True).withColumn("v", r9("v"))
    order = Window.partitionBy("image_id").orderBy("k", "y1", "x1", "y2", "x2")
    boxes = regions.heatmap_boxes(up).withColumn("box_id", F.row_number().over(order))
    return regions.top_k(regions.nms(boxes, 0.2)).withColumn("score", r6("score"))


@query("boxes", "SELECT image_id, box_id, round(score, 9) AS score FROM boxes WHERE score > 0.5 UNION ALL SELECT image_id, box_id, round(score, 9) FROM boxes WHERE score < 0.2")
def u1_union_regions(spark, d):
    b = view(spark, d, "boxes").select("image_id", "box_id", r9("score").alias("score"), F.col("score").alias("s"))
    return regions.union_regions(b.filter("s > 0.5").drop("s"), b.filter("s < 0.2").drop("s"))


@query("masks", "SELECT score > 0.9::DOUBLE AS valid, class_id, count(*) AS n FROM masks GROUP BY ALL")
def r1_split_by_mask_score(spark, d):
    good, bad = regions.split_by_mask_score(view(spark, d, "masks"), 0.9)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False))).groupBy("valid", "class_id").agg(F.count("*").alias("n"))


MERGE = """vm AS (SELECT * FROM masks WHERE score > 0.9::DOUBLE), mg AS (SELECT m.image_id, m.y, m.x, m.class_id, CASE WHEN max(m.logit) > 0 THEN max(p / (1 + exp(-logit))) ELSE 0 END AS p
FROM vm m JOIN class_probs USING (image_id, y, x, class_id) GROUP BY m.image_id, m.y, m.x, m.class_id), mp AS (SELECT image_id, y, x, CASE WHEN max(p) > 0 THEN arg_max(class_id, (p, -class_id)) ELSE 0 END AS class_id FROM mg GROUP BY image_id, y, x)"""


def _merged(spark, d):
    good, bad = regions.split_by_mask_score(view(spark, d, "masks"), 0.9)
    return (*aggregates.merge_masks(good, view(spark, d, "class_probs")), bad)


@query("masks class_probs", MERGE + " SELECT image_id, y, x, class_id, round(p, 6) + 0.0 AS p FROM mg")
def a9_merge_masks(spark, d):
    return _merged(spark, d)[0].withColumn("p", r6("p"))


@query("masks class_probs", MERGE + " SELECT image_id, y, x, class_id FROM mp")
def a9_merged_map(spark, d):
    return _merged(spark, d)[1]


@query("masks class_probs grid", MERGE + ", tot AS (SELECT image_id, y, x, sum(p) AS s FROM mg GROUP BY image_id, y, x) SELECT g.image_id, g.y, g.x, CASE WHEN tot.s <> 0 THEN mp.class_id ELSE g.class_id END AS class_id FROM grid g LEFT JOIN tot USING (image_id, y, x) LEFT JOIN mp USING (image_id, y, x)")
def r2_fallback_prediction(spark, d):
    scores, refined, _ = _merged(spark, d)
    return regions.fallback_prediction(scores, refined, view(spark, d, "grid"))


@query("masks class_probs", MERGE + """, fa AS (SELECT DISTINCT image_id, y, x FROM masks WHERE NOT score > 0.9::DOUBLE), fp AS (SELECT c.* FROM class_probs c JOIN fa USING (image_id, y, x))
SELECT image_id, y, x, class_id, round(greatest(coalesce(mg.p, 0), coalesce(fp.p, 0)), 6) + 0.0 AS p FROM mg FULL JOIN fp USING (image_id, y, x, class_id)""")
def r3_restore_failed(spark, d):
    scores, _, bad = _merged(spark, d)
    return regions.restore_failed(scores, bad, view(spark, d, "class_probs")).withColumn("p", r6("p"))


REFINE = TOP + ", cb AS (SELECT image_id, y, x, CASE WHEN p < 0.35::DOUBLE THEN 5 ELSE class_id END AS class_id, p AS v FROM tp), fg AS (SELECT * FROM cb WHERE class_id <> 5), " + STATS.replace("grid", "fg") + """,
mx AS (SELECT image_id, class_id, max(p) AS m FROM class_probs GROUP BY image_id, class_id), kr AS (SELECT st.* FROM st JOIN mx USING (image_id, class_id) WHERE area >= 3 AND NOT m < 0.4::DOUBLE),
ms AS (SELECT rg.image_id, rg.y, rg.x, rg.class_id, rg.region_id AS mask_id, 8 * (f.v - 0.4::DOUBLE) AS logit, k.score + 0.45::DOUBLE AS score FROM rg JOIN kr k USING (image_id, class_id, region_id) JOIN fg f USING (image_id, y, x)),
""" + MERGE.replace("FROM masks", "FROM ms") + """, fa AS (SELECT DISTINCT image_id, y, x FROM ms WHERE NOT score > 0.9::DOUBLE), fp AS (SELECT c.* FROM class_probs c JOIN fa USING (image_id, y, x)),
rs AS (SELECT image_id, y, x, max(greatest(coalesce(mg.p, 0), coalesce(fp.p, 0))) AS p FROM mg FULL JOIN fp USING (image_id, y, x, class_id) GROUP BY image_id, y, x), tot AS (SELECT image_id, y, x, sum(p) AS s FROM mg GROUP BY image_id, y, x)"""


@query("class_probs", REFINE + """ SELECT c.image_id, c.y, c.x, CASE WHEN tot.s <> 0 THEN mp.class_id ELSE c.class_id END AS class_id, round(rs.p, 6) + 0.0 AS p
FROM cb c LEFT JOIN tot USING (image_id, y, x) LEFT JOIN mp USING (image_id, y, x) LEFT JOIN rs USING (image_id, y, x)""")
def refine_regions(spark, d):
    """Region refinement: coarse map, connected regions of the foreground, those that are large and sure, masks for them, merged, restored where they failed.

    The mask model is the user's; in its place a region's cells get a logit from their own probability and the region's mean score.
    """
    probs = view(spark, d, "class_probs")
    coarse = storage.materialize(rowmath.coarse_background(windows.argmax_class(probs, CELL), 0.35, 5), "coarse")
    cells = storage.materialize(regions.connected_regions(coarse.filter("class_id <> 5")).join(coarse.select(*CELL, "p"), CELL), "regions")
    kept = aggregates.filter_regions(aggregates.region_stats(cells), aggregates.max_per_class(probs), 0.4, 3)
    masks = cells.join(kept.select("image_id", "class_id", "region_id", "score"), ["image_id", "class_id", "region_id"])
    masks = masks.select(*CELL, "class_id", F.col("region_id").alias("mask_id"), (8 * (F.col("p") - 0.4)).alias("logit"), (F.col("score") + 0.45).alias("score"))
    good, failed = regions.split_by_mask_score(storage.materialize(masks, "masks"), 0.9)
    scores, refined = aggregates.merge_masks(good, probs)
    scores = storage.materialize(scores, "scores")
    labels = regions.fallback_prediction(scores, refined, coarse.select(*CELL, "class_id"))
    best = regions.restore_failed(scores, failed, probs).groupBy(*CELL).agg(F.max("p").alias("p"))
    return labels.join(best, CELL, "left").select(*CELL, F.col("class_id").cast("int").alias("class_id"), r6("p").alias("p"))


# voxels


@query("points", "SELECT scene, frame, count(*) AS n, round(sum(f), 4) AS f FROM points WHERE frame % 10 = 0 GROUP BY scene, frame")
def v1_sample_frames(spark, d):
    return voxels.sample_frames(view(spark, d, "points")).groupBy("scene", "frame").agg(F.count("*").alias("n"), (F.round(F.sum("f"), 4) + 0.0).alias("f"))


@query("points", """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY scene, frame ORDER BY md5(concat_ws(',', CAST(x AS VARCHAR), CAST(y AS VARCHAR), CAST(z AS VARCHAR), CAST(f AS VARCHAR), CAST(class_id AS VARCHAR))), x, y, z, f, class_id) AS r FROM points) WHERE r <= 20""")
def v2_cap_points(spark, d):
    return voxels.cap_points(view(spark, d, "points"), 20, order=("x", "y", "z", "f", "class_id"))


VOX = "vx AS (SELECT scene, CAST(floor(x / 0.05::DOUBLE) AS BIGINT) AS vx, CAST(floor(y / 0.05::DOUBLE) AS BIGINT) AS vy, CAST(floor(z / 0.05::DOUBLE) AS BIGINT) AS vz, f, class_id FROM points)"


@query("points", VOX + " SELECT scene, vx, vy, vz, count(*) AS cnt, round(avg(f), 9) AS f FROM vx GROUP BY scene, vx, vy, vz")
def v3_voxelize(spark, d):
    return voxels.voxelize(view(spark, d, "points")).withColumn("f", r9("f"))


def _voxel_probs(spark, d) -> DataFrame:
    n = voxels.cells(view(spark, d, "points")).groupBy("scene", *voxels.VOXEL, "class_id").agg(F.count("*").alias("n"))
    total = n.groupBy("scene", *voxels.VOXEL).agg(F.sum("n").alias("t"))
    return n.join(total, ["scene", *voxels.VOXEL]).select("scene", *voxels.VOXEL, "class_id", (F.col("n") / F.col("t")).alias("p"))


VPROBS = VOX + """, vn AS (SELECT scene, vx, vy, vz, class_id, count(*) AS n FROM vx GROUP BY scene, vx, vy, vz, class_id), vp AS (SELECT scene, vx, vy, vz, class_id, n / CAST(sum(n) OVER (PARTITION BY scene, vx, vy, vz) AS DOUBLE) AS p FROM vn),
vd AS (SELECT scene, vx, vy, vz, class_id, CASE WHEN max(p) OVER (PARTITION BY scene, class_id) < 0.9::DOUBLE THEN 0 ELSE p END AS p FROM vp),
vb AS (SELECT scene, vx, vy, vz, arg_max(class_id, (p, -class_id)) AS class_id, max(p) AS p FROM vd GROUP BY scene, vx, vy, vz)"""


@query("points", VPROBS + " SELECT scene, vx, vy, vz, CASE WHEN p < 0.3::DOUBLE THEN 0 ELSE class_id + 1 END AS class_id, round(p, 6) + 0.0 AS p FROM vb")
def v4_query_voxels(spark, d):
    return voxels.query_voxels(_voxel_probs(spark, d), 0.3, 0.9).withColumn("p", r6("p"))


def _truth(spark, d) -> DataFrame:
    """Voxels of every other frame with their most frequent class."""
    points = view(spark, d, "points").filter("frame % 2 = 0")
    n = voxels.cells(points).groupBy("scene", *voxels.VOXEL, "class_id").agg(F.count("*").alias("p"))
    return windows.argmax_class(n, ["scene", *voxels.VOXEL]).drop("p")


def _predicted(spark, d) -> DataFrame:
    points = view(spark, d, "points").filter("frame % 2 = 1")
    n = voxels.cells(points).groupBy("scene", *voxels.VOXEL, "class_id").agg(F.count("*").alias("p"))
    return windows.argmax_class(n, ["scene", *voxels.VOXEL]).drop("p")


HALVES = ", ".join(f"""n{k} AS (SELECT scene, CAST(floor(x / 0.05::DOUBLE) AS BIGINT) AS vx, CAST(floor(y / 0.05::DOUBLE) AS BIGINT) AS vy, CAST(floor(z / 0.05::DOUBLE) AS BIGINT) AS vz, class_id, count(*) AS n FROM points WHERE frame % 2 = {k} GROUP BY ALL),
h{k} AS (SELECT scene, vx, vy, vz, arg_max(class_id, (n, -class_id)) AS class_id FROM n{k} GROUP BY scene, vx, vy, vz)""" for k in (0, 1))
KNN = HALVES + """, kn AS (SELECT *, row_number() OVER (PARTITION BY scene, vx, vy, vz ORDER BY d, px, py, pz) AS rank FROM (
SELECT g.scene, g.vx, g.vy, g.vz, g.class_id AS gt, p.vx AS px, p.vy AS py, p.vz AS pz, p.class_id AS pred, (g.vx - p.vx) ** 2 + (g.vy - p.vy) ** 2 + (g.vz - p.vz) ** 2 AS d FROM h0 g JOIN h1 p USING (scene)))"""


@query("points", KNN + " SELECT scene, vx, vy, vz, CAST(rank AS INT) AS rank, px, py, pz FROM kn WHERE rank <= 5")
def j9_knn_voxels(spark, d):
    return voxels.knn_voxels(_truth(spark, d).drop("class_id"), _predicted(spark, d), 5)


@query("points", HALVES + " SELECT g.scene, g.vx, g.vy, g.vz, CAST(1 AS INT) AS rank, p.vx AS px, p.vy AS py, p.vz AS pz FROM h0 g JOIN h1 p ON g.scene = p.scene AND g.vx = p.vx AND g.vy = p.vy AND g.vz = p.vz")
def j9_equal_voxels(spark, d):
    return voxels.knn_voxels(_truth(spark, d).drop("class_id"), _predicted(spark, d), 0)


@query("points", KNN + """, vt AS (SELECT scene, vx, vy, vz, gt, pred, count(*) AS n, min(rank) AS r FROM kn WHERE rank <= 5 AND gt <> 4 GROUP BY ALL), wn AS (SELECT scene, gt, arg_max(pred, (n, -r)) AS pred FROM vt GROUP BY scene, vx, vy, vz, gt),
cm AS (SELECT scene, gt, pred, count(*) AS n FROM wn GROUP BY ALL), rw AS (SELECT scene, gt AS class_id, sum(n) AS gt_n FROM cm GROUP BY ALL), cl AS (SELECT scene, pred AS class_id, sum(n) AS pred_n FROM cm GROUP BY ALL), hit AS (SELECT scene, gt AS class_id, sum(n) AS i FROM cm WHERE gt = pred GROUP BY ALL),
iou AS (SELECT scene, class_id, CAST(coalesce(gt_n, 0) AS BIGINT) AS gt_n, CAST(coalesce(pred_n, 0) AS BIGINT) AS pred_n, CAST(coalesce(i, 0) AS BIGINT) AS inter_n FROM rw FULL JOIN cl USING (scene, class_id) LEFT JOIN hit USING (scene, class_id)) """ + IOU_OUT.replace("SELECT CAST", "SELECT scene, CAST", 1))
def v5_evaluate_scenes(spark, d):
    out = voxels.evaluate_scenes(_predicted(spark, d), _truth(spark, d), 5, spark.createDataFrame([(4,)], "class_id int"))
    return _iou(out, ("scene",))


@query("points", VOX + " SELECT scene, vx, vy, vz, count(*) AS cnt, round(sum(f), 9) + 0.0 AS total FROM vx GROUP BY scene, vx, vy, vz")
def v6_accumulate_voxels(spark, d):
    """The stream over the points' file, run until nothing is left, and the newest state of each voxel."""
    place = storage.new_path(spark, "stream")
    stream = sources.stream_table(spark, d, "lineitem")
    points = stream.selectExpr("CAST(l_suppkey % 8 AS INT) AS scene", "l_quantity / 10 AS x", "l_discount AS y", "l_tax AS z", "l_extendedprice / CAST(100000 AS DOUBLE) AS f")
    run_available(points, f"{place}/table", f"{place}/checkpoint")
    return latest(spark, f"{place}/table").withColumn("total", F.round("total", 9) + 0.0)


@query("points", VOX + " SELECT scene, vx, vy, vz, count(*) AS cnt, round(sum(f), 9) + 0.0 AS d0, round(sum(class_id), 9) + 0.0 AS d1 FROM vx GROUP BY scene, vx, vy, vz")
def v6_voxel_features(spark, d):
    """The stream of points with feature vectors, folded into one state per voxel with a snapshot after every batch."""
    place = storage.new_path(spark, "features")
    stream = sources.stream_table(spark, d, "lineitem")
    points = stream.selectExpr("CAST(l_suppkey % 8 AS INT) AS scene", "l_quantity / 10 AS x", "l_discount AS y", "l_tax AS z", "array(l_extendedprice / CAST(100000 AS DOUBLE), CAST(l_partkey % 5 AS DOUBLE)) AS feat")
    run_features(points, f"{place}/table", f"{place}/checkpoint", every=1)
    out = latest_features(spark, f"{place}/table")
    return out.select("scene", *voxels.VOXEL, "cnt", r9(F.get("total", F.lit(0))).alias("d0"), r9(F.get("total", F.lit(1))).alias("d1"))


# text, sources and sinks


@query("", "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents), s AS (SELECT doc_id, k, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS prompt FROM l), f AS (SELECT prompt, min((doc_id, k)) AS f FROM s WHERE prompt <> '' GROUP BY prompt) SELECT prompt, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS idx FROM f")
def t1_clean_prompts(spark, d):
    return prompts.clean_prompts(table(spark, d, "documents").select(F.col("doc_id").alias("submission"), "text"))


TEMPLATES = [(0, "a picture of {c}"), (1, "one {c} seen from far"), (2, "{c} and another {c}")]
TSQL = "tm(template_id, template) AS (VALUES (0, 'a picture of {c}'), (1, 'one {c} seen from far'), (2, '{c} and another {c}'))"


def _templates(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template_id int, template string")


@query("", TSQL + ", nm AS (SELECT DISTINCT p_type AS name FROM part) SELECT name, template_id, replace(template, '{c}', name) AS prompt FROM nm CROSS JOIN tm")
def t2_expand_templates(spark, d):
    return prompts.expand_templates(_types(spark, d), _templates(spark)).select("name", "template_id", "prompt")


@query("", NAMES + " SELECT CAST(class_id AS INT) AS class_id, name FROM nm UNION ALL SELECT 0, ''")
def t3_build_class_map(spark, d):
    return prompts.build_class_map(_types(spark, d))


@query("", TSQL + """, nm AS (SELECT row_number() OVER (ORDER BY p_type) - 1 AS i, p_type AS name FROM (SELECT DISTINCT p_type FROM part)), ev AS (SELECT name, template_id, vec_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM nm CROSS JOIN tm JOIN embeddings ON vec_id % (3 * (SELECT count(*) FROM nm)) = i * 3 + template_id),
en AS (SELECT name, vec_id, sqrt(sum(v * v)) AS n FROM ev GROUP BY name, vec_id) SELECT name, CAST(dim AS INT) AS dim, round(avg(v / greatest(n, 1e-12)), 6) + 0.0 AS v FROM ev JOIN en USING (name, vec_id) GROUP BY name, dim""")
def t4_encode_classes(spark, d):
    names = _types(spark, d).withColumn("idx", F.col("idx") - 1)
    slot = (F.col("idx") * 3 + F.col("template_id")).cast("long")
    asked = prompts.expand_templates(names, _templates(spark)).withColumn("slot", slot)
    held = table(spark, d, "embeddings").withColumn("slot", F.col("vec_id") % F.lit(3 * names.count()))  # every vector belongs to a prompt
    vectors = asked.join(held, "slot").select("prompt", F.col("embedding").alias("vec"))
    return prompts.encode_classes(names.select("name"), vectors, "labels", _templates(spark)).select("name", "dim", r6("v").alias("v"))


@query("", "SELECT CAST(d.doc_id AS VARCHAR) AS stem, '/img/' || d.doc_id || '.jpg' AS image, '/map/' || d.doc_id || '.png' AS segmap FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1")
def s1_pair_manifest(spark, d):
    path = lambda df, a, b: df.select(F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b)).alias("path"))
    labels = table(spark, d, "labels")
    split = labels.filter("quality = 1").select(F.col("doc_id").cast("string").alias("stem"))
    return sources.pair_manifest(path(table(spark, d, "documents"), "/img/", ".jpg"), path(labels, "/map/", ".png"), split)


@query("", "SELECT doc_id, name, CAST(i AS INT) AS class_idx FROM (SELECT doc_id, i, unnest(string_split(line, ', ')) AS name FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM (SELECT doc_id, regexp_replace(text, '\\n$', '') AS t FROM documents)))")
def s2_class_names(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("value"))
    return sources.class_names(docs, keys=("doc_id",))


@query("patches", PV + " SELECT vec_id, CAST(dim AS INT) AS dim, round(v, 6) + 0.0 AS v FROM pv")
def s3_feature_round_trip(spark, d):
    path = storage.new_path(spark, "features")
    sources.write_features(view(spark, d, "patches"), path, "image_id")
    return _long(sources.read_features(spark, path), ["vec_id"], "feat")


MAPS = PV + " SELECT image_id, y, x, CAST(dim AS INT) AS dim, round(v, 6) + 0.0 AS v FROM pv"


def _maps(spark, d, nested: bool) -> DataFrame:
    path = storage.new_path(spark, "maps")
    sources.write_maps(view(spark, d, "patches"), path, nested, partial=True)
    return _long(sources.read_maps(spark, path), CELL, "feat")


@query("patches", MAPS)
def s3_nested_maps(spark, d):
    """Feature maps written as map[y][x] of vectors and read back."""
    return _maps(spark, d, True)


@query("patches", MAPS)
def s3_flat_maps(spark, d):
    """Feature maps written as vectors in raster order with their height and width, and read back."""
    return _maps(spark, d, False)


@query("grid gt", f"{CM}, {IOU}, {SUMMARY} SELECT run, metric, round(value, 6) AS value FROM ms CROSS JOIN (VALUES ('first'), ('second')) r(run)")
def s4_append_metrics(spark, d):
    path = storage.new_path(spark, "metrics")
    m = aggregates.summary_metrics(aggregates.iou_metrics(_confusion(spark, d)))
    for run in ("first", "second"):
        sources.append_metrics(m, path, run, "m", "grid", "low", False)
    return spark.read.parquet(path).select("run", "metric", r6("value").alias("value"))
