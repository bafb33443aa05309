import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["classify_patches_iou", "c1_self_correlate", "c3_kmeans_labels", "g4_connected_regions", "j4_bilinear_resize", "r3_restore_failed", "v5_evaluate_scenes", "v6_accumulate_voxels", "t1_clean_prompts", "s1_pair_manifest", "a11_pca_rgb", "c2_recursive_attention", "c5_cluster_images", "g5_heatmap_boxes", "k1_nms", "j9_knn_voxels", "search_regions", "refine_regions", "t4_encode_classes"]


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def test_every_query_with_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    got = [r.asDict() for r in entry.queries()[name](spark, SF).collect()]
    key = lambda r: str([(c, plain(r[c])) for c in sorted(r)])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
