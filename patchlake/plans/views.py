"""Fixture views over the given tables; each is one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "patches": """SELECT CAST(floor(vec_id / 100) AS BIGINT) AS image_id, CAST(floor((vec_id % 100) / 10) AS INT) AS y,
        CAST(vec_id % 10 AS INT) AS x, vec_id, label, embedding AS feat FROM {embeddings}""",
    "images": "SELECT doc_id AS image_id, CAST(64 + (n_chars * 7) % 960 AS INT) AS h, CAST(64 + (n_chars * 13) % 1280 AS INT) AS w FROM {documents}",
    "grid": """SELECT CAST(floor(o_orderkey / 400) AS BIGINT) AS image_id, CAST(floor((o_orderkey % 400) / 20) AS INT) AS y,
        CAST(o_orderkey % 20 AS INT) AS x, o_totalprice / CAST(500000 AS DOUBLE) AS v, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS class_id FROM {orders}""",
    "gt": """SELECT CAST(floor(o_orderkey / 400) AS BIGINT) AS image_id, CAST(floor((o_orderkey % 400) / 20) AS INT) AS y, CAST(o_orderkey % 20 AS INT) AS x,
        CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(substr(o_orderpriority, 1, 1) AS INT) ELSE o_custkey % 6 END AS INT) AS gt FROM {orders}""",
    "class_probs": """SELECT image_id, y, x, class_id, raw / sum(raw) OVER (PARTITION BY o_orderkey) AS p FROM (
        SELECT CAST(floor(o_orderkey / 400) AS BIGINT) AS image_id, CAST(floor((o_orderkey % 400) / 20) AS INT) AS y, CAST(o_orderkey % 20 AS INT) AS x,
            c.class_id, o_orderkey, CAST(1 + (o_orderkey * (31 + 17 * c.class_id) + o_custkey) % 997 AS DOUBLE) AS raw
        FROM {orders} CROSS JOIN (SELECT 0 AS class_id UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c) r""",
    "masks": """SELECT CAST(floor(l_orderkey / 400) AS BIGINT) AS image_id, CAST(floor((l_orderkey % 400) / 20) AS INT) AS y, CAST(l_orderkey % 20 AS INT) AS x,
        CAST(l_partkey % 5 AS INT) AS class_id, l_linenumber AS mask_id, l_quantity / 10 - CAST(2.5 AS DOUBLE) AS logit,
        CAST(0.84 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 50 AS score FROM {lineitem}""",
    "boxes": """SELECT CAST(floor(o_orderkey / 50) AS BIGINT) AS image_id, o_orderkey AS box_id, CAST(o_custkey % 90 AS DOUBLE) AS x1,
        CAST((o_custkey * 7) % 90 AS DOUBLE) AS y1, CAST(o_custkey % 90 + 5 + o_orderkey % 30 AS DOUBLE) AS x2,
        CAST((o_custkey * 7) % 90 + 5 + (o_orderkey * 3) % 30 AS DOUBLE) AS y2, o_totalprice / CAST(500000 AS DOUBLE) AS score FROM {orders}""",
    "points": """SELECT CAST(l_suppkey % 8 AS INT) AS scene, CAST(l_orderkey % 100 AS INT) AS frame, l_quantity / 10 AS x, l_discount AS y, l_tax AS z,
        l_extendedprice / CAST(100000 AS DOUBLE) AS f, CAST(l_partkey % 5 AS INT) AS class_id FROM {lineitem}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def with_views(names: str, sql: str) -> str:
    """The oracle's text: the views as common table expressions, then sql (a SELECT, or `name AS (...), ... SELECT`)."""
    ctes = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names.split())
    more = "" if sql.lstrip().upper().startswith("SELECT") else ", "
    return f"WITH RECURSIVE {ctes}{more} {sql}" if ctes else f"WITH RECURSIVE {sql}" if more else sql
