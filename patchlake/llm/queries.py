"""Registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchlake.llm import fingerprints, langid, lexical, minhash, neardup, ordered, packing, pieces, pii, prefixes, substrings, toolcalls, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; PATCHLAKE_TOKENIZERS names another folder than the installed one."""
    folder = os.environ.get("PATCHLAKE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold=1, of=3, threshold=0.7)


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), fold=2, of=4)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.derive(_table(spark, sf_dir, "conversations"))
    return toolcalls.link_calls(calls, results, toolcalls.TOOLS)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), window=20).drop("text")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op12_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.pack_in_order(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, capacity=2048)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_nodes(_table(spark, sf_dir, "conversations"), every=20, most=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_nn_descent": op2_nn_descent,
    "op3_language": op3_language,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_packing": op5_packing,
    "op6_minhash": op6_minhash,
    "op7_fingerprints": op7_fingerprints,
    "op8_pii": op8_pii,
    "op9_tool_calls": op9_tool_calls,
    "op10_substrings": op10_substrings,
    "op11_ranked_search": op11_ranked_search,
    "op12_ordered_packing": op12_ordered_packing,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op11_ranked_search": lexical.SEARCH_SQL,
    "op9_tool_calls": """
WITH RECURSIVE c AS (SELECT conv_id, turn, text, length(text) % 60 AS lim FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
lv AS (SELECT c.conv_id, c.turn, 0 AS level FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 WHERE p.turn IS NULL
       UNION ALL SELECT c.conv_id, c.turn, lv.level + 1 FROM lv JOIN c ON c.conv_id = lv.conv_id AND c.turn = lv.turn + 2),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn - 1) AS id, coalesce(c.turn, r.turn) AS turn, lv.level,
             c.turn IS NOT NULL AS called, r.turn IS NOT NULL AS answered, c.lim, c.text AS query, r.text AS content,
             c.turn >= 2 AS refers, c.turn >= 2 AND p.turn IS NULL AS lost
      FROM c LEFT JOIN lv ON lv.conv_id = c.conv_id AND lv.turn = c.turn LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
      FULL JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1),
s AS (SELECT *, CASE WHEN NOT called THEN 'orphan' WHEN answered THEN 'linked' ELSE 'unanswered' END AS status,
             concat_ws(',', CASE WHEN lost THEN '"$ref call_' || (turn - 2) || ': unknown"' END,
                       CASE WHEN lim = 0 THEN '"$.limit: under minimum"' WHEN lim > 50 THEN '"$.limit: over maximum"' END) AS errs FROM j)
SELECT conv_id, 'call_' || id AS call_id, turn, CAST(level AS INT) AS level, CAST(called AS BIGINT) AS n_calls, CAST(answered AS BIGINT) AS n_results, status,
       called AND errs = '' AS valid,
       '{"arguments":' || CASE WHEN NOT called THEN 'null' ELSE '{' || CASE WHEN refers THEN '"after":{"$ref":"call_' || (turn - 2) || '"},' ELSE '' END
           || '"limit":' || lim || ',"query":' || CAST(to_json(query) AS VARCHAR) || '}' END
       || ',"errors":[' || errs || '],"id":"call_' || id || '","level":' || coalesce(CAST(level AS VARCHAR), 'null')
       || ',"name":' || CASE WHEN called THEN '"search"' ELSE 'null' END
       || ',"result":' || CASE WHEN answered THEN CAST(to_json(content) AS VARCHAR) ELSE 'null' END || ',"status":"' || status || '"}' AS message
FROM s
""",
}
