"""Corpus pipeline: language ID, MinHash near-dedup, substring dedup, personal data masking, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents, with n_chars following the text. run() writes every stage's result as a table and rereads it. Further columns of documents are
left out. Rows with a null doc_id pass the dedup stages as they are, different texts that share a doc_id are documents of their own, and rows that repeat
both are one; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm import langid, minhash, packing, pii, substrings
from patchlake.llm.common import materialize
from patchlake.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OTHERS = ("doc_id", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with a doc_id, h (hash of the text) and num: doc_id, or a number for each (doc_id, h) in the order of the ids if texts share one."""
    named = docs.select(COLUMNS).filter("doc_id is not null").withColumn("h", F.xxhash64("text"))
    ids = materialize(named.select("doc_id", "h").distinct(), "ids")
    if ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return named.withColumn("num", F.col("doc_id"))
    ids = ids.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("num", F.monotonically_increasing_id())
    return materialize(named.hint("merge").join(materialize(ids, "numbers"), ["doc_id", "h"]), "numbered")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected (no letter, or no margin between languages) go."""
    docs = docs.select(COLUMNS)
    found = langid.classify(docs, langid.train(docs.filter(~langid.held_out(2, 4))), carry=tuple(COLUMNS))
    return found.filter(~F.col("rejected")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays.

    Documents with a null doc_id are linked with nothing and stay, all of them. Different texts of one doc_id are documents of their own; rows that
    repeat both are one.
    """
    named = _numbered(docs)
    given = named.select(F.col("num").alias("doc_id"), "text")
    kept = minhash.near_duplicates(given, k=5, percent=80).filter("kept").select(F.col("doc_id").alias("num")).distinct()
    # num stands for one (doc_id, h): rows that repeat both meet, sorted, where the merge join has put them, and texts are shuffled once
    out = named.hint("merge").join(kept, "num", "left_semi").dropDuplicates(["num"])
    return out.select(COLUMNS).unionByName(docs.filter("doc_id is null").select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that stand earlier in the corpus are taken out; documents that lose all words go. Those with a null doc_id stay as they are."""
    given = _numbered(docs).withColumnRenamed("doc_id", "own").withColumnRenamed("num", "doc_id")
    out = substrings.remove_repeats(given, window=20, carry=("own", *OTHERS[1:])).withColumnRenamed("own", "doc_id")
    return _sized(out.filter("n_removed = 0 OR n_removed < n_words").select(COLUMNS).unionByName(docs.filter("doc_id is null").select(COLUMNS)))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in angle brackets."""
    return _sized(pii.detect(docs.select(COLUMNS), mask=True, carry=OTHERS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in packed sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Compression, trained networks and packing have no SQL form; run() is tested against brute-force stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
