"""Prompt lists, templates and class maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.sources.storage import global_index

MOST_TEMPLATES, MOST_LETTERS = 10_000, 8_000_000


def clean_prompts(df: DataFrame, col: str = "text", order: str = "submission") -> DataFrame:
    """prompt, idx: lines of all submissions without white space around them, empty ones and later repetitions; idx from 0."""
    lines = df.select(F.col(order).alias("_o"), F.posexplode(F.split(col, "\n")).alias("_k", "prompt"))
    lines = lines.withColumn("prompt", F.regexp_replace("prompt", r"(?U)^\s+|\s+$", "")).filter("prompt <> ''")
    first = lines.groupBy("prompt").agg(F.min(F.struct("_o", "_k")).alias("_first"))
    return global_index(first, ["_first", "prompt"]).select("prompt", "idx")


def expand_templates(labels: DataFrame, templates: DataFrame, name: str = "name") -> DataFrame:
    """Each label in each template (a `{c}` slot). Templates are a short list that goes to every task: more than MOST_TEMPLATES, or of
    more than MOST_LETTERS characters together, are an error."""
    size = templates.limit(MOST_TEMPLATES + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("template")), F.lit(0)).alias("letters")).first()
    if size["n"] > MOST_TEMPLATES or size["letters"] > MOST_LETTERS:
        raise ValueError(f"more than {MOST_TEMPLATES} templates or {MOST_LETTERS} characters of them")
    return labels.crossJoin(F.broadcast(templates)).withColumn("prompt", F.replace(F.col("template"), F.lit("{c}"), F.col(name)))


def build_class_map(names: DataFrame) -> DataFrame:
    """(class_id, name) from (idx, name): classes from 1 in order without an empty first name, and 0 for ''."""
    first = names.agg(F.min_by("name", "idx").alias("_first"), F.min("idx").alias("_at"))
    kept = names.crossJoin(F.broadcast(first)).filter(~((F.col("_first") == "") & (F.col("idx") == F.col("_at"))))
    ranked = global_index(kept.select("idx", "name"), ["idx", "name"], "_rank").select((F.col("_rank") + 1).alias("class_id"), "name")
    return ranked.unionByName(names.sparkSession.createDataFrame([(0, "")], "class_id int, name string"))


def name_to_index(class_map: DataFrame) -> DataFrame:
    """(name, class_id): the last index of a repeated name."""
    return class_map.groupBy("name").agg(F.max("class_id").alias("class_id"))


def encode_classes(names: DataFrame, embeddings: DataFrame, mode: str, templates: DataFrame | None = None) -> DataFrame:
    """(name, dim, v): each label's mean unit vector over the templates, or each prompt's vector as it is.

    embeddings: (prompt, vec), the vectors of all prompts that the mode asks for.
    """
    from patchlake.operators.aggregates import mean_vectors

    if mode not in ("labels", "prompts"):
        raise ValueError(f"unknown mode {mode!r}: labels or prompts")
    if names.isEmpty():
        raise ValueError("no classes")
    if mode == "prompts":
        joined = names.join(embeddings, names.name == embeddings.prompt)
        return joined.select("name", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    return mean_vectors(expand_templates(names, templates).join(embeddings, "prompt"), ["name"], "vec")
