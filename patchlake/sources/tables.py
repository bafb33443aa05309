"""Sources and sinks: file manifests, class lists, feature tables, metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stem(path: str, suffix: str):
    """File name without folder and suffix, null for other suffixes."""
    found = F.regexp_extract(F.col(path), rf"([^/]*)\.{suffix}$", 1)
    return F.when(found != "", found)


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path) of the files under a folder that end in .suffix; their contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true")
    return reader.load(folder).select("path")


def pair_manifest(images: DataFrame, segmaps: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """(stem, image, segmap) of images (path .jpg) and label maps (path .png) with one stem, in the split (stem) if there is one."""
    i = images.select(stem("path", "jpg").alias("stem"), F.col("path").alias("image")).filter("stem is not null")
    s = segmaps.select(stem("path", "png").alias("stem"), F.col("path").alias("segmap")).filter("stem is not null")
    if split is not None:
        i = i.join(split.select("stem"), "stem", "left_semi")
    return i.join(s, "stem")


def class_names(lines: DataFrame, col: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, name, class_idx) of whole class-list texts: line i is class i, `, ` parts its names, a newline at the end adds none."""
    t = lines.select(*keys, F.posexplode(F.split(F.regexp_replace(col, r"\n\z", ""), "\n")).alias("class_idx", "line"))
    return t.select(*keys, F.explode(F.split("line", ", ")).alias("name"), "class_idx")


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    return class_names(spark.read.text(path, wholetext=True))


def write_features(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Features as Parquet, in folders by a column of few values if one is named."""
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_maps(df: DataFrame, path: str, nested: bool = True, partial: bool = False) -> None:
    """Feature maps (image_id, y, x, feat) as one row per image: map[y][x] of vectors if nested, else the vectors of all places in raster order.

    A flat row keeps its height and width, so that read_maps finds the places again. An image with a missing place is an error when it is written flat
    or nested, unless it may be partial: a missing place then holds null, and read_maps leaves it out (as it does a place whose vector is null). A place
    that stands twice, or whose y or x is null or under 0, is an error in any case. Images must fit into a row (features by place go through write_features).
    """
    kind = df.schema["feat"].dataType.simpleString()
    bad = lambda what, kind: F.raise_error(F.lit(what)).cast(kind)
    ahead = lambda kind: bad("a map with a missing place", kind)

    def fill(gap, hole, kind: str):
        """Missing places before one."""
        some = F.array_repeat(hole, gap) if partial else F.when(gap == 0, F.array().cast(f"array<{kind}>")).otherwise(ahead(f"array<{kind}>"))
        return F.when(gap >= 0, some).otherwise(bad("a map with a place that stands twice or outside", f"array<{kind}>"))

    def dense(of, name: str, at: str, hole, kind: str):
        """The values of an array of places in order, with what is missing between them."""
        before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(of, i - 1)[at])
        gap = lambda s, i: F.coalesce(s[at] - before(i) - 1, F.lit(-1)).cast("int")
        return F.flatten(F.transform(of, lambda s, i: F.concat(fill(gap(s, i), hole, kind), F.array(s[name]))))

    none = F.lit(None).cast(kind)
    sorted_by = lambda at, name: F.sort_array(F.collect_list(F.struct(at, name))).alias("_r")
    rows = df.select("image_id", "y", "x", "feat").groupBy("image_id", "y").agg(sorted_by("x", "feat"))
    rows = rows.select("image_id", "y", dense(F.col("_r"), "feat", "x", none, kind).alias("_row"))
    maps = rows.groupBy("image_id").agg(sorted_by("y", "_row"))
    maps = maps.select("image_id", F.array_max(F.transform("_r", lambda s: F.size(s["_row"]))).alias("w"), dense(F.col("_r"), "_row", "y", F.array().cast(f"array<{kind}>"), f"array<{kind}>").alias("map"))
    wide = lambda r: F.concat(r, F.array_repeat(none, F.col("w") - F.size(r))) if partial else F.when(F.size(r) == F.col("w"), r).otherwise(ahead(f"array<{kind}>"))
    maps = maps.withColumn("map", F.transform("map", wide))
    out = maps.select("image_id", "map") if nested else maps.select("image_id", F.size("map").alias("h"), "w", F.flatten("map").alias("feats"))
    (out.withColumn("partial", F.lit(True)) if partial else out).write.parquet(path)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, y, x, feat) of maps that write_maps wrote in either layout; places that a partial map lacks have no row."""
    df = spark.read.parquet(path)
    there = "feat IS NOT NULL" if "partial" in df.columns else "true"
    if "map" in df.columns:
        rows = df.select("image_id", F.posexplode("map").alias("y", "_r"))
        return rows.select("image_id", "y", F.posexplode("_r").alias("x", "feat")).filter(there)
    flat = df.select("image_id", "w", F.posexplode("feats").alias("_p", "feat"))
    return flat.select("image_id", F.expr("CAST(_p DIV w AS INT)").alias("y"), F.expr("CAST(_p % w AS INT)").alias("x"), "feat").filter(there)


def append_metrics(df: DataFrame, path: str, run: str, model: str, dataset: str, resolution: str, refined: bool) -> None:
    """Adds a run's metrics (metric, value) to the log at path."""
    tags = {"run": run, "model": model, "dataset": dataset, "resolution": resolution}
    df.select(*[F.lit(v).alias(k) for k, v in tags.items()], F.lit(refined).alias("refined"), "metric", F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over folder/name.parquet, which may be a file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
