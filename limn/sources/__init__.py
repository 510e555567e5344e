"""Readers: parquet corpora, source directories, image folders, prediction files, tolerant JSON lines; and row ids."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from limn.functions.imaging import normalised_cell, readable_png


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or ValueError that names the columns it lacks; nothing runs."""
    if absent := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns {absent} are absent; there are {df.columns}")
    return df


def parquet(spark: SparkSession, path: str, *required: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), *required)


def kept(df: DataFrame) -> DataFrame:
    """df computed once: through a checkpoint where spark.checkpoint.dir is set, which Spark's cleaner removes; else persisted."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def with_row_id(df: DataFrame, name: str = "orig_id", order: list[str] | None = None) -> DataFrame:
    """df with ids from 0 on, unless it has them: by `order`, else in the order of its partitions.

    Rows are numbered within partitions; partitions' sizes, of which there are as many as partitions, give where each
    begins. No single task holds all rows, and they don't leave the JVM. With an order they are range-partitioned and kept
    as dealt. Without one df is read twice: pass what reads in the same order again, as files do.
    """
    if name in df.columns:
        return df
    if order is None:
        # An id of Spark's own is the partition's number above 33 bits of the row's place in it.
        dealt = df.withColumn("_id", F.monotonically_increasing_id())
        place, part = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("_id", 33)
        sizes = dealt.groupBy(part.alias("_part")).count()
        starts = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
        return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + place).drop("_part", "_id", "_start")
    dealt = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").count()
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_n", within).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_n") - 1).drop("_part", "_n", "_start")


def source_files(spark: SparkSession, path: str, pattern: str = "*.tex", recursive: bool = False, limit: int | None = None) -> DataFrame:
    """(path, source): a row for each file, whole. limit: the first files by path. FileNotFoundError where there is none."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))
    if not df.take(1):
        raise FileNotFoundError(f"no {pattern} below {path}")
    return df.orderBy("path").limit(limit) if limit is not None else df


def images(spark: SparkSession, path: str, pattern: str = "*.png", recursive: bool = False) -> DataFrame:
    """(filename, bytes) of image files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("content").alias("bytes"))


def decoded_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(filename, bytes) of a folder's images of any kind that the JVM reads, decoded there and kept as PNG; others are left out.

    The JVM doesn't turn pictures by their EXIF orientation; `imaging.as_png` of `images` does.
    """
    from limn.functions.imaging import png_of_rows

    df = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", recursive).load(path)
    name = F.element_at(F.split("image.origin", "/"), -1).alias("filename")
    return df.select(name, png_of_rows("image.data", "image.height", "image.width", "image.nChannels").alias("bytes"))


def image_pairs(spark: SparkSession, predicted: str, reference: str) -> DataFrame:
    """(filename, pred, ref) of image files that both folders have; predictions without a reference are left out."""
    p = images(spark, predicted).withColumnRenamed("bytes", "pred")
    return p.join(images(spark, reference).withColumnRenamed("bytes", "ref"), "filename")


PREDICTION = "index long, predicted string, ground_truth string"


def predictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(index, predicted, ground_truth) of a JSON array of records, or of a record a line, as `sinks.predictions_json` writes.

    ValueError where it is empty or a record lacks a text.
    """
    df = spark.read.schema(PREDICTION).json(path, multiLine=not lines)
    counts = df.agg(F.count("*").alias("n"), F.count_if(F.col("predicted").isNull() | F.col("ground_truth").isNull()).alias("bad")).first()
    if not counts["n"] or counts["bad"]:
        raise ValueError(f"{path}: {counts['n']} records, {counts['bad']} without predicted or ground_truth")
    return df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, and what can't be parsed is a row of nulls."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def image_cells(df: DataFrame, column: str, limit: int | None = None, key: str | None = None, verify: bool = False, marker: str = "__INVALID__:") -> DataFrame:
    """df with an image column as struct<path, bytes, kind>; rows whose cell is null go. limit: the first rows by key.

    verify: a cell whose bytes aren't a readable PNG gets the marker before its path. Web addresses and paths aren't read.
    """
    told = dict(df.dtypes)[column]
    inner = told.removeprefix("array<").removesuffix(">") if told.startswith("array<") else told
    kind = ("array " if told.startswith("array<") else "") + (inner if inner in ("binary", "string") else "struct")
    rows = df.orderBy(key).limit(limit) if limit is not None and key else df
    cells = rows.withColumn(column, normalised_cell(F.col(column), kind))
    if verify:
        c = F.col(column)
        path = F.when(c["bytes"].isNotNull() & ~readable_png(c["bytes"]), F.concat(F.lit(marker), F.coalesce(c["path"], F.lit("")))).otherwise(c["path"])
        cells = cells.withColumn(column, F.when(c.isNotNull(), F.struct(path.alias("path"), c["bytes"].alias("bytes"), c["kind"].alias("kind"))))
    return cells.filter(F.col(column).isNotNull())


#: Files of which a tokenizer's folder has one at least.
TOKENIZER_FILES = ("tokenizer.json", "tokenizer_config.json", "vocab.json", "merges.txt", "tokenizer.model")


def tokenizer_files(spark: SparkSession, path: str, load: Callable[[str], object], fetch: Callable[[str], None] | None = None, known: tuple[str, ...] = TOKENIZER_FILES) -> Callable[[], object]:
    """Ships a tokenizer file or folder to the executors; what it returns opens it there, once a worker.

    fetch(path) is called first to save a default tokenizer where path is a folder without any of the known files, or
    nothing; without it that is a FileNotFoundError.
    """
    there = os.path.isfile(path) or any(os.path.exists(os.path.join(path, n)) for n in known)
    if not there:
        if fetch is None:
            raise FileNotFoundError(f"{path} holds none of {known}")
        fetch(path)
    spark.sparkContext.addFile(path, recursive=os.path.isdir(path))
    name, opened = os.path.basename(path.rstrip("/")), []

    def open_once():
        if not opened:
            opened.append(load(SparkFiles.get(name)))
        return opened[0]

    return open_once


#: Environment settings, by the name of the setting that takes them.
ENVIRONMENT = {"api_key": "OPENAI_API_KEY", "image_folder": "VLM_TMP_DIR", "perceptual_environment": "DREAMSIM_ENV", "perceptual_cache": "DREAMSIM_CACHE_DIR"}


def required_paths(spark: SparkSession, *paths: str) -> None:
    """FileNotFoundError, before any job, for the first of the paths or patterns that nothing matches in its file system."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there):
            raise FileNotFoundError(path)


def setting(spark: SparkSession, name: str, default: str | None = None, required: bool = False) -> str | None:
    """A setting from spark.limn.NAME, else from its environment variable. ValueError where a required one is absent."""
    found = spark.conf.get(f"spark.limn.{name}", None) or os.environ.get(ENVIRONMENT.get(name, ""), None) or default
    if required and not found:
        raise ValueError(f"set spark.limn.{name} or {ENVIRONMENT.get(name)}")
    return found
