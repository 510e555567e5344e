"""Writers: parquet, kept and dropped rows, failures, JSON lines with resume, counts as CSV, a file for each row."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from limn.operators.annotation import remaining


def parquet(df: DataFrame, path: str, single: bool = False) -> None:
    """df as parquet; single: as one file, for what is known to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").parquet(path)


def split(df: DataFrame, kept: str, dropped: str, reason: str = "reason") -> None:
    """Rows without a reason to one path, the others to another. The tagged rows are computed once."""
    tagged = df.persist()
    try:
        tagged.filter(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(kept)
        tagged.filter(F.col(reason).isNotNull()).write.mode("overwrite").parquet(dropped)
    finally:
        tagged.unpersist()


def failures(df: DataFrame, path: str, image: str) -> bool:
    """Rows without an image, without that column, if there are any; whether there were."""
    failed = df.filter(F.col(image).isNull()).drop(image)
    if not failed.take(1):
        return False
    failed.write.mode("overwrite").parquet(path)
    return True


def success_index(df: DataFrame, key: str, image: str, path: str) -> None:
    """Keys of rows with an image, ascending, one a line of JSON. Sorted in parallel; part files are in order."""
    df.filter(F.col(image).isNotNull()).select(key).orderBy(key).write.mode("overwrite").json(path)


def append_json(df: DataFrame, path: str, key: str = "index", resume: bool = True) -> DataFrame:
    """Appends what isn't in the JSON lines at path yet, by key, or writes them anew; the rows that were left to do."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    left = remaining(df, spark.read.schema(df.schema).json(path), key) if resume and exists else df
    left.write.mode("append" if resume else "overwrite").json(path)
    return left


def counts_csv(counts: DataFrame, path: str, label: str = "label", count: str = "count") -> None:
    """Counts with a header, most frequent first, then by label, in one file: a row for each label."""
    counts.select(label, count).orderBy(F.desc(count), label).coalesce(1).write.mode("overwrite").csv(path, header=True)


def metrics_csv(df: DataFrame, path: str) -> None:
    """A wide table of metrics with a header, by file name."""
    df.orderBy("filename").write.mode("overwrite").csv(path, header=True)


def predictions_json(df: DataFrame, path: str) -> None:
    df.orderBy("index").write.mode("overwrite").json(path)


def files(df: DataFrame, path: Column, data: Column, write: Callable[[str, bytes], None]) -> None:
    """A file for each row: `write` puts bytes under a path, in storage that all executors reach."""

    def each(rows):
        for r in rows:
            if r["_data"] is not None:
                write(r["_path"], bytes(r["_data"]))

    df.select(path.alias("_path"), data.cast("binary").alias("_data")).foreachPartition(each)


def local_file(path: str, data: bytes) -> None:
    """Writes bytes under a path of the file system that executors share, and the folders above it."""
    plain = path.removeprefix("file://")
    os.makedirs(os.path.dirname(plain) or ".", exist_ok=True)
    with open(plain, "wb") as f:
        f.write(data)


def failure_preview(df: DataFrame, key: str, n: int = 10) -> tuple[list, int]:
    """The n smallest failed keys, and how many more there are."""
    first = [r[0] for r in df.select(key).orderBy(key).limit(n).collect()]
    return first, df.count() - len(first)


def summary(df: DataFrame, status: str) -> DataFrame:
    """(status, n, percent) of rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.groupBy(status).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(status, "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))
