"""Shared pieces of the training-data operators: scratch storage, whole-text iteration, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Keys that are told apart as hot at most: what is broadcast for them has no more rows.
HOT_KEYS = 4_096


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. ValueError where that is unset, but on one machine.

    With a local master, where driver and executors are one process, an unset folder is a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="limn-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/limn-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: computed once, and an executor's loss does not undo it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables of `written` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "scratch", None):
            there = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def split_join(rows: DataFrame, table: DataFrame, key: str, most: int = HOT_KEYS) -> DataFrame:
    """rows with the columns of table (one row a key), as a left join; a key that holds many rows meets in no one task.

    rows is read three times: pass what is stored. A key is hot that holds more than 1 / most of the rows, so there are
    `most` of them at most: these rows of table are broadcast, and hot rows aren't moved. All others are joined by
    shuffling, where no key holds more than 1 / most of the rows. Null keys find nothing and aren't shuffled either.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = F.broadcast(checkpointed(counts.filter(F.col("_n") * most > total).select(key)))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name != key]
    warm = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left")
    cold = rows.filter(F.col(key).isNotNull()).join(hot, key, "left_anti").join(table, key, "left")
    return warm.unionByName(cold).unionByName(rows.filter(F.col(key).isNull()).select("*", *none))


def checkpointed(df: DataFrame) -> DataFrame:
    """df through a reliable checkpoint; Spark's cleaner removes the files once nothing refers to them."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def need(df: DataFrame, *names: str) -> DataFrame:
    """df with just these columns; ValueError where one is absent. Other columns can't clash with an operator's own."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} are absent; there are {df.columns}")
    return df.select(*names)


def utf8(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a column, null as empty, one at a time."""
    for x in batch.column(name):
        buf = x.as_buffer()
        yield buf.to_pybytes() if buf is not None else b""


def order_hash(key: Column) -> Column:
    """A pseudo-random order that any rerun gives again: 60 bits of the MD5 of a key as text."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
