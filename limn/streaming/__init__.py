"""Incremental runs: files that arrive are filtered or annotated once, and metrics are kept as mergeable sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files that arrive below path."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def resumable(stream: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Runs work over what hasn't been done yet and stops. Restarts go on where the checkpoint ends.

    Each batch is written to a folder of its own, anew if it is repeated, so that no row is done twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def filtered(stream: DataFrame, code: str = "code") -> DataFrame:
    """The stream with `reason`; the native predicates need no state."""
    from limn.operators.filters import tagged

    return tagged(stream, code)


def running_means(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total, n, mean) so far: the mergeable state of a mean metric."""
    return stream.groupBy(key).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias("mean"))
