"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limn.llm.common import checkpointed


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): to each u the least of u and its v, joined back to every pair as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for each id of a link: the smallest id that links reach. Ids without a link are not returned.

    Each round keeps one row per edge at most and a hub is met by a join, which Spark can split, never by a list. The
    rounds grow with the logarithm of the components' size. Loops, repeats and either order of a pair are fine; nulls
    link nothing.
    """
    edges = checkpointed(_tidy(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))))
    mark = _mark(edges)
    for _ in range(rounds if mark[0] else 0):
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _tidy(_stars(sides).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _stars(large)
        edges = checkpointed(_tidy(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))))
        mark, before = _mark(edges), mark
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
