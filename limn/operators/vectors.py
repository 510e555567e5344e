"""Similarities of feature vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, natively."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def mean_vector_cosine(df: DataFrame, key: str, vector: str, group: str, dims: int) -> DataFrame:
    """(key, group, similarity): the cosine of each vector with its group's mean, whose `dims` sums are partially aggregated."""
    sums = df.groupBy(group).agg(*(F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(dims)))
    means = sums.select(group, F.array(*(F.col(f"m{i}") for i in range(dims))).alias("mean"))
    return df.join(means, group).select(key, group, cosine(F.col(vector), F.col("mean")).alias("similarity"))


def _moments(v: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over vectors of their components and of products of two and of three, the latter for ordered places only."""
    one, two = v.sum(axis=0), v.T @ v
    three = np.concatenate([((v[:, a : a + 1] * v[:, a:]).T @ v[:, a:])[np.triu_indices(dims - a)] for a in range(dims)])
    return one, two[np.triu_indices(dims)], three


def _multiplicity(dims: int) -> np.ndarray:
    """By place of `_moments`: how often a product comes among ordered ones, times its factor in ((x . y) / d + 1) ** 3 - 1."""
    i, j = np.triu_indices(dims)
    three = []
    for a in range(dims):
        b, c = (x + a for x in np.triu_indices(dims - a))
        three.append(np.where((b == a) & (c == a), 1, np.where((b == a) | (b == c), 3, 6)))
    return np.concatenate([np.full(dims, 3 / dims), np.where(i == j, 1, 2) * 3 / dims**2, np.concatenate(three) / dims**3])


def kernel_distance(df: DataFrame, vector: str, side: Column, dims: int) -> DataFrame:
    """One row (n, m, mmd2): the unbiased squared maximum mean discrepancy of two sides under the kernel (x . y / d + 1) ** 3.

    side: true for one, false for the other, null for neither. The kernel is a polynomial of inner products, so sums
    over pairs are products of moments: no pair of vectors is formed. A task sums the moments of its rows by Arrow
    batches, dims ** 3 / 6 numbers, and these sums are added up by place. Vectors of another length are left out.
    """
    rows = df.select(side.alias("side"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).filter(F.col("side").isNotNull() & (F.size("v") == dims))

    def sums(batches):
        total = {True: 0.0, False: 0.0}
        for b in batches:
            v = np.array(b.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
            on = np.array(b.column("side").to_pylist(), bool)
            for s in total:
                own = v[on == s]
                if len(own):
                    k = ((own * own).sum(axis=1) / dims + 1) ** 3
                    total[s] = total[s] + np.concatenate([*_moments(own, dims), [len(own), k.sum()]])
        for s, x in total.items():
            if not np.isscalar(x):
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(x)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], ["side", "place", "x"])

    places = dims + dims * (dims + 1) // 2 + dims * (dims + 1) * (dims + 2) // 6
    by_place = rows.mapInArrow(sums, "side boolean, place int, x double").groupBy("place").agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("x"))), F.lit(0.0)).alias(n) for s, n in ((True, "u"), (False, "w"))))

    def weighed(batches):
        weight = _multiplicity(dims)
        for b in batches:
            place = b.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("place"), b.column("u"), b.column("w"), pa.array(np.where(place < places, weight[np.minimum(place, places - 1)], 0.0))], ["place", "u", "w", "f"])

    table = by_place.mapInArrow(weighed, "place int, u double, w double, f double")
    f, u, w = F.col("f"), F.col("u"), F.col("w")
    at = lambda c, p: F.sum(F.when(F.col("place") == places + p, F.col(c)))
    one = table.agg(F.sum(f * u * u).alias("uu"), F.sum(f * w * w).alias("ww"), F.sum(f * u * w).alias("uw"), at("u", 0).alias("n"), at("w", 0).alias("m"), at("u", 1).alias("ku"), at("w", 1).alias("kw"))
    n, m = F.col("n"), F.col("m")
    mmd = (F.col("uu") + n * n - F.col("ku")) / (n * (n - 1)) + (F.col("ww") + m * m - F.col("kw")) / (m * (m - 1)) - 2 * (F.col("uw") / (n * m) + 1)
    return one.select(n.cast("long").alias("n"), m.cast("long").alias("m"), mmd.alias("mmd2"))


def kernel_distance_subsets(first, second, subsets: int = 100, size: int = 50, seed: int = 42) -> tuple[float, float]:
    """Mean and deviation of the kernel distance over random subsets of two feature matrices (numpy, on one machine)."""
    rng, out = np.random.default_rng(seed), []
    if min(len(first), len(second)) < size:
        raise ValueError(f"a subset takes {size} vectors of either side")
    for _ in range(subsets):
        x, y = (np.asarray(s, float)[rng.choice(len(s), size, replace=False)] for s in (first, second))
        k = lambda a, b: (a @ b.T / a.shape[1] + 1) ** 3
        xx, yy = k(x, x), k(y, y)
        out.append((xx.sum() - np.trace(xx) + yy.sum() - np.trace(yy)) / (size * (size - 1)) - 2 * k(x, y).mean())
    return float(np.mean(out)), float(np.std(out))
