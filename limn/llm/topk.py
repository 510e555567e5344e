"""Exact top-k search by integer inner product, with MaxScore over shards.

A vector's terms are its dimensions, one posting list for values above 0 and one for those below; a query adds to a
score through the list of its own sign, and only takes away through the other. Lists have bounds: the query's weight
times the largest value in the shard. Lists go by falling bound; those from which on the sum of bounds can't reach the
threshold are non-essential. Essential lists are traversed; what they found is probed in the others, best first, for as
long as bounds leave it competitive. Shards' best are merged. A first pass over a few vectors gives every query a
threshold that all shards share, so a shard whose bounds stay below it is skipped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from limn.llm.common import need, written

#: Vectors in a shard and queries in a block, about: what one task holds at once. Vectors of the first pass, about.
SHARD, BLOCK, FIRST = 16_384, 32_768, 4_096
#: Queries that traverse their lists together, and the candidates of one that are probed first.
_TOGETHER, _PROBED = 64, 64
#: Lists are traversed as long as the rest could add this share of the threshold; with less, bounds would say too little.
_LEFT = 1 / 3
_LONG = 2**63 - 1


def _merged(ids, scores, more_ids, more_scores, k: int):
    ids, scores = np.append(ids, more_ids), np.append(scores, more_scores)
    keep = np.lexsort((ids, -scores))[:k]
    return ids[keep], scores[keep]


class Shard:
    """Posting lists of a shard's vectors, by sign and dimension, and their bounds. Sums of products must stay below 2 ** 53."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], np.ascontiguousarray(vectors[order])
        columns = self.rows.T
        self.lists = np.concatenate([np.maximum(columns, 0), np.maximum(-columns, 0)])
        self.bounds = self.lists.max(axis=1, initial=0)

    def best(self, own: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and scores of the k best vectors but those of its own id; ties go to the smaller id.

        least: a score by query that its kth best of all shards has at least; vectors below it may be left out.
        """
        out = []
        for a in range(0, len(queries), _TOGETHER):
            q, floor = queries[a : a + _TOGETHER], least[a : a + _TOGETHER]
            weight = np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], axis=1)
            bound = weight * self.bounds
            order = np.argsort(-bound, axis=1, kind="stable")
            falling = np.take_along_axis(bound, order, axis=1)
            rest = np.cumsum(falling[:, ::-1], axis=1)[:, ::-1]  # rest[i]: what lists from the ith on can add
            traversed = rest >= np.where(floor > 0, floor * _LEFT, -np.inf)[:, None]
            beyond = np.where(traversed, 0, falling).sum(axis=1)
            some = np.flatnonzero(rest[:, 0] >= floor) if rest.shape[1] and len(self.ids) else np.arange(0)
            lists = np.zeros_like(weight)
            np.put_along_axis(lists, order, np.where(traversed, np.take_along_axis(weight, order, axis=1), 0), axis=1)
            found = lists[some] @ self.lists + beyond[some, None]
            none = (np.empty(0, self.ids.dtype), np.empty(0))
            part = [none] * len(q)
            for i, bounds in zip(some, found):
                part[i] = self._probed(own[a + i], q[i], bounds, floor[i], k, *none)
            out += part
        return out

    def _probed(self, own: int, query: np.ndarray, bounds: np.ndarray, threshold: float, k: int, ids, scores):
        """The k best of what bounds leave competitive, probed best first, in growing portions."""
        bounds[np.searchsorted(self.ids, own) : np.searchsorted(self.ids, own, side="right")] = -np.inf
        alive, portion = np.flatnonzero((bounds >= threshold) & (bounds > -np.inf)), _PROBED
        while len(alive):
            cut = min(portion, len(alive))
            first = np.argpartition(-bounds[alive], cut - 1)[:cut]
            probe = alive[first]
            ids, scores = _merged(ids, scores, self.ids[probe], self.rows[probe] @ query, k)
            if len(scores) == k:
                threshold = max(threshold, scores[-1])
            alive = np.delete(alive, first)
            alive, portion = alive[bounds[alive] >= threshold], 4 * portion
        return ids, scores


def integers(vector, by: int) -> list[int]:
    """floor(by * x) of each component of a vector, by exact integers where the product leaves what doubles hold."""
    return [int(x) * by if abs(x) >= 2**53 else math.floor(x * by) for x in map(float, vector)]


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class _Side:
    """Vectors of a task: a matrix of integers as doubles, and which rows hold components too large for it."""

    def __init__(self, pdf: pd.DataFrame, width: int, by: int):
        self.ids, self.raw = pdf["vec_id"].to_numpy(), pdf["v"].to_numpy()
        with np.errstate(over="ignore"):
            self.ints = np.floor(_matrix(self.raw, width) * by)
        self.large = np.abs(self.ints).max(axis=1, initial=0) > math.isqrt(2**53 // max(width, 1)) - 1

    def exact(self, at, by: int) -> list[list[int]]:
        return [integers(self.raw[i], by) for i in at]


def _exact_best(own, query: list[int], ids, vectors: list[list[int]], k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best, by Python's integers."""
    scored = [(-sum(a * b for a, b in zip(query, v)), i) for i, v in zip(ids, vectors) if i != own]
    return [(-s, i) for s, i in sorted(scored)[:k]]


def finite(embedding: Column) -> Column:
    """The components as doubles; null for a vector that is null or has a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: x.cast("double")))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector (vec_id, embedding) whose id `every` divides, the k best others.

    A component counts as floor(scale * x). Rows without an id, and vectors that are null or hold null or non-finite
    components, take no part. Vectors of unequal length count as filled up with zeros. Rows that repeat an id with equal
    vectors count once; with different ones, each is a candidate, and a query with ranks of its own; a query's candidates
    have another id than it. Ties go to the smaller id. Fewer than k others: all. Scores are exact for any finite
    component; one beyond a long's range is returned as the end of that range, and ranked by what it is. Other columns
    are ignored; an empty table gives an empty result.

    Every block of queries meets every shard, in a task that holds one of each; no pair is written, only k rows a query
    and shard. So the rows that are moved grow with vectors times queries, divided by what a task holds.
    """
    rows = need(vectors, "vec_id", "embedding").select("vec_id", finite(F.col("embedding")).alias("v")).filter("vec_id is not null and v is not null").distinct()
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    n = rows.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-(n // every + 1) // block))
    dealt = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    every_block, every_shard = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    table = rows.select("vec_id", "v", dealt(0, shards).alias("s"), every_block.alias("b"))
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("row", "vec_id", "v", dealt(1, blocks).alias("b"))
    wide = lambda left, right: max(left["v"].map(len).max(), right["v"].map(len).max()) if len(left) and len(right) else 0

    def begin(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The queries with the score of their kth best among a few vectors."""
        least = np.full(len(right), -np.inf)
        if len(left) and len(right):
            width = wide(left, right)
            held, asked = _Side(left, width, scale), _Side(right, width, scale)
            ids, some = held.ids[~held.large], held.ints[~held.large].T
            for i in np.flatnonzero(~asked.large) if len(ids) > k else ():
                scores = (asked.ints[i] @ some)[ids != asked.ids[i]]
                least[i] = np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf
        return right.assign(least=least)[["row", "vec_id", "v", "b", "least"]]

    few = rows.filter(dealt(2, max(1, n // first)) == 0).select("vec_id", "v", every_block.alias("b"))
    queries = few.groupBy("b").cogroup(queries.groupBy("b")).applyInPandas(begin, "row long, vec_id long, v array<double>, b int, least double")
    queries = written(queries, "topk-queries").select("*", every_shard.alias("s"))
    columns = ["row", "query_id", "vec_id", "score", "beyond"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = wide(left, right)
            held, asked = _Side(left, width, scale), _Side(right, width, scale)
            small, easy = np.flatnonzero(~held.large), np.flatnonzero(~asked.large)
            plain = Shard(held.ids[small], held.ints[small])
            row, least = right["row"].to_numpy(), right["least"].to_numpy()
            for i, (ids, scores) in zip(easy, plain.best(asked.ids[easy], asked.ints[easy], k, least[easy])):
                out.append(pd.DataFrame({"row": row[i], "query_id": asked.ids[i], "vec_id": ids, "score": scores.astype(np.int64), "beyond": None}, columns=columns))
            for at, against in ((np.flatnonzero(asked.large), np.arange(len(left))), (easy, np.flatnonzero(held.large))):
                values = held.exact(against, scale) if len(at) else []
                for i, query in zip(at, asked.exact(at, scale) if values else []):
                    for s, v in _exact_best(asked.ids[i], query, held.ids[against].tolist(), values, k):
                        # Beyond a long's range, bytes that sort as the scores do.
                        beyond = (s + (1 << 2302)).to_bytes(288, "big") if abs(s) > _LONG else None
                        out.append(pd.DataFrame([(row[i], asked.ids[i], v, max(min(s, _LONG), -_LONG - 1), beyond)], columns=columns))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in columns}).astype({c: "int64" for c in columns[:4]})

    found = table.groupBy("s", "b").cogroup(queries.groupBy("s", "b")).applyInPandas(search, "row long, query_id long, vec_id long, score long, beyond binary")
    order = [F.desc("score"), F.when(F.col("score") > 0, F.col("beyond")).desc_nulls_last(), F.when(F.col("score") < 0, F.col("beyond")).desc_nulls_first(), F.col("vec_id")]
    rank = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
