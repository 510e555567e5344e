"""Metrics of predicted against reference code: BLEU without trivially shared n-grams, and extended edit distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from limn.functions import tex

#: n-grams that count as trivially shared, and the longest n-gram.
TRIVIAL, ORDERS = 500, 4
#: Fixed values of the edit distance: cost of a jump, weight of coverage, cost of a deletion and of an insertion.
JUMP, COVERAGE, DELETION, INSERTION = 2.0, 0.3, 0.2, 1.0


@pandas_udf(T.ArrayType(T.StringType()))
def tex_tokens(code):
    return code.map(tex.words)


def whitespace_words(text: Column) -> Column:
    """Lower-case stretches between white space, natively."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, orders: int = ORDERS) -> Column:
    """array<struct<n, gram>> of all n-grams of 1 to `orders` tokens, a gram's tokens joined by spaces.

    Each order extends the one before by one token, in one pass over the array. Pass a column, not an expression: it is
    read several times.
    """
    out, grams = [], tokens
    for n in range(1, orders + 1):
        if n > 1:
            m = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
            grams = F.zip_with(F.slice(grams, F.lit(1), m), F.slice(tokens, F.lit(n), m), lambda g, t: F.concat(g, F.lit(" "), t))
        out.append(F.transform(grams, _numbered(n)))
    return F.concat(*out)


def _numbered(n: int):
    return lambda gram: F.struct(F.lit(n).alias("n"), gram.alias("gram"))


def ngram_counts(df: DataFrame, tokens: Column, *keys: str, orders: int = ORDERS) -> DataFrame:
    """(keys, n, gram, k): how often each n-gram comes. Counts are summed before rows are shuffled."""
    rows = df.select(*keys, tokens.alias("_tokens"))
    return rows.select(*keys, F.explode(ngrams(F.col("_tokens"), orders)).alias("g")).groupBy(*keys, "g.n", "g.gram").agg(F.count("*").alias("k"))


def trivial_ngrams(counts: DataFrame, top: int = TRIVIAL) -> DataFrame:
    """The `top` most frequent n-grams of counts (n, gram, k); ties by order, then by gram."""
    return counts.orderBy(F.desc("k"), "n", "gram").limit(top)


def corpus_bleu(pairs: DataFrame, key: str, predicted: Column, reference: Column, top: int = TRIVIAL, orders: int = ORDERS) -> DataFrame:
    """One row: precisions by order (matched, total), lengths, brevity penalty and `bleu` of pairs, ignoring trivial n-grams.

    predicted and reference: arrays of tokens. n-grams are matched within a pair, up to the reference's count; the `top`
    n-grams most frequent among references count nowhere. 0 where an order has no match. Scaled by 100.
    """
    tokens = pairs.select(F.col(key).alias("key"), predicted.alias("p"), reference.alias("r"))
    theirs = ngram_counts(tokens, F.col("r"), "key", orders=orders)
    trivial = trivial_ngrams(theirs.groupBy("n", "gram").agg(F.sum("k").alias("k")), top).select("n", "gram")
    trivial = F.broadcast(trivial)  # `top` rows at most
    ours = ngram_counts(tokens, F.col("p"), "key", orders=orders).join(trivial, ["n", "gram"], "left_anti")
    matched = ours.join(theirs.withColumnRenamed("k", "limit"), ["key", "n", "gram"], "left")
    by_order = matched.groupBy("n").agg(F.sum(F.least("k", F.coalesce("limit", F.lit(0)))).alias("matched"), F.sum("k").alias("total"))
    wide = by_order.agg(*(F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}_{n}") for n in range(1, orders + 1) for c in ("matched", "total")))
    lengths = tokens.agg(F.coalesce(F.sum(F.size("p")), F.lit(0)).alias("predicted_length"), F.coalesce(F.sum(F.size("r")), F.lit(0)).alias("reference_length"))
    one = wide.join(F.broadcast(lengths))  # one row each
    p, r = F.col("predicted_length"), F.col("reference_length")
    penalty = F.when(p == 0, 0.0).when(p > r, 1.0).otherwise(F.exp(1 - r / p))
    some = [F.col(f"matched_{n}") > 0 for n in range(1, orders + 1)]
    logs = [F.log(F.when(ok, F.col(f"matched_{n}") / F.col(f"total_{n}"))) for n, ok in enumerate(some, 1)]
    bleu = F.coalesce(100 * penalty * F.exp(sum(logs[1:], logs[0]) / orders), F.lit(0.0))
    return one.select("*", penalty.alias("brevity_penalty"), bleu.alias("bleu"))


def frequent_ngrams(df: DataFrame, tokens: Column, top: int = TRIVIAL, orders: int = ORDERS) -> list[tuple[int, str, int]]:
    """(n, gram, k) of the `top` most frequent n-grams of all orders; ties by order, then by gram. What trivial_ngrams gives.

    An n-gram comes no more often than its first and its last n - 1 tokens. So once there are `top` n-grams of lower
    orders, one more matters only if both of these come more often than the last of them; there are fewer than `top` such,
    and the others are left out before anything is shuffled.
    """
    words, spark = df.select(tokens.alias("_tokens")), df.sparkSession
    best: list[tuple[int, str, int]] = []
    for n in range(1, orders + 1):
        floor = best[-1][2] if len(best) == top else 0
        if n == 1:
            grams = words.select(F.explode("_tokens").alias("gram"))
        else:
            left, m = F.col("_tokens"), F.greatest(F.size("_tokens") - (n - 1), F.lit(0))
            parts = words.select(m.alias("_m"), "_tokens", _shorter(left, n - 1).alias("_g")).filter("_m > 0")
            last = F.slice("_tokens", F.lit(n), F.col("_m"))
            both = F.arrays_zip(F.slice("_g", F.lit(1), F.col("_m")).alias("a"), F.slice("_g", F.lit(2), F.col("_m")).alias("b"), last.alias("t"))
            rows = parts.select(F.explode(both).alias("x")).select("x.a", "x.b", F.concat("x.a", F.lit(" "), "x.t").alias("gram"))
            if floor:
                able = spark.createDataFrame([(g,) for k, g, c in best if k == n - 1 and c > floor], "g string")
                able = F.broadcast(able)  # fewer than `top` rows
                rows = rows.join(able, F.col("a") == F.col("g"), "left_semi").join(able.withColumnRenamed("g", "h"), F.col("b") == F.col("h"), "left_semi")
            grams = rows.select("gram")
        counts = grams.groupBy("gram").agg(F.count("*").alias("k")).filter(F.col("k") > floor).orderBy(F.desc("k"), "gram").limit(top)
        best = sorted([*best, *((n, r["gram"], r["k"]) for r in counts.collect())], key=lambda x: (-x[2], x[0], x[1]))[:top]
        if floor and not any(k == n for k, _, _ in best):
            break
    return best


def _shorter(tokens: Column, n: int) -> Column:
    """All n-grams of n tokens, in order."""
    grams = tokens
    for k in range(2, n + 1):
        m = F.greatest(F.size(tokens) - (k - 1), F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), m), F.slice(tokens, F.lit(k), m), lambda g, t: F.concat(g, F.lit(" "), t))
    return grams


#: Places of all pairs that are stepped together, about: they fit a core's cache.
_CELLS = 1 << 12


def extended_edit_distances(pairs: list[tuple[str, str]]) -> list[float]:
    """extended_edit_distance of pairs, many of like length at once."""
    out, order = [0.0] * len(pairs), sorted(range(len(pairs)), key=lambda i: -len(pairs[i][0]))
    while order:
        together = max(1, _CELLS // (len(pairs[order[0]][0]) + 1))
        own, order = sorted(order[:together], key=lambda i: -len(pairs[i][1])), order[together:]
        for i, d in zip(own, _stepped([pairs[i] for i in own])):
            out[i] = d
    return out


def _stepped(pairs: list[tuple[str, str]]) -> list[float]:
    """Distances of pairs whose references become no longer from one to the next.

    Tables have a column for each pair. Deletions go from place to place, each adding to the one before, until no place
    gains: just what a pass from the first place on gives, also in how sums are rounded, on which ties depend.
    """
    codes = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    sizes, lengths = np.array([len(p) for p, _ in pairs]), np.array([len(r) for _, r in pairs])
    width = int(sizes.max()) + 1
    p, r = np.zeros((width - 1, len(pairs)), np.uint32), np.zeros((int(lengths.max()), len(pairs)), np.uint32)
    for k, (a, b) in enumerate(pairs):
        p[: len(a), k], r[: len(b), k] = codes(a), codes(b)
    outside = np.arange(width)[:, None] > sizes
    row, visits = np.ones((width, len(pairs))), np.full((width, len(pairs)), -1)
    row[0] = 0.0
    for j in range(len(r)):
        n = int(np.searchsorted(-lengths, -j, side="left"))  # pairs whose reference has this character
        c, now = r[j, :n], row[:, :n]
        step = np.empty((width, n))
        step[0] = now[0] + 1.0
        np.minimum(now[:-1] + (p[:, :n] != c), now[1:] + INSERTION, out=step[1:])
        gain = np.empty((width - 1, n))
        while True:
            for _ in range(4):
                np.minimum(step[1:], np.add(step[:-1], DELETION, out=gain), out=step[1:])
            if not (np.add(step[:-1], DELETION, out=gain) < step[1:]).any():
                break
        step[outside[:, :n]] = np.inf
        best, own = step.argmin(axis=0), np.arange(n)
        visits[best, own] += 1
        np.minimum(step, np.where(c == 32, JUMP + step[best, own], np.inf), out=row[:, :n])
    covered = COVERAGE * np.where(outside, 0, np.where(visits >= 0, visits, 1)).sum(axis=0).astype(float)
    ends = row[sizes, np.arange(len(pairs))]
    return [float(min(1.0, (e + c) / (n + c))) for e, c, n in zip(ends, covered, lengths)]


def extended_edit_distance(predicted: str, reference: str) -> float:
    """Edit distance by characters with jumps at the reference's spaces, and a charge for places visited more than once, in [0, 1]."""
    return extended_edit_distances([(predicted, reference)])[0]


@pandas_udf(T.DoubleType())
def tex_edit_distance(predicted, reference):
    """extended_edit_distance of the comparable text of each pair, in Arrow batches."""
    return pd.Series(extended_edit_distances([(tex.distance_text(p), tex.distance_text(r)) for p, r in zip(predicted, reference)]), dtype=float)


def mean_edit_distance(pairs: DataFrame, predicted: str = "predicted", reference: str = "ground_truth") -> DataFrame:
    """One row: the mean edit distance of pairs, scaled by 100."""
    return pairs.agg((F.avg(tex_edit_distance(F.col(predicted), F.col(reference))) * 100).alias("ted"))
