"""Token bins, and samples of at most so many rows of each bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from limn.functions.text import source

#: Half-open bins of token counts.
BINS = ((0, 200), (200, 400), (400, 600), (600, 800), (800, 1200), (1200, 2000), (2000, 4096))


def parse_bins(spec: str | None) -> tuple[tuple[int, int], ...]:
    """Bins from text such as "0-200,200-400"; none: the default ones."""
    if not spec or not spec.strip():
        return BINS
    return tuple((int(a), int(b)) for a, _, b in (part.strip().partition("-") for part in spec.split(",") if part.strip()))


def whitespace_tokens(text: Column) -> Column:
    """Number of stretches between white space: the tokenizer where no other is given."""
    return F.regexp_count(source(text), F.lit(r"\S+")).cast("long")


def bin_index(n: Column, bins: tuple[tuple[int, int], ...] = BINS) -> Column:
    """Place of the first bin that holds n; null where none does."""
    out = F.lit(None).cast("int")
    for i, (low, high) in reversed(list(enumerate(bins))):
        out = F.when((n >= low) & (n < high), F.lit(i)).otherwise(out)
    return out


def token_bins(df: DataFrame, text: str = "code", tokens=whitespace_tokens, bins=BINS) -> DataFrame:
    """df with n_tokens and bin."""
    return df.withColumn("n_tokens", tokens(F.col(text))).withColumn("bin", bin_index(F.col("n_tokens"), bins))


def random_order(key: Column, seed: int) -> Column:
    """A pseudo-random order of keys that the seed fixes."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stratified(df: DataFrame, per_bin: int, key: str = "orig_id", strategy: str = "first", seed: int = 42, bins=BINS, text: str = "code", tokens=whitespace_tokens) -> DataFrame:
    """At most per_bin rows of each bin, with their rank `rn`: those of the smallest keys, or of a pseudo-random order.

    Rows outside all bins go. Spark limits each bin to per_bin rows before they are shuffled, so a bin of any size is fine.
    """
    if strategy not in ("first", "random"):
        raise ValueError(f"{strategy!r} is neither 'first' nor 'random'")
    binned = token_bins(df, text, tokens, bins).filter(F.col("bin").isNotNull())
    order = [F.col(key)] if strategy == "first" else [random_order(F.col(key), seed), F.col(key)]
    ranked = binned.withColumn("rn", F.row_number().over(Window.partitionBy("bin").orderBy(*order)))
    return ranked.filter(F.col("rn") <= per_bin)


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows of the smallest keys."""
    return df.orderBy(key).limit(n)


def dedupe_first(df: DataFrame, by: Column, key: str) -> DataFrame:
    """Of rows that are equal in `by`, that with the smallest key. Only keys and digests are shuffled for the choice."""
    chosen = df.groupBy(by.alias("_by")).agg(F.min(key).alias(key)).select(key)
    return df.join(chosen, key, "left_semi")
