"""Mixing sources to target weights, as a curriculum whose weights change over time. DataFrame operations only.

Each source's weight is spread over training time by a curve. Its integral is the cumulative demand for the source's
words; documents stand in a fixed pseudo-random order within their source, and a document is trained on where the
demand reaches its words: its position is the inverse of the cumulative demand. Passes over a source repeat it.
All running sums are distributed: rows are range-partitioned, summed within partitions, and partitions' totals, of
which there are as many as partitions, give where each begins. So one source may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from limn.llm.common import order_hash, written

#: A word, as Java's regular expressions have it.
WORD = r"[^\x20\x09-\x0D]+"
#: (time, rate) knots from time 0 to 1, linear in between, by weight class: early, even, late.
CURVES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its nth word, as it stands."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(ends, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "")


def running(df: DataFrame, order: list[str], sums: dict[str, str], name: str, found: DataFrame | None = None, key: str = "") -> DataFrame:
    """df with, for each new column of sums, the sum of the old column over all rows before this one.

    found: a table with one row for each value of key (null too), by which the rows are ordered; its other columns are
    joined. They are dealt out by partition and key, so a key with any share of the rows is split as the rows are.
    """
    own = [f"_own_{s}" for s in sums]
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("_part").agg(*(F.sum(v).alias(o) for o, v in zip(own, sums.values())))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *(F.coalesce(F.sum(o).over(before), F.lit(0)).alias(o) for o in own))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(s) for s, v in sums.items()))
    joined = within.join(F.broadcast(starts), "_part")  # no more rows than partitions
    summed = joined.withColumns({s: F.col(s) + F.col(o) for s, o in zip(sums, own)})
    if found is not None:
        parts = dealt.select(F.col("_part").alias("_at"), F.col(key).alias("_key")).distinct()  # partitions and keys rows at most
        by_part = parts.join(found.withColumnRenamed(key, "_of"), F.col("_key").eqNullSafe(F.col("_of"))).drop("_of")
        summed = summed.join(by_part, (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key"))).drop("_at", "_key")
    return summed.drop("_part", *own)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3) -> DataFrame:
    """sizes (source, source_size: one row a source) with class (of the weights), weight, base and target.

    Sources take the weights in turn, by code point, null last; base: words of all sources before. Targets share
    `share` of all words by weight; none exceeds cap times its source's words, and what exceeds it is reshared.
    """
    ranked = running(sizes.withColumns({"last": F.col("source").isNull(), "one": F.lit(1)}), ["last", "source"], {"rank": "one", "base": "source_size"}, "mixing-sources")
    kind = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    weighed = ranked.withColumn("class", kind).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1).cast("long")).drop("one", "rank")
    limited = weighed.withColumn("limit", F.col("source_size") * cap).withColumn("ratio", F.col("limit") / F.col("weight"))
    filled = running(limited, ["ratio", "last", "source"], {"limits": "limit", "weights": "weight"}, "mixing-limits")
    whole = filled.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    words_all, weight_all = (whole["n"] or 0) if share == 1 else int((whole["n"] or 0) * share), whole["w"] or 1
    exact = lambda c: c.cast("decimal(38,0)")
    # In order of limit by weight, a source is limited if its share of what those before it have left exceeds its limit.
    stopped = (exact(F.lit(words_all)) - exact(F.col("limits"))) * F.col("weight") > exact(F.col("limit")) * (F.lit(weight_all) - F.col("weights"))
    marked = written(filled.withColumn("stopped", stopped), "mixing-marked")
    gone = marked.filter("stopped").agg(F.sum("limit").alias("n"), F.sum("weight").alias("w")).first()
    left = weight_all - (gone["w"] or 0)
    level = (words_all - (gone["n"] or 0)) / left if left else 0.0
    target = F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(F.least(F.col("weight") * F.lit(float(level)), F.col("limit").cast("double")))
    return marked.select("source", "source_size", "class", "weight", "base", target.alias("target"))


def position(done: Column, curve: tuple[tuple[float, float], ...]) -> Column:
    """The time in [0, 1] at which a share `done` of a source's demand is met, under its curve of rates."""
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(curve, curve[1:])]
    if curve[0][0] != 0 or curve[-1][0] != 1 or min(areas) < 0 or sum(areas) <= 0:
        raise ValueError("a curve goes from time 0 to 1, with rates of which none is negative and some are above 0")
    need, before, out = done * F.lit(sum(areas)), 0.0, F.lit(1.0)
    parts = []
    for ((t0, a), (t1, b)), area in zip(zip(curve, curve[1:]), areas):
        y, slope = F.greatest(need - F.lit(before), F.lit(0.0)), (b - a) / (t1 - t0)
        root = F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * y, F.lit(0.0)))
        parts.append((before + area, F.least(F.lit(t0) + F.when(root > 0, 2 * y / root).otherwise(0.0), F.lit(t1))))
        before += area
    for end, inverse in reversed(parts):
        out = F.when(need <= F.lit(end), inverse).otherwise(out)
    return out


def mixed(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3, curves=CURVES) -> DataFrame:
    """rows (doc_id, source, size, other columns) as (row, mix): mix holds what the mix takes of each row.

    mix: source_size, target, taken (words, repeats counted), budget, start (the row's first word in its source's
    order), first (position of its first taken word, null where none is). A source's taken words are its target,
    rounded: only the document that the demand ends in is taken in part. Reruns agree. No row is lost: those of size 0
    take 0; null sources are a source, the last; repeated rows each have a place; an empty table gives an empty result.
    """
    laid = rows.select(F.struct(*rows.columns).alias("row"), F.col("source").isNull().alias("last"), F.col("source"), order_hash(F.col("doc_id")).alias("order"), F.col("doc_id").alias("tie"), F.col("size").alias("words"))
    sizes = written(laid.groupBy("source").agg(F.sum("words").alias("source_size")), "mixing-sizes")
    goal = targets(sizes, weights, share, cap).select("source", F.struct("source_size", "class", "base", "target").alias("goal"))
    j = running(laid, ["last", "source", "order", "tie", "words"], {"before": "words"}, "mixing-rows", goal, "source")
    size, n = F.col("words"), F.col("goal.source_size")
    j = j.withColumn("budget", F.round("goal.target").cast("long")).withColumn("start", F.col("before") - F.col("goal.base"))
    j = j.withColumn("passes", F.when(n > 0, F.floor(F.col("budget") / n)).otherwise(0).cast("long"))
    j = j.withColumn("passes", F.col("passes") - F.when(F.col("passes") * n > F.col("budget"), 1).otherwise(0))
    part = F.least(F.greatest(F.col("budget") - F.col("passes") * n - F.col("start"), F.lit(0)), size)
    j = j.withColumn("taken", F.col("passes") * size + part)
    j = j.withColumn("first", F.when(F.col("taken") > 0, _position(F.col("start") / F.col("budget"), F.col("goal.class"), curves, len(weights))))
    return j.select("row", F.struct("goal.source_size", "goal.target", "goal.class", "taken", "budget", "start", size.alias("size"), "first").alias("mix"))


def _position(done: Column, kind: Column, curves, classes: int) -> Column:
    if len(curves) != classes:
        raise ValueError("one curve for each weight")
    out = F.lit(None).cast("double")
    for k, curve in enumerate(curves):
        out = F.when(kind == k, position(done, curve)).otherwise(out)
    return out


def curriculum(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3, curves=CURVES, whole: bool = False) -> DataFrame:
    """The rows of docs (doc_id, text, source, other columns) as often as the mix takes them, sorted by training position.

    A row of size n that is taken for k * n + m words comes k times whole and, if m > 0, once with its first m words
    (and n_chars, where docs has it, as long as that text). With `whole` that last copy is whole instead, or left out
    where that is nearer to the m words. Partitions are ranges of positions. Documents without a word, so null and empty
    texts, are not taken. Null sources are a source, the last; repeated rows are each taken; null ids stay null; an empty
    table gives an empty result; other columns stay as they are, whatever their names.
    """
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("doc"))
    mix = mixed(rows, weights, share, cap, curves).filter("mix.taken > 0").withColumn("row", F.col("row.doc"))
    m = lambda c: F.col(f"mix.{c}")
    times = (F.round if whole else F.ceil)(m("taken") / m("size")).cast("int")
    copies = mix.filter(times > 0).select("*", F.posexplode(F.sequence(F.lit(1), times)).alias("copy", "nth"))
    start = F.col("copy") * m("source_size") + m("start")
    take = m("size") if whole else F.least(m("size"), m("taken") - F.col("copy") * m("size"))
    timed = copies.select("row", take.alias("take"), m("size").alias("size"), _position(start / m("budget"), m("class"), curves, len(weights)).alias("position"), F.xxhash64("row.doc_id", "copy").alias("tie"))
    text = F.when(F.col("take") < F.col("size"), first_words(F.col("row.text"), F.col("take"))).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("take") < F.col("size"), F.char_length(text).cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    ordered = timed.repartitionByRange("position", "tie").sortWithinPartitions("position", "tie")
    return ordered.select(*((changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3, curves=CURVES) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position) for each row of docs (doc_id, text, source), by position."""
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mixing-sized")
    mix = mixed(sized, weights, share, cap, curves)
    out = mix.select("row.doc_id", "row.size", "mix.source_size", "mix.target", "mix.taken", F.col("mix.first").alias("position"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
