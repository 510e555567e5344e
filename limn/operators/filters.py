"""Row predicates over diagram code and compile logs, and the split into kept and dropped rows. All native columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from limn.functions.text import source

#: Code that holds one of these, in any case, is dropped.
BLACKLIST = (
    "rnd", "pgfmathsetseed", "bricks", "random", "includegraphics", "tikzducks", "tikzpeople", "tikzsymbols", "AddToHook", "lipsum",
    "example-image", "newpage", "animate", "addtobeamertemplate", "frame", "overlay-beamer-styles", "blindtext", "minipage", "TikzBox",
    "tikzlings", "pgfornament", "fontawesome", "tikzposter", "figure", "makeatletter", "pig", "tikzstyle", "filecontents",
)
#: Points allowed in one series, and in one axis.
SERIES_LIMIT, AXIS_LIMIT = 16, 96

#: Patterns of numbers, points, table lines and blocks, in Java's and RE2's syntax.
NUMBER = r"[-+]?(?:\d+\.\d+|\d+|\.\d+)(?:[eE][-+]?\d+)?"
POINT = rf"\(\s*{NUMBER}\s*,\s*{NUMBER}(?:\s*,\s*{NUMBER})?\s*\)"
TABLE_LINE = rf"(?m)^\s*{NUMBER}\s+{NUMBER}\s*(?:\\\\)?\s*(?:%.*)?$"
AXIS = r"(?s)\\begin\{axis\}.*?\\end\{axis\}"
COORDINATES = r"(?is)(?:plot\s+)?coordinates\s*\{(.*?)\}"
TABLE = r"(?is)(?:\\addplot.*?table(?:\[[^\]]*\])?|\\pgfplotstableread)\s*\{(.*?)\}"
PLOT = r"(?is)(?:\\draw|\\path)[^{};]*?plot[^{};]*?coordinates\s*\{(.*?)\}"

#: What a line of a compile log must not say.
LOG_PATTERNS = {
    "pgfplots_warning": r"(?i)Package pgfplots Warning:.*?(out of range|out of bounds|clipp|dropped|discarded|empty plot|could not be transformed)",
    "tikz_warning": r"(?i)Package tikz Warning:.*?(outside|not allowed outside|dimension too large|overflow|out of range|discarded)",
    "overfull": r"(?i)Overfull",
    "latex_error": r"! LaTeX Error:",
    "package_error": r"! Package .* Error:",
    "undefined": r"! Undefined control sequence",
    "missing": r"! Missing ",
    "emergency": r"! Emergency stop\.",
}


def blacklisted(code: Column, keywords: tuple[str, ...] = BLACKLIST) -> Column:
    """Whether code holds a keyword, as a substring, in any case. Null code doesn't."""
    lowered = F.lower(source(code))
    return reduce(Column.__or__, (F.contains(lowered, F.lit(k.lower())) for k in keywords))


def count_points(body: Column) -> Column:
    """Points of a series: coordinate tuples, or where there are none, lines of two numbers."""
    tuples = F.regexp_count(body, F.lit(POINT))
    return F.when(tuples > 0, tuples).otherwise(F.regexp_count(body, F.lit(TABLE_LINE)))


def _series(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), count_points)


def too_dense(code: Column, series: int = SERIES_LIMIT, axis: int = AXIS_LIMIT) -> Column:
    """Whether a series has too many points, in an axis or in a plain plot, or an axis all together."""
    text = source(code)
    counts = F.transform(F.regexp_extract_all(text, F.lit(AXIS), F.lit(0)), lambda a: F.concat(_series(a, COORDINATES), _series(a, TABLE)))
    total = lambda ns: F.aggregate(ns, F.lit(0), lambda s, n: s + n)
    dense = F.exists(counts, lambda ns: F.exists(ns, lambda n: n > series) | (total(ns) > axis))
    plots = F.exists(_series(text, PLOT), lambda n: n > series)
    # The cheap tests come first: most code has neither an axis nor a plot.
    return (F.contains(text, F.lit(r"\begin{axis}")) & dense) | (F.contains(F.lower(text), F.lit("plot")) & plots)


def log_findings(log: Column, patterns: dict[str, str] = LOG_PATTERNS) -> Column:
    """Names of the pattern families that a compile log holds, in their order."""
    return F.filter(F.array(*(F.when(log.rlike(p), F.lit(n)) for n, p in patterns.items())), lambda x: x.isNotNull())


def clean_log(log: Column) -> Column:
    """Whether a log holds none of the patterns; null: false."""
    return F.coalesce(~reduce(Column.__or__, (log.rlike(p) for p in LOG_PATTERNS.values())), F.lit(False))


def valid_image(cell: Column, marker: str = "__INVALID__:") -> Column:
    """Whether a normalised image reference is there and not marked as invalid."""
    return cell.isNotNull() & ~F.startswith(cell, F.lit(marker))


def too_small(data: Column, least: int = 1000) -> Column:
    """Whether a document's bytes are too few to be one; null counts as too small."""
    return F.coalesce(F.octet_length(data) < least, F.lit(True))


def tagged(df: DataFrame, code: str = "code", compiled: Column | None = None) -> DataFrame:
    """df with `reason`: the first predicate that drops the row (blacklist, density, compile), or null if it is kept.

    compiled: a column that says whether the code compiles with a clean log; null counts as not.
    """
    reason = F.when(blacklisted(F.col(code)), "blacklist").when(too_dense(F.col(code)), "density")
    if compiled is not None:
        reason = reason.when(~F.coalesce(compiled, F.lit(False)), "compile")
    return df.withColumn("reason", reason)


def stage_counts(df: DataFrame) -> DataFrame:
    """(reason, n): rows dropped for each reason; kept rows are under `kept`."""
    return df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds any of words, taken literally."""
    return "|".join(map(re.escape, words))
