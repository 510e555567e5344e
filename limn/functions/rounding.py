"""Numeric literals in diagram code, rounded to four significant figures where that can't change its meaning.

Substitution by a function of the match has no native form, so whole columns go through one Arrow UDF.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from limn.operators.filters import COORDINATES, TABLE

FIGURES = 4
#: Option keys whose numbers are rounded. All others stay.
ROUNDED_KEYS = frozenset("pos out in xshift yshift shift rotate scale xscale yscale xmin xmax ymin ymax zmin zmax opacity".split())

#: Patterns of literals and of what stands around those that are rounded.
_DIGITS = r"(?:\d+\.\d+|\d+|\.\d+)(?:[eE][-+]?\d+)?"
_SIGNED = r"[-+]?" + _DIGITS
_LITERAL = re.compile(r"(?:^|(?<=[\s,;=({\[+-]))\+?-?" + _DIGITS + r"(?=$|[\s,;:)}\]%])")
_TUPLE = re.compile(rf"\s*{_SIGNED}(?:\s*,\s*{_SIGNED}){{1,2}}\s*\Z")
_PARENTHESIS = re.compile(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)")
_OPTION = re.compile(rf"(?P<key>[A-Za-z@/_]+)\s*=\s*(?P<number>{_SIGNED})(?=$|[\s,;\]}}])")
#: Spans all of whose literals are rounded: the body is the group.
_BODIES = (
    re.compile(r"\\definecolor\{[^}]+\}\{rgb\}\{([^}]*)\}"),
    re.compile(COORDINATES),
    re.compile(TABLE),
)


def round_literal(literal: str) -> str:
    """One literal to four figures, with as many decimals as it had. Exponents, leading zeros and long integers stay."""
    sign, digits = literal[: len(literal) - len(literal.lstrip("+-"))], literal.lstrip("+-")
    if "e" in digits.lower() or (digits.isdigit() and len(digits) > 1 and digits[0] == "0"):
        return literal
    try:
        value = float(literal)
    except ValueError:
        return literal
    places = FIGURES - 1 - math.floor(math.log10(abs(value))) if value else 0
    value = round(value, max(places, 0)) if value else 0.0
    whole, point, decimals = digits.partition(".")
    if point:
        text = f"{value:.{len(decimals)}f}"
        if not whole:
            text = re.sub(r"\A(-?)0\.", r"\1.", text)
    else:
        text = str(int(value)) if value == int(value) else str(value)
    return "+" + text if sign.startswith("+") and text[0] not in "+-" else text


def round_span(text: str) -> str:
    """All literals of a span that stand by themselves."""
    return _LITERAL.sub(lambda m: round_literal(m[0]), text)


def _body(m: re.Match) -> str:
    whole, a, b = m[0], m.start(1) - m.start(), m.end(1) - m.start()
    return whole[:a] + round_span(whole[a:b]) + whole[b:]


def _option(m: re.Match) -> str:
    return f"{m['key']}={round_literal(m['number'])}" if m["key"].lower() in ROUNDED_KEYS else m[0]


def round_code(code: str | None) -> str | None:
    """Colours, coordinates, tables, bare number tuples and plain options of code, in this order."""
    if not code:
        return code
    for pattern in _BODIES:
        code = pattern.sub(_body, code)
    code = _PARENTHESIS.sub(lambda m: f"({round_span(m[1])})" if _TUPLE.match(m[1]) else m[0], code)
    return _OPTION.sub(_option, code)


@pandas_udf(T.StringType())
def rounded(code):
    """round_code of each row, in Arrow batches."""
    return code.map(round_code)


@pandas_udf(T.StringType())
def rounded_literal(literal):
    """round_literal of each row, in Arrow batches."""
    return literal.map(lambda x: None if x is None else round_literal(x))


def round_numbers(df: DataFrame, column: str = "code") -> DataFrame:
    """df with the literals of a column rounded."""
    return df.withColumn(column, rounded(F.col(column)))
