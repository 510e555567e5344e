"""A small lexer of LaTeX source."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # command, comment, open, close, optional, math, builtin or text
    value: str


_LEXER = re.compile(
    r"(?P<comment>%[^\n]*\n?)|(?P<command>\\(?:[A-Za-z@]+\*?|.|\n))|(?P<open>\{)|(?P<close>\})|(?P<optional>[\[\]])|(?P<math>\$\$?)|(?P<builtin>[&^_~#])|(?P<text>[^%\\{}\[\]$&^_~#]+)|(?P<lone>\\)",
    re.DOTALL,
)


def lex(code: str) -> list[Token]:
    """All of code as tokens; their values join to it again."""
    return [Token("text" if m.lastgroup == "lone" else m.lastgroup, m[0]) for m in _LEXER.finditer(code)]


_PARTS = re.compile(r"\w+(?:[.,]\w+)*|[^\w\s]")


def words(code: str | None) -> list[str]:
    """Tokens for n-gram metrics: comments go; text, options and braces are split into words and marks; commands stay whole."""
    out: list[str] = []
    for t in lex(code or ""):
        if t.kind == "comment":
            continue
        out += [t.value] if t.kind == "command" else _PARTS.findall(t.value)
    return out


#: Abbreviations after which a stop isn't split off.
_TITLES = r"(Dr|Jr|Prof|Rev|Gen|Mr|Mt|Mrs|Ms)"


def english(text: str) -> str:
    """Text with its marks split off by a space, as sentence metrics of English take it."""
    t = re.sub(r"([.!?,])", r" \1", text.rstrip())
    t = re.sub(r"\s+", " ", t)
    t = re.sub(r"(\d) ([.,]) (\d)", r"\1\2\3", t)
    t = re.sub(_TITLES + r" \.", r"\1.", t)
    return t.replace("e . g .", "e.g.").replace("i . e .", "i.e.").replace("U . S .", "U.S.")


def distance_text(code: str | None) -> str:
    """The text that the edit distance compares: tokens without comments, prose as English, padded with a space."""
    parts: list[str] = []
    for t in lex(code or ""):
        if t.kind == "text":
            parts += english(t.value).split()
        elif t.kind != "comment":
            parts += t.value.split()
    return f" {' '.join(parts)} "
