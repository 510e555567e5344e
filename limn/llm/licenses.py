"""License notices in texts: exact phrases, and short notices with a bounded number of edits.

A notice that may have k edits is cut into k + 1 seeds; whatever matches it holds one of them unchanged. Where a seed
stands, the regex library matches the whole notice with at most k errors in a window around it, and gives the span.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from limn.llm.common import need, utf8

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices, their labels and the edits allowed in each.
NOTICES = {
    "gnu general public license": ("gpl", 3),
    "gnu lesser general public license": ("lgpl", 3),
    "licensed under the apache license": ("apache", 3),
    "apache license version 2 0": ("apache", 3),
    "released under the mit license": ("mit", 3),
    "licensed under the mit license": ("mit", 3),
    "permission is hereby granted free of charge": ("mit", 4),
    "redistribution and use in source and binary forms": ("bsd", 4),
    "mozilla public license": ("mpl", 2),
    "creative commons attribution": ("cc-by", 3),
}
_WORD_BYTES = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normalized(text: bytes) -> bytes:
    """A text's words, A-Z as a-z, each after one space; what is neither ASCII letter or digit nor beyond ASCII parts words."""
    return b"".join([b" " + w for w in text.translate(_WORD_BYTES).split()])


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """(place, seed): the notice cut into edits + 1 parts of nearly equal length."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def _matchers(notices: tuple) -> list:
    return [(n, label, k, seeds(n, k), regex.compile(f"(?e)(?<= )(?:{regex.escape(n)}){{e<={k}}}(?= )")) for n, label, k in notices]


def fuzzy_spans(words: str, notices: dict[str, tuple[str, int]] = NOTICES) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of notices in words (as `normalized` gives them, with a space after): spans of characters.

    A span begins and ends at words. Windows of one notice that touch are searched as one; spans of one don't overlap.
    """
    found = []
    for notice, label, k, parts, pattern in _matchers(tuple((n, *v) for n, v in notices.items())):
        windows: list[list[int]] = []
        places = []
        for at, seed in parts:
            i = words.find(seed)
            while i >= 0:
                places.append((i - at - k - 1, i - at + len(notice) + k + 1))
                i = words.find(seed, i + 1)
        for a, b in sorted(places):
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(b, windows[-1][1])
            else:
                windows.append([max(a, 0), b])
        for a, b in windows:
            found += [(label, m.start(), m.end(), sum(m.fuzzy_counts)) for m in pattern.finditer(words, a, b + 1)]
    return found


def scan(text: bytes, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, int]] = NOTICES) -> dict:
    """What a text in UTF-8 tells: n_words, base places (label, first word), and spans (label, first word, words, edits).

    A word's number is that of the space before it, looked up in the spaces' places: time grows with the text and its hits.
    """
    line = normalized(text) + b" "
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    base = []
    for phrase, label in phrases.items():
        needle, i, places = b" " + phrase.encode() + b" ", -1, []
        while (i := line.find(needle, i + 1)) >= 0:
            places.append(i)
        base += [(label, w) for w in np.searchsorted(spaces, places).tolist()]
    words = line.decode("utf-8", "replace")
    found = fuzzy_spans(words, notices)
    if found and len(words) != len(line):
        spaces = np.flatnonzero(np.frombuffer(words.encode("utf-32-le", "replace"), "<u4") == 32)
    first, end = (np.searchsorted(spaces, [f[k] for f in found]).tolist() for k in (1, 2))
    spans = [(label, a - 1, b - a + 1, e) for (label, _, _, e), a, b in zip(found, first, end)]
    return {"n_words": len(spaces) - 1, "base": base, "spans": spans}


def license_spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, int]] = NOTICES) -> DataFrame:
    """(doc_id, n_words, base array of (label, word), spans array of (label, word, words, edits)) for each row of docs.

    Null and empty texts have no words. Null ids and repeated rows return as they are; an empty table gives an empty
    result; other columns are ignored.
    """
    kind = "doc_id long, n_words long, base array<struct<label: string, word: long>>, spans array<struct<label: string, word: long, words: long, edits: long>>"
    of = lambda *names: pa.list_(pa.struct([(n, pa.string() if n == "label" else pa.int64()) for n in names]))

    def run(batches):
        for b in batches:
            told = [scan(t, phrases, notices) for t in utf8(b, "text")]
            base = [[dict(zip(("label", "word"), x)) for x in t["base"]] for t in told]
            spans = [[dict(zip(("label", "word", "words", "edits"), x)) for x in t["spans"]] for t in told]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t["n_words"] for t in told], pa.int64()), pa.array(base, of("label", "word")), pa.array(spans, of("label", "word", "words", "edits"))], ["doc_id", "n_words", "base", "spans"])

    return need(docs, "doc_id", "text").mapInArrow(run, kind)
