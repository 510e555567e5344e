"""Token counts by a whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone: those that give one token are proven whole.
A text is split into pre-tokens; whole ones count one, only the rest are merged, once per worker while they are kept.
"""

from __future__ import annotations

import json
import re
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from limn.llm.common import need, utf8

#: Code points below this one are split alike by the tokenizer library and by `regex` (tested one by one). Each other one
#: is tried where it first comes: the two know different versions of Unicode.
SHARED_CODE_POINTS = 0x250
#: Stretches whose counts a worker keeps, of at most this many characters each; when full it starts anew. No result depends on it.
KEPT_STRETCHES, KEPT_CHARACTERS = 500_000, 64
#: With one of these in a text, a space may not begin a pre-token, or other white space may come next to one.
ODD_BLANKS = ("  ", " \n", "\n ", "\t", "\v", "\f", "\r", "\x85", "\xa0")
#: Spaces between two characters that no version of Unicode holds for white space: each begins a pre-token.
_BETWEEN = re.compile(r"(?<=[^\s\u180e\u200b-\u200d\u2060\ufeff]) (?=[^\s\u180e\u200b-\u200d\u2060\ufeff])")
#: The pre-token pattern of the byte-level tokenizer files.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Alike(dict):
    """Whether a character is split alike by the tokenizer library and by `regex`: tried where it first comes.

    The pattern tells letters, numbers, white space and others apart, so one string that splits differently for each of
    these proves that both take a character for the same kind.
    """

    def __init__(self, tok: Tokenizer):
        self.split, self.pieces = tok.pre_tokenizer.pre_tokenize_str, regex.compile(BYTE_LEVEL).finditer

    def __missing__(self, c: str) -> bool:
        s = f"a{c}1 {c}"
        self[c] = [o for _, o in self.split(s)] == [m.span() for m in self.pieces(s)]
        return self[c]

    def all(self, text: str) -> bool:
        return text.isascii() or all(map(self.__getitem__, set(text)))


def whole_tokens(path: str) -> frozenset[str]:
    """The strings that are one pre-token and encode alone as one token: proven by encoding each vocabulary string.

    Strings with characters that the shortcut can't split itself are left out.
    """
    tok = Tokenizer.from_file(path)
    special, alike = {t.content for t in tok.get_added_tokens_decoder().values()}, Alike(tok)
    text = sorted({tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())} - special - {""})
    pattern = regex.compile(BYTE_LEVEL)
    able = [t for t in text if alike.all(t) and pattern.fullmatch(t)]
    return frozenset(t for t, e in zip(able, tok.encode_batch(able, add_special_tokens=False)) if len(e.ids) == 1)


def ranks(tok: Tokenizer) -> dict[bytes, int]:
    """The bytes of each ordinary token, by rank of merge.

    The library merges listed pairs, a table of ranks any pair that forms a known token. They agree where each token
    but the single bytes has one listed pair, and each, alone, is merged to itself: then, in any text, what lies
    between a token's ends has merged as it does alone before the token forms. Both are verified here.
    """
    model = json.loads(tok.to_str())["model"]
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    show = lambda c: tok.pre_tokenizer.pre_tokenize_str(chr(c))[0][0]
    byte = {show(c): c for c in range(128)} | {show(0x80 | c)[1]: 0x80 | c for c in range(64)}
    leads = [(0xC0 | k, k << 6) for k in range(2, 32)] + [(0xE0 | k, max(k << 12, 0x800)) for k in range(16)] + [(0xF0 | k, max(k << 18, 0x10000)) for k in range(5)]
    byte |= {show(c)[0]: lead for lead, c in leads}
    never = iter([0xC0, 0xC1, *range(0xF5, 0x100)])  # no UTF-8 text has these bytes, yet the vocabulary has them
    byte |= {t: next(never) for t in vocab if len(t) == 1 and t not in byte}
    plain = not (model["dropout"] or model["byte_fallback"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"])
    if not plain or len(model["merges"]) != len(vocab) - 256 or any(len(tok.model.tokenize(t)) != 1 for t in vocab):
        raise ValueError("this vocabulary is not one of plain byte pairs by rank")
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


class Counter(dict):
    """Tokens of a stretch of text that begins with a space; unknown stretches are split, shortcut and merged once.

    A space after a non-space always begins a pre-token, so stretches between such spaces count on their own.
    """

    def __init__(self, path: str, whole: frozenset[str]):
        self.tok, self.whole = Tokenizer.from_file(path), whole
        if self.tok.normalizer is not None or type(self.tok.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError(f"{path} is not a byte-level tokenizer without a normalizer")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces, self.other = regex.compile(BYTE_LEVEL).findall, re.compile(f"[^\\x00-{chr(SHARED_CODE_POINTS - 1)}]")
        self.alike = Alike(self.tok)
        # What is merged is one pre-token already: this pattern takes it whole.
        self.merge = tiktoken.Encoding(path, pat_str=r"(?s).+", mergeable_ranks=ranks(self.tok), special_tokens={}).encode_ordinary

    def stretch(self, text: str) -> int:
        whole, merge = self.whole, self.merge
        return sum(1 if p in whole else len(merge(p)) for p in self.pieces(text))

    def __missing__(self, chunk: str) -> int:
        if chunk.isalpha():  # then it is one pre-token, with its space
            n = 1 if (piece := " " + chunk) in self.whole else len(self.merge(piece))
        else:
            n = self.stretch(" " + chunk)
        if len(chunk) <= KEPT_CHARACTERS:
            if len(self) >= KEPT_STRETCHES:
                self.clear()
            self[chunk] = n
        return n

    def by_library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        """Tokens of a text. Special strings make it the library's; characters that it may split otherwise, their stretches."""
        if any(map(text.__contains__, self.special)):
            return self.by_library(text)
        if not text.isascii() and self.other.search(text):
            if self.alike.all(text):
                return self.stretch(text)
            parts = _BETWEEN.sub("\0 ", text).split("\0") if "\0" not in text else [text]
            return sum(self.stretch(p) if self.alike.all(p) else self.by_library(p) for p in parts)
        if text[:1] == " " or text[-1:] == " " or any(map(text.__contains__, ODD_BLANKS)):
            return self.stretch(text)
        first, *rest = text.split(" ")
        return self.stretch(first) + sum(map(self.__getitem__, rest))


@cache
def _counter(path: str, whole: frozenset[str]) -> Counter:
    return Counter(path, whole)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text).

    path: a byte-level tokenizer file that every executor has. No begin, end or added tokens; special strings in texts
    count as the library counts them. Null and empty texts have no bytes and no tokens; null ids and repeated rows
    return as they are; an empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # no more strings than the vocabulary has

    def run(batches):
        counter = _counter(path, sent.value)
        for b in batches:
            n_bytes, n_tokens = [], []
            for t in utf8(b, "text"):
                n_bytes.append(len(t))
                n_tokens.append(counter.count(t.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
