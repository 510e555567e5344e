"""Best-fit packing of token sequences, with bounds that certify the number of bins.

Documents are cut into pieces of at most one sequence. Pieces are dealt at random to partitions of bounded size and
packed best-fit decreasing. Dual feasible functions give each partition a bound below which no packing can go; a
partition that meets its bound, not rounded, is certified. Those with a gap give up their emptiest bins; the pieces of these are dealt
anew, to far fewer partitions, which so exchange documents, and packed again, as long as that saves bins.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from limn.llm.common import need, utf8, written

CAPACITY = 2048
#: Pieces in a partition, about: what one task holds at once.
DEALT = 32_768
#: Bins that a partition gives up, its emptiest ones, for each bin that it has above its bound.
GIVEN = 16
#: Code points below this one are lower-cased and split alike by the tokenizer library and by Python (tested one by one).
SHARED_CODE_POINTS = 0x250
#: Words whose ids a worker keeps, of at most this many characters each; when full it starts anew. No result depends on it.
KEPT_WORDS, KEPT_CHARACTERS = 400_000, 64
#: The pre-token pattern of the tokenizer file with word ends.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = "\0"


class WordIds(dict):
    """Little-endian 32-bit ids of each lower-case stretch between white space, under a BPE vocabulary with word ends.

    The word end is a byte of its own here, whose pairs with the other bytes rank first, as the library has it. Merging
    by rank equals merging by listed pairs where each token has one pair and, alone, merges to itself; both are verified.
    """

    def __init__(self, path: str):
        self.tok = tok = Tokenizer.from_file(path)
        model = json.loads(tok.to_str())["model"]
        suffix, self.special = model["end_of_word_suffix"], [t.content for t in tok.get_added_tokens_decoder().values()]
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        if not suffix or model["dropout"] or model["byte_fallback"] or len(model["merges"]) != len(vocab) - 512:
            raise ValueError(f"{path} is not a plain byte-level BPE with word ends")
        letters = {i: t for t, i in vocab.items() if i < 256}
        byte = bytes_of_letters(tok)
        stem = lambda t: (t[: -len(suffix)], _END.encode()) if t.endswith(suffix) else (t, b"")
        ranks = {bytes(byte[c] for c in s) + end: i for t, i in vocab.items() for s, end in [stem(t)]}
        if len(ranks) != len(vocab) or len(letters) != 256 or any(len(tok.model.tokenize(s)) != 1 for t in vocab if (s := stem(t)[0]) and t.endswith(suffix)):
            raise ValueError(f"{path}: a token does not merge to itself")
        self.encode = tiktoken.Encoding(path, pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces, self.other = regex.compile(WORDS).findall, re.compile(f"[\\x00\\x1c-\\x1f]|[^\\x00-{chr(SHARED_CODE_POINTS - 1)}]")

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk + _END if chunk.isalpha() else "".join([p + _END for p in self.pieces(chunk)]))
        out = array("I", ids).tobytes()
        if len(chunk) <= KEPT_CHARACTERS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if any(map(text.__contains__, self.special)) or self.other.search(text):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


def bytes_of_letters(tok: Tokenizer) -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    show = lambda c: level.pre_tokenize_str(chr(c))[0][0]
    byte = {show(c): c for c in range(128)} | {show(0x80 | c)[1]: 0x80 | c for c in range(64)}
    leads = [(0xC0 | k, k << 6) for k in range(2, 32)] + [(0xE0 | k, max(k << 12, 0x800)) for k in range(16)] + [(0xF0 | k, max(k << 18, 0x10000)) for k in range(5)]
    byte |= {show(c)[0]: lead for lead, c in leads}
    never = iter([0xC0, 0xC1, *range(0xF5, 0x100)])  # no UTF-8 text has these
    return byte | {t: next(never) for t in ByteLevel.alphabet() if t not in byte}


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut where they exceed the capacity."""

    def run(batches):
        words = _word_ids(path)
        end, step = array("I", [end_id]).tobytes(), 4 * capacity
        for b in batches:
            rows = [[] for _ in range(5)]
            for doc, t in zip(b.column("doc_id").to_pylist(), utf8(b, "text")):
                ids = words.ids(t.decode("utf-8", "replace")) + end
                for k, a in enumerate(range(0, len(ids), step)):
                    own = ids[a : a + step]
                    for column, value in zip(rows, (doc, k, a // 4, len(own) // 4, zlib.crc32(own))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(rows)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity), and each bin's load. Ties: the earlier item, the latest bin."""
    bins, offsets, loads = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    some = 0  # bit r: a bin has room r
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        if fits := some >> n:
            room = n + (fits & -fits).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            k, room = len(loads), capacity
            loads.append(0)
        bins[i], offsets[i] = k, loads[k]
        loads[k] += n
        if left := room - n:
            free[left].append(k)
            some |= 1 << left
    return bins, offsets, np.array(loads, np.int64)


@cache
def _dual_feasible(capacity: int) -> list[tuple[int, np.ndarray]]:
    """(denominator, numerators by length) of dual feasible functions: no full bin's lengths sum to over 1."""
    x = np.arange(capacity + 1, dtype=np.int64)
    out = []
    for e in range(0, capacity // 2 + 1):  # lengths that leave no room for e take a whole bin; shorter than e, nothing
        out.append((capacity, np.where(x > capacity - e, capacity, np.where(x < e, 0, x))))
    for k in range(1, 33):  # rounded to multiples of 1 / k, but for multiples of 1 / (k + 1)
        out.append((k * capacity, np.where(x * (k + 1) % capacity == 0, x * k, x * (k + 1) // capacity * capacity)))
    for e in range(1, capacity // 2 + 1):  # a length from e to the half is one of floor(capacity / e); a longer one is what it displaces
        k = capacity // e
        out.append((k, np.where(2 * x > capacity, k - (capacity - x) // e, np.where(x >= e, 1, 0))))
    return out


def lower_bound(histogram: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs at least; histogram: pieces by length."""
    return max(-(-int(f @ histogram) // d) for d, f in _dual_feasible(capacity))


def excess(bins: int, histogram: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins above the bound before it is rounded up, rounded up: what partitions that pool their pieces could save."""
    return max(0, min(-(-(bins * d - int(f @ histogram)) // d) for d, f in _dual_feasible(capacity)))


def _round(items: DataFrame, number: int, capacity: int, dealt: int) -> DataFrame:
    """Deals items out, packs each partition, and says which bins are settled: all but the GIVEN emptiest for each bin of gap."""
    parts = max(1, -(-items.count() // dealt))
    names = [c for c in items.columns if c != "part"]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, loads = best_fit_decreasing(lengths, capacity)
        gap = excess(len(loads), np.bincount(lengths, minlength=capacity + 1), capacity)
        given = np.zeros(len(loads), bool)
        given[np.argsort(loads, kind="stable")[: GIVEN * gap]] = True
        return pdf[names].assign(sequence_id=bins + (number << 56) + (int(key[0]) << 24), offset=offsets, settled=~given[bins])

    kinds = dict(items.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long, settled boolean"
    keyed = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(parts)))
    return written(keyed.groupBy("part").applyInPandas(pack, schema), "packing")


def packed(items: DataFrame, capacity: int = CAPACITY, dealt: int = DEALT, rounds: int = 12) -> DataFrame:
    """items (length from 1 to capacity, other columns) with sequence_id and offset, in as few sequences as found.

    Reruns over the same rows in other partitions may deal otherwise, and pack as well. Of each round only unsettled bins
    go on, and it counts only if it saves bins. There are `rounds` rounds at most, and a partition gives up GIVEN bins for
    each bin of gap: both bound the search for savings, every item is packed whatever they are. An empty table gives an
    empty result.
    """
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "packing-items")
    now, done = _round(items, 0, capacity, dealt), []
    for number in range(1, rounds):
        open_bins = now.filter(~F.col("settled"))
        bins = open_bins.agg(F.countDistinct("sequence_id")).first()[0]
        if bins <= 1:
            break
        lengths = open_bins.groupBy("length").count().collect()  # no more rows than the capacity
        histogram = np.zeros(capacity + 1, np.int64)
        for r in lengths:
            histogram[r["length"]] = r["count"]
        if bins == lower_bound(histogram, capacity):
            break
        again = _round(open_bins.select(items.columns), number, capacity, dealt)
        if again.agg(F.countDistinct("sequence_id")).first()[0] >= bins:
            break
        done.append(now.filter("settled"))
        now = again
    for d in done:
        now = now.unionByName(d)
    return now.drop("item", "settled")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs (doc_id, text).

    path: a tokenizer file that every executor has. Null and empty texts have the end id alone. Repeated rows are packed
    as often as they come; null ids stay null; an empty table gives an empty result; other columns are ignored.
    """
    return packed(pieces(docs, path, capacity), capacity)
