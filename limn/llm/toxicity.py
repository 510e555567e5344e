"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams and of itself, so an unseen misspelling shares most
of its vectors with the word it stems from. A window of consecutive words is the mean of its words; a document is as
toxic as its two most toxic windows, so a few words in a long text aren't averaged away. As the softmax is linear, each
n-gram's vector comes down to one number when scoring, and each distinct word to one more.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limn.llm.common import need, utf8
from limn.llm.labelled import calibrated, fitted, held_out, sigmoid, training_rows

#: The bound of the training sample: rows, and bytes of each text.
ROWS, LONGEST = 5_000, 20_000
BUCKETS, DIMENSIONS, WINDOW, TOPS = 1 << 17, 8, 8, 2
GRAMS = (3, 4, 5)
THRESHOLD = 0.7
#: Words whose score a worker keeps; when full it starts anew. No result depends on it.
KEPT_WORDS, KEPT_BYTES = 250_000, 48
_EDGES = b".,;:!?\"'()[]{}%&#$*|"


def tokens(text: bytes) -> list[bytes]:
    """Stretches between white space of a text in UTF-8, in lower case."""
    return text.decode("utf-8", "replace").lower().encode().split()


def grams(token: bytes) -> list[int]:
    """Buckets of a word, without punctuation at its ends, and of its character n-grams, with marks at both ends."""
    w = b"<" + token.strip(_EDGES) + b">"
    crc, mask = zlib.crc32, BUCKETS - 1
    out = [crc(w) & mask]
    for n in GRAMS:
        out += [crc(w[i : i + n], n) & mask for i in range(len(w) - n + 1)]
    return out


class Model:
    """Numbers by bucket, the score of a usual clean word, and the curve from a document's raw score to a probability."""

    def __init__(self, numbers: np.ndarray, usual: float, bias: float, curve: tuple[float, float], name: str):
        self.numbers, self.usual, self.bias, self.curve, self.name = numbers, usual, bias, curve, name


def windows(n: int) -> np.ndarray:
    """Where the windows of n words begin; the last one takes what is left, up to nearly two windows."""
    return np.arange(0, max(n - WINDOW + 1, 1), WINDOW)


def raw_score(s: np.ndarray, model: Model) -> float:
    """The mean of the TOPS largest means of a window of words' scores; usual clean words fill up less than one window."""
    if len(s) < WINDOW:
        return model.bias + (float(s.sum()) + (WINDOW - len(s)) * model.usual) / WINDOW
    at = windows(len(s))
    means = np.add.reduceat(s, at) / np.diff(at, append=len(s))
    return model.bias + float((np.partition(means, -TOPS)[-TOPS:] if len(means) > TOPS else means).mean())


class Scorer(dict):
    """Score of each word under a model."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.number = model, model.numbers.tolist().__getitem__

    def __missing__(self, token: bytes) -> float:
        g = grams(token)
        s = sum(map(self.number, g)) / len(g)
        if len(token) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[token] = s
        return s

    def raw(self, text: bytes) -> float:
        """raw_score of the text's words."""
        words = tokens(text)
        return raw_score(np.fromiter(map(self.__getitem__, words), float, len(words)), self.model)

    def score(self, text: bytes) -> float:
        a, b = self.model.curve
        return float(sigmoid(a * self.raw(text) + b))


class _Learner:
    """Embeddings of buckets and a two-class softmax, learned together.

    The classes' vectors only matter by their difference d, so a bag's gradient is its error times d for each of its
    buckets, and d's is the sum of the buckets' vectors by the same errors: one number a bucket carries both.
    """

    def __init__(self, seed: int, rate: float):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
        self.d = rng.normal(0, 0.3, DIMENSIONS)
        self.bias, self.rate = 0.0, rate
        self.seen, self.seen_d, self.seen_bias = np.full(BUCKETS, 1e-8), np.full(DIMENSIONS, 1e-8), 1e-8

    def numbers(self) -> np.ndarray:
        return self.embed @ self.d

    def step(self, index: np.ndarray, share: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step on bags: buckets, their shares, the bag of each, and the bags' labels and weights."""
        logits = np.bincount(bag, share * self.numbers()[index], len(y)) + self.bias
        error = (sigmoid(logits) - y) * weight
        c = np.bincount(index, share * error[bag], BUCKETS)
        on = np.flatnonzero(c)
        down = c[on] @ self.embed[on]
        self.seen[on] += c[on] ** 2
        self.seen_d += down**2
        self.seen_bias += error.sum() ** 2
        self.embed[on] -= (self.rate * c[on] / np.sqrt(self.seen[on]))[:, None] * self.d
        self.d -= 0.2 * self.rate * down / np.sqrt(self.seen_d)
        self.bias -= 0.2 * self.rate * error.sum() / np.sqrt(self.seen_bias)


def fit(texts: list[str], labels, bags: int = 2, epochs: int = 12, rate: float = 0.1, batch: int = 64, seed: int = 7) -> Model:
    """Trains embeddings and softmax jointly by adaptive gradients.

    The first `bags` epochs see each document as one bag of all its words. Then each document stands for its most toxic
    windows so far, and one that isn't toxic for a random one too. Both labels weigh the same. Without both labels,
    or without a word in any text, every score is the same.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, (0.0, 6.0 if y.any() else -6.0), "constant")
    known: dict[bytes, int] = {}
    docs = []
    for t in texts:
        words = tokens(t.encode())
        docs.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
    if not known:  # nothing to learn from: every score is the share of label 1
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, (0.0, float(np.log(y.mean() / (1 - y.mean())))), "constant")
    packed, length = array("i"), array("i")
    for w in known:
        g = grams(w)
        packed.extend(g)
        length.append(len(g))
    del known
    flat, length = np.frombuffer(packed, np.int32), np.frombuffer(length, np.int32) if length else np.zeros(1, np.int32)
    starts = np.concatenate([[0], np.cumsum(length)])
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    learner = _Learner(seed, rate)

    def train(chosen: list[np.ndarray], own: np.ndarray, gain: float = 1) -> None:
        words = np.concatenate(chosen)
        of = np.repeat(np.arange(len(chosen)), [len(x) for x in chosen])
        n = length[words]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = np.array([len(x) for x in chosen])
        share = np.repeat(gain / (n * size[of]), n)
        learner.step(flat[np.repeat(starts[words], n) + within], share, np.repeat(of, n), y[own], balance[own])

    full = [i for i in range(len(docs)) if len(docs[i])]
    for epoch in range(bags + epochs):
        if epoch >= bags:
            numbers = learner.numbers()
            scores = np.add.reduceat(numbers[flat], starts[:-1]) / length
        order = rng.permutation(full)
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            if epoch < bags:
                train([np.unique(docs[i]) for i in own], own, WINDOW)
                continue
            chosen, of = [], []
            for i in own:
                at = windows(len(docs[i]))
                end = np.append(at[1:], len(docs[i]))
                tops = np.argsort(-np.add.reduceat(scores[docs[i]], at) / (end - at))[:TOPS].tolist()
                tops += [int(rng.integers(len(at)))] * int(y[i] == 0)
                chosen += [docs[i][at[t] : end[t]] for t in tops]
                of += [i] * len(tops)
            train(chosen, np.array(of))
    numbers = learner.numbers().astype(np.float32)
    by_word = np.add.reduceat(numbers[flat], starts[:-1]) / length
    clean = [by_word[docs[i]].mean() for i in full if y[i] == 0]
    model = Model(numbers, float(np.mean(clean)) if clean else 0.0, float(learner.bias), (1.0, 0.0), f"{zlib.crc32(numbers.tobytes()):08x}")
    model.curve = calibrated(np.array([raw_score(by_word[d], model) for d in docs]), y)
    return model


@lru_cache(1)  # a worker goes through many jobs; only the last model's words stay
def _scorer(name: str, held) -> Scorer:
    return Scorer(held.model)


class _Held:
    """A model that equals another of the same name, for the cache of a worker."""

    def __init__(self, model: Model):
        self.model = model

    def __hash__(self):
        return hash(self.model.name)

    def __eq__(self, other):
        return self.model.name == other.model.name and self.model.curve == other.model.curve


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> Model:
    """A model of labels (doc_id, toxic) over docs (doc_id, text); rows and longest bound the sample it learns from."""
    return fitted(training_rows(docs, labels, "toxic", rows, longest), fit)


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text), from its text alone.

    Null and empty texts are scored as usual clean words. Null ids and repeated rows return as they are; an
    empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches):
        scorer = _scorer(sent.value.name, _Held(sent.value))
        for b in batches:
            scores = [scorer.score(t) for t in utf8(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (text, other columns) that score below the threshold, as they are.

    Null and empty texts are scored as by `toxicity`. Null ids, repeated rows and any other columns stay as they are; an empty
    table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _scorer(sent.value.name, _Held(sent.value))
        for b in batches:
            yield b.filter(pa.array([scorer.score(t) < threshold for t in utf8(b, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
