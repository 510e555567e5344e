"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j). The pairwise sum is taken in linear time, as
half of (sum v_i x_i) ** 2 - sum (v_i x_i) ** 2 by factor.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limn.llm.common import need, utf8
from limn.llm.labelled import calibrated, fitted, held_out, sigmoid, training_rows

#: The bound of the training sample: rows, and bytes of each text.
ROWS, LONGEST = 4_000, 30_000
BUCKETS, FACTORS = 1 << 13, 6
THRESHOLD = 0.5
#: Words whose bucket a worker keeps; when full it starts anew. No result depends on it.
KEPT_WORDS = 250_000
STATISTICS = ("upper", "digits", "marks", "symbols", "exclamations", "pipes", "blanks", "lines", "beyond_ascii", "word_length", "distinct_words", "distinct_lines", "repeats", "stops", "log_bytes", "log_words")
_KINDS = np.zeros((9, 256))
for _row, _bytes in enumerate((range(65, 91), b"0123456789", b".,;:?'\"()-", b"#$%&*+/<=>@\\^_`{}~[]", b"!", b"|", b" \t\r\v\f", b"\n", range(128, 256))):
    _KINDS[_row, list(_bytes)] = 1


def statistics(text: bytes, words: list[bytes]) -> list[float]:
    """The numbers named by STATISTICS; metadata are the text's size in bytes and words."""
    n, k = max(len(text), 1), max(len(words), 1)
    shares = (_KINDS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n).tolist()
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(map(bytes.__eq__, words, words[1:]))
    return [*shares, len(text) / k / 10, len(set(words)) / k, len(set(lines)) / max(len(lines), 1), again / k, (text.count(b". ") + text.count(b".\n")) * 10 / k, np.log1p(len(text)) / 10, np.log1p(len(words)) / 10]


class Buckets(dict):
    """The bucket of each word."""

    def __missing__(self, word: bytes) -> int:
        k = zlib.crc32(word) & (BUCKETS - 1)
        if len(word) <= 48:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = k
        return k

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(index, x): hashed words by the root of their count, in a vector of length 1, then the statistics."""
        words = text.split()
        stats = statistics(text, words)
        k = np.fromiter(map(self.__getitem__, text.lower().split()), int, len(words))
        index, n = np.unique(k, return_counts=True)
        x = np.sqrt(n)
        x = x / np.sqrt((x * x).sum()) if len(x) else x
        return np.append(index, np.arange(BUCKETS, BUCKETS + len(stats))), np.append(x, stats)


class Model:
    """A factorisation machine: constant, weights, factors, and the scale of the statistics."""

    def __init__(self):
        self.constant, self.weights, self.factors = 0.0, np.zeros(BUCKETS + len(STATISTICS)), np.zeros((BUCKETS + len(STATISTICS), FACTORS))
        self.mean, self.scale, self.curve = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), (1.0, 0.0)

    def scaled(self, index: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.append(x[: -len(STATISTICS)], np.clip((x[-len(STATISTICS) :] - self.mean) / self.scale, -4, 4))

    def raw(self, index: np.ndarray, x: np.ndarray) -> float:
        """The machine's value, in time linear in the features."""
        vx = self.factors[index] * x[:, None]
        return float(self.constant + self.weights[index] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx * vx).sum()))

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        a, b = self.curve
        return float(sigmoid(a * self.raw(index, self.scaled(index, x)) + b))


def fit(texts: list[str], labels, epochs: int = 8, rate: float = 0.05, batch: int = 64, seed: int = 11) -> Model:
    """Trains by adaptive gradients on batches; both labels weigh the same. Without both labels every score is the same."""
    rng, model = np.random.default_rng(seed), Model()
    y = np.asarray(labels, float)
    if len(set(y.tolist())) < 2:
        model.curve = (0.0, 6.0 if y.all() else -6.0)
        return model
    buckets = Buckets()
    rows = [buckets.features(t.encode()) for t in texts]
    stats = np.array([x[-len(STATISTICS) :] for _, x in rows])
    model.mean, model.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    rows = [(i, model.scaled(i, x)) for i, x in rows]
    model.factors = rng.normal(0, 0.02, model.factors.shape)
    seen_w, seen_v, seen_c = np.full(model.weights.shape, 1e-6), np.full(model.factors.shape, 1e-6), 1e-6
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            index = np.concatenate([rows[i][0] for i in own])
            x = np.concatenate([rows[i][1] for i in own])
            starts = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in own])[:-1]])
            of = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
            vx = model.factors[index] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            value = model.constant + np.add.reduceat(model.weights[index] * x, starts) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            error = (sigmoid(value) - y[own]) * balance[own] / len(own)
            e = error[of] * x
            gw = np.bincount(index, e, len(model.weights)) + 1e-5 * model.weights
            gv = np.stack([np.bincount(index, e * (sums[of, f] - vx[:, f]), len(model.weights)) for f in range(FACTORS)], axis=1) + 1e-4 * model.factors
            seen_w, seen_v, seen_c = seen_w + gw**2, seen_v + gv**2, seen_c + error.sum() ** 2
            model.weights -= rate * gw / np.sqrt(seen_w)
            model.factors -= 0.3 * rate * gv / np.sqrt(seen_v)
            model.constant -= rate * error.sum() / np.sqrt(seen_c)
    model.curve = calibrated(np.array([model.raw(*r) for r in rows]), y)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> Model:
    """A model of labels (doc_id, quality) over docs (doc_id, text); rows and longest bound the sample it learns from."""
    return fitted(training_rows(docs, labels, "quality", rows, longest), fit)


@cache
def _buckets() -> Buckets:
    return Buckets()


def quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text), from its text alone.

    Null and empty texts are scored as texts without words. Null ids and repeated rows return as they are; an empty
    table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of FACTORS numbers

    def run(batches):
        m, f = sent.value, _buckets().features
        for b in batches:
            scores = [m.score(*f(t)) for t in utf8(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (text, other columns) that score at least the threshold, as they are.

    Null and empty texts are scored as by `quality`. Null ids, repeated rows and any other columns stay as they are; an empty
    table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, f = sent.value, _buckets().features
        for b in batches:
            yield b.filter(pa.array([m.score(*f(t)) >= threshold for t in utf8(b, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
