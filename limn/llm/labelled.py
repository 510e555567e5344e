"""Which labelled rows a classifier learns from, and how it is judged."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limn.llm.common import need


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from training: crc32 of its id as text leaves 1 when divided by 3. Null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents that aren't held out, with whole texts of at most `longest` bytes.

    These two are the bound of the sample, which is the same at any rerun: the first by a hash of the id, a half of the
    rows for either label as far as there are as many. Null texts and labels are left out; an id with several labels
    counts with the largest.
    """
    known = need(labels, "doc_id", label).filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    able = need(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= longest))
    sizes = able.join(known, "doc_id").select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    picked = [sizes.filter(F.col("y") == y).orderBy("h", "doc_id").limit(rows // 2).select("doc_id", "y") for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).distinct()
    return able.join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))  # `rows` rows at most


def fitted(sample: DataFrame, fit: Callable):
    """What fit(texts, labels) makes of a bounded sample (doc_id, text, y), in one task: the driver only gets the model.

    The sample's order is that of its ids, so reruns give the same model.
    """

    def run(batches):
        parts = [b.to_pandas() for b in batches]
        rows = pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "text": [], "y": []})
        rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
        model = fit(rows["text"].tolist(), rows["y"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(made["model"])) if made else fit([], np.zeros(0))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def calibrated(raw: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) of the logistic curve that turns raw scores to probabilities, by damped Newton steps; a isn't below 0."""
    a, b, z = 1.0, 0.0, (raw - raw.mean()) / (raw.std() + 1e-9)
    for _ in range(steps):
        p = sigmoid(a * z + b)
        w, g = p * (1 - p) + 1e-6, p - y
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * z).sum() + 0.1 * (a - 1), g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    a = max(a, 0.0)
    scale = raw.std() + 1e-9
    return a / scale, b - a * raw.mean() / scale
