"""Text layout: boxes normalised to a canvas, DIoU, and the matching of predicted with reference boxes.

A side's boxes are an array<struct<x0, y0, x1, y1: double, text: string>>. Predicates are native columns. The matching
depends on order, so it runs as one Arrow UDF on the two arrays of a document: no group of rows is ever gathered.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import udf

from limn.functions.text import strip
from limn.operators.assignment import assign

CANVAS = 384.0
BOXES = "array<struct<x0: double, y0: double, x1: double, y1: double, text: string>>"


def normalised_box(box: Column, width: Column, height: Column, canvas: float = CANVAS) -> Column:
    """A box scaled so that the longer side of its page fills the canvas, centred on the other, and clamped to it."""
    scale = canvas / F.greatest(width, height)
    dx, dy = (canvas - width * scale) / 2, (canvas - height * scale) / 2
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(canvas))
    return F.struct(*(clamp(box[c] * scale + d).alias(c) for c, d in (("x0", dx), ("y0", dy), ("x1", dx), ("y1", dy))), box["text"].alias("text"))


def normalised_boxes(boxes: Column, width: Column, height: Column, canvas: float = CANVAS) -> Column:
    """Boxes on the canvas; those without area go."""
    placed = F.transform(boxes, lambda b: normalised_box(b, width, height, canvas))
    return F.filter(placed, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))


def placed_boxes(width: float, height: float, boxes: list[dict], canvas: float = CANVAS) -> list[dict]:
    """`normalised_boxes` in Python, where boxes come from a provider."""
    scale = canvas / max(width, height)
    shift = {"x": (canvas - width * scale) / 2, "y": (canvas - height * scale) / 2}
    placed = [{c: min(max(b[c] * scale + shift[c[0]], 0.0), canvas) for c in ("x0", "y0", "x1", "y1")} | {"text": b["text"]} for b in boxes]
    return [b for b in placed if b["x1"] > b["x0"] and b["y1"] > b["y0"]]


def diou(a: Column, b: Column) -> Column:
    """Intersection over union less the squared distance of the centres by the squared diagonal around both, in [-1, 1]."""
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    overlap = side(F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"])) * side(F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - overlap
    far = ((a["x0"] + a["x1"]) - (b["x0"] + b["x1"])) / 2, ((a["y0"] + a["y1"]) - (b["y0"] + b["y1"])) / 2
    across = F.greatest(a["x1"], b["x1"]) - F.least(a["x0"], b["x0"]), F.greatest(a["y1"], b["y1"]) - F.least(a["y0"], b["y0"])
    diagonal = across[0] * across[0] + across[1] * across[1]
    iou = overlap / union
    apart = F.least((far[0] * far[0] + far[1] * far[1]) / diagonal, F.lit(2.0))
    return F.when(union <= 0, 0.0).when(diagonal <= 0, iou).otherwise(F.greatest(F.least(iou - apart, F.lit(1.0)), F.lit(-1.0)))


def allowed_distance(n: Column, m: Column) -> Column:
    """Edits allowed between texts of n and m characters."""
    shorter, mean = F.least(n, m), (n + m) / 2
    base = (
        F.when((n == 1) & (m == 1), 0)
        .when(shorter <= 3, 1)
        .when(mean <= 10, F.greatest(F.lit(1), F.floor(mean * 0.2)))
        .otherwise(F.greatest(F.lit(2), F.least(F.lit(5), F.floor(mean * 0.15))))
    )
    return F.when((n == 1) & (m == 1), 0).otherwise(F.least(base, F.greatest(F.lit(1), F.floor(shorter / 2)))).cast("int")


def similar_text(a: Column, b: Column, fixed: int | None = None) -> Column:
    """struct(similar, exact, distance): trimmed lower-case texts within the edits that their lengths, or `fixed`, allow.

    Empty texts are like nothing. distance is null beyond the allowance.
    """
    s, t = F.lower(strip(a)), F.lower(strip(b))
    n, m = F.length(s), F.length(t)
    limit = F.lit(fixed) if fixed is not None else allowed_distance(n, m)
    some = (n > 0) & (m > 0)
    distance = F.when(some & (F.abs(n - m) <= limit), F.levenshtein(s, t))
    similar = F.coalesce(some & ((s == t) | (distance <= limit)), F.lit(False))
    return F.struct(similar.alias("similar"), F.coalesce(some & (s == t), F.lit(False)).alias("exact"), F.when(similar, F.when(s == t, 0).otherwise(distance)).cast("int").alias("distance"))


def box_diou(a: tuple, b: tuple) -> float:
    """`diou` of two (x0, y0, x1, y1), in Python."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    overlap = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - overlap
    if union <= 0:
        return 0.0
    diagonal = (max(a[2], b[2]) - min(a[0], b[0])) ** 2 + (max(a[3], b[3]) - min(a[1], b[1])) ** 2
    if diagonal <= 0:
        return overlap / union
    centre = ((a[0] + a[2] - b[0] - b[2]) / 2) ** 2 + ((a[1] + a[3] - b[1] - b[3]) / 2) ** 2
    return max(-1.0, min(1.0, overlap / union - min(centre / diagonal, 2.0)))


def edits_within(a: str, b: str, limit: int) -> int | None:
    """Levenshtein distance, or None beyond the limit."""
    if abs(len(a) - len(b)) > limit:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > limit:
            return None
    return row[-1] if row[-1] <= limit else None


def edits_allowed(n: int, m: int) -> int:
    """`allowed_distance` in Python."""
    if n == m == 1:
        return 0
    mean = (n + m) / 2
    base = 1 if min(n, m) <= 3 else max(1, math.floor(0.2 * mean)) if mean <= 10 else max(2, min(5, math.floor(0.15 * mean)))
    return min(base, max(1, min(n, m) // 2))


def match_boxes(predicted: list, reference: list, geometric: bool = False) -> list[tuple[int, int, str, float]]:
    """(predicted, reference, stage, DIoU) of boxes matched one to one.

    exact: reference boxes by number of equal texts, ascending; the best DIoU of those still free. fuzzy: likewise among
    what is left, by distance, and only where the best is the only one. geometric: the rest by least total -DIoU, pairs
    above -0.5.
    """
    box = lambda b: (b["x0"], b["y0"], b["x1"], b["y1"])
    clean = lambda b: (b["text"] or "").strip().lower()
    texts, free_p, free_r, out = [clean(b) for b in predicted], set(range(len(predicted))), set(range(len(reference))), []
    by_text = defaultdict(list)
    for i, t in enumerate(texts):
        by_text[t].append(i)
    wanted = [clean(b) for b in reference]

    def take(i, j, stage):
        free_p.discard(i)
        free_r.discard(j)
        out.append((i, j, stage, box_diou(box(predicted[i]), box(reference[j]))))

    exact = [(len(by_text[t]), j) for j, t in enumerate(wanted) if t and by_text.get(t)]
    for _, j in sorted(exact):
        if left := [i for i in by_text[wanted[j]] if i in free_p]:
            take(max(left, key=lambda i: (box_diou(box(predicted[i]), box(reference[j])), -i)), j, "exact")
    near = {j: [(d, i) for i in sorted(free_p) if texts[i] and (d := edits_within(texts[i], wanted[j], edits_allowed(len(texts[i]), len(wanted[j])))) is not None] for j in sorted(free_r) if wanted[j]}
    for j in sorted(near, key=lambda j: (len(near[j]), j)):
        left = sorted(x for x in near[j] if x[1] in free_p)
        if left and (len(left) == 1 or left[0][0] < left[1][0]):
            take(left[0][1], j, "fuzzy")
    if geometric and free_p and free_r:
        p, r = sorted(free_p), sorted(free_r)
        gain = np.array([[box_diou(box(predicted[i]), box(reference[j])) for j in r] for i in p])
        for a, b in zip(*assign(-gain)):
            if gain[a, b] > -0.5:
                take(p[a], r[b], "geometric")
    return out


def layout_score(predicted: list | None, reference: list | None, geometric: bool = False) -> float:
    """Sum of (DIoU + 1) / 2 over matched boxes, by the larger number of boxes; 1 where neither side has any, else 0."""
    p, r = predicted or [], reference or []
    if not p or not r:
        return float(not p and not r)
    return sum((d + 1) / 2 for *_, d in match_boxes(p, r, geometric)) / max(len(p), len(r))


MATCHES = T.ArrayType(T.StructType([T.StructField("predicted", T.IntegerType()), T.StructField("reference", T.IntegerType()), T.StructField("stage", T.StringType()), T.StructField("diou", T.DoubleType())]))


@udf(returnType=MATCHES, useArrow=True)
def matched_boxes(predicted, reference):
    return match_boxes(predicted or [], reference or [])


@udf(returnType=MATCHES, useArrow=True)
def matched_boxes_geometric(predicted, reference):
    """matched_boxes with the geometric stage."""
    return match_boxes(predicted or [], reference or [], True)


@udf(returnType=T.DoubleType(), useArrow=True)
def text_layout_score(predicted, reference):
    return layout_score(predicted, reference)
