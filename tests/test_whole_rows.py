"""Queries that take every row and the whole of each text."""

import codecs
import hashlib

import pytest

from limn.plans.catalogue import QUERIES
from tests.test_catalogue import SF


def test_rot13_covers_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {d: hashlib.md5(codecs.encode(t, "rot13").encode()).hexdigest() for d, t in texts.items()}
    assert any(len(t) > 40 for t in texts.values())
    assert {r["doc_id"]: r["rot13"] for r in QUERIES["rot13_text"](spark, SF).collect()} == want


def test_edit_distance_query_is_brute_force(spark):
    from limn.functions.tex import distance_text
    from limn.plans import fixtures
    from tests.test_functions import brute_edit_distance

    want = {r["index"]: brute_edit_distance(distance_text(r["predicted"]), distance_text(r["ground_truth"])) for r in fixtures.turns(spark, SF).collect()}
    got = {r["index"]: r["distance"] for r in QUERIES["edit_distance"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_layout_query_is_brute_force(spark):
    """The rules of matching again, box by box: equal texts from the rarest on by best overlap, then the one nearest text."""
    from limn.operators.layout import box_diou, edits_allowed
    from limn.plans import fixtures

    def matched(p, r):
        box = lambda b: (b["x0"], b["y0"], b["x1"], b["y1"])
        pt, rt = [b["text"].strip().lower() for b in p], [b["text"].strip().lower() for b in r]
        used, done, score = set(), set(), 0.0
        for j in sorted((j for j in range(len(r)) if rt[j] in pt), key=lambda j: (pt.count(rt[j]), j)):
            free = [i for i in range(len(p)) if pt[i] == rt[j] and i not in used]
            if free:
                best = max(box_diou(box(p[i]), box(r[j])) for i in free)
                i = next(i for i in free if box_diou(box(p[i]), box(r[j])) == best)
                used.add(i), done.add(j)
                score += (best + 1) / 2
        near = {j: [(levenshtein(pt[i], rt[j]), i) for i in range(len(p)) if i not in used] for j in range(len(r)) if j not in done}
        near = {j: [(d, i) for d, i in x if d <= edits_allowed(len(pt[i]), len(rt[j]))] for j, x in near.items()}
        for j in sorted(near, key=lambda j: (len(near[j]), j)):
            free = sorted((d, i) for d, i in near[j] if i not in used)
            if free and [d for d, _ in free].count(free[0][0]) == 1:
                used.add(free[0][1])
                score += (box_diou(box(p[free[0][1]]), box(r[j])) + 1) / 2
        return score / max(len(p), len(r)), len(used)

    want = {r["l_orderkey"]: matched(r["predicted"], r["reference"]) for r in fixtures.order_boxes(spark, SF).collect()}
    got = {r["l_orderkey"]: (r["score"], r["matches"]) for r in QUERIES["text_layout_match"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1] == want[k][1] for k in want)


def test_geometry_query_is_brute_force(spark):
    """The least cost over all ways to match, for orders of few lines; the types for all."""
    import math
    from itertools import permutations

    from limn.operators import geometry
    from limn.plans.catalogue import _elements

    got = {r["l_orderkey"]: (r["overall"], r["types"]) for r in QUERIES["geometry_match"](spark, SF).collect()}
    tried = 0
    for r in _elements(spark, SF).collect():
        a, b = [geometry.element(e) for e in r["predicted"]], [geometry.element(e) for e in r["reference"]]
        kinds = {e.type for e in a}
        assert got[r["l_orderkey"]][1] == len(kinds)
        if len(a) > 8:
            continue
        boxes = [e.bbox for e in a + b]
        canvas = max(1.0, math.hypot(max(x["x1"] for x in boxes) - min(x["x0"] for x in boxes), max(x["y1"] for x in boxes) - min(x["y0"] for x in boxes)))
        total = 0.0
        for kind in kinds:
            p, q = [e for e in a if e.type == kind], [e for e in b if e.type == kind]
            way = min(permutations(range(len(q))), key=lambda w: sum(geometry.cost(x, q[j], canvas) for x, j in zip(p, w)))
            total += sum(math.exp(-1.5 * geometry.cost(x, q[j], canvas)) for x, j in zip(p, way))
        assert abs(got[r["l_orderkey"]][0] - total / len(a)) < 1e-6
        tried += 1
    assert tried > 1000


def test_image_query_is_brute_force(spark):
    """SSIM and edges again, window by window, over images drawn by the query's rule."""
    import numpy as np

    from limn.functions import imaging

    e = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(40).collect()}
    draw = lambda v: imaging.resize(np.clip(np.asarray(v, float)[:64].reshape(8, 8) * 255 + 128, 0, 255), 32, 32).round().astype(np.uint8) / np.float32(255)
    got = {r["filename"]: r for r in QUERIES["image_metrics"](spark, SF).collect()}
    k = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    k = np.outer(k, k) / k.sum() ** 2
    tried = 0
    for i in e:
        if i + 1 not in e or (draw(e[i]) == 1).any() or (draw(e[i + 1]) == 1).any():
            continue  # a white border would be trimmed
        x, y = draw(e[i]).astype(float), draw(e[i + 1]).astype(float)
        values = []
        for a in range(22):
            for b in range(22):
                p, q = x[a : a + 11, b : b + 11], y[a : a + 11, b : b + 11]
                mp, mq = (k * p).sum(), (k * q).sum()
                vp, vq, c = (k * p * p).sum() - mp**2, (k * q * q).sum() - mq**2, (k * p * q).sum() - mp * mq
                values.append((2 * mp * mq + 1e-4) * (2 * c + 9e-4) / ((mp**2 + mq**2 + 1e-4) * (vp + vq + 9e-4)))
        r = got[f"v{i}.png"]
        assert abs(r["ssim"] - np.mean(values)) < 1e-3 and abs(r["psnr"] - 10 * np.log10(1 / ((x - y) ** 2).mean())) < 1e-3
        assert -100 <= r["mse"] <= 100
        tried += 1
    assert tried > 3


@pytest.mark.parametrize("name", ["metric_merge_all", "metric_pivot_all"])
def test_metrics_keep_every_document(spark, name):
    names = {f"f{r['doc_id']}" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES[name](spark, SF).collect()
    assert len(got) == len(names) and {r["filename"] for r in got} == names
    assert all(r["ssim"] is not None for r in got) and 0 < sum(r["psnr"] is not None for r in got) < len(got)
