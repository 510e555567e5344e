"""Geometric elements of drawings: built from path segments, de-duplicated, and matched by type.

An element is struct<type, coordinates: array<double>, bbox: struct<x0, y0, x1, y1>, cx, cy, area, orientation>. Path
building and the matching work on one document's arrays in an Arrow UDF; counts, canvas and predicates are native.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import udf

from limn.operators.assignment import assign

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
ELEMENT = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType())), T.StructField("bbox", BBOX)] + [T.StructField(c, T.DoubleType()) for c in ("cx", "cy", "area", "orientation")]
)
#: Fixed values. Gap of ends that close a path; circle fits: fewest points, radii, largest and mean error by radius.
CLOSED_GAP, CIRCLE_POINTS, CIRCLE_RADII, CIRCLE_ERRORS = 5.0, 12, (8.0, 300.0), (0.003, 0.0015)
#: Fixed values. Rectangles: difference of opposite sides, cosine at corners, least area. Duplicates: bbox and mean coordinate difference, area share.
SIDE_GAP, CORNER_COSINE, LEAST_AREA, SAME, SAME_AREA = 1.0, 0.04, 1.0, 2.0, 0.1
#: By type, weights of position and of the measures named, and the steepness of exp(-k * cost).
COSTS = {
    "circle": ({"position": 0.6, "radius": 0.4}, 2.0),
    "line": ({"position": 0.4, "area": 0.3, "orientation": 0.3}, 1.5),
    "rectangle": ({"position": 0.4, "area": 0.3, "aspect": 0.3}, 1.5),
    "curve": ({"position": 0.4, "area": 0.3, "box": 0.3}, 1.5),
    "closed_curve": ({"position": 0.4, "area": 0.3, "box": 0.3}, 1.5),
    "polygon": ({"position": 0.4, "area": 0.3, "vertices": 0.3}, 1.5),
    "other": ({"position": 0.6, "area": 0.4}, 1.5),
}


@dataclass
class Element:
    type: str
    coordinates: list[float]
    bbox: dict[str, float]
    cx: float
    cy: float
    area: float
    orientation: float = 0.0


def _box(points) -> dict[str, float]:
    x, y = [float(p[0]) for p in points], [float(p[1]) for p in points]
    return {"x0": min(x), "y0": min(y), "x1": max(x), "y1": max(y)}


def _flat(points) -> list[float]:
    return [float(c) for p in points for c in p]


def line(a, b) -> Element:
    """A line; its area is its length, its orientation in [0, pi]."""
    angle = math.atan2(b[1] - a[1], b[0] - a[0])
    return Element("line", _flat((a, b)), _box((a, b)), (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.dist(a, b), angle + math.pi if angle < 0 else angle)


def curve(points) -> Element:
    """A Bezier curve by its control points; its area is the length of their polygon."""
    length = sum(math.dist(p, q) for p, q in zip(points, points[1:]))
    return Element("curve", _flat(points), _box(points), sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points), length)


def rectangle(x: float, y: float, w: float, h: float) -> Element:
    return Element("rectangle", [x, y, w, h], _box(((x, y), (x + w, y + h))), x + w / 2, y + h / 2, abs(w * h), 0.0 if abs(w) > abs(h) or h == 0 else math.pi / 2)


def polygon(points) -> Element:
    """A polygon with the area of the shoelace formula."""
    twice = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, [*points[1:], points[0]]))
    return Element("polygon", _flat(points), _box(points), sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points), abs(twice) / 2)


def closed_curve(points) -> Element:
    b = _box(points)
    return Element("closed_curve", _flat(points), b, (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2, (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))


def fit_circle(points) -> Element | None:
    """The least-squares circle of points, if they are enough and lie on one of a fitting radius."""
    if len(points) < CIRCLE_POINTS:
        return None
    x, y = np.array(points, float).T
    (a, b, c), *_ = np.linalg.lstsq(np.column_stack([x, y, np.ones(len(x))]), x * x + y * y, rcond=None)
    cx, cy = a / 2, b / 2
    square = c + cx * cx + cy * cy
    if not square > 0 or not CIRCLE_RADII[0] <= (r := math.sqrt(square)) <= CIRCLE_RADII[1]:
        return None
    error = np.abs(np.hypot(x - cx, y - cy) - r) / r
    if error.max() > CIRCLE_ERRORS[0] or error.mean() > CIRCLE_ERRORS[1]:
        return None
    return Element("circle", [float(cx), float(cy), r], _box(((cx - r, cy - r), (cx + r, cy + r))), float(cx), float(cy), math.pi * r * r)


def as_rectangle(points) -> Element | None:
    """The rectangle that four points are the corners of, if they are."""
    if len(points) != 4:
        return None
    sides = [(q[0] - p[0], q[1] - p[1]) for p, q in zip(points, [*points[1:], points[0]])]
    lengths = sorted(math.hypot(*s) for s in sides)
    square = all(abs(s[0] * t[0] + s[1] * t[1]) <= CORNER_COSINE * math.hypot(*s) * math.hypot(*t) for s, t in zip(sides, [*sides[1:], sides[0]]))
    if lengths[1] - lengths[0] >= SIDE_GAP or lengths[3] - lengths[2] >= SIDE_GAP or not square:
        return None
    b = _box(points)
    found = rectangle(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"])
    return found if found.area >= LEAST_AREA else None


def elements_of_path(segments: list, closed: bool = False) -> list[Element]:
    """Elements of one path. segments: lists of points, two for a line and four for a curve.

    A path counts as closed if said, or if three segments or more end where they began.
    """
    ends_meet = len(segments) >= 3 and math.dist(segments[0][0], segments[-1][-1]) < CLOSED_GAP
    if len(segments) >= 3 and (closed or ends_meet):
        curves = [s for s in segments if len(s) > 2]
        if len(curves) >= 3 and (circle := fit_circle([p for s in curves for p in s])):
            return [circle]
        if not curves:
            corners = [s[0] for s in segments]
            return [as_rectangle(corners) or polygon(corners)]
        return [closed_curve([p for s in segments for p in s])]
    return [line(*s) if len(s) == 2 else curve(s) for s in segments]


def elements_of_items(items: list) -> list[Element]:
    """Elements of one path from its drawing items (kind, points).

    m begins anew at a point; l and c draw a line (two points) and a curve (four); re and qu are a rectangle (two corners)
    and a quadrangle (four corners) at once; s and h close what has been drawn, by a line where its ends differ.
    """
    out, segments, start = [], [], None

    def flush(closed: bool, open_only: bool = False):
        nonlocal segments
        if segments:
            out.extend([line(*s) if len(s) == 2 else curve(s) for s in segments] if open_only else elements_of_path(segments, closed))
        segments = []

    for kind, points in items:
        points = [tuple(map(float, p)) for p in points]
        if kind == "m":
            flush(False, open_only=True)
            start = points[0]
        elif kind in ("l", "c") and len(points) == (2 if kind == "l" else 4):
            segments.append(points)
            start = start if start is not None else points[0]
        elif kind == "re" and len(points) == 2:
            (x0, y0), (x1, y1) = points
            out.append(rectangle(x0, y0, x1 - x0, y1 - y0))
        elif kind == "qu" and len(points) == 4:
            out.append(as_rectangle(points) or polygon(points))
        elif kind in ("s", "h"):
            if segments and start is not None and segments[-1][-1] != start:
                segments.append([segments[-1][-1], start])
            flush(True)
            start = None
    flush(False)
    return out


def join_circles(elements: list[Element]) -> list[Element]:
    """Curves whose ends lie near those of a seed curve, three or more of them, as a circle where they fit one."""
    ends = lambda e: (e.coordinates[:2], e.coordinates[-2:])
    pending, out = [e for e in elements if e.type == "curve"], list(elements)
    while pending:
        seed, *pending = pending
        near = [e for e in pending if min(math.dist(p, q) for p in ends(seed) for q in ends(e)) < CLOSED_GAP]
        pending = [e for e in pending if not any(e is n for n in near)]
        group = [seed, *near]
        if len(group) >= 3 and (circle := fit_circle([p for e in group for p in zip(e.coordinates[::2], e.coordinates[1::2])])):
            out = [e for e in out if not any(e is g for g in group)] + [circle]
    return out


def same(a: Element, b: Element) -> bool:
    """Whether two elements are near duplicates."""
    if a.type != b.type or max(abs(a.bbox[k] - b.bbox[k]) for k in a.bbox) > SAME or len(a.coordinates) != len(b.coordinates):
        return False
    if (larger := max(a.area, b.area)) > 0 and abs(a.area - b.area) > SAME_AREA * larger:
        return False
    pairs = list(zip(a.coordinates, b.coordinates))[:8]
    return not pairs or sum(abs(x - y) for x, y in pairs) / len(pairs) < SAME


def without_duplicates(elements: list[Element]) -> list[Element]:
    """The first of each set of near duplicates."""
    out: list[Element] = []
    for e in elements:
        if not any(same(e, kept) for kept in out):
            out.append(e)
    return out


def costs(a: list[Element], b: list[Element], canvas: float) -> np.ndarray:
    """Cost of matching each of a with each of b, all of one type; only the measures that the type weighs are taken."""
    if not a or not b:
        return np.zeros((len(a), len(b)))

    def pair(value) -> tuple[np.ndarray, np.ndarray]:
        return np.array([[value(e)] for e in a], float), np.array([value(e) for e in b], float)

    def share(value, least: float = 1e-6) -> np.ndarray:
        x, y = pair(value)
        return np.abs(x - y) / np.maximum(np.maximum(x, y), least)

    def position() -> np.ndarray:
        (x, u), (y, v) = pair(lambda e: e.cx), pair(lambda e: e.cy)
        return np.hypot(x - u, y - v) / canvas

    def turned() -> np.ndarray:
        x, y = pair(lambda e: e.orientation)
        turn = np.abs(x - y)
        return np.minimum(turn, math.pi - turn) / (math.pi / 2)

    measures = {
        "position": position, "orientation": turned, "area": lambda: share(lambda e: e.area),
        "box": lambda: share(lambda e: (e.bbox["x1"] - e.bbox["x0"]) * (e.bbox["y1"] - e.bbox["y0"])),
        "radius": lambda: share(lambda e: e.coordinates[2]),
        "aspect": lambda: share(lambda e: abs(e.coordinates[2]) / max(abs(e.coordinates[3]), 1e-6)),
        "vertices": lambda: share(lambda e: len(e.coordinates) // 2, 1),
    }
    weights, _ = COSTS.get(a[0].type, COSTS["other"])
    return sum(w * measures[m]() for m, w in weights.items())


def cost(a: Element, b: Element, canvas: float) -> float:
    """Cost of matching two elements of one type."""
    return float(costs([a], [b], canvas)[0, 0])


def canvas_size(elements: list[Element]) -> float:
    """Diagonal of the box around all elements, 1 at least."""
    if not elements:
        return 1.0
    return max(math.hypot(max(e.bbox["x1"] for e in elements) - min(e.bbox["x0"] for e in elements), max(e.bbox["y1"] for e in elements) - min(e.bbox["y0"] for e in elements)), 1.0)


def geometry_result(candidate: list[Element], reference: list[Element]) -> dict:
    """overall score, and by type the sum of exp(-k * cost) over matches and the numbers of elements."""
    if not candidate or not reference:
        return {"overall": float(not candidate and not reference), "by_type": {}, "counts": {}}
    canvas, by_type, counts = canvas_size(candidate + reference), {}, {}
    for kind in sorted({e.type for e in candidate} | {e.type for e in reference}):
        a, b = [e for e in candidate if e.type == kind], [e for e in reference if e.type == kind]
        of_pairs = costs(a, b, canvas)
        rows, columns = assign(of_pairs)
        by_type[kind] = float(np.exp(-COSTS.get(kind, COSTS["other"])[1] * of_pairs[rows, columns]).sum())
        counts[kind] = {"candidate": len(a), "reference": len(b)}
    return {"overall": sum(by_type.values()) / max(len(candidate), len(reference)), "by_type": by_type, "counts": counts}


def element(row) -> Element:
    """An element from its struct."""
    bbox = row["bbox"] if isinstance(row["bbox"], dict) else row["bbox"].asDict()
    return Element(row["type"], [float(x) for x in row["coordinates"]], bbox, row["cx"], row["cy"], row["area"], row["orientation"])


COUNTS = T.StructType([T.StructField("candidate", T.IntegerType()), T.StructField("reference", T.IntegerType())])
RESULT = T.StructType([T.StructField("overall", T.DoubleType()), T.StructField("by_type", T.MapType(T.StringType(), T.DoubleType())), T.StructField("counts", T.MapType(T.StringType(), COUNTS))])


@udf(returnType=RESULT, useArrow=True)
def geometry_match(candidate, reference):
    """geometry_result of two arrays of elements."""
    return geometry_result([element(e) for e in candidate or []], [element(e) for e in reference or []])


#: A drawing's paths: segments as lists of points and whether they are closed, or else drawing items in their order.
PATHS = "array<struct<segments: array<array<array<double>>>, closed: boolean, items: array<struct<kind: string, points: array<array<double>>>>>>"


@udf(returnType=T.ArrayType(ELEMENT), useArrow=True)
def path_elements(paths):
    """Elements of a drawing's paths (array<struct<segments, closed, items>>: see PATHS), de-duplicated."""
    found = [e for p in paths or [] for e in (elements_of_items([(i["kind"], i["points"]) for i in p["items"]]) if p["items"] else elements_of_path([[tuple(q) for q in s] for s in p["segments"] or []], bool(p["closed"])))]
    return [asdict(e) for e in without_duplicates(join_circles(found))]


def canvas_diagonal(elements: Column) -> Column:
    """`canvas_size` of an array of elements, natively."""
    side = lambda lo, hi: F.array_max(F.transform(elements, lambda e: e["bbox"][hi])) - F.array_min(F.transform(elements, lambda e: e["bbox"][lo]))
    x, y = side("x0", "x1"), side("y0", "y1")
    return F.coalesce(F.greatest(F.sqrt(x * x + y * y), F.lit(1.0)), F.lit(1.0))


def line_element(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """`line` as a native column."""
    angle = F.atan2(y1 - y0, x1 - x0)
    return F.struct(
        F.lit("line").alias("type"), F.array(x0, y0, x1, y1).alias("coordinates"),
        F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1")).alias("bbox"),
        ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)).alias("area"),
        F.when(angle < 0, angle + math.pi).otherwise(angle).alias("orientation"),
    )


def rectangle_element(x: Column, y: Column, w: Column, h: Column) -> Column:
    """`rectangle` as a native column, for sides that aren't negative."""
    return F.struct(
        F.lit("rectangle").alias("type"), F.array(x, y, w, h).alias("coordinates"),
        F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1")).alias("bbox"),
        (x + w / 2).alias("cx"), (y + h / 2).alias("cy"), (w * h).alias("area"), F.when((w > h) | (h == 0), 0.0).otherwise(math.pi / 2).alias("orientation"),
    )
