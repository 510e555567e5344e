"""Pure functions, on hand-derived cases and properties."""

import base64
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from limn.functions import imaging, preamble, rounding, tex
from limn.functions.text import loose_json_text
from limn.operators import geometry
from limn.operators.assignment import assign
from limn.operators.layout import box_diou, edits_allowed, edits_within, layout_score, match_boxes
from limn.operators.sampling import BINS, parse_bins
from limn.operators.textmetrics import extended_edit_distance

LITERALS = {
    "3.14159": "3.14200", "12345": "12345", "12345.678": "12346.000", "-.56789": "-.56790", "+1.23456": "+1.23500", ".99999": "1.00000", "99999.5": "100000.0",
    "007": "007", "1e5": "1e5", "-0.0": "0.0", "0": "0", "2.5": "2.5", "abc": "abc", "0.00123456": "0.00123500",
}


@pytest.mark.parametrize(("literal", "expected"), LITERALS.items())
def test_round_literal(literal, expected):
    assert rounding.round_literal(literal) == expected
    assert rounding.round_literal(expected) == expected


@given(st.decimals(min_value=-10**6, max_value=10**6, places=5).map(str).filter(lambda s: "E" not in s))
@settings(max_examples=300, deadline=None)
def test_rounding_is_idempotent(literal):
    once = rounding.round_literal(literal)
    assert rounding.round_literal(once) == once


@pytest.mark.parametrize(
    ("code", "expected"),
    [
        (r"\definecolor{a}{rgb}{0.123456,1,0.5}", r"\definecolor{a}{rgb}{0.123500,1,0.5}"),
        (r"coordinates {(1.23456,2) (3,4.56789)}", r"coordinates {(1.23500,2) (3,4.56800)}"),
        (r"\addplot table[x=a] {1.23456 2}", r"\addplot table[x=a] {1.23500 2}"),
        (r"\draw (1.23456, 2) -- (a, 1.23456);", r"\draw (1.23500, 2) -- (a, 1.23456);"),
        ("[scale=1.23456, name=1.23456, fill=1.23456, xshift=1.23456cm]", "[scale=1.23500, name=1.23456, fill=1.23456, xshift=1.23456cm]"),
        ("1.23456cm", "1.23456cm"),
        ("", ""),
        (None, None),
    ],
)
def test_round_code(code, expected):
    assert rounding.round_code(code) == expected


def test_loose_json():
    assert loose_json_text('```json\n{"label": "a"}\n```') == '{"label": "a"}'
    assert loose_json_text('so {"label": "a"} and } more') == '{"label": "a"}'
    assert loose_json_text("none") is None and loose_json_text("") is None and loose_json_text(None) is None


def test_lexer_loses_nothing():
    code = "\\a{b}[c] % d\n$e$ \\\\ & \\% f"
    assert "".join(t.value for t in tex.lex(code)) == code
    assert tex.words("\\draw (0,1.5) % no\nx;") == ["\\draw", "(", "0,1.5", ")", "x", ";"]


SOURCE = "\\documentclass[tikz,border=3mm]{article}\n\\usepackage[a=b]{x, y}\n% \\usepackage{no}\n\\usepackage{y}\n\\usetikzlibrary{l1,\n l2} % end\nbody"


def test_declarations():
    assert preamble.packages_and_libraries(SOURCE) == (["x", "y"], ["l1", "l2"])
    assert preamble.document_class(SOURCE) == (["tikz", "border=3mm"], "article")
    assert preamble.packages_and_libraries("\\usepackage{open") == ([], [])


def test_edits():
    assert preamble.without(SOURCE, r"\usepackage", ["y"]) == SOURCE.replace("{x, y}", "{x}").replace("\\usepackage{y}\n", "")
    assert preamble.without_duplicates(SOURCE) == SOURCE.replace("\\usepackage{y}\n", "")
    assert preamble.without(SOURCE, r"\usetikzlibrary", ["l1", "l2"]) == SOURCE.replace("\\usetikzlibrary{l1,\n l2} % end\n", "")
    assert preamble.without_class_options(SOURCE, ["tikz"]).startswith("\\documentclass[border=3mm]{article}")


def needs(*names):
    def compiles(code):
        p, lib = preamble.packages_and_libraries(code)
        options = (preamble.document_class(code) or ([], ""))[0]
        missing = [n for n in names if n not in p + lib + options]
        return not missing, ",".join(missing) or None

    return compiles


def test_prune():
    r = preamble.prune(SOURCE, "f", needs("y", "l2"))
    assert (r["status"], r["removable_packages"], r["removable_libraries"], r["compilation_success"]) == ("success", ["x"], ["l1"], True)
    assert preamble.packages_and_libraries(r["optimized_content"]) == (["y"], ["l2"])
    bad = preamble.prune("x", "f", needs("y"))
    assert bad["status"] == "error" and bad["optimized_content"] == "x" and bad["compilation_success"] is None


def test_standalone_migrates_options_and_implied_packages():
    code = preamble.to_standalone(SOURCE, needs("tikz"))
    assert code.startswith("\\documentclass[border=2mm]{standalone}\n\\usepackage{tikz}\n\\usepackage[a=b]")
    assert preamble.to_standalone("x") == "\\documentclass[border=2mm]{standalone}\nx"
    assert "\\usepackage{amsmath}\n\\usepackage{amssymb}" in preamble.to_standalone("\\documentclass{amsart}\n")


@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
@settings(max_examples=80, deadline=None)
def test_assignment_is_optimal(n, m, rng):
    from itertools import permutations

    cost = np.array([[rng.uniform(-5, 5) for _ in range(m)] for _ in range(n)])
    rows, columns = assign(cost)
    assert len(rows) == min(n, m) == len(set(rows)) == len(set(columns))
    wide = cost if n <= m else cost.T
    best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
    assert abs(cost[rows, columns].sum() - best) < 1e-9


boxes = st.tuples(st.floats(0, 90), st.floats(0, 90), st.floats(1, 10), st.floats(1, 10)).map(lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3]))


@given(boxes, boxes)
@settings(deadline=None)
def test_diou_is_symmetric_and_bounded(a, b):
    assert abs(box_diou(a, b) - box_diou(b, a)) < 1e-12 and -1 <= box_diou(a, b) <= 1 and abs(box_diou(a, a) - 1) < 1e-12


def box(text, x=0.0):
    return {"x0": x, "y0": 0.0, "x1": x + 10, "y1": 10.0, "text": text}


def test_matching_stages():
    p, r = [box("Alpha", 50), box("alpha"), box("betta", 20), box("zzz", 90)], [box("alpha", 1), box("beta", 20), box("q", 91)]
    assert [x[:3] for x in match_boxes(p, r)] == [(1, 0, "exact"), (2, 1, "fuzzy")]
    assert [x[:3] for x in match_boxes(p, r, geometric=True)][-1] == (3, 2, "geometric")
    assert match_boxes([box("abcx"), box("abcy")], [box("abcz")]) == []
    assert layout_score([], []) == 1 and layout_score([box("a")], None) == 0 and layout_score([box("a")], [box("a")]) == 1


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
@settings(deadline=None)
def test_edits_within(a, b):
    def full(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for limit in range(4):
        assert edits_within(a, b, limit) == (d if (d := full(a, b)) <= limit else None)


def test_edits_allowed():
    assert [edits_allowed(*x) for x in ((1, 1), (1, 3), (3, 9), (5, 5), (10, 10), (20, 20), (60, 60), (4, 40))] == [0, 1, 1, 1, 2, 3, 5, 2]


def test_geometry():
    square = [[(0, 0), (10, 0)], [(10, 0), (10, 10)], [(10, 10), (0, 10)], [(0, 10), (0, 0)]]
    assert [e.type for e in geometry.elements_of_path(square)] == ["rectangle"]
    assert [e.type for e in geometry.elements_of_path(square[:2])] == ["line", "line"]
    assert [e.type for e in geometry.elements_of_path([[(0, 0), (30, 0)], [(30, 0), (10, 20)], [(10, 20), (0, 0)]])] == ["polygon"]

    def arcs(n, r=100.0):
        k = 4 / 3 * np.tan(np.pi / n / 2)
        out = []
        for i in range(n):
            a, b = 2 * np.pi * i / n, 2 * np.pi * (i + 1) / n
            p, q = np.array([np.cos(a), np.sin(a)]), np.array([np.cos(b), np.sin(b)])
            out.append([tuple(r * x) for x in (p, p + k * np.array([-p[1], p[0]]), q - k * np.array([-q[1], q[0]]), q)])
        return out

    assert [e.type for e in geometry.elements_of_path(arcs(4))] == ["closed_curve"]
    assert [e.type for e in geometry.elements_of_path(arcs(32))] == ["circle"]
    assert [e.type for e in geometry.join_circles([geometry.curve(a) for a in arcs(4)])] == ["curve"] * 4
    one = [geometry.line((0, 0), (10, 0)), geometry.rectangle(0, 0, 5, 5), *geometry.elements_of_path(arcs(32))]
    assert abs(geometry.geometry_result(one, one)["overall"] - 1) < 1e-9
    assert geometry.geometry_result([], [])["overall"] == 1 and geometry.geometry_result(one, [])["overall"] == 0
    assert len(geometry.without_duplicates([*one, geometry.line((0, 0), (10, 0.5))])) == 3
    assert geometry.geometry_result(one, one[:1])["counts"]["circle"] == {"candidate": 1, "reference": 0}


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (5, 7, 3), (4, 4, 4), (3, 9, 2)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        assert (imaging.decode_png(imaging.encode_png(x)).reshape(shape) == x).all()
    with pytest.raises(ValueError):
        imaging.decode_png(b"no")


def test_png_predictors():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (5, 6, 3)).astype(np.int64)
    lines = []
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        row, up = x[y].reshape(-1), x[y - 1].reshape(-1) if y else np.zeros(18, int)
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        d = np.abs(np.stack([p - left, p - up, p - corner]))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        guess = (0 * row, left, up, (left + up) // 2, paeth)[kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (imaging.decode_png(png) == x).all()


def test_pixel_metrics():
    rng = np.random.default_rng(0)
    x = rng.random((40, 50)).astype(np.float32)
    y = rng.random((40, 50)).astype(np.float32)
    assert imaging.psnr(x, x) == float("inf") and abs(imaging.ssim(x, x) - 1) < 1e-9
    assert imaging.edge_similarity(x, x) == imaging.pixel_similarity(x, x) == 1 and imaging.pixel_distance(x, x) == 0
    assert imaging.ssim(x, y) < 0.2 and -1 <= imaging.pixel_similarity(x, y) < 0.2 and 0 <= imaging.pixel_distance(x, y) <= 2
    assert abs(imaging.psnr(np.zeros((4, 4), np.float32), np.full((4, 4), 0.1, np.float32)) - 20) < 1e-4
    assert imaging.resize(x, 20, 25).shape == (20, 25) and np.allclose(imaging.resize(np.ones((3, 3)), 7, 5), 1)
    assert imaging.require_grey(x) is x
    with pytest.raises(ValueError):
        imaging.require_grey(x * 2)


def test_canny_finds_a_step():
    x = np.zeros((20, 20))
    x[:, 10:] = 255
    edges = imaging.canny(x)
    assert edges[5].sum() == 1 and edges[:, :8].sum() == 0


def test_trim_and_flatten():
    x = np.full((10, 20, 3), 255, np.uint8)
    x[2:4, 5:11] = 0
    assert imaging.trim_square(x).shape == (6, 6, 3) and imaging.trim_square(x, 12).shape == (12, 12, 3)
    assert imaging.is_blank(x[:1]) and not imaging.is_blank(x)
    clear = np.zeros((2, 2, 4), np.uint8)
    assert (imaging.on_white(clear) == 255).all()


def test_lanczos_keeps_flat_pictures_and_their_range():
    assert (imaging.lanczos(np.full((9, 5, 3), 77, np.uint8), 4, 11) == 77).all()
    x = np.zeros((8, 8, 1), np.uint8)
    x[:, 4:] = 255
    up, down = imaging.lanczos(x, 8, 16)[0, :, 0], imaging.lanczos(x, 4, 4)[0, :, 0]
    assert up[0] < 10 and up[-1] > 245 and down.tolist() == sorted(down.tolist()) and abs(int(down[0]) + int(down[-1]) - 255) <= 1
    wide = np.zeros((10, 40, 3), np.uint8)
    assert imaging.trim_square(wide, 20).shape == (20, 20, 3) and (imaging.trim_square(wide, 20)[:7] == 255).all() and (imaging.trim_square(wide, 20)[8:12] < 255).all()


@pytest.mark.parametrize("turned", range(1, 9))
def test_upright(turned):
    """Against the turns and mirrors that each orientation names."""
    x = np.arange(6).reshape(2, 3, 1)
    named = [x, x[:, ::-1], np.rot90(x, 2), x[::-1], x.swapaxes(0, 1), np.rot90(x, -1), np.rot90(x, 2).swapaxes(0, 1), np.rot90(x, 1)]
    assert np.array_equal(imaging.upright(x, turned), named[turned - 1])


def test_orientation_of_files():
    entry = lambda order, value: struct.pack(order + "HHIHH", imaging.ORIENTATION, imaging.SHORT, 1, value, 0)
    block = lambda order, value: (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 1) + entry(order, value)
    jpeg = lambda e: b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(e) + 8) + b"Exif\0\0" + e + b"\xff\xda\0\2"
    assert [imaging.orientation(jpeg(block(o, v))) for o, v in (("<", 6), (">", 3), ("<", 9))] == [6, 3, 1]
    assert imaging.orientation(jpeg(b"II*\0")) == imaging.orientation(jpeg(block("<", 6)[:12])) == imaging.orientation(b"") == imaging.orientation(b"\xff\xd8\xff") == 1


def test_loader(tmp_path):
    png = imaging.encode_png(np.full((2, 3, 4), 0, np.uint8))
    (tmp_path / "a.png").write_bytes(png)
    text = base64.b64encode(png).decode()
    load = imaging.Loader({"jpeg": lambda data: np.full((1, 1, 1), len(data), np.uint8)}, fetch={"https://x/y": png}.__getitem__)
    for image in (png, str(tmp_path / "a.png"), "file:" + str(tmp_path / "a.png"), text, "data:image/png;base64," + text, "https://x/y"):
        assert (load(image) == 255).all() and load(image).shape == (2, 3, 3)
    assert load(b"\xff\xd8\xff\xe0")[0, 0].tolist() == [4, 4, 4]
    for image in (b"", b"GIF89a", png[:20], png[:-20], "no such file", "data:image/png;base64,!", "https://x/z", None):
        with pytest.raises(ValueError):
            load(image)
    with pytest.raises(ValueError):
        imaging.Loader()("https://x/y")


def test_edit_distance():
    assert extended_edit_distance(" a b ", " a b ") < 0.35 and extended_edit_distance("", " abc def ") == 1
    assert extended_edit_distance(" kitten sits ", " kitten sits ") < extended_edit_distance(" kittn sits ", " kitten sits ") < extended_edit_distance(" zzz ", " kitten sits ")


def test_bins():
    assert parse_bins("0-200, 200-400") == ((0, 200), (200, 400)) and parse_bins("") == parse_bins(None) == BINS


def brute_edit_distance(p, r):
    row, visits = [0.0] + [1.0] * len(p), [-1] * (len(p) + 1)
    for c in r:
        step = [row[0] + 1.0]
        for i in range(1, len(row)):
            step.append(min(step[i - 1] + 0.2, row[i - 1] + (p[i - 1] != c), row[i] + 1.0))
        best = step.index(min(step))
        visits[best] += 1
        row = [min(x, 2.0 + step[best]) for x in step] if c == " " else step
    covered = 0.3 * sum(v if v >= 0 else 1 for v in visits)
    return min(1.0, (row[-1] + covered) / (len(r) + covered))


def test_edit_distances_of_many_pairs():
    import random

    from limn.operators.textmetrics import extended_edit_distances

    rng = random.Random(4)
    text = lambda: "".join(rng.choices("ab c  d\u00e9", k=rng.choice([0, 1, 5, 40, 90])))
    pairs = [(text(), text()) for _ in range(700)]
    assert np.allclose(extended_edit_distances(pairs), [brute_edit_distance(*x) for x in pairs], rtol=0, atol=1e-12)
    assert extended_edit_distances([]) == []


def test_drawing_items():
    kinds = lambda items: [e.type for e in geometry.elements_of_items(items)]
    square = [("l", [(0, 0), (9, 0)]), ("l", [(9, 0), (9, 9)]), ("l", [(9, 9), (0, 9)])]
    assert kinds([("re", [(1, 2), (5, 9)])]) == ["rectangle"] and geometry.elements_of_items([("re", [(1, 2), (5, 9)])])[0].coordinates == [1, 2, 4, 7]
    assert kinds([("qu", [(0, 0), (9, 0), (9, 9), (0, 9)])]) == ["rectangle"] and kinds([("qu", [(0, 0), (9, 0), (5, 9), (0, 3)])]) == ["polygon"]
    assert kinds([("m", [(0, 0)]), *square, ("h", [])]) == ["rectangle"] and kinds([*square, ("s", [])]) == ["rectangle"]
    assert kinds([*square[:2], ("m", [(50, 50)]), ("l", [(50, 50), (60, 50)])]) == ["line", "line", "line"]
    assert kinds([("c", [(0, 0), (1, 5), (5, 1), (9, 9)]), ("zz", [])]) == ["curve"] and kinds([("h", [])]) == []


def test_recent_results_are_bounded():
    from limn.providers import Recent

    made = []
    seen = Recent(2_000)
    for code in ("a", "b", "a", "c" * 3, "a"):
        seen.get(code, lambda c: made.append(c) or {"png": bytes(700)})
    assert made == ["a", "b", "ccc"] and seen.held <= 2_000 and len(seen.results) == 2
