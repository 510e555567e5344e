"""Operators, sources, sinks, providers, pipelines and streams on Spark."""

import json
from collections import Counter
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import numpy as np
import pytest
from pyspark.sql import functions as F

from limn import providers, sources, streaming
from limn.functions import imaging, text
from limn.operators import annotation, filters, layout, sampling, textmetrics, vectors
from limn.plans import pipelines
from limn.sources import sinks


class Asked:
    """A model that takes some of the flags."""

    def __init__(self):
        self.options, self.connection, self.timeout, self.model, self.checked = {}, {}, 1, "", False

    def check(self):
        self.checked = True


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def series(n):
    return " ".join(f"({i},{i})" for i in range(n))


@pytest.mark.parametrize(
    ("code", "dense"),
    [
        (None, False),
        ("", False),
        (rf"\begin{{axis}}\addplot coordinates {{{series(16)}}};\end{{axis}}", False),
        (rf"\begin{{axis}}\addplot coordinates {{{series(17)}}};\end{{axis}}", True),
        (r"\begin{axis}" + rf"\addplot coordinates {{{series(16)}}};" * 6 + r"\end{axis}", False),
        (r"\begin{axis}" + rf"\addplot coordinates {{{series(16)}}};" * 7 + r"\end{axis}", True),
        ("\\begin{axis}\\addplot table[x=a] {" + "\n".join(f"{i} {i}" for i in range(17)) + "\n};\\end{axis}", True),
        (rf"\draw[red] plot[smooth] coordinates {{{series(17)}}};", True),
        (rf"\draw[red] plot[smooth] coordinates {{{series(16)}}};", False),
        (rf"\node coordinates {{{series(30)}}};", False),
    ],
)
def test_density(spark, code, dense):
    assert one(spark, filters.too_dense, code) is dense


def test_blacklist_and_logs(spark):
    assert one(spark, filters.blacklisted, "a \\IncludeGraphics{x}") and not one(spark, filters.blacklisted, "\\draw") and not one(spark, filters.blacklisted, None)
    assert one(spark, filters.log_findings, "Overfull \\hbox\n! Missing $ inserted") == ["overfull", "missing"]
    assert one(spark, filters.clean_log, "fine") is True and one(spark, filters.clean_log, None) is False
    assert one(spark, filters.valid_image, "__INVALID__:x") is False and one(spark, filters.valid_image, "x.png") is True


REPLIES = [
    ("```latex\n a \n```", "a", "a"),
    ("say\n```\nb\n```\nthen", "b", "say\n```\nb\n```\nthen"),
    ("<think>x</think><answer> c </answer>", "c", "<think>x</think><answer> c </answer>"),
    (" plain ", " plain ", "plain"),
]


@pytest.mark.parametrize(("reply", "extracted", "unwrapped"), REPLIES)
def test_replies(spark, reply, extracted, unwrapped):
    assert one(spark, text.extract_code, reply) == extracted and one(spark, text.unwrap_fence, reply) == unwrapped


def test_fence_split(spark):
    assert tuple(one(spark, text.fence_split, "t\n```x\n code \n```")) == ("t\n```x\n code \n```", "code")
    assert tuple(one(spark, text.fence_split, "``` no line ```")) == ("``` no line ```", None)
    assert tuple(one(spark, text.fence_split, "```\n\n```")) == ("```\n\n```", None)
    assert tuple(one(spark, text.fence_split, None)) == ("", None)


def test_format_and_strip(spark):
    assert one(spark, text.format_score, "<think>a\n</think> \n<answer>b</answer>") == 1.0 and one(spark, text.format_score, "x<think></think><answer></answer>") == 0.0
    assert one(spark, text.strip, "\u00a0 a b \u2003\n") == "a b" and one(spark, text.squeeze_tags, "a < b / c > d") == "a<b/c>d"
    assert one(spark, lambda c: text.inject_page_style(c, "S"), "a\nb\n") == "a\nS\nb\n" and one(spark, text.rot13, "Hello") == "Uryyb"


@pytest.mark.parametrize(("a", "b", "want"), [("Alpha ", "alpha", (True, True, 0)), ("abc", "abd", (True, False, 1)), ("a", "b", (False, False, None)), ("", "", (False, False, None)), (None, "x", (False, False, None)), ("abcdefghij", "abcdefghxy", (True, False, 2))])
def test_similar_text(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert tuple(df.select(layout.similar_text(F.col("a"), F.col("b")).alias("s")).first()["s"]) == want


def test_stratified(spark):
    df = spark.createDataFrame([(i, "w " * (i * 7 % 500)) for i in range(1, 300)], "orig_id long, code string")
    first, random = (sampling.stratified(df, 5, strategy=s).collect() for s in ("first", "random"))
    for rows in (first, random):
        assert max(Counter(r["bin"] for r in rows).values()) <= 5 and all(sampling.BINS[r["bin"]][0] <= r["n_tokens"] < sampling.BINS[r["bin"]][1] for r in rows)
    for b in {r["bin"] for r in first}:
        ids = sorted(r["orig_id"] for r in sampling.token_bins(df).collect() if r["bin"] == b)
        assert sorted(r["orig_id"] for r in first if r["bin"] == b) == ids[:5]
    assert {r["orig_id"] for r in first} != {r["orig_id"] for r in random}
    with pytest.raises(ValueError):
        sampling.stratified(df, 5, strategy="other")


def test_row_ids_and_columns(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "code string")
    assert sorted(map(tuple, sources.with_row_id(df, order=["code"]).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted(r["orig_id"] for r in sources.with_row_id(df).collect()) == [0, 1, 2]
    many = spark.range(1000).repartition(7).select(F.col("id").alias("x"))
    assert sorted(r["orig_id"] for r in sources.with_row_id(many).collect()) == list(range(1000))
    assert sources.with_row_id(df.withColumn("orig_id", F.lit(7))).first()["orig_id"] == 7
    with pytest.raises(ValueError, match="absent"):
        sources.require_columns(df, "code", "image")


def test_keep_and_dump_split(spark, tmp_path):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["ok", "lipsum", rf"\begin{{axis}}coordinates {{{series(20)}}}\end{{axis}}", None])], "orig_id long, code string")
    sinks.split(filters.tagged(df), str(tmp_path / "k"), str(tmp_path / "d"))
    kept, dropped = spark.read.parquet(str(tmp_path / "k")), spark.read.parquet(str(tmp_path / "d"))
    assert sorted(r["orig_id"] for r in kept.collect()) == [0, 3] and {(r["orig_id"], r["reason"]) for r in dropped.collect()} == {(1, "blacklist"), (2, "density")}
    assert kept.columns == df.columns


class Checks:
    """Compiles what doesn't hold "bad"; a page for each."""

    def compile(self, code):
        if "boom" in code:
            raise RuntimeError("boom")
        ok = "bad" not in code
        png = imaging.encode_png(np.arange(64, dtype=np.uint8).reshape(8, 8) * (1 + len(code) % 3)) if ok else None
        log = "Overfull" if "wide" in code else ""
        return dict(zip(providers.COMPILED_FIELDS, (ok, 0 if ok else 1, 0.0, None if ok else "no", log, png, b"x" * 2000 if ok else None)))


def test_filter_with_compiler_and_recordings(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["ok", "bad", "wide", "lipsum", "boom", None])], "orig_id long, code string")
    got = {r["orig_id"]: r["reason"] for r in pipelines.filtered(df, Checks()).collect()}
    assert got == {0: None, 1: "compile", 2: "compile", 3: "blacklist", 4: "compile", 5: None}  # null code is empty code
    kinds = providers.COMPILED
    table = spark.createDataFrame([("ok", True, 0, 0.0, None, "", None, None), ("wide", True, 0, 0.0, None, "Overfull", None, None)], "code string, " + kinds).withColumn("code_sha256", F.sha2("code", 256)).drop("code")
    got = {r["orig_id"]: r["reason"] for r in pipelines.filtered(df, recorded=table).collect()}
    assert got[0] is None and got[1] == got[2] == got[4] == "compile" and got[3] == "blacklist"


def test_corpus_plan(spark):
    df = spark.createDataFrame([(i, f"(1.23456,{i})" + " w" * i) for i in range(20)], "orig_id long, code string")
    rows = pipelines.corpus(df, 4, "first").collect()
    assert sorted(r["orig_id"] for r in rows) == [0, 1, 2, 3] and rows[0]["code"].startswith("(1.23500,")


def test_rendering(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "orig_id long, code string")
    out = pipelines.rendered(df, Checks())
    assert {r["orig_id"]: r["render_image"] is not None for r in out.collect()} == {1: True, 2: False, 3: False}
    assert pipelines.rendered(df, Checks(), drop_failed=True).count() == 1
    assert sinks.failures(out, str(tmp_path / "f"), "render_image") and spark.read.parquet(str(tmp_path / "f")).columns == ["orig_id", "code"]
    sinks.success_index(out, "orig_id", "render_image", str(tmp_path / "s"))
    assert [r[0] for r in spark.read.json(str(tmp_path / "s")).collect()] == [1]
    assert sinks.failure_preview(out.filter(F.col("render_image").isNull()), "orig_id", 1) == ([2], 1)


def test_rewriting(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "orig_id long, code string")
    model = providers.RecordedReplies({"Go\n\n```latex\na\n```": "thought\n```latex\nb\n```"}, "no fence")
    out = pipelines.rewritten(df, model, "Go").collect()
    assert [(r["orig_id"], r["new_code"]) for r in out] == [(1, "b")]
    kept = pipelines.rewritten(df, model, "Go", keep_failed=True)
    assert {r["orig_id"]: r["new_code"] for r in kept.collect()} == {1: "b", 2: ""}
    assert tuple(pipelines.kept_ratio(df, df.limit(1)).first()) == (1, 2, 50.0)


def test_chat_model_tries_api_errors_again():
    class Client:
        calls = 0

        async def reply(self, model, system, prompt):
            Client.calls += 1
            if prompt == "down" or (prompt == "once" and Client.calls == 1):
                raise ConnectionError
            return prompt.upper()

    assert providers.ChatModel(Client, "m", attempts=1).generate([{"prompt": "x"}, {"prompt": "down"}]) == ["X", ""]


def test_annotation_resumes_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}.png") for i in range(4)], "id long, path string")
    model = providers.RecordedReplies(default='```json\n{"label": " charts ", "score": 1}\n```')
    out = annotation.annotate(df, "id", model, annotation.system_prompt(), valid=F.col("id") != 3)
    path = str(tmp_path / "a")
    sinks.append_json(out.filter("index < 2"), path)
    left = sinks.append_json(out, path)
    done = sources.json_lines(spark, path, "index long, path string, raw string")
    assert sorted(r["index"] for r in done.collect()) == [0, 1, 2, 3] and left.columns == out.columns
    counts = annotation.label_histogram(done)
    assert [tuple(r) for r in counts.collect()] == [("charts", 3), ("mixed", 1)]
    assert tuple(annotation.parse_counters(done).first()) == (4, 3, 1)
    sinks.counts_csv(counts, str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == [("charts", "3"), ("mixed", "1")]
    assert one(spark, annotation.rating, "x Score: 4") == 4 and one(spark, annotation.rating, "x") is None
    assert annotation.image_column(spark.createDataFrame([], "a int, png binary")) == "png"


def test_json_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"index": 1, "predicted": "a", "ground_truth": "b"}]))
    assert tuple(sources.predictions(spark, str(tmp_path / "p.json")).first()) == (1, "a", "b")
    (tmp_path / "q.json").write_text(json.dumps([{"index": 1, "predicted": "a"}]))
    with pytest.raises(ValueError):
        sources.predictions(spark, str(tmp_path / "q.json"))
    (tmp_path / "l.jsonl").write_text('{"index": 1}\n\n  \nnot json\n')
    assert sorted(str(r["index"]) for r in sources.json_lines(spark, str(tmp_path / "l.jsonl"), "index long").collect()) == ["1", "None"]


def test_directories(spark, tmp_path):
    (tmp_path / "s" / "t").mkdir(parents=True)
    for p in ("b.tex", "a.tex", "t/c.tex", "n.txt"):
        (tmp_path / "s" / p).write_text(f"code of {p}\nline")
    names = lambda df: [r["path"].rsplit("/", 1)[-1] for r in df.orderBy("path").collect()]
    assert names(sources.source_files(spark, str(tmp_path / "s"))) == ["a.tex", "b.tex"]
    assert names(sources.source_files(spark, str(tmp_path / "s"), recursive=True)) == ["a.tex", "b.tex", "c.tex"]
    assert names(sources.source_files(spark, str(tmp_path / "s"), recursive=True, limit=2)) == ["a.tex", "b.tex"]
    with pytest.raises(FileNotFoundError):
        sources.source_files(spark, str(tmp_path / "s"), "*.none")

    def write(path, data):
        with open(path, "wb") as f:
            f.write(data)

    (tmp_path / "o").mkdir()
    df = sources.source_files(spark, str(tmp_path / "s"))
    sinks.files(df, text.output_path(F.col("path"), str(tmp_path / "s"), str(tmp_path / "o")), F.col("source"), write)
    assert (tmp_path / "o" / "a.tex").read_text() == "code of a.tex\nline"


def test_image_folders_and_evaluation(spark, tmp_path):
    rng = np.random.default_rng(0)
    for side in ("p", "r"):
        (tmp_path / side).mkdir()
        for name in ("a", "b") if side == "p" else ("a", "c"):
            (tmp_path / side / f"{name}.png").write_bytes(imaging.encode_png(rng.integers(0, 256, (20, 20, 3)).astype(np.uint8)))
    (tmp_path / "r" / "b.png").write_bytes(b"broken")
    pairs = sources.image_pairs(spark, str(tmp_path / "p"), str(tmp_path / "r"))
    assert sorted(r["filename"] for r in pairs.collect()) == ["a.png", "b.png"]
    scored = pipelines.evaluated(pairs)
    assert [r["filename"] for r in scored.collect()] == ["a.png"]
    preds = spark.createDataFrame([(1, "\\draw (0,0) -- (1,1) node {a b c d e};", "\\draw (0,0) -- (1,1) node {a b c d e};"), (2, "x", "y")], "index long, predicted string, ground_truth string")
    row = pipelines.evaluation_summary(scored, preds).first()
    assert row["coverage"] == "1/2" and 0 <= row["ted"] <= 100 and 0 <= row["bleu"] <= 100
    sinks.metrics_csv(scored, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 1


def test_image_cells(spark):
    df = spark.createDataFrame([(1, "data:image/png;base64,QUI="), (2, "http://x/y"), (3, "a/b.png"), (4, None)], "id long, image string")
    got = {r["id"]: tuple(r["image"]) for r in sources.image_cells(df, "image").collect()}
    assert got == {1: (None, bytearray(b"AB"), "data"), 2: ("http://x/y", None, "url"), 3: ("a/b.png", None, "path")}
    assert sources.image_cells(df, "image", 2, "id").count() == 2
    png = spark.createDataFrame([(1, imaging.encode_png(np.zeros((2, 2), np.uint8))), (2, b"no")], "id long, image binary")
    checked = sources.image_cells(png, "image", verify=True).select("id", filters.valid_image(F.coalesce("image.path", F.lit(""))).alias("ok"))
    assert {r["id"]: r["ok"] for r in checked.collect()} == {1: True, 2: False}


def test_cells_of_any_origin_become_png(spark, tmp_path):
    png = imaging.encode_png(np.full((2, 2), 9, np.uint8))
    (tmp_path / "a.png").write_bytes(png)
    rows = [(1, [png, b"x"]), (2, [b"x"]), (3, []), (4, None)]
    cells = sources.image_cells(spark.createDataFrame(rows, "id long, image array<binary>"), "image")
    got = {r["id"]: r["p"] for r in cells.select("id", imaging.as_png(F.col("image")).alias("p")).collect()}
    assert sorted(got) == [1, 2] and got[2] is None and (imaging.decode_png(bytes(got[1])) == 9).all()
    paths = sources.image_cells(spark.createDataFrame([(1, str(tmp_path / "a.png")), (2, "https://x/y"), (3, str(tmp_path / "b.png"))], "id long, image string"), "image")
    fetch = lambda address: imaging.encode_png(np.full((1, 1), len(address), np.uint8))
    got = {r["id"]: r["p"] and imaging.decode_png(bytes(r["p"]))[0, 0, 0] for r in paths.select("id", imaging.as_png(F.col("image"), imaging.Loader(fetch=fetch)).alias("p")).collect()}
    assert got == {1: 9, 2: 11, 3: None}
    sources.required_paths(spark, str(tmp_path), str(tmp_path / "*.png"))
    with pytest.raises(FileNotFoundError):
        sources.required_paths(spark, str(tmp_path), str(tmp_path / "*.gif"))


def test_folders_of_jpegs(spark, tmp_path):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for x in range(16):
        for y in range(8):
            picture.setRGB(x, y, 0x2040C0)
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    (tmp_path / "b.jpg").write_bytes(b"broken")
    (row,) = sources.decoded_images(spark, str(tmp_path)).collect()
    pixels = imaging.decode_png(bytes(row["bytes"])).astype(int)
    assert row["filename"] == "a.jpg" and pixels.shape == (8, 16, 3) and abs(pixels - [0x20, 0x40, 0xC0]).max() <= 4


def test_bleu_of_equal_texts(spark):
    pairs = spark.createDataFrame([(1, "a b c d e f".split(), "a b c d e f".split()), (2, "u v w x y".split(), "u v w x y".split())], "key long, p array<string>, r array<string>")
    assert abs(textmetrics.corpus_bleu(pairs, "key", F.col("p"), F.col("r"), top=0).first()["bleu"] - 100) < 1e-9
    assert textmetrics.corpus_bleu(pairs, "key", F.col("p"), F.col("r")).first()["bleu"] == 0
    assert textmetrics.corpus_bleu(pairs.limit(0), "key", F.col("p"), F.col("r")).first()["bleu"] == 0


def test_kernel_distance_is_the_sum_over_pairs(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=(20, 5)) + 1
    rows = [(True, v.tolist()) for v in x] + [(False, v.tolist()) for v in y] + [(None, x[0].tolist())]
    got = vectors.kernel_distance(spark.createDataFrame(rows, "side boolean, v array<double>").repartition(3), "v", F.col("side"), 5).first()
    k = lambda a, b: (a @ b.T / 5 + 1) ** 3
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    assert (got["n"], got["m"]) == (30, 20) and abs(got["mmd2"] - (off(k(x, x)) + off(k(y, y)) - 2 * k(x, y).mean())) < 1e-8
    mean, _ = vectors.kernel_distance_subsets(x, y, subsets=20, size=10)
    assert mean > 0


def test_rewards(spark):
    png = imaging.encode_png(np.arange(64, dtype=np.uint8).reshape(8, 8) * (1 + len("ok") % 3))
    rows = [(1, "<think>a</think><answer>ok</answer>", png), (2, "bad", png), (3, "ok", None)]
    got = {r["id"]: r for r in pipelines.rewards(spark.createDataFrame(rows, "id long, response string, reference_png binary"), Checks()).collect()}
    assert (got[1]["format"], got[1]["compile"], got[1]["pixel"], got[1]["overall"]) == (1.0, 1.0, 1.0, 0.5)
    assert (got[2]["format"], got[2]["pixel"], got[2]["overall"]) == (0.0, -1.0, -0.5)
    assert got[3]["overall"] == 0.0


def test_merged_metrics(spark):
    a = spark.createDataFrame([("x", 1.0), (None, 9.0)], "filename string, m double")
    b = spark.createDataFrame([("x", 2.0, 5.0), ("y", 3.0, None)], "filename string, m double, k double")
    assert sorted(map(tuple, pipelines.merged_metrics([a, b]).select("filename", "m", "k").collect())) == [("global", 9.0, None), ("x", 2.0, 5.0), ("y", 3.0, None)]


def test_streams(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    batch = lambda a, b: spark.createDataFrame([(i, "lipsum" if i % 2 else "ok") for i in range(a, b)], "orig_id long, code string").write.mode("append").parquet(src)
    batch(0, 4)
    for upto in (4, 7):
        stream = streaming.arriving(spark, src, "orig_id long, code string")
        streaming.resumable(stream, streaming.filtered, out, check).awaitTermination()
        assert sorted(r["orig_id"] for r in spark.read.parquet(out).collect()) == list(range(upto))
        if upto == 4:
            batch(4, 7)
    q = streaming.running_means(streaming.arriving(spark, src, "orig_id long, code string"), "code", "orig_id").writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["code"]: r["mean"] for r in spark.table("means").collect()} == {"ok": 3.0, "lipsum": 3.0}


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert sources.setting(spark, "api_key") == "k" and sources.setting(spark, "image_folder", "d") == "d"
    monkeypatch.delenv("OPENAI_API_KEY")
    with pytest.raises(ValueError):
        sources.setting(spark, "api_key", required=True)


def test_frequent_ngrams_are_all_counted(spark):
    """Against counting everything, with few and with many n-grams above the limit, and ties."""
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghijklmnop", weights=range(1, 17), k=rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    words = textmetrics.whitespace_words(F.col("text"))
    for top in (1, 5, 60, 100_000):
        want = [tuple(r) for r in textmetrics.trivial_ngrams(textmetrics.ngram_counts(df, words), top).select("n", "gram", "k").collect()]
        assert textmetrics.frequent_ngrams(df, words, top) == want
    assert textmetrics.frequent_ngrams(df.limit(0), words) == []


def test_tokenizer_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.tokenizer_files(spark, str(tmp_path / "none"), str)

    def fetch(path):
        (tmp_path / "t").mkdir()
        (tmp_path / "t" / "tokenizer.json").write_text("{}")

    assert sources.tokenizer_files(spark, str(tmp_path / "t"), str, fetch)().endswith("t")


def test_evaluation_columns_of_models(spark):
    images = spark.createDataFrame([("a", 1.0, 0.5, 0.25), ("b", 3.0, 0.7, None)], "filename string, psnr double, dsim double, lpips double")
    texts = spark.createDataFrame([(0, "a b", "a b")], "index long, predicted string, ground_truth string")
    kid = spark.createDataFrame([(0.125,)], "mmd2 double")
    got = pipelines.evaluation_summary(images, texts, kid, bleu=False, ted=False).first().asDict()
    assert got == {"psnr": 2.0, "dsim": 60.0, "lpips": 0.25, "kid": 0.125, "coverage": "2/1"}


def test_fetching(tmp_path):
    (tmp_path / "a").write_bytes(b"bytes")
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=str(tmp_path)))
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert providers.fetched(f"http://127.0.0.1:{server.server_port}/a") == b"bytes"
    finally:
        server.shutdown()
        server.server_close()


def test_model_flags():
    from limn.__main__ import _model, parser

    common = ["--input", "a", "--output", "b", "--model", "tests.test_engine:Asked"]
    a = parser().parse_args(["add-comments", *common, "--temperature", "0.5", "--base-url", "u", "--api-timeout", "9", "--model-id", "m"])
    model = _model(a, **pipelines.COMMENT_OPTIONS)
    assert model.options == {"extra_body": {"enable_thinking": False}, "temperature": 0.5} and model.connection == {"base_url": "u"}
    assert model.timeout == 9 and model.model == "m" and model.checked and not hasattr(model, "concurrency")


def test_latexmk_and_the_reward_s_engine():
    command = providers.LatexCompiler(latexmk=True).command("xelatex")
    assert command[:2] == ["latexmk", "-xelatex"] and any("no-shell-escape" in c for c in command)
    assert providers.reward_compiler().engines == ("pdflatex",) and providers.reward_compiler().render


def test_compiler_without_engines():
    result = providers.LatexCompiler(engines=("no-such-engine",)).compile("x")
    assert result["ok"] is False and "no-such-engine" in result["error"]
    assert providers.run_group(["sleep", "30"], "/", 0.2)[0] == providers.TIMED_OUT


def test_pushdown_and_plans(spark):
    from limn.plans.catalogue import QUERIES

    spark.catalog.clearCache()  # what another test left there would be read instead
    plan = QUERIES["stratified_first"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "lang" not in plan.split("ReadSchema")[1].split(">")[0]


class Page:
    """A PDF whose bytes are JSON."""

    def boxes(self, pdf):
        d = json.loads(pdf)
        return d["w"], d["h"], d["boxes"]

    def paths(self, pdf):
        return json.loads(pdf)["paths"]

    def extract(self, images):
        return [[float(len(i)), 1.0] for i in images]

    def distances(self, pairs):
        if any(a == b"boom" for a, _ in pairs):
            raise RuntimeError
        return [0.25 if a != b else 0.0 for a, b in pairs]


def test_pdf_and_model_columns(spark):
    page = {"w": 200, "h": 100, "boxes": [{"x0": 0.0, "y0": 0.0, "x1": 100.0, "y1": 50.0, "text": "a"}, {"x0": 5.0, "y0": 5.0, "x1": 5.0, "y1": 9.0, "text": "flat"}], "paths": [{"segments": [[[0, 0], [10, 0]]], "closed": False}] * 2}
    df = spark.createDataFrame([(1, json.dumps(page).encode(), b"ab"), (2, b"broken", b"boom"), (3, None, None)], "id long, pdf binary, png binary")
    got = {r["id"]: r for r in df.select("id", providers.text_boxes(F.col("pdf"), Page()).alias("b"), providers.drawing_elements(F.col("pdf"), Page()).alias("e")).collect()}
    assert [tuple(b) for b in got[1]["b"]] == [(0.0, 96.0, 192.0, 192.0, "a")] and got[2]["b"] == got[3]["b"] == []
    assert [e["type"] for e in got[1]["e"]] == ["line"] and got[2]["e"] == []
    assert {r["id"]: r["features"] for r in providers.features(df, "png", Page()).collect()} == {1: [2.0, 1.0], 2: [4.0, 1.0], 3: None}
    scored = providers.perceptual_similarity(df.withColumn("ref", F.lit(b"ab")), "png", "ref", Page(), batch=1).collect()
    assert {r["id"]: r["perceptual"] for r in scored} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_commands(spark, tmp_path):
    from limn.__main__ import main

    at = lambda n: str(tmp_path / n)
    spark.createDataFrame([(i, f"(1.23456,{i})" + (" lipsum" if i % 2 else "")) for i in range(10)], "orig_id long, code string").write.parquet(at("in"))
    main(["both", "--input", at("in"), "--out-keep", at("k"), "--out-dump", at("d"), "--out-rounded", at("r"), "--out-sample", at("s"), "--samples-per-bin", "3", "--bin-strategy", "first"])
    assert [r["orig_id"] for r in spark.read.parquet(at("s")).orderBy("orig_id").collect()] == [0, 2, 4] and spark.read.parquet(at("d")).count() == 5
    main(["reorder", "--input", at("in"), "--output", at("w"), "--model", "limn.plans.catalogue:EchoModel"])
    assert spark.read.parquet(at("w")).count() == 10
    spark.createDataFrame([(i, b"x") for i in range(3)], "index long, image binary").write.parquet(at("img"))
    main(["classify", "--input", at("img"), "--output", at("a"), "--model", "limn.providers:RecordedReplies", "--stats-csv", at("c")])
    assert spark.read.csv(at("c"), header=True).first()["label"] == "mixed"
