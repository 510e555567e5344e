"""Queries that write what they read, read it back, and run the flows with stand-in providers; and the same in DuckDB SQL.

Files go below spark.checkpoint.dir. Sinks run when the query is called, as they return nothing.
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from limn import sources, streaming
from limn.functions import imaging, preamble, rounding
from limn.operators import filters, geometry, layout
from limn.plans import catalogue, fixtures, pipelines
from limn.plans.catalogue import query
from limn.plans.fixtures import scratch, spread, table
from limn.providers import COMPILED_FIELDS, RuleCompiler, failed
from limn.sources import sinks

md5 = lambda c: F.md5(c.cast("binary"))
_PLAIN = lambda path: path.removeprefix("file://")


def _write_files(df: DataFrame, folder: str, name, data) -> None:
    sinks.files(spread(df), F.concat(F.lit(_PLAIN(folder) + "/"), name), data, sinks.local_file)


@query("SELECT doc_id, md5(text) AS source FROM documents")
def source_files_round_trip(spark, sf_dir):
    """A file for each document, in a folder for each source, found again below the top one."""
    out = scratch(spark, "tex")
    _write_files(table(spark, sf_dir, "documents"), out, F.concat("source", F.lit("/f"), "doc_id", F.lit(".tex")), F.col("text"))
    found = sources.source_files(spark, out, recursive=True)
    return found.select(F.regexp_extract("path", r"/f(\d+)\.tex\z", 1).cast("long").alias("doc_id"), md5(F.col("source")).alias("source"))


@query("SELECT 'p' || lpad(CAST(page_id AS VARCHAR), 12, '0') || '.tex' AS name, md5(html) AS source FROM pages ORDER BY 1 LIMIT 20")
def first_source_files(spark, sf_dir):
    """The first files by path of a flat folder."""
    out = scratch(spark, "flat")
    _write_files(table(spark, sf_dir, "pages"), out, F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(".tex")), F.col("html"))
    found = sources.source_files(spark, out, limit=20)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), md5(F.col("source")).alias("source"))


@query(f"WITH {catalogue._TURNS} SELECT key AS index, md5(p) AS predicted, md5(r) AS ground_truth FROM c")
def predictions_round_trip(spark, sf_dir):
    out = scratch(spark, "predictions")
    sinks.predictions_json(fixtures.turns(spark, sf_dir).select("index", "predicted", "ground_truth"), out)
    return sources.predictions(spark, out, lines=True).select("index", md5(F.col("predicted")).alias("predicted"), md5(F.col("ground_truth")).alias("ground_truth"))


@query("SELECT conv_id * 1000 + turn AS index, md5(text) AS raw, 1::BIGINT AS times FROM conversations")
def append_and_resume(spark, sf_dir):
    """Users' turns are appended first; a second run over all turns does what is left, a third nothing."""
    out = scratch(spark, "replies")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), "role", F.col("text").alias("raw"))
    sinks.append_json(rows.filter("role = 'user'").drop("role"), out)
    for _ in range(2):
        sinks.append_json(rows.drop("role"), out)
    back = sources.json_lines(spark, out, "index long, raw string")
    return back.groupBy("index").agg(md5(F.min("raw")).alias("raw"), F.count("*").alias("times"))


@query("SELECT CASE WHEN event_type = 'view' THEN NULL ELSE event_id END AS event_id, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1")
def tolerant_lines(spark, sf_dir):
    """A line for each event: clicks are blank, views are cut off and give nulls, the others parse."""
    line = F.when(F.col("event_type") == "click", F.lit("  ")).when(F.col("event_type") == "view", F.lit('{"event_id": 1')).otherwise(F.to_json(F.struct("event_id")))
    out = scratch(spark, "lines")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(out)
    return sources.json_lines(spark, out, "event_id long").groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT event_type AS label, CAST(count(*) AS VARCHAR) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS BIGINT) AS place FROM events GROUP BY event_type")
def counts_csv(spark, sf_dir):
    """Counts as CSV, in the file's order."""
    out = scratch(spark, "counts")
    sinks.counts_csv(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).count(), out)
    return spark.read.csv(out, header=True).withColumn("place", F.monotonically_increasing_id() + 1)


@query("SELECT 'f' || doc_id AS filename, CAST(n_chars AS VARCHAR) AS ssim FROM documents")
def metrics_csv(spark, sf_dir):
    out = scratch(spark, "metrics")
    sinks.metrics_csv(table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), "doc_id").alias("filename"), F.col("n_chars").alias("ssim")), out)
    return spark.read.csv(out, header=True)


@query(f"SELECT doc_id, md5(text) AS code, CASE WHEN {catalogue._BLACK.format('text')} THEN 'dump' ELSE 'keep' END AS status FROM documents")
def split_round_trip(spark, sf_dir):
    """Kept and dropped rows written apart and read back."""
    keep, dump, rows = scratch(spark, "keep"), scratch(spark, "dump"), table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code"))
    sinks.split(filters.tagged(rows), keep, dump)
    read = lambda path, status: sources.parquet(spark, path, "doc_id", "code").select("doc_id", md5(F.col("code")).alias("code"), F.lit(status).alias("status"))
    return read(keep, "keep").unionByName(read(dump, "dump"))


class Plotter:
    """A stand-in that draws: code with an x gives one colour only, and the PDF has as many bytes as the code."""

    def compile(self, code: str) -> dict:
        if "\x00" in code:
            return failed("! Missing text")
        pixels = np.zeros((4, 4), np.uint8)
        pixels[0, 0] = 0 if "x" in code else 255
        return dict(zip(COMPILED_FIELDS, (True, 0, 0.0, None, "", imaging.encode_png(pixels), bytes(len(code.encode())))))


_DRAWN = "(strlen(text) >= 1000 AND NOT contains(text, 'x'))"


@query(f"SELECT doc_id, {_DRAWN} AS rendered FROM documents")
def render_outcomes(spark, sf_dir):
    """Which documents give an image: not blank, of a PDF that is large enough."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code")))
    return pipelines.rendered(rows, Plotter()).select("doc_id", F.col("render_image").isNotNull().alias("rendered"))


@query(f"SELECT doc_id, 'failed' AS kind FROM documents WHERE NOT {_DRAWN} UNION ALL SELECT doc_id, 'success' FROM documents WHERE {_DRAWN}")
def render_records(spark, sf_dir):
    """What the sinks of a rendering run leave: rows that failed, and the index of the others."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code")))
    done, bad, good = sources.kept(pipelines.rendered(rows, Plotter())), scratch(spark, "failed"), scratch(spark, "success")
    sinks.failures(done, bad, "render_image")
    sinks.success_index(done, "doc_id", "render_image", good)
    keys = spark.read.schema("doc_id long").json(good)
    return sources.parquet(spark, bad, "doc_id", "code").select("doc_id", F.lit("failed").alias("kind")).unionByName(keys.withColumn("kind", F.lit("success")))


@query(f"""WITH {catalogue._AXIS_CODE}, a AS (SELECT code FROM c UNION ALL SELECT text FROM documents)
    SELECT CASE WHEN {catalogue._BLACK.format('code')} THEN 'blacklist' WHEN {catalogue._DENSE} THEN 'density' WHEN NOT contains(code, 'x') THEN 'compile' ELSE 'kept' END AS reason, count(*) AS n FROM a GROUP BY 1""")
def compile_filter(spark, sf_dir):
    """The filter flow with a stand-in compiler, for which code without an x fails."""
    both = fixtures.axis_code(spark, sf_dir).select("code").unionByName(table(spark, sf_dir, "documents").select(F.col("text").alias("code")))
    done = pipelines.filtered(both, RuleCompiler(lambda code: ("x" in code, None if "x" in code else "! Missing x")))
    return filters.stage_counts(done)


@query(f"SELECT count(*) FILTER (NOT {catalogue._BLACK.format('text')}) AS kept, count(*) AS total, round(100.0 * count(*) FILTER (NOT {catalogue._BLACK.format('text')}) / count(*), 6) AS percent FROM documents")
def kept_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return pipelines.kept_ratio(d, d.filter(~filters.blacklisted(F.col("text")))).withColumn("percent", F.round("percent", 6))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def running_means(spark, sf_dir):
    """Means of a stream of all events, as they stand when it has been read."""
    name = "limn_running_means"
    stream = streaming.running_means(spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir), "event_type", "value")
    run = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark, "means")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("event_type", "n", F.round("mean", 6).alias("mean"))


_PIXEL = "CAST(floor(least(greatest({0}::DOUBLE * 255 + 128, 0), 255)) AS INTEGER)"


@query(f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: {_PIXEL.format('x')}) AS v FROM embeddings),
    q AS (SELECT a.vec_id, unnest(list_zip(a.v, b.v)) AS z FROM p a JOIN p b ON b.vec_id = a.vec_id + 1),
    m AS (SELECT vec_id, (z[1] / 255.0::DOUBLE)::FLOAT::DOUBLE AS x, (z[2] / 255.0::DOUBLE)::FLOAT::DOUBLE AS y FROM q),
    s AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, avg((x - y) * (x - y)) AS e FROM m GROUP BY vec_id),
    d AS (SELECT s.vec_id, avg(((x - mx) / sx - (y - my) / sy) ** 2) AS z FROM m JOIN s USING (vec_id) GROUP BY s.vec_id)
    SELECT 'v' || vec_id || '.png' AS filename, round(least(greatest(z / 2, 0), 2) * 100, 3) AS mse_nocanny, round(10 * log10(1 / e), 3) AS psnr FROM s JOIN d USING (vec_id)""")
def pixel_metrics(spark, sf_dir):
    """Pixel distance and PSNR of each vector with the next one, both stored as PNG files of 8 by 8 in two folders, paired by name."""

    def draw(v):
        return imaging.encode_png(np.clip(np.asarray(v, float).reshape(8, -1) * 255 + 128, 0, 255).astype(np.uint8))

    png, e = F.udf(draw, "binary", useArrow=True), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    predicted, reference = scratch(spark, "pred"), scratch(spark, "ref")
    name = F.concat(F.lit("v"), "vec_id", F.lit(".png"))
    _write_files(e, predicted, name, png("embedding"))
    _write_files(e.withColumn("vec_id", F.col("vec_id") - 1), reference, name, png("embedding"))
    found = pipelines.evaluated(spread(sources.image_pairs(spark, predicted, reference)))
    return found.select("filename", F.round("mse_nocanny", 3).alias("mse_nocanny"), F.round("psnr", 3).alias("psnr"))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 8 + 1 AS o, p_partkey % 251 AS a, p_partkey % 241 AS b FROM part)
    SELECT k AS p_partkey, o >= 5 AS tall, CASE WHEN o IN (2, 3, 7, 8) THEN b ELSE a END AS first, CASE WHEN o IN (2, 3, 7, 8) THEN a ELSE b END AS last FROM p""")
def upright_images(spark, sf_dir):
    """Pictures of two pixels with all EXIF orientations, as lists of data URIs, opened upright."""

    def draw(key):
        png = imaging.encode_png(np.array([[key % 251, key % 241]], np.uint8))
        exif = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, imaging.ORIENTATION, imaging.SHORT, 1, key % 8 + 1, 0, 0)
        chunk = struct.pack(">I", len(exif)) + b"eXIf" + exif + struct.pack(">I", zlib.crc32(b"eXIf" + exif))
        return [f"data:image/png;base64,{base64.b64encode(png[:33] + chunk + png[33:]).decode()}"]

    def seen(png):
        pixels = imaging.decode_png(bytes(png))
        return pixels.shape[0] > pixels.shape[1], int(pixels[0, 0, 0]), int(pixels[-1, -1, 0])

    rows = spread(table(spark, sf_dir, "part").select("p_partkey"))
    cells = sources.image_cells(rows.withColumn("image", F.udf(draw, "array<string>", useArrow=True)("p_partkey")), "image")
    look = F.udf(seen, "struct<tall: boolean, first: long, last: long>", useArrow=True)
    return cells.select("p_partkey", look(imaging.as_png(F.col("image"))).alias("s")).select("p_partkey", "s.*")


@query("SELECT 's' || s_suppkey || '.png' AS filename, s_suppkey % 256 AS red, s_suppkey * 7 % 256 AS green, s_suppkey * 31 % 256 AS blue FROM supplier")
def folder_images(spark, sf_dir):
    """A picture file for each supplier, decoded by the JVM."""
    draw = F.udf(lambda k: imaging.encode_png(np.array([[[k % 256, k * 7 % 256, k * 31 % 256]]], np.uint8)), "binary", useArrow=True)
    seen = F.udf(lambda png: imaging.decode_png(bytes(png))[0, 0].tolist(), "array<long>", useArrow=True)
    out = scratch(spark, "folder")
    _write_files(table(spark, sf_dir, "supplier").select("s_suppkey"), out, F.concat(F.lit("s"), "s_suppkey", F.lit(".png")), draw("s_suppkey"))
    colours = sources.decoded_images(spark, out).select("filename", seen("bytes").alias("c"))
    return colours.select("filename", *(F.col("c")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))))


_DIOU = """m AS (SELECT *, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s,
        (a.x0 + a.x1 - b.x0 - b.x1) * (a.x0 + a.x1 - b.x0 - b.x1) / 4.0 + (a.y0 + a.y1 - b.y0 - b.y1) * (a.y0 + a.y1 - b.y0 - b.y1) / 4.0 AS c,
        (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.x1, b.x1) - least(a.x0, b.x0)) + (greatest(a.y1, b.y1) - least(a.y0, b.y0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) AS g FROM b),
    d AS (SELECT *, greatest(least(i / (s - i)::DOUBLE - least(c::DOUBLE / g::DOUBLE, 2.0), 1.0), -1.0) AS diou FROM m)"""
_BOXES = f"b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, {catalogue._P} AS a, {catalogue._R} AS b FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem))"
_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q")


@query(f"""WITH {_BOXES}, {_DIOU} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, CASE WHEN l_linenumber % 3 = 0 THEN 'fuzzy' ELSE 'exact' END AS stage, round((diou + 1) / 2, 6) AS score FROM d""")
def single_box_layout(spark, sf_dir):
    """Layout of a box against one other: equal labels match exactly, those with a letter more are alike."""
    b = spread(fixtures.line_boxes(spark, sf_dir)).select(*_LINE, F.array("predicted").alias("p"), F.array("reference").alias("r"))
    return b.select(*_LINE, layout.matched_boxes("p", "r")[0]["stage"].alias("stage"), F.round(layout.text_layout_score("p", "r"), 6).alias("score"))


@query(f"""WITH {_BOXES}, {_DIOU} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, CASE WHEN diou > -0.5 THEN 'geometric' END AS stage, CASE WHEN diou > -0.5 THEN round(diou, 6) END AS diou FROM d""")
def single_box_geometric(spark, sf_dir):
    """Boxes whose texts have nothing in common match by their places alone, if they aren't too far apart."""
    other = F.transform(F.array("reference"), lambda b: b.withField("text", F.lit("quite another")))
    b = spread(fixtures.line_boxes(spark, sf_dir)).select(*_LINE, F.array("predicted").alias("p"), other.alias("r"))
    first = F.get(layout.matched_boxes_geometric("p", "r"), 0)
    return b.select(*_LINE, first.alias("m")).select(*_LINE, "m.stage", F.round("m.diou", 6).alias("diou"))


@query(f"""WITH {_BOXES}, w AS (SELECT *, (a.x1 - a.x0)::DOUBLE AS aw, (a.y1 - a.y0)::DOUBLE AS ah, (b.x1 - b.x0)::DOUBLE AS bw, (b.y1 - b.y0)::DOUBLE AS bh,
        greatest(sqrt((greatest(a.x1, b.x1) - least(a.x0, b.x0)) ** 2 + (greatest(a.y1, b.y1) - least(a.y0, b.y0)) ** 2), 1) AS canvas,
        sqrt(((a.x0 + a.x1 - b.x0 - b.x1) / 2.0) ** 2 + ((a.y0 + a.y1 - b.y0 - b.y1) / 2.0) ** 2) AS away FROM b)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, round(exp(-1.5 * (0.4 * away / canvas + 0.3 * abs(aw * ah - bw * bh) / greatest(aw * ah, bw * bh) + 0.3 * abs(aw / ah - bw / bh) / greatest(aw / ah, bw / bh))), 6) AS overall, 1 AS types FROM w""")
def single_rectangle_geometry(spark, sf_dir):
    """The score of a rectangle against one other."""
    made = lambda b: F.array(geometry.rectangle_element(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"]))
    b = spread(fixtures.line_boxes(spark, sf_dir)).select(*_LINE, geometry.geometry_match(made(F.col("predicted")), made(F.col("reference"))).alias("m"))
    return b.select(*_LINE, F.round("m.overall", 6).alias("overall"), F.size("m.counts").alias("types"))


_CODE = r"'\definecolor{c}{rgb}{' || l || ',0.5}' || chr(10) || '\addplot coordinates {(' || l || ',3) (4,' || l || ')};' || chr(10) || '\addplot table {' || chr(10) || '1 ' || l || chr(10) || '};' || chr(10) || '\draw (' || l || ',' || l || ') node[scale=' || l || ', name=' || t || '] {' || t || '};'"


@query(rf"""WITH n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT) AS q, {catalogue._WHOLE} AS w, {catalogue._FRAC} AS f FROM lineitem),
    r AS (SELECT *, (w + CASE WHEN f > 500 OR (f = 500 AND w % 2 = 1) THEN 1 ELSE 0 END) || '.000' AS l, w || '.' || lpad(CAST(f AS VARCHAR), 3, '0') AS t FROM n)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, md5({_CODE}) AS rounded FROM r""")
def round_places(spark, sf_dir):
    """One literal in a colour, coordinates, a table, a tuple and an option, which are rounded, and in a name and a text, which aren't."""
    literal = F.concat(F.expr(catalogue._WHOLE).cast("string"), F.lit("."), F.lpad(F.expr(catalogue._FRAC).cast("string"), 3, "0"))
    code = F.concat(*(literal if part in ("l", "t") else F.lit("\n") if part == "chr(10)" else F.lit(part[1:-1]) for part in _CODE.split(" || ")))
    keys = [F.col(c) for c in _LINE[:4]] + [F.col("l_quantity").cast("int").alias("q")]
    return spread(table(spark, sf_dir, "lineitem")).select(*keys, md5(rounding.rounded(code)).alias("rounded"))


_TWICE = r"'\documentclass[a' || w[1] || ',b' || w[2] || ']{amsart}' || chr(10) || '\usepackage{c' || w[1] || '}' || chr(10) || '\usepackage[o]{d' || w[2] || ', c' || w[1] || '}' || chr(10) || '\usepackage{c' || w[1] || '} % again' || chr(10) || '\usetikzlibrary{x,x}' || chr(10) || '\begin{document}x\end{document}' || chr(10)"
_ONCE = r"'\usepackage{c' || w[1] || '}' || chr(10) || '\usepackage[o]{d' || w[2] || '}' || chr(10) || '\usetikzlibrary{x}' || chr(10) || '\begin{document}x\end{document}' || chr(10)"


@query(rf"""WITH p AS (SELECT p_partkey, [replace(lower(p_type), ' ', ''), CAST(p_partkey AS VARCHAR)] AS w FROM part), o AS (SELECT *, {_ONCE} AS once, {_TWICE} AS twice FROM p)
    SELECT p_partkey, md5('\documentclass[a' || w[1] || ',b' || w[2] || ']{{amsart}}' || chr(10) || once) AS once,
        md5(replace(twice, '[a' || w[1] || ',b' || w[2] || ']', '[b' || w[2] || ']')) AS class_option, md5(replace(twice, '\documentclass[a' || w[1] || ',b' || w[2] || ']{{amsart}}', '\documentclass[border=2mm]{{standalone}}' || chr(10) || '\usepackage{{amsmath}}' || chr(10) || '\usepackage{{amssymb}}')) AS standalone,
        'a' || w[1] || ',b' || w[2] || ':amsart' AS class FROM o""")
def preamble_edits(spark, sf_dir):
    """Repeated declarations, a class option and the class itself, edited in sources with a comment after an emptied line."""

    def edit(code: str) -> list[str]:
        options, kind = preamble.document_class(code)
        return [preamble.without_duplicates(code), preamble.without_class_options(code, [options[0]]), preamble.to_standalone(code), f"{','.join(options)}:{kind}"]

    w = F.replace(F.lower("p_type"), F.lit(" "), F.lit("")), F.col("p_partkey").cast("string")
    code = F.concat(*(w[0] if part == "w[1]" else w[1] if part == "w[2]" else F.lit("\n") if part == "chr(10)" else F.lit(part[1:-1]) for part in _TWICE.split(" || ")))
    edited = F.udf(edit, "array<string>", useArrow=True)
    e = spread(table(spark, sf_dir, "part")).select("p_partkey", edited(code).alias("e"))
    return e.select("p_partkey", md5(F.col("e")[0]).alias("once"), md5(F.col("e")[1]).alias("class_option"), md5(F.col("e")[2]).alias("standalone"), F.col("e")[3].alias("class"))
