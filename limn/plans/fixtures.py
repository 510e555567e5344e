"""Diagram code, logs, replies and shapes made from the driver's tables by rules that DuckDB SQL can repeat."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where they come from fewer files than there are cores: a small table is one group of rows,
    which one task reads, however it is split. Tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share; a temporary one in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="limn-")
    return f"{base.rstrip('/')}/limn-{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def axis_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(orig_id, code): an axis with one series for each part and return flag, its points in order of their text."""
    point = F.concat(F.lit("("), F.col("l_quantity").cast("int"), F.lit(","), F.col("l_linenumber"), F.lit(")"))
    groups = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.array_sort(F.collect_list(point)).alias("points"))
    code = F.concat(F.lit("\\begin{axis}\n\\addplot coordinates {"), F.array_join("points", " "), F.lit("};\n\\end{axis}"))
    return groups.select((F.col("l_partkey") * 4 + F.expr("instr('ANR', l_returnflag)")).alias("orig_id"), code.alias("code"))


#: What a log says, by event_id modulo 8.
LOGS = (
    "This is fine\nOutput written on a.pdf",
    "Package pgfplots Warning: value OUT OF RANGE here",
    "Package tikz Warning: a point lies outside the box",
    "OVERFULL hbox",
    "! LaTeX Error: File not found",
    "! Package xcolor Error: no such colour",
    "! Undefined control sequence",
    "! Missing $ inserted\n! Emergency stop.",
)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, log)."""
    texts = F.array(*map(F.lit, LOGS))
    log = F.when(F.col("event_type") == "view", LOGS[0]).otherwise(F.element_at(texts, (F.col("event_id") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", log.alias("log"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, response): assistant turns in a marked fence, a plain one, answer tags, or bare."""
    kind, text = F.col("conv_id") % 4, F.col("text")
    response = (
        F.when(kind == 0, F.concat(F.lit("Sure:\n```latex\n"), text, F.lit("\n```\nDone")))
        .when(kind == 1, F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("<think> so </think> <answer>"), text, F.lit("</answer>")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select("conv_id", "turn", response.alias("response"))


def label_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, raw): JSON with the event's type as label, in a fence, cut off, or with junk after it."""
    i = F.col("event_id")
    body = F.concat(F.lit('{"label": " '), F.col("event_type"), F.lit('", "score": '), i % 10, F.lit("}"))
    raw = F.when(i % 7 == 0, F.expr("substring(body, 1, length(body) - 1)")).when(i % 3 == 0, F.concat(F.lit("```json\n"), F.col("body"), F.lit("\n```"))).when(i % 5 == 0, F.concat(F.col("body"), F.lit(" thanks}"))).otherwise(F.col("body"))
    return table(spark, sf_dir, "events").withColumn("body", body).select(i.alias("index"), raw.alias("raw"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, predicted, ground_truth): each turn but the first of a conversation, and the one before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("predicted"))
    return c.join(before, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), "predicted", F.col("text").alias("ground_truth"))


def _box(x: Column, y: Column, w: Column, h: Column, text: Column) -> Column:
    d = lambda c: c.cast("double")
    return F.struct(d(x).alias("x0"), d(y).alias("y0"), d(x + w).alias("x1"), d(y + h).alias("y1"), text.alias("text"))


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_partkey, l_suppkey, l_linenumber, q, predicted, reference): two boxes for each line of an order."""
    li = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    p, s, n, q = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "q"))
    word = F.concat(F.lit("label "), (p % 40).cast("string"))
    predicted = _box(p % 300, s % 300, q + 5, n * 3 + 4, word)
    reference = _box((p + n) % 300, (s + 3) % 300, q + 6, n * 3 + 2, F.when(n % 3 == 0, F.concat(word, F.lit("x"))).otherwise(word))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q", predicted.alias("predicted"), reference.alias("reference"))


#: The order of an order's lines; it is unique in every table.
LINE_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "q")


def order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, predicted, reference): the boxes of each order, which has few lines, as arrays in their order."""
    rows = line_boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "predicted", "reference"))).alias("lines"))
    return rows.select("l_orderkey", F.transform("lines", lambda x: x["predicted"]).alias("predicted"), F.transform("lines", lambda x: x["reference"]).alias("reference"))


def preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, source): packages and a library from the words of a part's type. A comment says which names are needed.

    A name is needed unless its MD5 begins with a digit.
    """
    words = F.split(F.lower("p_type"), " ")
    pkgs = F.array_distinct(F.concat(words, F.array(F.lit("tikz"), F.lit("amsmath"))))
    libs = F.array_distinct(F.transform(words, lambda w: F.concat(F.lit("lib"), w)))
    needed = F.filter(F.concat(pkgs, libs), lambda n: ~F.substring(F.md5(n.cast("binary")), 1, 1).rlike("[0-9]"))
    source = F.concat(F.lit("\\documentclass{article}\n% needs "), F.array_join(needed, " "), F.lit("\n\\usepackage[a=b]{"), F.array_join(pkgs, ", "), F.lit("}\n% \\usepackage{never}\n\\usetikzlibrary{"), F.array_join(libs, ","), F.lit("}\n\\begin{document}x\\end{document}\n"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".tex")).alias("path"), source.alias("source"))


def compiles_if_needed_names_are_there(code: str) -> tuple[bool, str | None]:
    """The rule of the preambles' recorded compiles."""
    from limn.functions.preamble import packages_and_libraries

    needed = next((x.split()[2:] for x in code.split("\n") if x.startswith("% needs ")), [])
    there = {n for names in packages_and_libraries(code) for n in names}
    missing = [n for n in needed if n not in there]
    return not missing, f"! LaTeX Error: {missing[0]}" if missing else None
