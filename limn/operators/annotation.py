"""Annotation of images by a model: prompts, resumable runs, and histograms of the replies' labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limn import providers
from limn.functions.text import loose_json, strip

#: The labels of the category task.
LABELS = ("flowcharts", "charts", "circuits", "structures", "math_geometry", "physics", "chemistry", "networks", "graphs_theory", "layouts_ui", "mixed")
#: What each label covers, for the prompt.
GUIDANCE = {
    "flowcharts": "processes, decisions, state machines, sequences, swimlanes",
    "charts": "plots with axes, ticks and legends: lines, bars, scatter, heatmaps",
    "circuits": "electrical, electronic and digital schematics, signal blocks",
    "structures": "trees, organisation charts, class diagrams, commutative diagrams",
    "math_geometry": "constructions, angles, vectors, labelled coordinate axes",
    "physics": "forces, optics, fields, particles, apparatus",
    "chemistry": "molecules, reactions, lab set-ups, orbitals",
    "networks": "neural, computer and communication networks",
    "graphs_theory": "vertices and edges, automata, weighted graphs",
    "layouts_ui": "page, board and interface layouts, tables, timelines",
    "mixed": "several of these, or none that fits best",
}
CATEGORY_REPLY = "label string, score double, brief string"
INVALID = "INVALID IMAGE"


def system_prompt(guidance: dict[str, str] = GUIDANCE) -> str:
    """The rules of the category task, as one text."""
    kinds = "\n".join(f"- {label}: {what}" for label, what in guidance.items())
    return (
        "Sort a rendered technical figure into exactly one category.\n" + kinds + "\nTake the most specific one; take 'mixed' if several fit equally. "
        'Answer with one line of JSON and nothing else: {"label": category, "score": number from 0 to 1, "brief": at most 20 words}.'
    )


RATING_PROMPT = (
    "Rate the quality of this technical figure from 1 (unreadable or broken) over 2 (major flaws), 3 (understandable, with problems) and "
    "4 (clear, minor issues) to 5 (ready to publish). Describe it, name strengths and weaknesses, explain, and end with a line 'Score: X'."
)

#: Names under which an image column is looked for, in this order.
IMAGE_COLUMNS = ("image", "render_image", "png", "img", "picture", "figure", "bytes")


def image_column(df: DataFrame, wanted: str | None = None) -> str:
    """The column that holds images: the one wanted, else the first known name. ValueError where there is none."""
    for name in ((wanted,) if wanted else ()) + IMAGE_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"none of {df.columns} is an image column")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done: what a resumed run has left, in whatever order the others came."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def annotate(df: DataFrame, key: str, model: providers.Model, prompt: str, image: str | None = None, valid: Column | None = None, batch: int = 8) -> DataFrame:
    """(index, path, raw) for each row: a model's reply to a prompt and the row's image; invalid images get a fixed reply."""
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    data = F.when(ok, F.col(image)) if image else None
    path = F.col("path") if "path" in df.columns else F.lit(None).cast("string")
    answered = providers.replies(df.withColumn("_ok", ok), F.lit(prompt), model, "_raw", batch, data)
    return answered.select(F.col(key).alias("index"), path.alias("path"), F.when(F.col("_ok"), F.col("_raw")).otherwise(F.lit(INVALID)).alias("raw"))


def reply_label(raw: Column) -> Column:
    """The label of a reply, trimmed; `mixed` where it has none. Whole JSON is parsed natively, the rest more loosely."""
    label = lambda text: strip(F.get_json_object(text, "$.label"))
    found = label(loose_json(raw))
    return F.when(F.coalesce(found, F.lit("")) == "", "mixed").otherwise(found)


def label_histogram(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """(label, count) of replies, most frequent first, then by label. Labels that aren't known count as they are."""
    return replies.groupBy(reply_label(F.col(raw)).alias("label")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")


def parse_counters(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """One row: replies, those from which a label could be parsed, and the others."""
    ok = F.get_json_object(loose_json(F.col(raw)), "$.label").isNotNull()
    return replies.select(ok.alias("ok")).agg(F.count("*").alias("total"), F.count_if("ok").alias("parsed_ok"), F.count_if(~F.col("ok")).alias("fallback"))


def rating(raw: Column) -> Column:
    """The score that a rating reply ends with, or null."""
    return F.when(raw.rlike(r"Score:\s*[1-5]"), F.regexp_extract(raw, r"(?s).*Score:\s*([1-5])", 1).cast("int"))
