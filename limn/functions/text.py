"""Text functions as Spark columns: trimming, fences, replies, prompts, hashes. All stay inside the JVM unless noted."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf


def source(code: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(code, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def collapse_blank_lines(text: Column) -> Column:
    """Three and more line ends as two."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


#: Fixed value: a fenced block, its body the group.
FENCE = r"(?s)```[^\n`]*\n(.*?)```"


def fence_split(reply: Column) -> Column:
    """struct(thinking, code): the whole reply and its first fenced block; without one, the trimmed reply and null.

    An empty block counts as none. A null reply gives an empty text and null.
    """
    found = reply.rlike(FENCE)
    code = strip(_first(reply, FENCE))
    return F.struct(
        F.when(reply.isNull(), "").when(found, reply).otherwise(strip(reply)).alias("thinking"),
        F.when(found & (code != ""), code).alias("code"),
    )


def unwrap_fence(text: Column) -> Column:
    """A prediction without the fence around it, with or without the language mark."""
    t = strip(text)
    opened = F.when(t.startswith("```latex"), F.regexp_replace(t, r"\A```latex[\n\r]*", "")).when(t.startswith("```"), F.regexp_replace(t, r"\A```[\n\r]*", "")).otherwise(t)
    closed = F.when(opened.endswith("```"), F.regexp_replace(opened, r"```\z", "")).otherwise(opened)
    return strip(closed)


def squeeze_tags(response: Column) -> Column:
    """Without white space around <, > and /."""
    return F.regexp_replace(response, r"(?U)\s*([<>/])\s*", "$1")


#: Where the code of a reply is looked for, in this order.
REPLY_PATTERNS = (r"(?Us)```latex\s*(.*?)\s*```", r"(?Us)```\s*(.*?)\s*```", r"(?s)<answer>(.*?)</answer>")


def extract_code(response: Column) -> Column:
    """The code in a reply: in a marked fence, else in any fence, else between answer tags (all trimmed), else all of it."""
    out = response
    for p in reversed(REPLY_PATTERNS):
        out = F.when(response.rlike(p), strip(_first(response, p))).otherwise(out)
    return out


def format_score(response: Column) -> Column:
    """1.0 where the whole reply is a think part and an answer part, else 0.0."""
    return F.when(response.rlike(r"(?Us)\A<think>.*?</think>\s*<answer>.*?</answer>\z"), 1.0).otherwise(0.0)


def inject_page_style(code: Column, line: str = r"\AtBeginDocument{\thispagestyle{empty}\pagestyle{empty}}") -> Column:
    """code with a line that suppresses headers after its first line."""
    lines = F.split(code, "\n", -1)
    return F.concat_ws("\n", F.concat(F.slice(lines, 1, 1), F.array(F.lit(line)), F.slice(lines, F.lit(2), F.size(lines))))


def user_prompt(code: Column, instruction: str) -> Column:
    """The prompt of a rewriting request: the instruction, then the code in a fence."""
    return F.concat(F.lit(instruction.rstrip() + "\n\n```latex\n"), source(code), F.lit("\n```"))


def rot13(text: Column) -> Column:
    a, z = "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm"
    return F.translate(text, a + a.upper(), z + z.upper())


def content_name(data: Column, path: Column) -> Column:
    """A name for stored bytes: eight characters of their SHA-1 before the base name of their path."""
    return F.concat_ws("_", F.substring(F.sha1(data), 1, 8), F.element_at(F.split(F.coalesce(path, F.lit("image.png")), "/"), -1))


def output_path(path: Column, input_dir: str, output_dir: str) -> Column:
    """path moved from below input_dir to below output_dir; one that isn't below it keeps its base name alone."""
    base, out = input_dir.rstrip("/") + "/", output_dir.rstrip("/") + "/"
    plain = F.regexp_replace(path, r"\Afile:/+", "/")
    return F.when(plain.startswith(base), F.concat(F.lit(out), F.substring(plain, F.lit(len(base) + 1), F.length(plain)))).otherwise(F.concat(F.lit(out), F.element_at(F.split(plain, "/"), -1)))


def data_uri_bytes(uri: Column) -> Column:
    """The bytes of a base64 data URI, or of base64 text without the prefix."""
    return F.unbase64(F.regexp_replace(uri, r"\Adata:image/[^,]*,", ""))


def loose_json_text(raw: str | None) -> str | None:
    """The JSON value in a reply as JSON text, or null: without fences, else from the first brace to the last one that fits."""
    if not raw:
        return None
    s = raw.strip()
    if s.startswith("```"):
        head = s[3:].lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ").lstrip()
        s = head[:-3].rstrip() if head.endswith("```") else head
    first = s.find("{")
    ends = [] if first < 0 else [i + 1 for i in range(len(s) - 1, first, -1) if s[i] == "}"]
    for candidate in (s, *(s[first:e] for e in ends)):
        try:
            return json.dumps(json.loads(candidate))
        except ValueError:
            continue
    return None


@pandas_udf(T.StringType())
def loose_json(raw):
    """loose_json_text of each reply, in Arrow batches: retries on a shrinking span have no native form."""
    return raw.map(loose_json_text)
