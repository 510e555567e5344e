"""The end-to-end flows: filter, round and sample a corpus; rewrite it by a model; score replies; evaluate predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from limn import providers
from limn.functions import imaging, preamble, rounding, text
from limn.operators import filters, layout, sampling, textmetrics
from limn.operators.geometry import geometry_match

#: Weights of the reward's parts.
WEIGHTS = {"pixel": 0.5, "perceptual": 0.5, "layout": 0.5, "geometry": 0.5, "format": 0.0, "compile": 0.0, "edge": 0.0}


def filtered(df: DataFrame, compiler: providers.Compiler | None = None, recorded: DataFrame | None = None, code: str = "code") -> DataFrame:
    """df with `reason`: null for rows that pass blacklist, density and, with a compiler or recorded results, compile and log.

    Only rows that pass the native predicates are compiled: they are filtered before the compiler's stage.
    """
    native = filters.tagged(df, code)
    if compiler is None and recorded is None:
        return native
    left = native.filter(F.col("reason").isNull())
    styled = left.withColumn("_styled", text.inject_page_style(F.col(code)))
    done = providers.compiled(styled, "_styled", compiler) if compiler else providers.recorded(left, code, recorded).withColumn("_styled", F.lit(None))
    ok = F.col("compiled.ok") & filters.clean_log(F.coalesce("compiled.log", F.lit("")))
    judged = done.withColumn("reason", F.when(~F.coalesce(ok, F.lit(False)), "compile")).drop("compiled", "_styled")
    return judged.unionByName(native.filter(F.col("reason").isNotNull()))


def corpus(df: DataFrame, per_bin: int = 10_000, strategy: str = "random", seed: int = 42, bins=sampling.BINS, compiler: providers.Compiler | None = None) -> DataFrame:
    """Filter, round and sample (orig_id, code, other columns) in one plan."""
    kept = filtered(df, compiler).filter(F.col("reason").isNull()).drop("reason")
    return sampling.stratified(rounding.round_numbers(kept), per_bin, "orig_id", strategy, seed, bins).drop("rn")


REORDER = "Bring the drawing commands of this TikZ code into a natural order without changing the picture. Define everything before it is used, correct relative positions, and drop styles that nothing uses. Think first; give the code in a fence."
COMMENT = "Describe the picture in under 100 words, think in at most 600, then repeat the code unchanged with comments that explain each part, in a fence."
#: Fixed value: what a request for comments says, since its reply has the reasoning itself.
COMMENT_OPTIONS = {"extra_body": {"enable_thinking": False}}


def rewritten(df: DataFrame, model: providers.Model, instruction: str = REORDER, source: str = "code", output: str = "new_code", thinking: str = "thinking", keep_failed: bool = False) -> DataFrame:
    """df with a model's rewrite of a column and its whole reply. A reply without a fence is failed: it goes, or keeps the source."""
    asked = providers.replies(df, text.user_prompt(F.col(source), instruction), model, "_reply")
    parts = asked.withColumn("_parts", text.fence_split(F.col("_reply")))
    out = parts.withColumns({output: F.coalesce("_parts.code", text.source(F.col(source))), thinking: F.col("_parts.thinking"), "_failed": F.col("_parts.code").isNull()})
    return (out if keep_failed else out.filter(~F.col("_failed"))).drop("_reply", "_parts", "_failed")


def kept_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: kept, total and percent."""
    one = before.agg(F.count("*").alias("total")).join(F.broadcast(after.agg(F.count("*").alias("kept"))))
    return one.select("kept", "total", F.when(F.col("total") > 0, 100 * F.col("kept") / F.col("total")).alias("percent"))


def rendered(df: DataFrame, compiler: providers.Compiler, code: str = "code", image: str = "render_image", drop_failed: bool = False) -> DataFrame:
    """df with struct<bytes, path> of its rendered code, null where that fails, is blank or the PDF is too small."""
    done = providers.compiled(df, code, compiler)
    good = F.col("compiled.ok") & F.col("compiled.png").isNotNull() & ~imaging.blank_image("compiled.png") & ~filters.too_small(F.col("compiled.pdf"))
    out = done.withColumn(image, F.when(good, F.struct(F.col("compiled.png").alias("bytes"), F.lit(None).cast("string").alias("path")))).drop("compiled")
    return out.filter(F.col(image).isNotNull()) if drop_failed else out


def pruned(df: DataFrame, compiler: providers.Compiler, path: str = "path", code: str = "source", standalone: bool = False, border: str = "2mm") -> DataFrame:
    """The pruning of each file's preamble. Within a file each try builds on the one before; files are independent.

    Equal code is compiled once in a task, as far as its results are kept.
    """

    def run(batches):
        import pandas as pd

        def once(c):
            try:
                r = compiler.compile(c)
                return bool(r["ok"]), r["error"]
            except Exception as e:  # a provider's fault is a failed compile
                return False, f"{type(e).__name__}: {e}"

        seen = providers.Recent(providers.KEPT_BYTES)
        for b in batches:
            rows = [preamble.prune(c or "", p, lambda x: seen.get(x, once), standalone, border) for p, c in zip(b["path"], b["code"])]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in preamble.PRUNED.split(", ")])

    return df.select(F.col(path).alias("path"), F.col(code).alias("code")).mapInPandas(run, preamble.PRUNED)


def removal_ratio(results: DataFrame) -> DataFrame:
    """results with `removal_ratio`: names removed by names declared, null where none was declared."""
    n = lambda *cs: reduce(Column.__add__, (F.size(c) for c in cs))
    declared = n("original_packages", "original_libraries")
    return results.withColumn("removal_ratio", F.when(declared > 0, n("removable_packages", "removable_libraries") / declared))


def pruning_totals(results: DataFrame) -> DataFrame:
    """One row: files, successes, and the mean of their removal ratios."""
    return removal_ratio(results).agg(F.count("*").alias("files"), F.count_if(F.col("status") == "success").alias("successes"), F.avg(F.when(F.col("status") == "success", F.col("removal_ratio"))).alias("mean_removal"))


def reward(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum of a reward's parts; absent ones and nulls are 0."""
    return reduce(Column.__add__, (F.coalesce(parts[k], F.lit(0.0)) * w for k, w in weights.items() if k in parts))


def rewards(df: DataFrame, compiler: providers.Compiler, perceptual=None, boxes=None, elements=None, squeeze: bool = True) -> DataFrame:
    """df (response, reference image and PDF bytes) with the parts of its reward and their sum `overall`.

    Stages are columns: the code of the reply is compiled, its page compared with `reference_png`, and what providers
    give. perceptual(df): adds `perceptual`; boxes(column), elements(column): arrays of a PDF column's boxes and elements.
    A failed compile has -1 for both pixel parts and 0 for the others. squeeze: as extraction sees replies without white
    space around tags; off, only the format does.
    """
    squeezed = text.squeeze_tags(F.col("response"))
    out = df.withColumns({"format": text.format_score(squeezed), "code": text.extract_code(squeezed if squeeze else F.col("response"))})
    out = providers.compiled(out, "code", compiler).withColumn("compile", F.when(F.col("compiled.ok"), 1.0).otherwise(0.0))
    similar = imaging.reward_similarities(F.col("compiled.png"), F.col("reference_png"))
    out = out.withColumn("_similar", similar).withColumns({"edge": F.col("_similar.edge"), "pixel": F.col("_similar.pixel")})
    out = perceptual(out) if perceptual else out.withColumn("perceptual", F.lit(0.0))
    ok = F.col("compiled.ok") & F.col("reference_pdf").isNotNull() if "reference_pdf" in df.columns else F.lit(False)
    if boxes:
        out = out.withColumn("layout", F.when(ok, layout.text_layout_score(boxes(F.col("compiled.pdf")), boxes(F.col("reference_pdf")))).otherwise(0.0))
    if elements:
        out = out.withColumn("geometry", F.when(ok, geometry_match(elements(F.col("compiled.pdf")), elements(F.col("reference_pdf")))["overall"]).otherwise(0.0))
    names = [n for n in WEIGHTS if n in out.columns]
    return out.withColumn("overall", reward({n: F.col(n) for n in names})).drop("_similar", "compiled")


def merged_metrics(tables: list[DataFrame], key: str = "filename", missing: str = "global") -> DataFrame:
    """A row for each file name with the columns of all tables; a null name is `missing`; of columns that clash the later wins."""
    keyed = [t.withColumn(key, F.coalesce(key, F.lit(missing))) for t in tables]

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        both = [c for c in right.columns if c in left.columns and c != key]
        r = right.withColumnsRenamed({c: f"_{c}" for c in both})
        out = left.join(r, key, "full_outer")
        return out.withColumns({c: F.coalesce(f"_{c}", c) for c in both}).drop(*(f"_{c}" for c in both))

    return reduce(join, keyed)


def long_metrics(rows: DataFrame, metrics: list[str], key: str = "filename") -> DataFrame:
    """merged_metrics of (key, metric, value) rows in one aggregation."""
    return rows.groupBy(key).agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics))


def coverage(found: Column, total: Column) -> Column:
    """Rendered among all, as text."""
    return F.concat(found.cast("string"), F.lit("/"), total.cast("string"))


def evaluated(pairs: DataFrame) -> DataFrame:
    """(filename and pixel metrics) of image pairs (filename, pred, ref); each pair is decoded once for all metrics."""
    return pairs.select("filename", imaging.image_metrics("pred", "ref").alias("m")).filter(F.col("m").isNotNull()).select("filename", "m.*")


#: Scores of a pair of images that a model gives, by the factor of their mean.
MODEL_SCORES = {"dsim": 100, "siglip": 100, "lpips": 1}


def evaluation_summary(images: DataFrame, predictions: DataFrame, kid: DataFrame | None = None, bleu: bool = True, ted: bool = True) -> DataFrame:
    """One row: the means of the metrics of scored pairs, corpus BLEU, mean edit distance and coverage.

    images: the pixel metrics and, where a model gave them, columns of MODEL_SCORES; those that it hasn't are left out.
    kid: the row of a kernel distance of features, whose mmd2 becomes `kid`. bleu, ted: whether texts are compared.
    """
    have = [c for c in ("mse", "mse_nocanny", "ssim", "psnr", *MODEL_SCORES) if c in images.columns]
    parts = [images.agg(*((F.avg(c) * MODEL_SCORES.get(c, 1)).alias(c) for c in have), F.count("*").alias("_n"))]
    tokens = lambda c: textmetrics.tex_tokens(F.col(c))
    if bleu:
        parts.append(textmetrics.corpus_bleu(predictions, "index", tokens("predicted"), tokens("ground_truth")).select("bleu"))
    if ted:
        parts.append(textmetrics.mean_edit_distance(predictions))
    if kid is not None:
        parts.append(kid.select(F.col("mmd2").alias("kid")))
    parts.append(predictions.agg(F.count("*").alias("_total")))
    one = reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each
    return one.withColumn("coverage", coverage(F.col("_n"), F.col("_total"))).drop("_n", "_total")
