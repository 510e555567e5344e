"""Commands: python -m limn COMMAND --input ... --output ...

filter, round, sample and both work on a corpus; reorder and add-comments rewrite it by a model; classify, rate and infer
ask a model about images; render compiles and draws, render-dir a folder of files; prune drops packages; evaluate scores predictions. A model is named
as module:object of a provider; compile steps use the LaTeX engines that the machine has, or recorded results.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from limn import providers, sources
from limn.functions import rounding, text
from limn.operators import annotation, sampling
from limn.plans import pipelines
from limn.sources import sinks


def named(spec: str):
    """The object that module:object names; called if it is a class."""
    module, _, name = spec.partition(":")
    found = getattr(importlib.import_module(module), name)
    return found() if isinstance(found, type) else found


def _model(a: argparse.Namespace, **options):
    """The provider that --model names, with the flags that it has attributes for; a required one that is absent stops it."""
    model = named(a.model)
    wanted = {"concurrency": a.concurrency, "attempts": a.max_retries, "timeout": a.api_timeout, "model": a.model_id}
    sampling_options = {"temperature": a.temperature, "top_p": a.top_p, "max_tokens": a.max_tokens}
    merged = {
        "options": {**options, **{k: v for k, v in sampling_options.items() if v is not None}},
        "connection": {k: v for k, v in (("base_url", a.base_url), ("api_key", a.api_key)) if v is not None},
    }
    for name, value in wanted.items():
        if value is not None and hasattr(model, name):
            setattr(model, name, value)
    for name, value in merged.items():
        if value and hasattr(model, name):
            setattr(model, name, {**getattr(model, name), **value})
    if hasattr(model, "check"):
        model.check()
    return model


def _corpus(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return sources.with_row_id(sources.parquet(spark, a.input, "code"))


def _filtered(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    recorded = spark.read.parquet(a.recorded) if a.recorded else None
    compiler = providers.LatexCompiler(timeout=a.timeout) if a.compile else None
    return pipelines.filtered(_corpus(spark, a), compiler, recorded)


def run_filter(spark, a):
    sinks.split(_filtered(spark, a), a.out_keep, a.out_dump)


def run_round(spark, a):
    sinks.parquet(rounding.round_numbers(sources.parquet(spark, a.input, "code")), a.out_rounded)


def _sample(df: DataFrame, a: argparse.Namespace) -> DataFrame:
    return sampling.stratified(sources.require_columns(df, "orig_id", "code"), a.samples_per_bin, strategy=a.bin_strategy, seed=a.seed, bins=sampling.parse_bins(a.bins)).drop("rn", "bin", "n_tokens")


def run_sample(spark, a):
    sinks.parquet(_sample(spark.read.parquet(a.input), a), a.out_sample)


def run_both(spark, a):
    run_filter(spark, a)
    sinks.parquet(rounding.round_numbers(spark.read.parquet(a.out_keep)), a.out_rounded)
    sinks.parquet(_sample(spark.read.parquet(a.out_rounded), a), a.out_sample)


def run_rewrite(spark, a):
    instruction, source, output, thinking = (pipelines.REORDER, "code", "new_code", "thinking") if a.command == "reorder" else (pipelines.COMMENT, "new_code", "commented_code", "comment_thinking")
    df = sources.parquet(spark, a.input, a.input_col or source)
    model = _model(a, **(pipelines.COMMENT_OPTIONS if a.command == "add-comments" else {}))
    sinks.parquet(pipelines.rewritten(df, model, instruction, a.input_col or source, a.output_col or output, a.thinking_col or thinking, a.keep_failed), a.output)


def run_annotate(spark, a):
    prompts = {"classify": annotation.system_prompt(), "rate": annotation.RATING_PROMPT, "infer": a.prompt}
    df = sources.with_row_id(spark.read.parquet(a.input), "index")
    image = annotation.image_column(df, a.image_col)
    cells = sources.image_cells(df, image, a.limit, "index").withColumn("path", F.col(f"{image}.path")).withColumn("_bytes", F.col(f"{image}.bytes"))
    out = annotation.annotate(cells, "index", _model(a), prompts[a.command] or "", "_bytes", F.lit(True), a.batch_size)
    sinks.append_json(out, a.output, resume=not a.no_resume)
    if a.stats_csv:
        sinks.counts_csv(annotation.label_histogram(sources.json_lines(spark, a.output, "index long, path string, raw string")), a.stats_csv)


def _drawer(a: argparse.Namespace) -> providers.LatexCompiler:
    return providers.LatexCompiler(timeout=a.timeout, size=a.size, render=True, dpi=a.dpi, latexmk=a.latexmk)


def run_render_dir(spark, a):
    """A PNG for each source file below a folder, at its place below the other; 0 if all worked, 1 if some, 2 if none."""
    files = sources.source_files(spark, a.input, recursive=True)
    out = pipelines.rendered(files, _drawer(a), "source").select("path", F.col("render_image.bytes").alias("png")).persist()
    try:
        n, good = out.count(), out.filter("png is not null").count()
        name = F.regexp_replace(text.output_path(F.col("path"), a.input, a.output), r"\.tex\z", ".png")
        sinks.files(out, name, F.col("png"), sinks.local_file)
    finally:
        out.unpersist()
    return 0 if good == n else 1 if good else 2


def run_render(spark, a):
    out = pipelines.rendered(sources.parquet(spark, a.input, a.code_col), _drawer(a), a.code_col, a.image_col or "render_image")
    out = out.persist()
    image = a.image_col or "render_image"
    if a.failed_output:
        sinks.failures(out, a.failed_output, image)
    if a.success_json:
        sinks.success_index(sources.with_row_id(out), "orig_id", image, a.success_json)
    sinks.parquet(out.filter(F.col(image).isNotNull()) if a.drop_failed else out, a.output)
    out.unpersist()


def run_prune(spark, a):
    files = sources.source_files(spark, a.input, recursive=True, limit=a.max_files)
    sinks.parquet(pipelines.removal_ratio(pipelines.pruned(files, providers.LatexCompiler(timeout=a.timeout), standalone=a.standalone, border=a.border)), a.output)


def run_evaluate(spark, a):
    images = pipelines.evaluated(sources.image_pairs(spark, a.pred_dir, a.ref_dir))
    images = images.drop(*(c for c in ("mse", "mse_nocanny", "ssim", "psnr") if getattr(a, f"no_{c}"))).persist()
    try:
        sinks.metrics_csv(images, f"{a.output}/images")
        done = pipelines.evaluation_summary(images, sources.predictions(spark, a.input), bleu=not a.no_bleu, ted=not a.no_ted)
        done.write.mode("overwrite").json(f"{a.output}/summary")
    finally:
        images.unpersist()


COMMANDS = {
    "filter": run_filter, "round": run_round, "sample": run_sample, "both": run_both, "reorder": run_rewrite, "add-comments": run_rewrite,
    "classify": run_annotate, "rate": run_annotate, "infer": run_annotate, "render": run_render, "render-dir": run_render_dir, "prune": run_prune, "evaluate": run_evaluate,
}


#: Flags of all commands that ask a model. The key is better given by the environment, which other users don't see.
MODEL_FLAGS = {
    "--model-id": str, "--base-url": str, "--api-key": str, "--concurrency": int, "--max-retries": int, "--api-timeout": float,
    "--temperature": float, "--top-p": float, "--max-tokens": int,
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="limn", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("--input", required=True)
        add = p.add_argument
        if name in ("filter", "both"):
            add("--out-keep", required=True), add("--out-dump", required=True), add("--compile", action="store_true"), add("--recorded"), add("--timeout", type=float, default=20)
        if name in ("round", "both"):
            add("--out-rounded", required=True)
        if name in ("sample", "both"):
            add("--out-sample", required=True), add("--bin-strategy", choices=("random", "first"), default="random"), add("--seed", type=int, default=42), add("--samples-per-bin", type=int, default=10_000), add("--bins", default="")
        if name in ("reorder", "add-comments"):
            add("--output", required=True), add("--model", required=True), add("--input-col"), add("--output-col"), add("--thinking-col"), add("--keep-failed", action="store_true")
        if name in ("classify", "rate", "infer"):
            add("--output", required=True), add("--model", required=True), add("--image-col"), add("--batch-size", type=int, default=8), add("--limit", type=int), add("--no-resume", action="store_true"), add("--stats-csv"), add("--prompt")
        if name in ("reorder", "add-comments", "classify", "rate", "infer"):
            for flag, kind in MODEL_FLAGS.items():
                add(flag, type=kind)
        if name == "render":
            add("--output", required=True), add("--size", type=int, default=384), add("--timeout", type=float, default=60), add("--dpi", type=int, default=200), add("--latexmk", action="store_true"), add("--code-col", default="code"), add("--image-col"), add("--failed-output"), add("--success-json"), add("--drop-failed", action="store_true")
        if name == "render-dir":
            add("--output", required=True), add("--size", type=int, default=384), add("--timeout", type=float, default=60), add("--dpi", type=int, default=200), add("--latexmk", action="store_true")
        if name == "prune":
            add("--output", required=True), add("--timeout", type=float, default=30), add("--max-files", type=int), add("--standalone", action="store_true"), add("--border", default="2mm")
        if name == "evaluate":
            add("--output", required=True), add("--pred-dir", required=True), add("--ref-dir", required=True)
            for c in ("mse", "mse_nocanny", "ssim", "psnr", "bleu", "ted"):
                add(f"--no-{c.replace('_', '-')}", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("limn").getOrCreate()
    sources.required_paths(spark, *(p for p in (args.input, getattr(args, "pred_dir", None), getattr(args, "ref_dir", None)) if p))
    return COMMANDS[args.command](spark, args) or 0


if __name__ == "__main__":
    sys.exit(main())
