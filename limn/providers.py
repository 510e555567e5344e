"""What needs a compiler, a PDF parser, a model or a network: interfaces, recorded answers, and how columns call them.

A provider is a picklable object. It is called once per distinct input where inputs repeat, inside the tasks, and keeps
what it opens per worker. `Recorded` answers from a table, so that whatever is built on providers runs without them.
"""

from __future__ import annotations

import asyncio
import hashlib
import os
import signal
import subprocess
import tempfile
import time
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf, udf

#: What a compile gives: whether it worked, return code, seconds, error, log, and the page as PNG and PDF.
COMPILED = "ok boolean, rc int, secs double, error string, log string, png binary, pdf binary"
COMPILED_FIELDS = tuple(x.split()[0] for x in COMPILED.split(", "))
#: Seconds of a compile, return code of one that ran out of them, and least bytes of a PDF.
TIMEOUT, TIMED_OUT, LEAST_PDF = 20, 124, 1000


class Compiler(Protocol):
    def compile(self, code: str) -> dict: ...


class Model(Protocol):
    """A language or vision model: a batch of prompts, with images or without, to as many replies."""

    def generate(self, prompts: list[dict]) -> list[str]: ...


class Features(Protocol):
    """A batch of images to feature vectors."""

    def extract(self, images: list[bytes]) -> list[list[float]]: ...


class Distances(Protocol):
    """A batch of image pairs to perceptual distances."""

    def distances(self, pairs: list[tuple[bytes, bytes]]) -> list[float]: ...


class Pdf(Protocol):
    """The first page of a PDF: text lines as boxes with the page's size, and drawing paths as segments or as drawing items."""

    def boxes(self, pdf: bytes) -> tuple[float, float, list[dict]]: ...

    def paths(self, pdf: bytes) -> list[dict]: ...


def failed(error: str, rc: int = 1, secs: float = 0.0, log: str | None = None) -> dict:
    return dict(zip(COMPILED_FIELDS, (False, rc, secs, error, log, None, None)))


def run_group(command: list[str], folder: str, timeout: float) -> tuple[int, str]:
    """(return code, output) of a process in a session of its own; at the timeout its whole group is killed, code 124."""
    with subprocess.Popen(command, cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, stdin=subprocess.DEVNULL, start_new_session=True) as p:
        try:
            out, _ = p.communicate(timeout=timeout)
            return p.returncode, out.decode("latin-1")
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, signal.SIGKILL)
            p.communicate()
            return TIMED_OUT, ""


@dataclass
class LatexCompiler:
    """Compiles with the engines that the machine has, in turn, without shell escape, and renders the last page to PNG.

    latexmk: let it run an engine as often as references need. An empty bibliography stands ready for classes that read one.
    """

    engines: tuple[str, ...] = ("pdflatex", "lualatex", "xelatex")
    timeout: float = TIMEOUT
    size: int = 384
    render: bool = False
    dpi: int = 200
    latexmk: bool = False

    def command(self, engine: str) -> list[str]:
        if self.latexmk:
            return ["latexmk", f"-{engine}", "-norc", "-nobibtex", "-interaction=nonstopmode", "-latexoption=-no-shell-escape", "a.tex"]
        return [engine, "-interaction=batchmode", "-halt-on-error", "-no-shell-escape", "a.tex"]

    def compile(self, code: str) -> dict:
        began = time.monotonic()
        result = failed("no LaTeX engine")
        with tempfile.TemporaryDirectory() as folder:  # local to one compile, never read by another task
            Path(folder, "a.tex").write_text(code)
            Path(folder, "a.bbl").touch()
            for engine in self.engines:
                try:
                    rc, out = run_group(self.command(engine), folder, self.timeout)
                except OSError as e:
                    result = failed(f"{engine}: {e.strerror}")
                    continue
                log, pdf = Path(folder, "a.log"), Path(folder, "a.pdf")
                text = log.read_text("latin-1") if log.exists() else out
                data = pdf.read_bytes() if pdf.exists() else None
                if rc == 0 and data and len(data) >= LEAST_PDF:
                    png = self._page(folder) if self.render else None
                    if not self.render or png:
                        return dict(zip(COMPILED_FIELDS, (True, 0, time.monotonic() - began, None, text, png, data)))
                    rc, text = 1, text + "\nthe page can't be rendered"
                result = failed(f"{engine} gave {rc}", rc or 1, time.monotonic() - began, text)
        return result

    def _page(self, folder: str) -> bytes | None:
        """The last page without its white border, centred on a square; none where it is blank or can't be drawn."""
        from limn.functions import imaging

        try:
            rc, _ = run_group(["pdftoppm", "-png", "-r", str(self.dpi), "a.pdf", "page"], folder, self.timeout)
        except OSError:
            return None
        pages = sorted(Path(folder).glob("page*.png"), key=lambda p: (len(p.name), p.name))
        if rc or not pages:
            return None
        pixels = imaging.on_white(imaging.decode_png(pages[-1].read_bytes()))
        return None if imaging.is_blank(pixels) else imaging.encode_png(imaging.trim_square(pixels, self.size))


def reward_compiler(timeout: float = TIMEOUT) -> LatexCompiler:
    """What rewards are computed with: one engine, and PNG and PDF of the page."""
    return LatexCompiler(engines=("pdflatex",), timeout=timeout, render=True)


def fetched(address: str, timeout: float = 30) -> bytes:
    """What a web address holds, for `imaging.Loader(fetch=...)`."""
    with urllib.request.urlopen(urllib.request.Request(address, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as reply:
        return reply.read()


@dataclass
class RuleCompiler:
    """A stand-in that compiles by a rule: code fails where one of `needed` is absent from it. For tests and recordings."""

    needed: Callable[[str], tuple[bool, str | None]]

    def compile(self, code: str) -> dict:
        ok, error = self.needed(code)
        return failed(error or "fails") if not ok else dict(zip(COMPILED_FIELDS, (True, 0, 0.0, None, "", None, None)))


#: Bytes of results that a task keeps for code that comes again. No result depends on it.
KEPT_BYTES = 64 << 20


class Recent:
    """The latest results by the digest of what they were made from, of so many bytes at most."""

    def __init__(self, most: int):
        self.most, self.held, self.results = most, 0, OrderedDict()

    def get(self, code: str, make: Callable[[str], object]):
        key = hashlib.blake2b(code.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in self.results:
            self.results.move_to_end(key)
            return self.results[key]
        found = make(code)
        self.results[key] = found
        self.held += self._size(found)
        while self.held > self.most and len(self.results) > 1:
            self.held -= self._size(self.results.popitem(last=False)[1])
        return found

    @staticmethod
    def _size(found) -> int:
        values = found.values() if isinstance(found, dict) else found if isinstance(found, tuple) else (found,)
        return 200 + sum(len(v) for v in values if isinstance(v, (str, bytes)))


def compiled(df: DataFrame, code: str, provider: Compiler, into: str = "compiled") -> DataFrame:
    """df with a struct of what compiling a column gives. Equal code is compiled once for each task; null code fails."""
    fields = "struct<" + COMPILED.replace(" ", ": ").replace(",: ", ", ") + ">"

    @pandas_udf(fields)
    def run(codes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = Recent(KEPT_BYTES)

        def safe(c):
            if c is None:
                return failed("no code")
            try:
                return seen.get(c, provider.compile)
            except Exception as e:  # a provider's fault fails its row, not the job
                return failed(f"{type(e).__name__}: {e}")

        for s in codes:
            yield pd.DataFrame([safe(c) for c in s], columns=COMPILED_FIELDS)

    return df.withColumn(into, run(F.col(code)))


def recorded(df: DataFrame, code: str, table: DataFrame, into: str = "compiled") -> DataFrame:
    """df with what a table of recorded compiles (code_sha256 and the fields) has for a column; failed where it has none."""
    kept = table.select(F.col("code_sha256").alias("_sha"), F.struct(*COMPILED_FIELDS).alias("_found"))
    none = F.struct(*(F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for t, v in zip(COMPILED.split(", "), failed("not recorded").values())))
    own = F.coalesce(F.sha2(F.col(code), 256), F.concat(F.lit("none "), F.xxhash64(*df.columns).cast("string")))
    return df.withColumn("_sha", own).join(kept, "_sha", "left").withColumn(into, F.coalesce("_found", none)).drop("_sha", "_found")


@dataclass
class RecordedReplies:
    """Replies by prompt; `default` where there is none."""

    replies: dict[str, str] = field(default_factory=dict)
    default: str = ""

    def generate(self, prompts: list[dict]) -> list[str]:
        return [self.replies.get(p["prompt"], self.default) for p in prompts]


@dataclass
class ChatModel:
    """An OpenAI-style endpoint: `client(**connection)` gives an async client in the worker. Only API errors are tried again.

    At most `concurrency` requests of a task are under way. Between attempts it waits 2, 4, ... up to 10 seconds, and not
    after the last. A request that takes more than `timeout` seconds is one that failed. options go with each request:
    sampling, or what switches a provider's own thinking off.
    """

    client: Callable[[], object]
    model: str
    system: str = ""
    concurrency: int = 128
    attempts: int = 3
    retried: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError)
    timeout: float = 300
    options: dict = field(default_factory=dict)
    connection: dict = field(default_factory=dict)

    def generate(self, prompts: list[dict]) -> list[str]:
        return asyncio.run(self._all(prompts))

    async def _all(self, prompts: list[dict]) -> list[str]:
        client, limit = self.client(**self.connection), asyncio.Semaphore(self.concurrency)

        async def one(p: dict) -> str:
            async with limit:
                for attempt in range(1, self.attempts + 1):
                    try:
                        return await asyncio.wait_for(client.reply(self.model, self.system, p["prompt"], **self.options), self.timeout)
                    except self.retried:
                        if attempt < self.attempts:
                            await asyncio.sleep(min(2 * attempt, 10))
            return ""

        return list(await asyncio.gather(*map(one, prompts)))


def replies(df: DataFrame, prompt: Column, provider: Model, into: str = "raw", batch: int = 8, image: Column | None = None) -> DataFrame:
    """df with a model's reply to each row's prompt, in batches; a batch that fails gives empty replies."""

    @pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in parts:
            rows = [{"prompt": p, "image": i} for p, i in zip(*columns)]
            out: list[str] = []
            for a in range(0, len(rows), batch):
                try:
                    out += provider.generate(rows[a : a + batch])
                except Exception:  # as if the model had said nothing
                    out += [""] * len(rows[a : a + batch])
            yield pd.Series(out, dtype=object)

    return df.withColumn(into, run(prompt, image if image is not None else F.lit(None).cast("binary")))


def per_distinct(df: DataFrame, key: Column, work: Callable[[DataFrame], DataFrame], joined: list[str]) -> DataFrame:
    """work done once for each distinct key over all of df, and joined back: for inputs that repeat across tasks."""
    keyed = df.withColumn("_key", key)
    done = work(keyed.dropDuplicates(["_key"])).select("_key", *joined)
    return keyed.join(done, keyed["_key"].eqNullSafe(done["_key"])).drop("_key")


def text_boxes(pdf: Column, provider: Pdf) -> Column:
    """Boxes of a PDF column's first page on the canvas; none where it can't be read."""
    from limn.operators.layout import BOXES, placed_boxes

    @udf(returnType=BOXES, useArrow=True)
    def read(data):
        try:
            return placed_boxes(*provider.boxes(bytes(data)))
        except Exception:  # a page that can't be read has no boxes
            return []

    return read(pdf)


def drawing_elements(pdf: Column, provider: Pdf) -> Column:
    """Geometric elements of a PDF column's first page; none where it can't be read."""
    from limn.operators.geometry import PATHS, path_elements

    @udf(returnType=PATHS, useArrow=True)
    def read(data):
        try:
            return [{"segments": p.get("segments"), "closed": p.get("closed"), "items": p.get("items")} for p in provider.paths(bytes(data))]
        except Exception:  # a page that can't be read has no elements
            return []

    return path_elements(read(pdf))


def features(df: DataFrame, image: str, provider: Features, into: str = "features", batch: int = 16) -> DataFrame:
    """df with the feature vector of an image column, null for null or where a batch fails."""

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(_batched(s.tolist(), batch, provider.extract, lambda x: x is not None), dtype=object)

    return df.withColumn(into, run(F.col(image)))


def perceptual_similarity(df: DataFrame, predicted: str, reference: str, provider: Distances, into: str = "perceptual", batch: int = 16) -> DataFrame:
    """df with 1 less the perceptual distance of a pair of images, in [0, 1]; 0 where one is null or a batch fails.

    Scores stay with their rows, whatever the batches are.
    """

    @pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            found = _batched(list(zip(a, b)), batch, provider.distances, lambda p: p[0] is not None and p[1] is not None)
            yield pd.Series([0.0 if d is None else min(max(1 - float(d), 0.0), 1.0) for d in found])

    return df.withColumn(into, run(F.col(predicted), F.col(reference)))


def _batched(rows: list, batch: int, work: Callable[[list], list], able: Callable[[object], bool]) -> list:
    """work over the able rows in batches, each result at its row's place; None for the others and for failed batches."""
    out, places = [None] * len(rows), [i for i, r in enumerate(rows) if able(r)]
    for a in range(0, len(places), batch):
        own = places[a : a + batch]
        try:
            found = work([rows[i] for i in own])
        except Exception:  # a model's fault leaves its batch without results
            continue
        for i, x in zip(own, found):
            out[i] = x
    return out
