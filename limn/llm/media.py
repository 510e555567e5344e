"""Interleaved document sequences with media columns.

HTML becomes an ordered array of text and media-reference structs. References name media by digest; a join with a
content-addressed store resolves them, while positions and captions stay with their element. Media are stored as 8-bit
grey images (binary PGM), whose samples are the payload's bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limn.llm.common import need, scratch_path, split_join, utf8, written

#: Samples in a row of an image: payloads are filled up with zeros to a positive multiple of it.
WIDTH = 64
ELEMENT = "struct<position: int, kind: string, text: string, digest: string, caption: string>"
_SCHEME = "digest:sha256/"
_BLOCKS = frozenset("address article aside blockquote body dd details div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul br".split())
_SILENT = frozenset("script style template noscript title head".split())
_MEDIA = frozenset("img audio video source embed".split())


def padded(text: bytes, width: int = WIDTH) -> bytes:
    return text + bytes(-len(text) % width or (0 if text else width))


def encoded(payload: bytes, width: int = WIDTH) -> bytes:
    """A binary PGM image of rows of `width` 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def decoded(image: bytes) -> bytes:
    """The samples of a binary PGM image with 8-bit samples. ValueError where it isn't one, or is cut."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", image)
    if not head or int(head[3]) > 255 or len(image) - head.end() != int(head[1]) * int(head[2]):
        raise ValueError("not a whole 8-bit PGM image")
    return image[head.end() :]


def feature(payload: bytes) -> str:
    """Rows, least, mean and largest sample, and entropy in bits, of the samples without the zeros that fill up."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    rows, total = len(payload) // WIDTH, int(n[1:].sum())
    if not total:
        return f"{rows}:0:0.0000:0:0.0000"
    values, share = np.arange(256), n[1:][n[1:] > 0] / total
    held = np.flatnonzero(n[1:]) + 1
    return f"{rows}:{held[0]}:{int((n * values).sum()) / total:.4f}:{held[-1]}:{abs(float(-(share * np.log2(share)).sum())):.4f}"


class _Sequence(HTMLParser):
    """Collects elements in reading order; a figure's caption belongs to the media of that figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.silent, self.caption, self.figure = [], [], 0, None, None

    def end_text(self):
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            self.out.append({"kind": "text", "text": words, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCKS:
            self.end_text()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.end_text()
            self.caption = []
        src = dict(attrs).get("src") if tag in _MEDIA else None
        if src and not self.silent:
            self.end_text()
            digest = src.removeprefix(_SCHEME) if src.startswith(_SCHEME) else None
            self.out.append({"kind": "media", "text": None if digest else src, "digest": digest, "caption": dict(attrs).get("alt") or None})
            if self.figure is not None:
                self.figure.append(self.out[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _MEDIA and tag not in ("br", "hr"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figure and words:
                for m in self.figure:
                    m["caption"] = words
            elif words:
                self.out.append({"kind": "text", "text": words, "digest": None, "caption": None})
        if tag in _BLOCKS:
            self.end_text()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str) -> list[dict]:
    """The ordered elements of a page: position, kind (text or media), text or outside reference, digest, caption."""
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser.end_text()
    return [{"position": i, **e} for i, e in enumerate(parser.out)]


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, elements) for each row of pages (key, html). Null and empty html have no elements; other columns are ignored."""
    element = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches):
        for b in batches:
            found = [sequence_of(t.decode("utf-8", "replace")) for t in utf8(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(found, pa.list_(element))], [key, "elements"])

    p = need(pages, key, "html")
    return p.mapInArrow(run, f"{key} {dict(p.dtypes)[key]}, elements array<{ELEMENT}>")


def store(texts: DataFrame, path: str) -> DataFrame:
    """Writes each row of texts (text) as an image into the store at path, under its digest; the store, read again.

    The store has (digest, media); equal media may stand in it more than once. Null text: empty.
    """

    def run(batches):
        for b in batches:
            media = [encoded(padded(t)) for t in utf8(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    texts.select("text").mapInArrow(run, "digest string, media binary").write.option("compression", "zstd").parquet(path)
    return texts.sparkSession.read.schema("digest string, media binary").parquet(path)


def features(kept: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of a store, one row a digest.

    Everything comes from the stored bytes. ValueError where they don't have their digest.
    """
    kinds = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        names = [x.split()[0] for x in kinds.split(", ")]
        for b in batches:
            rows = []
            for digest, x in zip(b.column("digest").to_pylist(), b.column("media")):
                media = x.as_buffer().to_pybytes()
                payload, own = decoded(media), hashlib.sha256(media).hexdigest()
                if own != digest:
                    raise ValueError(f"media {digest} has changed")
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), own, feature(payload)))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k.endswith("string") else pa.int64()) for c, k in zip(columns, kinds.split(", "))], names)

    return kept.mapInArrow(run, kinds).dropDuplicates(["digest"])


def resolved(found: DataFrame, kept: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, position, kind, text, digest, caption, media columns): the elements of sequences, each media reference with
    what `kept` (digest, other columns; one row a digest) has under its digest, or nulls where it has nothing.

    Elements keep their positions and captions. One medium may hold any share of all references: see `split_join`.
    """
    rows = written(found.select(key, F.explode("elements").alias("e")).select(key, "e.*"), "media-elements")
    return split_join(rows, kept, "digest")


def payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, position, caption and the columns of `features`) for each row of docs (doc_id, text).

    Each text becomes a stored image, and each document a page that refers to it by digest; the sequence parsed from the
    page is resolved against what is read back from the store. Null text: empty. Equal texts have one stored form.
    Repeated rows return as often; null ids stay null; an empty table gives an empty result; other columns are ignored.
    """
    d = need(docs, "doc_id", "text")
    kept = written(features(store(d, scratch_path(docs.sparkSession, "media"))), "media-features")

    def run(batches):
        for b in batches:
            texts = list(utf8(b, "text"))
            pages = [f'<article><figure><img src="{_SCHEME}{hashlib.sha256(encoded(padded(t))).hexdigest()}"><figcaption>{len(t)} bytes</figcaption></figure></article>' for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(pages, pa.string())], ["doc_id", "n_bytes", "html"])

    pages = d.mapInArrow(run, "doc_id long, n_bytes long, html string").withColumn("own", F.struct("doc_id", "n_bytes"))
    return resolved(sequences(pages, "own"), kept, "own").filter(F.col("kind") == "media").select("own.*", "position", "caption", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
