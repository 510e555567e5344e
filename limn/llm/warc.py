"""WARC archives: writing with revisits, segments and chunked bodies; reading back with segment reassembly.

A response's block is an HTTP message with a chunked body. Blocks beyond a size are cut into a first record and
continuation records, which name their origin and their number; the last one states the total length. Reading groups
continuations by origin identifier, orders them by number, verifies the total, and decodes the chunks.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from limn.llm.common import need, scratch_path, split_join, utf8, written

#: Bytes of a block in one record, and of a body in one chunk.
SEGMENT, CHUNK = 16_384, 4_096
#: Records in one archive file: with SEGMENT it bounds what reading a file takes.
RECORDS = 1_000
#: Payloads from this size on are stored once.
REVISIT_FROM = 1_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_FOUND = "id string, page_id long, kind string, refers string, segment int, origin string, total long, digest string, block binary"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """body in chunked transfer framing."""
    parts = [body[a : a + size] for a in range(0, len(body), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of a chunked framing; extensions and trailers are skipped. ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size line has no end")
        n = int(framed[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            break
        if len(framed) < at + n + 2 or framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        out.append(framed[at : at + n])
        at += n + 2
    if framed[at : at + 2] != b"\r\n" and b"\r\n\r\n" not in framed[at:]:
        raise ValueError("the trailer has no end")
    return b"".join(out)


def payload(block: bytes) -> bytes:
    """The payload of an HTTP message, its transfer coding decoded."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("an HTTP head has no end")
    return dechunked(body) if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head.lower()) else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive. ValueError where it is broken."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"the head of the record at byte {at} has no end")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, n = end + 4, int(fields["content-length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't as long as it says")
        yield fields, data[start : start + n]
        at = start + n + 4


def _records_of(page: int | None, url: str | None, body: bytes, size: int, digest: str, refers: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    name = lambda p: f"urn:x-page:{'' if p is None else p}:{digest}"
    about = [("WARC-Target-URI", url), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size)]
    if refers is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name(page)}>"), ("WARC-Refers-To", f"<{name(refers)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *about], _HTTP)
        return
    block = _HTTP + chunked(body, chunk)
    cuts = [block[a : a + segment] for a in range(0, len(block), segment)]
    for k, cut in enumerate(cuts, 1):
        kind = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name(page)}>")] if k == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name(page)}:{k}>"), ("WARC-Segment-Origin-ID", f"<{name(page)}>")]
        part = [("WARC-Segment-Number", k)] if len(cuts) > 1 else []
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(cuts) > 1 else []
        yield record([*kind, *part, *last, *about], cut)


#: Bits of the table that tells digests which certainly come once from others; as bytes, what is broadcast for it.
BITS = 1 << 26


def _repeats(equal: DataFrame) -> np.ndarray:
    """A table of BITS bits, by a hash of the digest, of which those of `equal` (digest) are set. Its size is fixed."""
    words = equal.select((_place("digest") / 64).cast("long").alias("w"), (_place("digest") % 64).cast("int").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("bits")).toPandas()  # BITS / 64 rows at most
    table = np.zeros(BITS // 64, np.int64)
    table[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table


def _place(digest: str) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(BITS))


def _told(p: DataFrame, revisit_from: int) -> DataFrame:
    """p (page_id, url, html, digest, n) with refers: the page that a revisit refers to, else null.

    Only what may be a revisit is shuffled with its html: a table of bits, of fixed size, tells pages whose payload
    certainly comes once. For the others it is decided by rows without html first, and these meet theirs by page and
    digest, so that many copies of one page don't meet in one task.
    """
    spark = p.sparkSession
    small = written(p.select("page_id", "digest", "n"), "warc-pages")
    equal = small.filter(F.col("n") >= revisit_from).groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.count("*").alias("k")).filter("k > 1 and top is not null")
    equal = written(equal.groupBy("digest").agg(F.max("top").alias("top")), "warc-equal")
    bits = spark.sparkContext.broadcast(_repeats(equal))  # BITS / 8 bytes

    @pandas_udf("boolean")
    def may_repeat(place: pd.Series) -> pd.Series:
        at = place.to_numpy(np.int64)
        return pd.Series((bits.value[at >> 6] >> (at & 63)) & 1 == 1)

    once = ~((F.col("n") >= revisit_from) & may_repeat(_place("digest")))
    some = written(small.filter(~once).distinct(), "warc-some")
    decided = split_join(some, equal, "digest").withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")))
    d = decided.select(F.col("page_id").alias("own"), F.col("digest").alias("same"), "refers")
    several = p.filter(~once).join(d, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same")))
    out = ["page_id", "url", F.when(F.col("refers").isNull(), F.col("html")).alias("html"), "n", "digest", "refers"]
    return p.filter(once).withColumn("refers", F.lit(None).cast("long")).select(*out).unionByName(several.select(*out))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, revisit_from: int = REVISIT_FROM, per_file: int = RECORDS) -> None:
    """Writes pages (page_id, url, html) as gzipped archives into the folder path, which Spark's writers must reach.

    Of equal payloads of at least revisit_from bytes, the one with the largest page_id is a response (each of them,
    where it repeats), the others are revisits of it; without any page_id all are responses. Null html is an empty
    payload; a null page_id is the smallest.
    """
    p = need(pages, "page_id", "url", "html").withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).withColumn("n", F.coalesce(F.octet_length("html"), F.lit(0)))

    def run(batches):
        for b in batches:
            out, held = [], 0
            for page, url, body, n, digest, refers in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), utf8(b, "html"), b.column("n").to_pylist(), b.column("digest").to_pylist(), b.column("refers").to_pylist()):
                for x in _records_of(page, url, body, n, digest, refers, segment, chunk):
                    out.append(x)
                    held += len(x)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = _told(p, revisit_from).mapInArrow(run, "record binary")
    # The text writer puts out bytes as they are, and closes each record as the format asks.
    made.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _unzipped(data: bytes) -> bytes:
    """All members of a gzip file, or the data where it is none."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out) + data


def _strip(x: str | None) -> str | None:
    return x.strip("<>") if x else None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """A record as _FOUND has it."""
    own, total = _strip(fields.get("warc-record-id")), fields.get("warc-segment-total-length")
    page = (re.match(r"urn:x-page:(-?\d+):", own or "") or [None, None])[1]
    digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    return own, page and int(page), fields.get("warc-type"), _strip(fields.get("warc-refers-to")), int(fields.get("warc-segment-number", 0)), _strip(fields.get("warc-segment-origin-id")), total and int(total), digest, block


def read_records(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """A row for each record of the archives in path: id, page_id, kind, refers, segment, origin, total, digest, block.

    verify: responses that aren't segmented are verified and decoded as they are read. Their digest is then that of their
    payload, their total its size, and their block is null.
    """

    def seen(row: tuple) -> tuple:
        own, page, kind, refers, segment, origin, _, digest, block = row
        if not verify or kind != "response" or segment:
            return row
        body = payload(block)
        return own, page, kind, refers, segment, origin, len(body), _verified(own, body, digest), None

    def run(batches):
        names = [x.split()[0] for x in _FOUND.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for f in b.column("content"):
                rows = [seen(_row(*x)) for x in records(_unzipped(f.as_buffer().to_pybytes()))]
                columns = list(zip(*rows)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _FOUND)


def _verified(own: str, body: bytes, digest: str | None) -> str:
    """The digest of a payload. ValueError where its record states another."""
    found = hashlib.sha1(body).hexdigest()
    if digest and found != digest:
        raise ValueError(f"{own}: the payload doesn't have its digest")
    return found


def reassembled(found: DataFrame, keep: bool = True) -> DataFrame:
    """(id, page_id, payload_bytes, payload_digest[, payload]) of each response; keep: with the payload.

    Segmented ones are grouped by origin, ordered by number and verified against the total length; a segment that
    lacks or a length that differs raises ValueError. Archives that hold a record twice give it twice. A group is one
    page's own bytes. Payloads are verified against their digest.
    """
    kinds = "id string, page_id long, payload_bytes long, payload_digest string" + ", payload binary" * keep

    def told(own, page, body, digest):
        return (own, page, len(body), _verified(own, body, digest), *[body] * keep)

    names = [x.split()[0] for x in kinds.split(", ")]
    arrow = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def alone(batches):
        for b in batches:
            own, page, digest = (b.column(c).to_pylist() for c in ("id", "page_id", "digest"))
            rows = [told(o, p, payload(x.as_buffer().to_pybytes()), d) for o, p, d, x in zip(own, page, digest, b.column("block"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(names), arrow)], names)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment", kind="stable")
        times = int((pdf["segment"] == 1).sum())
        one = pdf.drop_duplicates("segment")
        block, total = b"".join(one["block"]), one["total"].max()
        if list(one["segment"]) != list(range(1, len(one) + 1)) or len(one) * times != len(pdf) or len(block) != total:
            raise ValueError(f"{pdf['key'].iloc[0]}: segments {list(pdf['segment'])} with {len(block)} bytes of {total}")
        first = one.iloc[0]
        page = None if pd.isna(first["page_id"]) else int(first["page_id"])
        return pd.DataFrame([told(first["id"], page, payload(block), first["digest"])] * times, columns=names).astype({"page_id": "Int64"})

    whole = found.filter((F.col("kind") == "response") & (F.col("segment") == 0)).select("id", "page_id", "digest", "block").mapInArrow(alone, kinds)
    parts = found.filter(F.col("segment") > 0).withColumn("key", F.coalesce("origin", "id"))
    return whole.unionByName(parts.groupBy("key").applyInPandas(joined, kinds))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each page of the archives in path.

    A revisit has the size and digest of the response that it refers to; one whose response is absent raises an error.
    Archives are parsed once: only segments go on with their bytes.
    """
    found = written(read_records(spark, path, verify=True), "warc-records")
    whole = found.filter((F.col("kind") == "response") & (F.col("segment") == 0)).select("id", "page_id", F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    responses = written(whole.unionByName(reassembled(found.filter(F.col("segment") > 0), keep=False)), "warc-responses")
    once = responses.select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    revisits = split_join(found.filter(F.col("kind") == "revisit").select("page_id", "refers"), once, "refers")
    absent = F.raise_error(F.concat(F.lit("a revisit refers to an absent response: "), F.coalesce("refers", F.lit("none"))))
    size = F.when(F.col("payload_bytes").isNull(), absent.cast("long")).otherwise(F.col("payload_bytes"))
    own = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(revisits.select("page_id", size.alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) written as archives in the shared folder, and what reading them back tells of each page.

    Null html is an empty payload; repeated rows return as often; null ids stay null; an empty table gives an empty
    result; other columns are ignored.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_pages(pages.sparkSession, path)
