"""SimHash near-duplicate detection by multi-index hashing.

Fingerprint: the 64 bit majorities of the XXH64 values of a text's word shingles. Two 32-bit halves index it. If two
fingerprints differ in at most three bits, one of the halves differs in at most one, so looking up, for every
fingerprint, the Hamming ball of radius one around each half finds all partners; the whole distance is then verified.
A pair whose halves differ in one bit is reached from the side where this bit is 0, so only these flips are looked up.

Equal fingerprints are one class, whose representative is its smallest doc_id. Classes are linked, never their members.
Buckets with many classes are not joined pair by pair: see `_crowded_links`.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from limn.llm.common import discard, need, split_join, utf8, written
from limn.llm.components import components

SEED = 42
#: Classes in one bucket from which on links go through nodes of the Hamming cube rather than through pairs, or, where links
#: are but candidates, which are verified by similarity, through leaders first.
CROWDED, CANDIDATES = 64, 8
#: Fingerprints of words, and the bits in which those of two texts that meet differ at most.
TABLES, WHOLE = 3, 10
#: Members of a crowded bucket in one block, about, and their mean number of shingles from which on it has fewer.
BLOCK, _SHINGLES = 1_024, 4_096
_MEMBER = {"key": "long", "rep": "long", "fp": "long", "flip": "int", "least": "long", "most": "long", "component": "long"}
_CHUNK, _BINS, _SLICE = 1 << 16, 256, 2_048
#: Six standard errors of a sketch's estimate near 0.8.
MARGIN = 0.15


def fingerprint(text: bytes, words: int = 3) -> int:
    """The unsigned fingerprint of a text in UTF-8. A-Z count as a-z; words end at ASCII white space; shingles repeat.

    Fewer words than a shingle has: the whole sequence is the one shingle. No word: 0.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(min(words, len(tokens))))))
    ones, n = np.zeros(64, np.int64), max(len(tokens) - words, 0) + 1
    while len(h := np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, _CHUNK), repeat(SEED)), "<u8")):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the signed form of each document's fingerprint. Null texts count as empty."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in utf8(b, "text")), "<u8", b.num_rows).view("<i8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _half(fp, h: int):
    return F.shiftrightunsigned(fp, 32) if h else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(fp, h: int):
    """A half's value and its flips from 0 to 1, as keys that hold the half's number.

    Spark doesn't count the rows that these are exploded to: it takes them for as large as the classes' compressed file, and
    would send them all through the driver as a broadcast. So exploded ones are joined by a merge join at every size.
    """
    half = _half(fp, h)
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: half.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), lambda k: k != half)
    return F.transform(F.concat(F.array(half), flips), lambda k: k + F.lit(h << 32))


def links(classes: DataFrame, distance: int = 3, crowded: int = CROWDED) -> DataFrame:
    """(a, b) between representatives: enough links of at most `distance` bits to connect just what all links connect.

    classes has (rep, fp) with distinct fp. In a bucket of fewer than `crowded` classes every link is made.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of radius one are exact for distances up to 3")
    both = [F.struct(F.lit(h).alias("h"), (_half(F.col("fp"), h) + F.lit(h << 32)).alias("key")) for h in (0, 1)]
    index = classes.select("rep", "fp", F.explode(F.array(*both)).alias("k")).select("rep", "fp", "k.key")
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= crowded)
    hot = written(sizes.select("key"), "simhash-crowded")
    probes = classes.select("rep", "fp", F.explode(F.concat(_ball(F.col("fp"), 0), _ball(F.col("fp"), 1))).alias("key"))
    sparse = index.join(hot, "key", "left_anti") if hot.take(1) else index
    i, p = sparse.alias("i"), probes.hint("merge").alias("p")
    near = (F.bit_count(F.col("i.fp").bitwiseXOR(F.col("p.fp"))) <= distance) & (F.col("i.rep") != F.col("p.rep"))
    found = i.join(p, (F.col("i.key") == F.col("p.key")) & near).select(F.least("i.rep", "p.rep").alias("a"), F.greatest("i.rep", "p.rep").alias("b"))
    if hot.take(1):
        found = found.unionByName(_crowded_links(probes, hot, distance))
    return found.distinct()


def _crowded_links(probes: DataFrame, hot: DataFrame, distance: int) -> DataFrame:
    """Links of the crowded buckets, as stars instead of pairs; rows grow with the classes, not with their pairs.

    A class in a bucket has the bucket's value in one half, or came by one flip. It is laid out on the nodes of its
    other half's Hamming cube that are few bits away; its weight at a node is those bits plus its flip. Two classes
    that meet differ in at most the sum of their weights, so where that sum is at most `distance` they link. Any two
    classes of a bucket that link meet at a node halfway with just such weights, of which one is 0 or 1. At each node
    the class of least weight is linked to all whose weight allows it; these stars join whatever pairs would join.
    """
    h = F.shiftright("key", 32)
    other = F.when(h == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    flip = F.when(F.when(h == 0, _half(F.col("fp"), 0)).otherwise(_half(F.col("fp"), 1)) == F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), 0).otherwise(1)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    masks = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.transform(F.sequence(i, F.lit(31)), lambda j: bit(i).bitwiseOR(bit(j))))))
    members = probes.join(hot, "key").withColumns({"other": other, "flip": flip})
    weights = F.filter(masks, lambda m: F.bit_count(m) + F.col("flip") <= F.lit((distance + 1) // 2))
    laid = members.select("key", "rep", "other", "flip", F.explode(weights).alias("m")).select("key", "rep", F.col("other").bitwiseXOR(F.col("m")).alias("node"), (F.bit_count("m") + F.col("flip")).alias("w"))
    least = laid.groupBy("key", "node").agg(F.min(F.struct("w", "rep")).alias("e"))
    stars = laid.join(least, ["key", "node"]).filter((F.col("e.w") + F.col("w") <= distance) & (F.col("e.rep") != F.col("rep")))
    return stars.select(F.least("rep", "e.rep").alias("a"), F.greatest("rep", "e.rep").alias("b"))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The distinct XXH3 values of all of a text's word shingles, ascending."""
    tokens = text.lower().split()
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(min(words, len(tokens))))))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), "<u8"))


def signature(text: bytes, words: int) -> tuple[list[int], int, bytes]:
    """TABLES fingerprints of a text's distinct words, the number of its distinct word shingles, and a sketch of these.

    Near copies keep most of their words, so these fingerprints stay closer than those of shingles. The sketch is one
    permutation's least hash in each of _BINS ranges, as 16 bits, 0 where a range is empty.
    """
    tokens = text.lower().split()
    if not tokens:
        return [0] * TABLES, 0, bytes(2 * _BINS)
    hashes = (lambda w: xxhash.xxh3_128_digest(w) + xxhash.xxh3_64_digest(w, 1))
    once = np.frombuffer(b"".join(map(hashes, set(tokens))), np.uint8).reshape(-1, 8 * TABLES)
    ones = np.zeros(64 * TABLES, np.int64)
    for a in range(0, len(once), _CHUNK):
        ones += np.unpackbits(once[a : a + _CHUNK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    u = np.packbits(2 * ones > len(once), bitorder="little").view("<u8").tolist()
    h = shingle_hashes(text, words)
    bins, at = np.unique(h >> np.uint64(64 - _BINS.bit_length() + 1), return_index=True)
    sketch = np.zeros(_BINS, "<u2")
    sketch[bins.astype(int)] = (h[at] & np.uint64(0xFFFF)) | np.uint64(1)
    return u, len(h), sketch.tobytes()


def signatures(docs: DataFrame, words: int, similar: int) -> DataFrame:
    """(doc_id, fp, u, n, sketch) for each document: `fingerprint` and `signature`."""
    signed = lambda x: np.array(x, "<u8").view("<i8")

    def run(batches):
        for b in batches:
            rows = [(fingerprint(t, words), *signature(t, similar)) for t in utf8(b, "text")]
            fp, u, n, sketch = zip(*rows) if rows else ([], [], [], [])
            lists = pa.array([signed(x) for x in u], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(signed(fp)), lists, pa.array(n, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "fp", "u", "n", "sketch"])

    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long, u array<long>, n long, sketch binary")


@pandas_udf(T.DoubleType())
def estimated_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of shingles, estimated from two sketches: ranges that agree, of those that aren't empty in both."""

    def one(x: bytes, y: bytes) -> float:
        p, q = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
        some = (p != 0) | (q != 0)
        return float((p == q)[some].mean()) if some.any() else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


@pandas_udf(T.DoubleType())
def exact_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of two whole sets of `shingle_hashes`; of two empty ones: 0."""

    def one(x: bytes, y: bytes) -> float:
        p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        both = len(np.intersect1d(p, q, assume_unique=True))
        return both / (len(p) + len(q) - both) if both else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def shingle_sets(docs: DataFrame, ids: DataFrame, similar: int) -> DataFrame:
    """(id, hashes): `shingle_hashes` of the documents whose id is among ids (doc_id, each once)."""

    def run(batches):
        for b in batches:
            sets = pa.array([shingle_hashes(t, similar).tobytes() for t in utf8(b, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sets], ["id", "hashes"])

    return written(need(docs, "doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "id long, hashes binary"), "simhash-sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, similar: int) -> DataFrame:
    """The pairs (a, b) of nodes (rep, sketch) whose shingles are that similar by exact count.

    Sketches only spare the count where they are further below than MARGIN.
    """
    side = lambda x: nodes.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").filter(estimated_similarity("sketch_a", "sketch_b") >= similarity - MARGIN)
    likely = written(likely.select("a", "b").distinct(), "simhash-likely")
    sets = shingle_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), similar)
    whole = lambda x: sets.select(F.col("id").alias(x), F.col("hashes").alias(f"hashes_{x}"))
    judged = likely.join(whole("a"), "a").join(whole("b"), "b").filter(exact_similarity("hashes_a", "hashes_b") >= similarity)
    found = written(judged.select("a", "b").distinct(), "simhash-similar")
    discard(likely, sets)
    return found


def _by_blocks(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """members (key, rep, ...) of the buckets of blocks (key, blocks), a row for each two blocks of a bucket that they are in.

    A bucket's members are dealt to so many blocks; any two of them meet in just one group (key, i, j), as members of
    different blocks or, where i = j, of the same.
    """
    dealt = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return other.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("blocks", "other")


def _may_link(g: pd.DataFrame, i: int, similarity: float, whole: int) -> np.ndarray:
    """Which members of a group may link with member i: they meet, aren't connected, and their numbers of shingles allow it."""
    fp, flip, of, least, most, block = (g[c].to_numpy() for c in ("fp", "flip", "component", "least", "most", "block"))
    share = similarity - 1e-9
    ok = (of != of[i]) & (most >= share * least[i]) & (most[i] >= share * least) & (np.bitwise_count(fp ^ fp[i]) <= whole)
    if flip[i]:
        ok &= flip == 0
    return ok & (block != block[i]) if g["i"].iloc[0] != g["j"].iloc[0] else ok


def _open_members(similarity: float, whole: int):
    """The members of a group of `_by_blocks` that may link with one of it."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        keep = np.zeros(len(g), bool)
        for i in np.flatnonzero(g["flip"].to_numpy() == 0):
            ok = _may_link(g, i, similarity, whole)
            keep |= ok
            keep[i] |= ok.any()
        return g.loc[keep, [*_MEMBER]]

    return run


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements any two sets share: the product of their incidence matrix with itself, a slice of elements at a time."""
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate([*sets, np.zeros(0, "<u8")]), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    several = count[place] > 1  # what one set alone has is shared with none
    own, column = own[several], column[place[several]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, _SLICE):
        low, high = np.searchsorted(column, (a, a + _SLICE))
        m = np.zeros((len(sets), _SLICE), np.float32)
        m[own[low:high], column[low:high] - a] = 1
        out += m @ m.T
    return out


def _new_links(similarity: float, whole: int):
    """Links that connect what links of a group of `_by_blocks` connect, by exact count of whole shingle sets (hashes)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, "<u8") for x in g["hashes"]]
        size, both, rep = np.array([len(s) for s in sets]), shared(sets), g["rep"].to_numpy()
        root = {c: c for c in g["component"]}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found, of = [], g["component"].tolist()
        for i in range(len(g)):
            ok = _may_link(g, i, similarity, whole) & (both[i] > 0) & (both[i] >= similarity * (size + size[i] - both[i]) - 1e-9)
            ok[: i + 1] = False
            for j in np.flatnonzero(ok):
                a, b = find(of[i]), find(of[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def similar_links(docs: DataFrame, nodes: DataFrame, linked: DataFrame, similarity: float, similar: int = 5, crowded: int = CANDIDATES, whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """(a, b): linked and further links between nodes (rep, u, n, sketch), which connect just what all links connect.

    Two nodes link that meet, and whose shingles are that similar by exact count. They meet if, for one of the fingerprints
    of words, a half differs in at most one bit and the whole in at most `whole`. All fingerprints are looked up at once,
    as tables of their own. In a bucket of fewer than `crowded` nodes every pair is tried. In a crowded one, three leaders
    and the smallest node of each fingerprint are tried first. What meets there and isn't connected by then is compared
    block by block, within tasks of bounded size that give no more links than they have nodes.
    """
    rows = nodes.select("rep", F.posexplode("u").alias("t", "fp"))
    keyed = lambda key, h: key + F.lit(h << 32) + F.shiftleft(F.col("t").cast("long"), 34)
    index = rows.select("rep", "fp", F.explode(F.array(*(keyed(_half(F.col("fp"), h), h) for h in (0, 1)))).alias("key"))
    ball = F.concat(*(F.transform(_ball(F.col("fp"), h), lambda k, i: F.struct(k.alias("key"), (i > 0).cast("int").alias("flip"))) for h in (0, 1)))
    probes = rows.select("rep", "fp", "t", F.explode(ball).alias("k")).select("rep", "fp", "k.flip", keyed(F.col("k.key"), 0).alias("key"))
    node, far = F.struct("rep", "fp"), lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) > whole
    leaders = index.groupBy("key").agg(F.count("*").alias("n"), F.min(node).alias("l0"), F.max(node).alias("l1"), F.min_by(node, F.xxhash64("rep")).alias("l2"))
    crowd = written(leaders.filter(F.col("n") >= crowded), "simhash-leaders")
    # A crowded bucket is one row without a node here, so the probes are dealt out once for both kinds.
    marks = crowd.select(F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("fp"), "key")
    i, p = index.join(crowd.select("key"), "key", "left_anti").select("rep", "fp", "key").unionByName(marks).alias("i"), probes.hint("merge").alias("p")
    met = i.join(p, (F.col("i.key") == F.col("p.key")) & (F.col("i.rep").isNull() | ((F.col("i.rep") != F.col("p.rep")) & ~far("i.fp", "p.fp"))))
    met = written(met.select(F.col("i.rep").alias("a"), F.col("p.rep").alias("rep"), F.col("p.fp").alias("fp"), F.col("p.flip").alias("flip"), F.col("p.key").alias("key")), "simhash-met")
    pairs, members = met.filter(F.col("a").isNotNull()).select("a", F.col("rep").alias("b")), met.filter(F.col("a").isNull()).drop("a")
    own = members.filter("flip = 0")
    led = own.join(crowd, "key").select(F.explode(F.array("l0", "l1", "l2")).alias("l"), "rep", "fp").filter(~far("l.fp", "fp")).select(F.col("l.rep").alias("a"), F.col("rep").alias("b"))
    same = own.groupBy("key", "fp").agg(F.min("rep").alias("a"))
    same = own.join(same, ["key", "fp"]).select("a", F.col("rep").alias("b"))
    tidy = lambda x: x.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = written(tidy(pairs.unionByName(led).unionByName(same)), "simhash-candidates")
    linked = written(linked.unionByName(verified(tried, nodes, docs, similarity, similar)), "simhash-linked")
    if crowd.take(1):
        linked = linked.unionByName(_block_links(docs, nodes, linked, members, similarity, similar, whole, block))
    discard(tried)
    return linked


def _block_links(docs: DataFrame, nodes: DataFrame, linked: DataFrame, members: DataFrame, similarity: float, similar: int, whole: int, block: int) -> DataFrame:
    """Further links (a, b) between members (key, rep, fp, flip) of crowded buckets that `linked` doesn't connect."""
    found = components(linked).select(F.col("id").alias("rep"), "component")
    sized = nodes.groupBy("rep").agg(F.min("n").alias("least"), F.max("n").alias("most")).join(found, "rep", "left")
    known = members.join(sized.select("rep", "least", "most", F.coalesce("component", "rep").alias("component")), "rep").select(*_MEMBER)
    known = written(known, "simhash-members")
    blocks = known.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    parts = _by_blocks(known, blocks.filter("c0 <> c1").select("key", "blocks"))
    left = parts.groupBy("key", "i", "j").applyInPandas(_open_members(similarity, whole), ", ".join(f"{c} {t}" for c, t in _MEMBER.items()))
    left = written(left.distinct(), "simhash-open")
    if not left.take(1):
        return linked.limit(0)
    sets = shingle_sets(docs, left.select(F.col("rep").alias("doc_id")).distinct(), similar)
    weight = F.greatest(F.count("*") / block, F.sum("most") / (block * _SHINGLES))
    parts = _by_blocks(left, left.groupBy("key").agg(F.ceil(weight).alias("blocks")))
    parts = parts.join(sets.withColumnRenamed("id", "rep"), "rep")
    links = written(parts.groupBy("key", "i", "j").applyInPandas(_new_links(similarity, whole), "a long, b long").distinct(), "simhash-across")
    discard(known, left, sets)
    return links


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, crowded: int = CROWDED, similarity: float | None = None, similar: int = 5, candidates: int = CANDIDATES) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text): the smallest doc_id that links reach.

    Documents link whose fingerprints differ in at most `distance` bits. With a similarity, those also link whose shingles
    of `similar` words are that similar, by exact count over candidates that multi-index hashing of their words finds.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows return as often. Rows without a
    doc_id link nothing and have no component. An empty table gives an empty result; other columns are ignored.
    """
    made = fingerprints(docs, words) if similarity is None else signatures(docs, words, similar)
    rows = written(made, "simhash-fps")
    known, rest = rows.filter(F.col("doc_id").isNotNull()), [c for c in rows.columns if c not in ("doc_id", "fp")]
    least = F.min(F.struct("doc_id", *rest)).alias("least")
    classes = written(known.groupBy("fp").agg(least).select("fp", F.col("least.doc_id").alias("rep"), *(f"least.{c}" for c in rest)), "simhash-classes")
    linked = links(classes.select("rep", "fp"), distance, crowded)
    if similarity is not None:
        linked = similar_links(docs, classes, linked, similarity, similar, candidates)
    found = components(linked)
    of_class = classes.join(found, classes.rep == found.id, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    of_class = written(of_class, "simhash-components")
    discard(classes)
    told = split_join(rows.select("doc_id", "fp"), of_class, "fp")
    return told.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 3, distance: int = 3, similarity: float | None = 0.8) -> DataFrame:
    """The rows of docs whose doc_id is their group's smallest; all its columns. Of rows that repeat a doc_id one stays.

    Rows without a doc_id stay.
    """
    kept = near_duplicates(docs, words, distance, similarity=similarity).filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    kept = written(kept, "simhash-kept")
    repeated = kept.groupBy("doc_id").count().filter("count > 1").take(1)
    # Which ids are kept grows with the input: rows meet them by a merge join at every size, never by a broadcast.
    with_id = docs.filter(F.col("doc_id").isNotNull()).join(kept.hint("merge"), "doc_id", "left_semi")
    with_id = with_id.dropDuplicates(["doc_id"]) if repeated else with_id
    return with_id.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)
