"""The near copies that the pipeline's stage links, against brute force."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest

from limn.llm import simhash
from tests.llm.test_operators import brute_components, brute_fingerprint, near, shingles


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def meet(x: int, y: int) -> bool:
    z = x ^ y
    return min((z >> 32).bit_count(), (z & 0xFFFFFFFF).bit_count()) <= 1 and z.bit_count() <= simhash.WHOLE


def grouped(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, similarity=0.8, **options).collect()}


def families(seed: int, number: int, members: int) -> list[str]:
    """Families whose members share their words, so their fingerprints of words meet, and of which only some are similar."""
    rng, texts = random.Random(seed), []
    for _ in range(number):
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
        for _ in range(members):
            rng.shuffle(words)
            for _ in range(2):
                t = list(words)
                for _ in range(rng.choice([1, 1, 3])):
                    t[rng.randrange(len(t))] = rng.choice(words)
                texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("candidates", [2, 8])
def test_crowded_buckets_lose_no_pair(spark, candidates):
    texts = families(5, 6, 10)
    fps = {d: brute_fingerprint(t) for d, t in enumerate(texts)}
    words_of = [simhash.signature(t.encode(), 5)[0] for t in texts]
    close = [(a, b) for a in fps for b in fps if a < b and any(map(meet, words_of[a], words_of[b]))]
    alike = [(a, b) for a, b in close if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(alike) >= 50 and len(close) > 3 * len(alike)
    assert grouped(spark, texts, candidates=candidates) == brute_components(near(fps) + alike, list(fps))


def test_blocks_of_a_bucket_lose_no_pair(spark):
    """Small blocks, so that buckets are compared in many groups, and hardly anything is connected before."""
    texts = families(6, 2, 16)
    df = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id long, text string")
    nodes = simhash.signatures(df, 3, 5).withColumnRenamed("doc_id", "rep")
    none = spark.createDataFrame([], "a long, b long")
    found = simhash.similar_links(df, nodes, none, 0.8, crowded=2, block=7).collect()
    words_of = [simhash.signature(t.encode(), 5)[0] for t in texts]
    close = [(a, b) for a in range(len(texts)) for b in range(a) if any(map(meet, words_of[a], words_of[b]))]
    alike = [(a, b) for a, b in close if jaccard(texts[a], texts[b]) >= 0.8]
    assert all(jaccard(texts[r["a"]], texts[r["b"]]) >= 0.8 for r in found) and len(alike) > 15
    assert brute_components([tuple(r) for r in found], range(len(texts))) == brute_components(alike, range(len(texts)))


def test_shared_elements_are_counted():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9_000, n).astype("<u8") * 7919) for n in (0, 1, 40, 3_000, 6_000, 6_000)]
    want = [[len(np.intersect1d(a, b)) if len(a) and len(b) else 0 for b in sets] for a in sets]
    got = simhash.shared(sets)
    assert all(got[i][j] == want[i][j] for i in range(6) for j in range(6) if i != j)
    assert simhash.shared([np.zeros(0, "<u8")] * 2).tolist() == [[0, 0], [0, 0]]


def test_links_are_verified_by_whole_shingle_sets(spark):
    """Pairs just below and just above 0.8, of which a sketch takes some for the other kind."""
    rng, texts, wrong = random.Random(8), [], 0
    while len(texts) < 120:
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(900)]
        other = words[: 800 + rng.choice([-9, -6, -3, 3, 6, 9])]
        a, b = " ".join(words[:-1]), " ".join(other + [w for w in reversed(words[len(other) :])])
        texts += [a, b]
    pairs = [(i, i + 1) for i in range(0, len(texts), 2)]
    fps = {d: brute_fingerprint(t) for d, t in enumerate(texts)}
    signed = [simhash.signature(t.encode(), 5) for t in texts]
    close = [(a, b) for a, b in pairs if any(map(meet, signed[a][0], signed[b][0]))]
    alike = [(a, b) for a, b in close if jaccard(texts[a], texts[b]) >= 0.8]
    for a, b in close:
        p, q = (np.frombuffer(signed[d][-1], "<u2") for d in (a, b))
        wrong += (float((p == q)[(p != 0) | (q != 0)].mean()) >= 0.8) != (jaccard(texts[a], texts[b]) >= 0.8)
    assert wrong >= 3 and 0 < len(alike) < len(close)
    assert grouped(spark, texts) == brute_components(near(fps) + alike, list(fps))


def similar_pairs(texts: list[str], least: float = 0.8) -> list[tuple[int, int]]:
    """All pairs that similar, by an exact search: their rarest shingles meet."""
    sets, count = [shingles(t) for t in texts], defaultdict(int)
    for s in sets:
        for x in s:
            count[x] += 1
    post, out = defaultdict(list), []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        s = sets[i]
        met = set()
        for x in sorted(s, key=lambda x: (count[x], x))[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]:
            met.update(post[x])
            post[x].append(i)
        out += [(i, j) for j in met if len(sets[j]) >= least * len(s) and len(s & sets[j]) >= least * len(s | sets[j]) - 1e-9]
    return out


@pytest.mark.parametrize("path,rows", [("/root/testdata/sf0.1", 10_000), ("/root/testdata/check_h", 6_000)])
def test_recall_and_precision(spark, path, rows):
    """Of pairs of different texts that are similar by exact count, nine in ten at least are in one group; links are no less similar."""
    if not os.path.exists(f"{path}/documents.parquet"):
        pytest.skip(f"{path} is absent")
    df = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(rows)
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    first = {}
    for d, t in sorted(texts.items()):
        first.setdefault(" ".join(t.lower().split()), d)
    ids = [d for t, d in first.items() if len(t.split()) >= 5]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, similarity=0.8).collect()}
    pairs = similar_pairs([texts[d] for d in ids])
    assert sum(got[ids[i]] == got[ids[j]] for i, j in pairs) >= 0.9 * len(pairs) > 30
    groups = defaultdict(list)
    linked = {ids[i] for p in pairs for i in p}
    for d in ids:
        groups[got[d]].append(d)
    for g in groups.values():
        if 1 < len(g) <= 200 and not linked.issuperset(g):
            fps = {d: simhash.fingerprint(texts[d].encode()) for d in g}
            assert all(d in linked or any((fps[d] ^ fps[e]).bit_count() <= 3 for e in g if e != d) for d in g)
