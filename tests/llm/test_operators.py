"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from limn.llm import licenses, media, mixing, packing, quality, simhash, token_counts, topk, toxicity, warc
from limn.llm.components import components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [None, "", "one", "two words", "A b C d e", "é É ß 日本 <|endoftext|> x", "x " * 3000, "\t\n \x0b", "don't  stop\n\nnow 123", "a\x1cb\x85c\xa0d", "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns named like what operators make."""
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", 7, "clash") for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "two words", "s1", 1, "clash"), (100, "two words", None, 2, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, score string").repartition(3)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(len(words) - 2, 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(fps, distance=3):
    keys = sorted(fps)
    return [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= distance]


def test_simhash_is_brute_force(docs, odd):
    for df in (docs, odd.filter("doc_id is not null")):
        texts = texts_of(df)
        fps = {d: brute_fingerprint(t) for d, t in texts}
        want = brute_components(near(fps), list(fps))
        got = simhash.near_duplicates(df).collect()
        assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((d, f"{fps[d]:016x}", want[d]) for d, _ in texts)


def test_simhash_null_ids_link_nothing(odd):
    got = [r for r in simhash.near_duplicates(odd).collect() if r["doc_id"] is None]
    assert len(got) == 1 and got[0]["component_id"] is None and got[0]["fingerprint"] == f"{brute_fingerprint('two words'):016x}"


@pytest.mark.parametrize("crowded", [2, 6, 64])
def test_links_connect_what_pairs_connect(spark, crowded):
    """Close fingerprints by the hundred, so that with a small limit most buckets are crowded."""
    rng = random.Random(crowded)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for bit in rng.sample(range(64), rng.choice([0, 1, 1, 2, 2, 3, 4])):
                x ^= 1 << bit
            fps.add(x)
    of = {i: x for i, x in enumerate(sorted(fps))}
    classes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in of.items()], "rep long, fp long")
    found = [(r["a"], r["b"]) for r in simhash.links(classes, 3, crowded).collect()]
    true = near(of)
    assert all((of[a] ^ of[b]).bit_count() <= 3 for a, b in found)
    assert brute_components(found, list(of)) == brute_components(true, list(of))
    if crowded == 64:
        assert sorted(found) == sorted(true)


def test_exploded_probes_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Spark takes the many probes of a class for one row, so by its own choice they would all pass through the driver."""
    rng, plans, write = random.Random(9), {}, simhash.written
    rows = [(i, rng.getrandbits(63), [rng.getrandbits(63) for _ in range(simhash.TABLES)], 1, bytes(512)) for i in range(1000)]
    spark.createDataFrame(rows, "rep long, fp long, u array<long>, n long, sketch binary").write.parquet(f"{tmp_path}/classes")
    classes = spark.read.parquet(f"{tmp_path}/classes")

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(simhash, "written", seen)
    linked = seen(simhash.links(classes.select("rep", "fp")), "links")
    simhash.similar_links(classes.selectExpr("rep doc_id", "'' text"), classes, linked, 0.8)
    for name in ("links", "simhash-met"):
        joins = [x for x in plans[name].splitlines() if "Join" in x and "Inner" in x]
        assert joins and all("SortMergeJoin" in x for x in joins), plans[name]


def test_deduplicated_keeps_one_of_each_group(docs, odd):
    fps = {d: brute_fingerprint(t) for d, t in texts_of(docs)}
    want = sorted(d for d, c in brute_components(near(fps), list(fps)).items() if d == c)
    kept = simhash.deduplicated(docs, similarity=None)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want
    assert Counter(r["doc_id"] for r in simhash.deduplicated(odd).collect())[4] == 1


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))}


def test_similar_links_find_near_copies_and_nothing_else(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(3000)]
    texts = []
    for g in range(60):
        base = rng.choices(words, k=rng.randint(80, 400))
        for _ in range(4):
            t = list(base)
            for _ in range(max(1, len(t) // 80)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [" ".join(rng.choices(words, k=100)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, fps = [shingles(t) for t in texts], [brute_fingerprint(t) for t in texts]
    jaccard = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, similarity=0.8).collect()}
    groups = defaultdict(list)
    for d, c in got.items():
        groups[c].append(d)
    true = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(i, j) >= 0.8]
    assert sum(got[i] == got[j] for i, j in true) >= 0.6 * len(true) > 50
    for members in groups.values():
        assert all(any(jaccard(i, j) >= 0.7 or (fps[i] ^ fps[j]).bit_count() <= 3 for j in members if j != i) for i in members if len(members) > 1)


def test_components_of_chains_hubs_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2), (200, 201), (201, 200), (None, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    assert got == brute_components([p for p in pairs if None not in p], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_media_round_trip(docs, odd):
    for df in (docs, odd):
        want = Counter()
        for d, t in texts_of(df):
            raw = t.encode()
            p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            image = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
            n = Counter(raw.replace(b"\0", b""))
            total = sum(n.values())
            entropy = abs(sum(k / total * np.log2(total / k) for k in n.values()))
            told = f"{len(p) // 64}:{min(n, default=0)}:{sum(x * k for x, k in n.items()) / max(total, 1):.4f}:{max(n, default=0)}:{entropy:.4f}"
            want[d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(image), hashlib.sha256(image).hexdigest(), 0, f"{len(raw)} bytes", told] += 1
        got = media.payloads(df).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["position"], r["caption"], r["feature"]) for r in got) == want


def test_a_medium_that_most_pages_show(spark):
    """Hot, common, single, absent and null references, each with and without hot keys told apart."""
    from limn.llm.common import split_join

    keys = ["hot"] * 300 + ["warm"] * 20 + [f"k{i}" for i in range(50)] + ["absent"] * 5 + [None] * 30
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, digest string")
    table = spark.createDataFrame([(k, len(k)) for k in {*keys} - {None, "absent"}] + [("other", 1)], "digest string, size int")
    want = sorted((i, k, None if k in (None, "absent") else len(k)) for i, k in enumerate(keys))
    for most in (1, 2, 10, 4_096):
        assert sorted((r["id"], r["digest"], r["size"]) for r in split_join(rows, table, "digest", most).collect()) == want
    assert split_join(rows.limit(0), table, "digest").count() == 0


def test_sequences_keep_order_captions_and_unresolved_references(spark):
    html = '<title>no</title><p>first <b>words</b></p><figure><img src="digest:sha256/aa" alt="old"><figcaption>a <i>caption</i></figcaption></figure>text<img src="http://x/y.png" alt="alt"><script>x="<p>"</script><video src="digest:sha256/zz"></video><p>last</p>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "plain")], "page_id long, html string")
    kept = spark.createDataFrame([("aa", 5)], "digest string, payload_bytes long")
    got = media.resolved(media.sequences(pages), kept).orderBy("page_id", "position").collect()
    assert [(r["page_id"], r["position"], r["kind"], r["text"], r["digest"], r["caption"], r["payload_bytes"]) for r in got] == [
        (1, 0, "text", "first words", None, None, None),
        (1, 1, "media", None, "aa", "a caption", 5),
        (1, 2, "text", "text", None, None, None),
        (1, 3, "media", "http://x/y.png", None, "alt", None),
        (1, 4, "media", None, "zz", None, None),
        (1, 5, "text", "last", None, None, None),
        (4, 0, "text", "plain", None, None, None),
    ]


def test_token_counts_are_the_library_s(docs, odd):
    tok = Tokenizer.from_file(BYTE)
    for df in (docs, odd):
        want = Counter((d, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 1024) for d, t in texts_of(df))
        assert Counter(tuple(r) for r in token_counts.token_counts(df, BYTE).collect()) == want


ALPHABET = " \n\t\r\xa0 \x85\x1c\0.,'sdtmllvereéİÉÀ1²3ABz<|endoftext|>日ﬁ́"


def test_tokenizers_agree_on_odd_strings():
    rng = random.Random(5)
    counter, words = token_counts.Counter(BYTE, token_counts.whole_tokens(BYTE)), packing.WordIds(WORD)
    special = ["<|endoftext|>", "<|startoftext|>", "don't", "I'LL"]
    for _ in range(4000):
        t = "".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) + rng.choice(["", "", rng.choice(special)]) + " the Reed" * rng.randint(0, 2)
        assert counter.count(t) == len(counter.tok.encode(t, add_special_tokens=False).ids), repr(t)
        assert np.frombuffer(words.ids(t), "<u4").tolist() == words.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_only_stretches_that_may_differ_go_to_the_library(monkeypatch):
    """Greek, Cyrillic, Chinese and typographic marks take the shortcut; of a text with an unassigned letter, one stretch doesn't."""
    counter, asked = token_counts.Counter(BYTE, token_counts.whole_tokens(BYTE)), []
    library = lambda t: len(counter.tok.encode(t, add_special_tokens=False).ids)
    monkeypatch.setattr(counter, "by_library", lambda t: asked.append(t) or library(t))
    rng = random.Random(9)
    parts = ["\u201cquoted\u201d", "it\u2019s", "\u2014", "\u0391\u03b8\u03ae\u03bd\u03b1", "\u041c\u043e\u0441\u043a\u0432\u0430", "\u4e1c\u4eac", "\u3000", "\u2003x", "plain", " two", "\n", "\u00bd", "\u0661\u0662", "e\u0301"]
    for _ in range(300):
        t = rng.choice(["", " "]).join(rng.choices(parts, k=12))
        assert counter.count(t) == library(t), repr(t)
    assert not asked
    counter.alike["\u4e1c"] = False
    for _ in range(100):
        t = " ".join(rng.choices(parts, k=12))
        del asked[:]
        assert counter.count(t) == library(t), repr(t)
        assert all("\u4e1c" in x for x in asked) and len(asked) <= t.count("\u4e1c")


def test_shared_code_points_split_and_lower_alike():
    import unicodedata

    import regex

    a, b = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    pattern = regex.compile(token_counts.BYTE_LEVEL)
    for cp in range(token_counts.SHARED_CODE_POINTS):
        s = f"a{chr(cp)}1 {chr(cp)}"
        assert [o for _, o in a.pre_tokenizer.pre_tokenize_str(s)] == [m.span() for m in pattern.finditer(s)], hex(cp)
        assert b.normalizer.normalize_str(f"a{chr(cp)}a") == regex.sub(r"\s+", " ", unicodedata.normalize("NFC", f"a{chr(cp)}a")).lower(), hex(cp)


def test_whole_tokens_are_proven():
    tok, whole = Tokenizer.from_file(BYTE), token_counts.whole_tokens(BYTE)
    assert len(whole) > 45_000 and " the" in whole
    assert all(len(tok.encode(t, add_special_tokens=False).ids) == 1 for t in random.Random(1).sample(sorted(whole), 2000))


def check_packing(rows, texts, capacity=2048):
    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for d, t in texts:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.update((d, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    check_sequences(rows, capacity)


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing_rows_and_sequences(docs, odd):
    for df in (docs, odd):
        check_packing(packing.pack_documents(df, WORD).collect(), texts_of(df))
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


def test_packing_exchanges_until_certified(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in np.minimum(2048, rng.lognormal(5.5, 1, 4000).astype(int) + 1)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.packed(items, 2048, dealt=250).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    least = packing.lower_bound(np.bincount(lengths, minlength=2049))
    assert least <= check_sequences(rows, 2048) <= least + 2


def test_bounds_hold_against_the_best_packing():
    rng = random.Random(2)

    def best(lengths, room):
        if not lengths:
            return len(room)
        first, rest = lengths[0], lengths[1:]
        tries = [best(rest, [*room[:i], r - first, *room[i + 1 :]]) for i, r in enumerate(room) if r >= first]
        return min([*tries, best(rest, [*room, 20 - first])])

    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 7))), reverse=True)
        bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)
        bins, _, loads = packing.best_fit_decreasing(np.array(lengths), 20)
        assert bound <= best(lengths, []) <= len(loads) and loads.max() <= 20 and loads.sum() == sum(lengths)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in stopped]
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = {s: weight[s] * rest / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in stopped}
        stopped |= over


def test_mixing_meets_brute_force_targets(docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "text", "source").collect()
        n = Counter()
        for r in rows:
            n[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        goal = brute_targets(n)
        got = mixing.mix_report(df).collect()
        again = mixing.mix_report(df.repartition(5)).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
        assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        assert all((r["position"] is None) == (r["taken"] == 0) for r in got)
        taken = Counter()
        targets = {}
        source = {r["doc_id"]: r["source"] for r in rows}
        for r in got:
            s = source[r["doc_id"]]
            taken[s] += r["taken"]
            targets[s] = r["target"]
            assert r["source_size"] == n[s]
        assert all(abs(targets[s] - goal[s]) < 1e-6 * max(goal[s], 1) and abs(taken[s] - goal[s]) <= 0.5 + 1e-6 for s in goal)


def test_mixing_is_its_sql(spark):
    import duckdb

    from limn.llm.queries import ORACLE_SQL, op7_source_mixing

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op7_source_mixing"]).df()
    got = op7_source_mixing(spark, SF).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").to_numpy().tolist() == want.sort_values("doc_id").to_numpy().tolist() or str(got.sort_values("doc_id").to_numpy().tolist()) == str(want.sort_values("doc_id").to_numpy().tolist())


def test_mixing_limits_small_sources_and_reshares(spark):
    df = spark.createDataFrame([(1, "w " * 10, "a"), (2, "w " * 10, "b"), (3, "w " * 980, "c")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix_report(df).collect()}
    assert (got[1]["target"], got[2]["target"], got[3]["target"]) == (30.0, 30.0, 940.0)
    assert [got[i]["taken"] for i in (1, 2, 3)] == [30, 30, 940]


def test_position_inverts_the_integral():
    import pandas as pd

    curve = ((0.0, 0.5), (0.25, 2.0), (1.0, 0.0))
    area = lambda t: np.trapezoid(np.interp(np.linspace(0, t, 4001), *zip(*curve)), np.linspace(0, t, 4001))
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    shares = [0.0, 0.1, 0.3, 0.5, 0.9, 1.0]
    got = spark.createDataFrame(pd.DataFrame({"x": shares})).select("x", mixing.position(F.col("x"), curve).alias("t")).collect()
    assert all(abs(area(r["t"]) / area(1) - r["x"]) < 1e-4 for r in got)
    with pytest.raises(ValueError):
        mixing.position(F.col("x"), ((0.1, 1.0), (1.0, 1.0)))


def test_curriculum_gives_what_the_mix_takes(docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect()}
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got, text = Counter(), dict(texts_of(docs))
    for r in out.collect():
        got[r["doc_id"]] += words(r["text"])
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert got == Counter({d: n for d, n in plan.items() if n})


def brute_top(rows, every=50, k=5):
    v = {i: [int(np.floor(256 * float(x))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored, 1)]
    return out


def test_top_k_is_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows += [(10_000, rows[3][1]), (10_001, rows[3][1]), (10_050, rows[3][1]), (10_100, None), (10_150, [1.0, None]), (10_200, [float("nan")] * 64), (None, rows[0][1]), (10_250, [float("inf")] * 64), (10_300, [0.5, -0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    for options in ({}, {"shard": 97, "block": 3, "first": 20}):
        assert sorted(tuple(r) for r in topk.top_k(df, **options).collect()) == sorted(brute_top(rows))
    assert topk.top_k(df.limit(0)).count() == 0
    assert sorted(tuple(r) for r in topk.top_k(df.filter("vec_id in (0, 3)")).collect()) == sorted(brute_top([r for r in rows if r[0] in (0, 3)]))


def test_top_k_is_exact_for_any_finite_component(spark):
    """Products beyond what doubles hold, and scores beyond a long's range, which come back as its ends in their order."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.choice([0.3, 7.25, 3e9, 1e17, 1e300, 1.7e308]), rng.uniform(-1, 1), float(rng.randint(-3, 3))]) for i in range(120)]
    v = {i: topk.integers(e, 256) for i, e in rows}
    want = []
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:5]
        want += [(q, rank, c, max(min(-s, 2**63 - 1), -(2**63))) for rank, (s, c) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, shard=50, first=30).collect()) == want
    assert topk.integers([1e17, 0.1, -0.1, 1.7e308], 256) == [256 * 10**17, 25, -26, 256 * int(1.7e308)]


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [3.0, 0.0])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).collect())
    unit = 256 * 256
    assert got == sorted([(0, 1, 2, 3 * unit), (0, 2, 1, unit), (0, 1, 2, 2 * unit), (0, 2, 1, 0)])


def test_max_score_with_negative_and_tied_scores():
    rng = np.random.default_rng(1)
    for _ in range(40):
        v = rng.integers(-6, 7, (300, 7)).astype(float) * (rng.random((300, 7)) < rng.choice([0.2, 1]))
        ids = rng.permutation(300) * 5
        held = topk.Shard(ids, v)
        asked = np.array([v[0], -np.abs(v[1]), np.zeros(7)])
        want = [sorted((-s, i) for s, i in zip(v @ q, ids) if i != ids[0])[:5] for q in asked]
        for least in (np.full(3, -np.inf), np.array([-w[-1][0] for w in want])):
            got = held.best(np.full(3, ids[0]), asked, 5, least)
            assert [[(-s, i) for i, s in zip(*g)] for g in got] == want


def test_warc_round_trip(spark):
    big = "".join(random.Random(1).choices("abcé<>\r\n ", k=60_000))
    rows = [(1, "http://a/\r\nX: y", "x" * 999), (2, None, "x" * 999), (3, "u", big), (4, "u", big), (9, "u", big), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 200), (3, "u", big), (9, "u", big), (None, "u", big), (None, "v", "z" * 2000), (8, "u", "é" * 500), (10, "u", "é" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    want = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        top = max((q for q, _, g in rows if q is not None and (g or "").encode() == raw), default=None) if len(raw) >= 1000 else None
        refers = top if top is not None and top != p else None
        want[p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers] += 1
    assert Counter(tuple(r) for r in warc.round_trip(df).collect()) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_segments_must_be_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "y" * 50_000)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    found = warc.read_records(spark, str(tmp_path / "w"))
    assert found.filter("segment > 0").count() == 4
    assert warc.reassembled(found).first()["payload"] == b"y" * 50_000
    with pytest.raises(Exception, match="segments"):
        warc.reassembled(found.filter("segment != 2")).collect()


def test_a_revisit_needs_its_response(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(1, "u", "z" * 2000), (2, "u", "z" * 2000), (3, "u", "short")], "page_id long, url string, html string"), path)
    kept = warc.read_records(spark, path).filter("kind <> 'response' or page_id <> 2").collect()
    alone = [warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{r['id']}>"), ("WARC-Refers-To", f"<{r['refers']}>")], bytes(r["block"])) for r in kept if r["kind"] == "revisit"]
    assert len(alone) == 1
    (tmp_path / "broken").mkdir()
    import gzip

    (tmp_path / "broken" / "a.gz").write_bytes(gzip.compress(alone[0] + b"\r\n\r\n"))
    with pytest.raises(Exception, match="absent response"):
        warc.read_pages(spark, str(tmp_path / "broken")).collect()


def test_pages_that_the_table_of_bits_takes_for_repeats(spark, monkeypatch):
    """With few bits nearly all pages may repeat; the records are the same."""
    rows = [(i, "u", f"{i % 40}" * 1200) for i in range(120)] + [(None, "u", "5" * 1200), (7, "u", "7" * 1200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = Counter(map(tuple, warc.round_trip(df).collect()))
    monkeypatch.setattr(warc, "BITS", 64)
    assert Counter(map(tuple, warc.round_trip(df).collect())) == want
    assert sum(n for r, n in want.items() if r[3] == "revisit") == 122 - 40


def test_chunked_framing():
    for body in (b"", b"a", b"x" * 9000, b"\r\n0\r\n\r\n"):
        assert warc.dechunked(warc.chunked(body, 7)) == body
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"3"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [(i, label) for p, label in licenses.PHRASES.items() for n in [p.split()] for i in range(len(words)) if words[i : i + len(n)] == n]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_places(spark, docs, odd):
    from limn.llm.queries import op10_license_scan

    extra = ["Apache License apache-license MIT/License cc by cc BY cc", "GNU general public license", "éapache license", "gnu generel publik license", "licensed under the apachee license"]
    for t in [*(t for _, t in texts_of(docs)), *(t for _, t in texts_of(odd)), *extra]:
        got, want = licenses.scan(t.encode()), brute_license(t)
        at = [w for _, w in got["base"]]
        assert (got["n_words"], len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in got["base"]}))) == want
    rows = op10_license_scan(spark, SF).collect()
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in rows)


def test_many_notices_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        got = licenses.scan(b"Mit License \xc3\xa9 " * n)
        took.append(time.perf_counter() - began)
        assert got["n_words"] == 3 * n and got["base"] == [("mit", 3 * i) for i in range(n)]
    assert took[1] < 10 * took[0]


def brute_labels(text):
    """Labels, spans and score of a text, by trying each notice at each word with the regex library's own fuzzy search."""
    import regex

    line = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) + " "
    spans = []
    for notice, (label, k) in licenses.NOTICES.items():
        for m in regex.finditer(f"(?e)(?<= )(?:{regex.escape(notice)}){{e<={k}}}(?= )", line):
            spans.append((label, line.count(" ", 0, m.start()) - 1, m[0].count(" ") + 1, sum(m.fuzzy_counts)))
    base = [label for p, label in licenses.PHRASES.items() if f" {p} " in line]
    score = 1.0 if base else max([max(1 - e / (5.0 * n), 0.0) for _, _, n, e in spans], default=0.0)
    return ",".join(sorted({*base, *(s[0] for s in spans)})), round(score, 9), sorted(":".join(map(str, s)) for s in spans)


def test_license_query_is_brute_force(spark, docs):
    from limn.llm.queries import op10_license_scan

    texts = dict(texts_of(docs))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9), sorted(r["spans"])) for r in op10_license_scan(spark, SF).collect()}
    assert got == {d: brute_labels(t) for d, t in texts.items()} and any(x[0] for x in got.values())


def test_fuzzy_notices_are_all_found():
    rng = random.Random(4)
    for _ in range(200):
        notice, (label, k) = rng.choice(sorted(licenses.NOTICES.items()))
        s = list(notice)
        for _ in range(rng.randint(0, k)):
            i = rng.randrange(1, len(s) - 1)
            s[i : i + 1] = rng.choice([[], [s[i], "q"], ["q"]])
        text = "thnt ere " + "".join(s) + " onan"
        spans = licenses.fuzzy_spans(" " + text + " ")
        assert any(x[0] == label and x[3] <= k for x in spans), (text, spans)
    assert licenses.fuzzy_spans(" nothing of the kind is here ") == []


def accuracy(rows, labels, column):
    known = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    return sum(a == b for a, b in held) / len(held)


def test_classifiers_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    for module, column, least in ((quality, "quality", 0.97), (toxicity, "toxic", 0.93)):
        model = module.train(docs, labels)
        rows = (module.quality if module is quality else module.toxicity)(docs, model).collect()
        assert accuracy(rows, labels, column) >= least
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_toxicity_query_is_brute_force(spark, docs):
    """Each score from the model's numbers alone: n-grams, words, windows and curve, one by one."""
    from limn.llm.queries import op5_toxicity

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def word(w):
        w = "<".encode() + w.encode().strip(b".,;:!?\"'()[]{}%&#$*|") + b">"
        buckets = [zlib.crc32(w) % (1 << 17)] + [zlib.crc32(w[i : i + n], n) % (1 << 17) for n in (3, 4, 5) for i in range(len(w) - n + 1)]
        return sum(float(model.numbers[b]) for b in buckets) / len(buckets)

    def score(text):
        s = [word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]
        if len(s) < 8:
            raw = (sum(s) + (8 - len(s)) * model.usual) / 8
        else:
            parts = [s[a : a + 8] for a in range(0, len(s) - 7, 8)]
            parts[-1] = s[8 * (len(parts) - 1) :]
            means = sorted((sum(p) / len(p) for p in parts), reverse=True)[:2]
            raw = sum(means) / len(means)
        a, b = model.curve
        return 1 / (1 + np.exp(-np.clip(a * (model.bias + raw) + b, -35, 35)))

    got, texts = op5_toxicity(spark, SF).collect(), dict(texts_of(docs))
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        want = score(texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_quality_query_is_brute_force(spark, docs):
    """Each score by the sum over all pairs of features."""
    from limn.llm.queries import op6_quality

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def score(text):
        index, x = quality.Buckets().features(text.encode())
        x = model.scaled(index, x)
        products = (model.factors[index] @ model.factors[index].T) * np.outer(x, x)
        raw = model.constant + model.weights[index] @ x + np.triu(products, 1).sum()
        a, b = model.curve
        return 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))

    got, texts = op6_quality(spark, SF).collect(), dict(texts_of(docs))
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert abs(r["score"] - score(texts[r["doc_id"]])) < 1e-6 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_features_of_quality_are_counted():
    """Hashed words by the root of their count, in a vector of length 1."""
    index, x = quality.Buckets().features(b"A b a\nc")
    n = Counter(zlib.crc32(w) % quality.BUCKETS for w in (b"a", b"b", b"a", b"c"))
    assert dict(zip(index[:3].tolist(), (x[:3] ** 2 * 4).round(6).tolist())) == {k: float(v) for k, v in n.items()}


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for train, score, accepted in ((quality.train, quality.quality, quality.accepted), (toxicity.train, toxicity.toxicity, toxicity.accepted)):
        for known in (labels, labels.limit(0)):
            model = train(odd, known)
            assert score(odd, model).count() == odd.count()
            kept = accepted(odd, model)
            assert kept.columns == odd.columns and kept.count() <= odd.count()
            assert score(odd.limit(0), model).count() == 0


def test_classifiers_without_words():
    for texts in (["", ""], [" \n", "\t"]):
        model = toxicity.fit(texts, [0, 1])
        assert 0 < toxicity.Scorer(model).score(b"") < 1 and toxicity.Scorer(model).score(b"some words") == toxicity.Scorer(model).score(b"")
        index, x = quality.Buckets().features(b"")
        assert 0 <= quality.fit(texts, [0, 1]).score(index, x) <= 1


def test_misspellings_share_vectors():
    rng = random.Random(0)
    plain = ["the", "and", "thing", "reed", "onan", "stint", "lyed", "hean"]
    texts = [" ".join(rng.choices(plain, k=40)) for _ in range(120)]
    bad = [t + " moron " + t + " worthless" for t in texts]
    model = toxicity.fit(texts + bad, np.array([0] * 120 + [1] * 120))
    score = toxicity.Scorer(model).score
    assert score(b"the thing and moronn reed worthles onan") > 0.5 > score(b"the thing and reed onan")


def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    m = quality.Model()
    m.weights, m.factors = rng.normal(size=m.weights.shape), rng.normal(size=m.factors.shape)
    index, x = quality.Buckets().features(b"Some words, some MORE words!!\nSome lines")
    x = m.scaled(index, x)
    pairs = sum(m.factors[index[i]] @ m.factors[index[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert abs(m.raw(index, x) - (m.constant + m.weights[index] @ x + pairs)) < 1e-8


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for made in (simhash.near_duplicates(none), media.payloads(none), token_counts.token_counts(none, BYTE), mixing.mix_report(none), mixing.curriculum(none), licenses.license_spans(none), simhash.deduplicated(none)):
        assert made.count() == 0
