"""The pipeline's stages against brute-force versions of each."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from limn.llm import mixing, quality, toxicity
from tests.llm.test_operators import SF, brute_components, brute_fingerprint, brute_targets, check_packing, near, shingles


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before, after = docs.collect(), out.collect()
        if k == 0:
            score = toxicity.Scorer(toxicity.train(docs, labels)).score
            want = [r for r in before if score(r["text"].encode()) < toxicity.THRESHOLD]
        elif k == 1:
            model, features = quality.train(docs, labels), quality.Buckets().features
            want = [r for r in before if model.score(*features(r["text"].encode())) >= quality.THRESHOLD]
        elif k == 2:
            fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before}
            sets = {r["doc_id"]: shingles(r["text"]) for r in before}
            alike = [(a, b) for a in fps for b in fps if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])]
            near_ones, most = near(fps), brute_components(near(fps) + alike, list(fps))
            least = brute_components(near_ones, list(fps))
            assert Counter(after) <= Counter(r for r in before if least[r["doc_id"]] == r["doc_id"])
            assert {r["doc_id"] for r in after} >= {d for d, c in most.items() if d == c}
        if k < 2:
            assert Counter(after) == Counter(want)
        if k < 4:
            assert out.dtypes == docs.dtypes and after
        if k == 3:
            size, largest, got = Counter(), Counter(), Counter()
            for r in before:
                size[r["source"]] += words(r["text"])
                largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
            for r in after:
                got[r["source"]] += words(r["text"])
            assert all(abs(got[s] - t) <= largest[s] / 2 + 1 for s, t in brute_targets(size).items())
            assert set(after) <= set(before) and max(Counter(r["doc_id"] for r in after).values()) <= 3
        if k == 4:
            check_packing(after, [(r["doc_id"], r["text"]) for r in before])
        docs = spark.createDataFrame(after, out.schema)
    pieces = lambda rows: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert pieces(corpus_pipeline.run(spark, SF).collect()) == pieces(after)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


ODD = {
    "odd": [(i, t, "en", "ab"[i % 2] if i % 3 else None, 7) for i, t in enumerate([None, "", " \n", "one", "one two three four five six", "one two three four five six", "w " * 30_000, "\u4e1c\u4eac \u00e9 <|endoftext|>"])] + [(3, "one", "en", None, 7), (None, "one", None, "b", None)],
    "nulls": [(i, None, None, None, None) for i in range(5)],
    "empty": [],
}


@pytest.mark.parametrize("kind", sorted(ODD))
def test_run_on_odd_tables(spark, tmp_path, kind):
    """Nulls in any column, empty and long texts, repeated rows, no rows, and other columns named like what stages make."""
    docs = spark.createDataFrame(ODD[kind], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("score", "component_id", "fp", "size", "position", "item", "row", "take")
    docs.withColumns({c: F.lit("clash") for c in clashing}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r[0] for r in ODD[kind] if words(r[1])}
    assert {r["doc_id"] for r in rows} <= ids and all(r["length"] <= 2048 for r in rows)


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert all(any(n.startswith(f"op{i}_") for n in __spark_entry__.queries()) for i in range(1, 11))


def test_mixed_keeps_texts_whole(spark):
    """Ten documents of 100 words a source: targets end within documents, of which some are nearer whole and some left out."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(100)), "en", "abcde"[i % 5], 0) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    before = {r["doc_id"]: r for r in docs.collect()}
    got = corpus_pipeline.mixed(spark, docs, SF).collect()
    assert all(r == before[r["doc_id"]] for r in got)
    source, target, plan = {d: r["source"] for d, r in before.items()}, {}, mixing.mix_report(docs).collect()
    for r in plan:
        target[source[r["doc_id"]]] = r["target"]
    words = Counter(source[r["doc_id"]] for r in got)
    assert any(r["taken"] % 100 for r in plan)
    assert all(abs(100 * words[s] - t) <= 51 for s, t in target.items())
