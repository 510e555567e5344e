"""The catalogue of queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limn.functions import imaging, preamble, rounding, text
from limn.operators import annotation, filters, geometry, layout, sampling, textmetrics, vectors
from limn.plans import fixtures, pipelines
from limn.plans.fixtures import table
from limn.providers import RuleCompiler
from limn.sources import with_row_id

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("orig_id"), F.col("text").alias("code"), "source")


_BLACK = "(" + " OR ".join(f"contains(lower(coalesce({{0}}, '')), '{k.lower()}')" for k in filters.BLACKLIST) + ")"
_TOKENS = r"CAST(len(regexp_extract_all(coalesce(text, ''), '\S+')) AS BIGINT)"
_BIN = "CASE " + " ".join(f"WHEN n_tokens >= {a} AND n_tokens < {b} THEN {i}" for i, (a, b) in enumerate(sampling.BINS)) + " END"
_BINNED = f"t AS (SELECT doc_id, {_TOKENS} AS n_tokens FROM documents WHERE NOT {_BLACK.format('text')}), b AS (SELECT *, {_BIN} AS bin FROM t)"
_AXIS_CODE = r"""c AS (SELECT l_partkey * 4 + strpos('ANR', l_returnflag) AS orig_id,
    '\begin{axis}' || chr(10) || '\addplot coordinates {' || array_to_string(list_sort(list('(' || CAST(l_quantity AS INT) || ',' || l_linenumber || ')')), ' ') || '};' || chr(10) || '\end{axis}' AS code
    FROM lineitem GROUP BY l_partkey, l_returnflag)"""
_POINTS = rf"len(regexp_extract_all({{0}}, '{filters.POINT}'))"
_COUNT = rf"CASE WHEN {_POINTS} > 0 THEN {_POINTS} ELSE len(regexp_extract_all({{0}}, '{filters.TABLE_LINE}')) END"


def _series_sql(of: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({of}, '{pattern}', 1), lambda s: {_COUNT.format('s')})"


_DENSE = f"""(len(list_filter(regexp_extract_all(code, '{filters.AXIS}'), lambda a:
        len(list_filter(list_concat({_series_sql('a', filters.COORDINATES)}, {_series_sql('a', filters.TABLE)}), lambda n: n > 16)) > 0
        OR coalesce(list_sum(list_concat({_series_sql('a', filters.COORDINATES)}, {_series_sql('a', filters.TABLE)})), 0) > 96)) > 0
    OR len(list_filter({_series_sql('code', filters.PLOT)}, lambda n: n > 16)) > 0)"""


@query(f"SELECT doc_id FROM documents WHERE NOT {_BLACK.format('text')}")
def blacklist_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(~filters.blacklisted(F.col("text"))).select("doc_id")


@query(f"WITH {_AXIS_CODE} SELECT orig_id, {_DENSE} AS dense FROM c")
def density_filter(spark, sf_dir):
    return fixtures.axis_code(spark, sf_dir).select("orig_id", filters.too_dense(F.col("code")).alias("dense"))


@query(f"""WITH {_AXIS_CODE}, a AS (SELECT code FROM c UNION ALL SELECT text FROM documents)
    SELECT CASE WHEN {_BLACK.format('code')} THEN 'blacklist' WHEN {_DENSE} THEN 'density' ELSE 'kept' END AS reason, count(*) AS n FROM a GROUP BY 1""")
def filter_reason_counts(spark, sf_dir):
    both = fixtures.axis_code(spark, sf_dir).select("code").unionByName(_docs(spark, sf_dir).select("code"))
    return filters.stage_counts(filters.tagged(both))


_LOG = "CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 8 END"


@query(f"""WITH l AS (SELECT event_id, {_LOG} AS k FROM events)
    SELECT event_id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'pgfplots_warning' WHEN 2 THEN 'tikz_warning' WHEN 3 THEN 'overfull' WHEN 4 THEN 'latex_error'
        WHEN 5 THEN 'package_error' WHEN 6 THEN 'undefined' ELSE 'missing,emergency' END AS findings, k = 0 AS clean FROM l""")
def log_scan(spark, sf_dir):
    return fixtures.logs(spark, sf_dir).select("event_id", F.array_join(filters.log_findings(F.col("log")), ",").alias("findings"), filters.clean_log(F.col("log")).alias("clean"))


#: For each family of findings: a line that belongs to it, with %s for one of its phrases, the phrases, and a line like it that doesn't.
_LINES = {
    "pgfplots_warning": ("Package pgfplots Warning: it is %s.", ("out of range", "Out Of Bounds", "clipped", "dropped", "discarded"), "Package pgfplots Warning: running in old mode"),
    "tikz_warning": ("package tikz warning: %s", ("outside", "dimension too large", "overflow", "OUT of range", "discarded"), "Package tikz Warning: library loaded twice"),
    "overfull": ("%s in paragraph", ("Overfull hbox", "overfull vbox"), "Underfull hbox in paragraph"),
    "latex_error": ("! LaTeX Error: %s", ("missing file", "bad option"), "! latex error: in lower case"),
    "package_error": ("! Package %s Error: stop", ("xcolor", "pgfkeys", "tikz"), "Package xcolor Error: without its mark"),
    "undefined": ("! Undefined %s", ("control sequence",), "! Undefined colour"),
    "missing": ("! Missing %s", ("$ inserted", "number"), "! Missing: nothing"),
    "emergency": ("! Emergency %s", ("stop.",), "! Emergency stop"),
}


@query("SELECT event_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN (event_id >> {i}) & 1 = 1 THEN '{name}' END" for i, name in enumerate(_LINES)) + """], lambda x: x IS NOT NULL), ',') AS findings,
    event_id & 255 = 0 AS clean FROM events""")
def log_families(spark, sf_dir):
    """Logs of eight lines, each of its family or only like it, in all 256 combinations and with each family's phrases in turn."""
    turn = F.floor(F.col("event_id") / 256)
    lines = []
    for i, (line, phrases, other) in enumerate(_LINES.values()):
        hits = F.array(*(F.lit(line % x) for x in phrases))
        hit = F.element_at(hits, (turn % len(phrases) + 1).cast("int"))
        lines.append(F.when(F.shiftright("event_id", i).bitwiseAND(1) == 1, hit).otherwise(other))
    logs = table(spark, sf_dir, "events").select("event_id", F.concat_ws("\n", *lines).alias("log"))
    return logs.select("event_id", F.array_join(filters.log_findings(F.col("log")), ",").alias("findings"), filters.clean_log(F.col("log")).alias("clean"))


@query(f"SELECT doc_id, CASE WHEN {_BLACK.format('text')} THEN 'dump' ELSE 'keep' END AS status FROM documents")
def keep_dump_split(spark, sf_dir):
    tagged = filters.tagged(_docs(spark, sf_dir))
    return tagged.select(F.col("orig_id").alias("doc_id"), F.when(F.col("reason").isNull(), "keep").otherwise("dump").alias("status"))


@query(f"WITH s AS (SELECT CASE WHEN {_BLACK.format('text')} THEN 'dump' ELSE 'keep' END AS status FROM documents) SELECT status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM s), 2) AS percent FROM s GROUP BY status")
def stage_summary(spark, sf_dir):
    from limn.sources.sinks import summary

    return summary(keep_dump_split(spark, sf_dir), "status")


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS n_tokens FROM documents) SELECT doc_id, n_tokens, {_BIN} AS bin FROM t")
def token_bins(spark, sf_dir):
    return sampling.token_bins(_docs(spark, sf_dir)).select(F.col("orig_id").alias("doc_id"), "n_tokens", "bin")


def _stratified(spark, sf_dir, strategy, n):
    kept = _docs(spark, sf_dir).filter(~filters.blacklisted(F.col("code")))
    return sampling.stratified(kept, n, strategy=strategy).select(F.col("orig_id").alias("doc_id"), "bin", "n_tokens", "rn")


@query(f"WITH {_BINNED}, r AS (SELECT doc_id, bin, n_tokens, row_number() OVER (PARTITION BY bin ORDER BY doc_id) AS rn FROM b WHERE bin IS NOT NULL) SELECT * FROM r WHERE rn <= 20")
def stratified_first(spark, sf_dir):
    return _stratified(spark, sf_dir, "first", 20)


@query(f"WITH {_BINNED}, r AS (SELECT doc_id, bin, n_tokens, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM b WHERE bin IS NOT NULL) SELECT * FROM r WHERE rn <= 20")
def stratified_random(spark, sf_dir):
    return _stratified(spark, sf_dir, "random", 20)


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark, sf_dir):
    return sampling.first_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), 50, "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS orig_id FROM documents")
def row_ids(spark, sf_dir):
    return with_row_id(table(spark, sf_dir, "documents").select("doc_id", "source"), order=["source", "doc_id"]).select("doc_id", "orig_id")


_REPLY = r"""r AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```latex' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done'
    WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 2 THEN '<think> so </think> <answer>' || text || '</answer>' ELSE text END AS response
    FROM conversations WHERE role = 'assistant')"""
_STRIP = r"regexp_replace({0}, '\A\s+|\s+\z', '', 'g')"


@query(rf"""WITH {_REPLY}, m AS (SELECT *, regexp_matches(response, '(?s)```[^\n`]*\n(.*?)```') AS found, {_STRIP.format("regexp_extract(response, '(?s)```[^\n`]*\n(.*?)```', 1)")} AS code FROM r)
    SELECT conv_id, turn, CASE WHEN found THEN response ELSE {_STRIP.format('response')} END AS thinking, CASE WHEN found AND code <> '' THEN code END AS code FROM m""")
def fence_extract(spark, sf_dir):
    return fixtures.replies(spark, sf_dir).select("conv_id", "turn", text.fence_split(F.col("response")).alias("p")).select("conv_id", "turn", "p.thinking", "p.code")


@query(rf"""WITH {_REPLY} SELECT conv_id, turn, CASE WHEN response LIKE '%```latex%' THEN {_STRIP.format(r"regexp_extract(response, '(?s)```latex\s*(.*?)\s*```', 1)")}
    WHEN response LIKE '%```%```%' THEN {_STRIP.format(r"regexp_extract(response, '(?s)```\s*(.*?)\s*```', 1)")}
    WHEN response LIKE '%<answer>%' THEN {_STRIP.format("regexp_extract(response, '(?s)<answer>(.*?)</answer>', 1)")} ELSE response END AS code FROM r""")
def response_extract(spark, sf_dir):
    return fixtures.replies(spark, sf_dir).select("conv_id", "turn", text.extract_code(F.col("response")).alias("code"))


@query(rf"""WITH {_REPLY}, u AS (SELECT *, {_STRIP.format('response')} AS t FROM r), o AS (SELECT *, CASE WHEN t LIKE '```latex%' THEN regexp_replace(t, '\A```latex[\n\r]*', '') WHEN t LIKE '```%' THEN regexp_replace(t, '\A```[\n\r]*', '') ELSE t END AS x FROM u)
    SELECT conv_id, turn, {_STRIP.format("CASE WHEN x LIKE '%```' THEN left(x, -3) ELSE x END")} AS code FROM o""")
def fence_unwrap(spark, sf_dir):
    return fixtures.replies(spark, sf_dir).select("conv_id", "turn", text.unwrap_fence(F.col("response")).alias("code"))


@query(rf"""WITH {_REPLY}, s AS (SELECT conv_id, turn, regexp_replace(response, '\s*([<>/])\s*', '\1', 'g') AS q FROM r)
    SELECT conv_id, turn, md5(q) AS squeezed, CASE WHEN regexp_full_match(q, '(?s)<think>.*?</think>\s*<answer>.*?</answer>') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS format FROM s""")
def format_check(spark, sf_dir):
    q = text.squeeze_tags(F.col("response"))
    return fixtures.replies(spark, sf_dir).select("conv_id", "turn", F.md5(q.cast("binary")).alias("squeezed"), text.format_score(q).alias("format"))


_WRAPPED = r"(chr(9) || '  ' || text || chr(10) || chr(10) || chr(10) || chr(10) || 'end ' || chr(10))"


@query(rf"""SELECT doc_id, md5({_STRIP.format(_WRAPPED)}) AS stripped, md5(regexp_replace({_WRAPPED}, '\n{{3,}}', chr(10) || chr(10), 'g')) AS collapsed FROM documents""")
def strip_and_collapse(spark, sf_dir):
    wrapped = F.concat(F.lit("\t  "), F.col("text"), F.lit("\n\n\n\nend \n"))
    md5 = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", md5(text.strip(wrapped)).alias("stripped"), md5(text.collapse_blank_lines(wrapped)).alias("collapsed"))


@query(r"""SELECT doc_id, md5(CASE WHEN strpos(text, chr(10)) > 0 THEN left(text, strpos(text, chr(10))) || '\pagestyle{empty}' || substr(text, strpos(text, chr(10))) ELSE text || chr(10) || '\pagestyle{empty}' END) AS styled,
    md5('Go' || chr(10) || chr(10) || '```latex' || chr(10) || text || chr(10) || '```') AS prompt, md5(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')) AS rot13 FROM documents""")
def page_style_and_prompt(spark, sf_dir):
    md5 = lambda c: F.md5(c.cast("binary"))
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", md5(text.inject_page_style(t, r"\pagestyle{empty}")).alias("styled"), md5(text.user_prompt(t, "Go")).alias("prompt"), md5(text.rot13(t)).alias("rot13"))


@query("SELECT doc_id, md5(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')) AS rot13 FROM documents")
def rot13_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.rot13(F.col("text")).cast("binary")).alias("rot13"))


@query("SELECT doc_id, substr(sha1(text), 1, 8) || '_f' || doc_id || '.png' AS name, md5(text) AS decoded, '/out/' || source || '/f' || doc_id || '.tex' AS path FROM documents")
def hashes_and_paths(spark, sf_dir):
    data, name = F.col("text").cast("binary"), F.concat(F.lit("/in/"), F.col("source"), F.lit("/f"), F.col("doc_id"))
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64(data))
    return table(spark, sf_dir, "documents").select("doc_id", text.content_name(data, F.concat(name, F.lit(".png"))).alias("name"), F.md5(text.data_uri_bytes(uri)).alias("decoded"), text.output_path(F.concat(F.lit("file://"), name, F.lit(".tex")), "/in", "/out").alias("path"))


_LABEL = "CASE WHEN event_id % 7 = 0 THEN 'mixed' ELSE event_type END"


@query(f"SELECT {_LABEL} AS label, count(*) AS count FROM events GROUP BY 1")
def label_histogram(spark, sf_dir):
    return annotation.label_histogram(fixtures.label_replies(spark, sf_dir))


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 7 <> 0) AS parsed_ok, count(*) FILTER (event_id % 7 = 0) AS fallback FROM events")
def parse_counters(spark, sf_dir):
    return annotation.parse_counters(fixtures.label_replies(spark, sf_dir))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 6 AS INTEGER) END AS score FROM events")
def rating_scores(spark, sf_dir):
    raw = F.concat(F.lit("Weaknesses: Score: 1 of it\nOverall\nScore: "), F.col("event_id") % 6)
    bare = F.when(F.col("event_id") % 6 == 0, F.lit("no rating")).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", annotation.rating(bare).alias("score"))


@query("SELECT conv_id * 1000 + turn AS index FROM conversations WHERE turn % 2 = 1")
def resume_antijoin(spark, sf_dir):
    all_rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), "turn")
    return annotation.remaining(all_rows, all_rows.filter("turn % 2 = 0"), "index").select("index")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_first(spark, sf_dir):
    return sampling.dedupe_first(table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id").select("doc_id")


@query("SELECT sha1(text) AS sha1, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def hash_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("sha1")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT a.p_partkey AS k, lower(trim(a.p_type)) AS s, lower(trim(b.p_type)) AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    l AS (SELECT *, length(s) AS n, length(t) AS m FROM p),
    d AS (SELECT *, CASE WHEN n = 1 AND m = 1 THEN 0 ELSE least(CASE WHEN least(n, m) <= 3 THEN 1 WHEN (n + m) / 2.0 <= 10 THEN greatest(1, floor((n + m) / 2.0 * 0.2)) ELSE greatest(2, least(5, floor((n + m) / 2.0 * 0.15))) END, greatest(1, floor(least(n, m) / 2.0))) END AS a FROM l),
    r AS (SELECT *, n > 0 AND m > 0 AND (s = t OR (abs(n - m) <= a AND levenshtein(s, t) <= a)) AS near FROM d)
    SELECT k AS p_partkey, near AS "similar", s = t AND n > 0 AS exact, CAST(CASE WHEN near THEN levenshtein(s, t) END AS INTEGER) AS distance FROM r""")
def levenshtein_similarity(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("other"))
    return a.join(b, "p_partkey").select("p_partkey", layout.similar_text(F.col("p_type"), F.col("other")).alias("s")).select("p_partkey", "s.*")


_WORDS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '\s+'), lambda w: w <> '')"


def _grams(source: str, tokens: str) -> str:
    return " UNION ALL ".join(f"SELECT key, {n} AS n, unnest(list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))) AS gram FROM {source}" for n in range(1, 5))


@query(f"""WITH w AS (SELECT doc_id AS key, {_WORDS.format('text')} AS t FROM documents), g AS ({_grams('w', 't')})
    SELECT n, gram, count(*) AS k FROM g GROUP BY n, gram ORDER BY k DESC, n, gram LIMIT 500""")
def ngram_topk(spark, sf_dir):
    return spark.createDataFrame(textmetrics.frequent_ngrams(fixtures.spread(table(spark, sf_dir, "documents").select("text")), textmetrics.whitespace_words(F.col("text"))), "n int, gram string, k long")


_TURNS = "c AS (SELECT a.conv_id * 1000 + a.turn AS key, b.text AS p, a.text AS r FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1)"


@query(f"""WITH {_TURNS}, w AS (SELECT key, {_WORDS.format('p')} AS p, {_WORDS.format('r')} AS r FROM c),
    gp AS (SELECT key, n, gram, count(*) AS k FROM ({_grams('w', 'p')}) GROUP BY ALL), gr AS (SELECT key, n, gram, count(*) AS k FROM ({_grams('w', 'r')}) GROUP BY ALL),
    t AS (SELECT n, gram FROM (SELECT n, gram, sum(k) AS k FROM gr GROUP BY ALL) ORDER BY k DESC, n, gram LIMIT 500),
    o AS (SELECT n, sum(least(gp.k, coalesce(gr.k, 0))) AS m, sum(gp.k) AS a FROM gp ANTI JOIN t USING (n, gram) LEFT JOIN gr USING (key, n, gram) GROUP BY n),
    l AS (SELECT sum(len(p)) AS lp, sum(len(r)) AS lr FROM w),
    x AS (SELECT lp, lr, CASE WHEN lp = 0 THEN 0.0 WHEN lp > lr THEN 1.0 ELSE exp(1 - lr / lp) END AS bp, (SELECT CASE WHEN min(m) > 0 AND count(*) = 4 THEN exp(sum(ln(m / a)) / 4) ELSE 0 END FROM o) AS q FROM l)
    SELECT CAST(lp AS BIGINT) AS predicted_length, CAST(lr AS BIGINT) AS reference_length, round(bp, 6) AS brevity_penalty, round(coalesce(100 * bp * q, 0), 6) AS bleu FROM x""")
def crystal_bleu(spark, sf_dir):
    words = lambda c: textmetrics.whitespace_words(F.col(c))
    one = textmetrics.corpus_bleu(fixtures.turns(spark, sf_dir), "index", words("predicted"), words("ground_truth"))
    return one.select("predicted_length", "reference_length", F.round("brevity_penalty", 6).alias("brevity_penalty"), F.round("bleu", 6).alias("bleu"))


@query()
def edit_distance(spark, sf_dir):
    pairs = fixtures.spread(fixtures.turns(spark, sf_dir))
    return pairs.select("index", F.round(textmetrics.tex_edit_distance("predicted", "ground_truth"), 6).alias("distance"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("""WITH m AS (SELECT label, list(s ORDER BY i) AS mean FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS s FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)
    SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS similarity FROM embeddings JOIN m USING (label)""")
def label_mean_cosine(spark, sf_dir):
    found = vectors.mean_vector_cosine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 64)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("""WITH v AS (SELECT vec_id, label < 5 AS u, embedding::DOUBLE[] AS e FROM embeddings),
    k AS (SELECT a.u AS x, b.u AS y, sum((list_dot_product(a.e, b.e) / 64 + 1) ** 3) AS s, count(*) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY a.u, b.u),
    n AS (SELECT count(*) FILTER (u) AS n, count(*) FILTER (NOT u) AS m FROM v)
    SELECT n, m, round((SELECT s / c FROM k WHERE x AND y) + (SELECT s / c FROM k WHERE NOT x AND NOT y) - 2 * (SELECT s / c FROM k WHERE x AND NOT y), 8) AS mmd2 FROM n""")
def kernel_distance(spark, sf_dir):
    return vectors.kernel_distance(table(spark, sf_dir, "embeddings"), "embedding", F.col("label") < 5, 64).withColumn("mmd2", F.round("mmd2", 8))


_P = "struct_pack(x0 := l_partkey % 300, y0 := l_suppkey % 300, x1 := l_partkey % 300 + q + 5, y1 := l_suppkey % 300 + l_linenumber * 3 + 4)"
_R = "struct_pack(x0 := (l_partkey + l_linenumber) % 300, y0 := (l_suppkey + 3) % 300, x1 := (l_partkey + l_linenumber) % 300 + q + 6, y1 := (l_suppkey + 3) % 300 + l_linenumber * 3 + 2)"


@query(f"""WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, {_P} AS a, {_R} AS b FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem)),
    m AS (SELECT *, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s,
        (a.x0 + a.x1 - b.x0 - b.x1) * (a.x0 + a.x1 - b.x0 - b.x1) / 4.0 + (a.y0 + a.y1 - b.y0 - b.y1) * (a.y0 + a.y1 - b.y0 - b.y1) / 4.0 AS c,
        (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.x1, b.x1) - least(a.x0, b.x0)) + (greatest(a.y1, b.y1) - least(a.y0, b.y0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) AS g FROM b)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, round(greatest(least(i / (s - i)::DOUBLE - least(c::DOUBLE / g::DOUBLE, 2.0), 1.0), -1.0), 6) AS diou FROM m""")
def diou_pairs(spark, sf_dir):
    return fixtures.line_boxes(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q", F.round(layout.diou(F.col("predicted"), F.col("reference")), 6).alias("diou"))


@query("""WITH b AS (SELECT l_orderkey, l_partkey, l_linenumber, l_partkey % 300 AS x0, l_suppkey % 300 AS y0, l_partkey % 300 + CAST(l_quantity AS INT) + 5 AS x1, l_suppkey % 300 + l_linenumber * 3 + 4 AS y1 FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber, round(least(greatest(x0 * 384.0 / 800, 0), 384), 6)::DOUBLE AS x0, round(least(greatest(y0 * 384.0 / 800 + 48, 0), 384), 6)::DOUBLE AS y0, round(least(greatest(x1 * 384.0 / 800, 0), 384), 6)::DOUBLE AS x1, round(least(greatest(y1 * 384.0 / 800 + 48, 0), 384), 6)::DOUBLE AS y1 FROM b""")
def box_normalisation(spark, sf_dir):
    placed = layout.normalised_box(F.col("predicted"), F.lit(800.0), F.lit(600.0))
    return fixtures.line_boxes(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", placed.alias("b")).select("l_orderkey", "l_partkey", "l_linenumber", *(F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query()
def text_layout_match(spark, sf_dir):
    b = fixtures.spread(fixtures.order_boxes(spark, sf_dir))
    return b.select("l_orderkey", F.round(layout.text_layout_score("predicted", "reference"), 6).alias("score"), F.size(layout.matched_boxes("predicted", "reference")).alias("matches"))


def _elements(spark, sf_dir) -> DataFrame:
    """(l_orderkey, predicted, reference): lines and rectangles made from an order's boxes."""
    make = lambda boxes, shift: F.transform(boxes, lambda b, i: F.when(i % 2 == 0, geometry.line_element(b["x0"], b["y0"], b["x1"] + shift, b["y1"])).otherwise(geometry.rectangle_element(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"])))
    return fixtures.spread(fixtures.order_boxes(spark, sf_dir)).select("l_orderkey", make(F.col("predicted"), 0.0).alias("predicted"), make(F.col("reference"), 2.0).alias("reference"))


@query()
def geometry_match(spark, sf_dir):
    found = _elements(spark, sf_dir).select("l_orderkey", geometry.geometry_match("predicted", "reference").alias("m"))
    return found.select("l_orderkey", F.round("m.overall", 6).alias("overall"), F.size("m.counts").alias("types"))


@query(f"""WITH b AS (SELECT l_orderkey, {_P} AS a FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem))
    SELECT l_orderkey, round(greatest(sqrt((max(a.x1) - min(a.x0)) ** 2 + (max(a.y1) - min(a.y0)) ** 2), 1), 6) AS diagonal FROM b GROUP BY l_orderkey""")
def canvas_diagonal(spark, sf_dir):
    return _elements(spark, sf_dir).select("l_orderkey", F.round(geometry.canvas_diagonal(F.col("predicted")), 6).alias("diagonal"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT 'line' AS type, sum((n + 1) // 2) AS n FROM c UNION ALL SELECT 'rectangle', sum(n // 2) FROM c) SELECT type, CAST(n AS BIGINT) AS n FROM t""")
def type_counts(spark, sf_dir):
    return _elements(spark, sf_dir).select(F.explode("predicted").alias("e")).groupBy("e.type").agg(F.count("*").alias("n"))


_SCORE = "(l_partkey % 101) / 100.0"


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(0.5 * ((CASE WHEN l_returnflag = 'R' THEN -1 ELSE {_SCORE} END) + CASE WHEN l_returnflag = 'R' THEN 0 ELSE (l_suppkey % 11) / 10.0 + coalesce(CASE WHEN l_linenumber < 4 THEN l_linenumber / 4.0 END, 0) END), 6)::DOUBLE AS overall FROM lineitem""")
def reward_combine(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ok = F.col("l_returnflag") != "R"
    parts = {"pixel": F.when(ok, F.col("l_partkey") % 101 / 100).otherwise(-1.0), "perceptual": F.when(ok, F.col("l_suppkey") % 11 / 10), "layout": F.when(ok & (F.col("l_linenumber") < 4), F.col("l_linenumber") / 4), "format": F.lit(1.0), "compile": ok.cast("double")}
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(pipelines.reward(parts), 6).alias("overall"))


@query("""SELECT coalesce(a.f, b.f) AS filename, a.v AS ssim, b.v AS psnr FROM (SELECT 'f' || doc_id AS f, n_chars % 100 AS v FROM documents) a
    FULL JOIN (SELECT 'f' || doc_id AS f, quality AS v FROM labels) b ON a.f = b.f""")
def metric_merge_all(spark, sf_dir):
    of = lambda name, value: table(spark, sf_dir, name).select(F.concat(F.lit("f"), F.col("doc_id")).alias("filename"), value)
    return pipelines.merged_metrics([of("documents", (F.col("n_chars") % 100).alias("ssim")), of("labels", F.col("quality").alias("psnr"))])


@query("SELECT 'f' || doc_id AS filename, max(ssim) AS ssim, max(psnr) AS psnr FROM (SELECT doc_id, n_chars % 100 AS ssim, NULL AS psnr FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels) GROUP BY 1")
def metric_pivot_all(spark, sf_dir):
    of = lambda name, metric, value: table(spark, sf_dir, name).select(F.concat(F.lit("f"), F.col("doc_id")).alias("filename"), F.lit(metric).alias("metric"), value.cast("long").alias("value"))
    return pipelines.long_metrics(of("documents", "ssim", F.col("n_chars") % 100).unionByName(of("labels", "psnr", F.col("quality"))), ["ssim", "psnr"])


@query("SELECT (SELECT count(*) FROM labels) || '/' || (SELECT count(*) FROM documents) AS coverage")
def coverage_string(spark, sf_dir):
    n = lambda name, c: table(spark, sf_dir, name).agg(F.count("*").alias(c))
    return n("labels", "a").join(F.broadcast(n("documents", "b"))).select(pipelines.coverage(F.col("a"), F.col("b")).alias("coverage"))


_WHOLE, _FRAC = "1000 + l_orderkey % 90000", "(l_orderkey * 37 + l_linenumber * 91 + l_partkey * 500) % 1000"


@query(f"""WITH n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT) AS q, {_WHOLE} AS w, {_FRAC} AS f FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, (w + CASE WHEN f > 500 OR (f = 500 AND w % 2 = 1) THEN 1 ELSE 0 END) || '.000' AS rounded FROM n""")
def round_literals(spark, sf_dir):
    literal = F.concat(F.expr(_WHOLE).cast("string"), F.lit("."), F.lpad(F.expr(_FRAC).cast("string"), 3, "0"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), rounding.rounded_literal(literal).alias("rounded"))


@query(rf"""WITH {_AXIS_CODE} SELECT orig_id, md5(replace(code, '}};', '}} [scale=1.2350, pos=.5, name=1.23456];')) AS rounded FROM c""")
def round_code(spark, sf_dir):
    code = F.replace(F.col("code"), F.lit("};"), F.lit("} [scale=1.2346, pos=.5, name=1.23456];"))
    return fixtures.axis_code(spark, sf_dir).select("orig_id", F.md5(rounding.rounded(code).cast("binary")).alias("rounded"))


#: Spans whose literals are rounded, marked @A and @B, and others whose literals stay, marked @a and @b.
_SPANS = r"""\definecolor{c}{rgb}{@A, @B}
\begin{axis}
\addplot coordinates {(@A,-@B) (@B,@A)};
\addplot table {x y
@A @B
};
\end{axis}
\node at (@A, @B) {@a};
\draw (@A,@B,@A) (@a,@b,@a,@b) node (@a) [scale=@A, name=@a, xshift=-@B, width=@b];"""
_LINE_NUMBERS = {"a": "10000 + (l_orderkey * 7919 + l_linenumber * 4729 + l_partkey * 31) % 90000", "b": "100000 + (l_suppkey * 6151 + l_orderkey * 409 + l_linenumber * 77) % 900000"}


@query(f"""WITH n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT) AS q, {_LINE_NUMBERS["a"]} AS x, {_LINE_NUMBERS["b"]} AS y FROM lineitem),
    m AS (SELECT *, CASE WHEN x % 10 = 5 THEN x + 1 ELSE x END AS a, CASE WHEN y % 100 = 50 THEN y + 1 ELSE y END AS b FROM n),
    r AS (SELECT *, (a + 5) // 10 * 10 AS a1, (b + 50) // 100 * 100 AS b1 FROM m)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, md5(replace(replace(replace(replace('{_SPANS}',
        {", ".join(f"'@{mark}', {v} // 10000 || '.' || lpad(CAST({v} % 10000 AS VARCHAR), 4, '0'))" for mark, v in (("A", "a1"), ("B", "b1"), ("a", "a"), ("b", "b")))}) AS rounded FROM r""")
def round_spans(spark, sf_dir):
    """Colours, coordinates, tables, tuples and options, each with numbers of five and of six figures; none is a tie."""
    a, b = (F.expr(_LINE_NUMBERS[k]) for k in "ab")
    a, b = F.when(a % 10 == 5, a + 1).otherwise(a), F.when(b % 100 == 50, b + 1).otherwise(b)
    literal = lambda n: F.concat(F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))
    code = F.lit(_SPANS)
    for mark, n in (("@A", a), ("@B", b), ("@a", a), ("@b", b)):
        code = F.replace(code, F.lit(mark), literal(n))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.md5(rounding.rounded(code).cast("binary")).alias("rounded"))


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part)
    SELECT 'p' || p_partkey || '.tex' AS path, array_to_string(list_concat(list_filter(w, lambda x, i: list_position(w, x) = i), list_filter(['tikz', 'amsmath'], lambda x: NOT list_contains(w, x))), ',') AS packages,
        array_to_string(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: 'lib' || x), ',') AS libraries FROM w""")
def preamble_extract(spark, sf_dir):
    found = F.udf(lambda c: [",".join(x) for x in preamble.packages_and_libraries(c)], "array<string>", useArrow=True)
    return fixtures.spread(fixtures.preambles(spark, sf_dir)).select("path", found("source").alias("f")).select("path", F.col("f")[0].alias("packages"), F.col("f")[1].alias("libraries"))


_REMOVED = """WITH w AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part),
    p AS (SELECT p_partkey, list_concat(list_concat(list_filter(w, lambda x, i: list_position(w, x) = i), list_filter(['tikz', 'amsmath'], lambda x: NOT list_contains(w, x))), list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: 'lib' || x)) AS n FROM w),
    r AS (SELECT p_partkey, len(n) AS a, len(list_filter(n, lambda x: regexp_matches(md5(x), '^[0-9]'))) AS k FROM p)"""


@query(_REMOVED + """
    SELECT 'p' || p_partkey || '.tex' AS path, 'success' AS status, true AS verified, CAST(k AS INTEGER) AS removed, round(k / a, 6) AS removal_ratio FROM r""")
def pruning(spark, sf_dir):
    done = pipelines.removal_ratio(pipelines.pruned(fixtures.spread(fixtures.preambles(spark, sf_dir)), RuleCompiler(fixtures.compiles_if_needed_names_are_there)))
    return done.select(F.col("file").alias("path"), "status", F.col("compilation_success").alias("verified"), (F.size("removable_packages") + F.size("removable_libraries")).alias("removed"), F.round("removal_ratio", 6).alias("removal_ratio"))


@query(_REMOVED + """ SELECT count(*) AS files, count(*) AS successes, round(avg(k / a), 6) AS mean_removal FROM r""")
def pruning_summary(spark, sf_dir):
    done = pipelines.pruned(fixtures.spread(fixtures.preambles(spark, sf_dir)), RuleCompiler(fixtures.compiles_if_needed_names_are_there))
    return pipelines.pruning_totals(done).select("files", "successes", F.round("mean_removal", 6).alias("mean_removal"))


_CLASS = r"""p AS (SELECT p_partkey AS k, 'o' || p_partkey % 11 AS a, 'o' || (11 + p_partkey % 7) AS b, 'pk' || p_size AS c, CASE p_partkey % 5 WHEN 0 THEN 'amssymb' ELSE 'br' || p_partkey % 17 END AS d FROM part)"""


@query(rf"""WITH {_CLASS}, n AS (SELECT *, list_filter([CASE WHEN k % 4 IN (1, 3) THEN a END, CASE WHEN k % 4 IN (2, 3) THEN b END], lambda x: x IS NOT NULL) AS needed,
    CASE WHEN k % 3 > 0 THEN [] WHEN k % 5 = 0 THEN ['amsmath'] ELSE ['amsmath', 'amssymb'] END AS implied FROM p)
    SELECT k AS p_partkey, '\documentclass[border=2mm]{{standalone}}' || chr(10) || array_to_string(list_transform(list_concat(needed, implied), lambda x: '\usepackage{{' || x || '}}' || chr(10)), '')
        || '% needs ' || array_to_string(needed, ' ') || chr(10) || '\usepackage{{tikz,' || c || '}}' || chr(10) || '\usepackage{{' || d || '}} % again' || chr(10) || '\usetikzlibrary{{x,y}}' || chr(10) || 'x' AS code FROM n""")
def preamble_standalone(spark, sf_dir):
    """Class options that a recorded compile needs become packages, a class's own packages are named, duplicates go."""

    def convert(code):
        needed = code.split("% needs ")[1].split("\n")[0].split()
        compiles = lambda c: (set(needed) <= set((preamble.document_class(c) or ([], ""))[0]), None)
        return preamble.without_duplicates(preamble.to_standalone(code, compiles))

    k, (a, b, c, d) = F.col("p_partkey"), (F.expr(x) for x in ("concat('o', p_partkey % 11)", "concat('o', 11 + p_partkey % 7)", "concat('pk', p_size)", "if(p_partkey % 5 = 0, 'amssymb', concat('br', p_partkey % 17))"))
    needed = F.concat_ws(" ", F.when(k % 4 % 2 == 1, a), F.when(k % 4 >= 2, b))
    lines = ("\\documentclass[%s, %s]{%s}", "%% needs %s", "\\usepackage{tikz,%s}", "\\usepackage{tikz}%% emptied", "\\usepackage{%s, %s, tikz} %% again", "\\usetikzlibrary{x,y,x}", "x")
    source = F.format_string("\n".join(lines), a, b, F.when(k % 3 == 0, "amsart").otherwise("article"), needed, c, c, d)
    return fixtures.spread(table(spark, sf_dir, "part")).select("p_partkey", F.udf(convert, "string", useArrow=True)(source).alias("code"))


@query()
def image_metrics(spark, sf_dir):
    """Pixel metrics of each vector with the next one, both drawn as images of 8 by 8, enlarged to 32 by 32."""

    def draw(v):
        import numpy as np

        x = np.clip(np.asarray(v, float)[:64].reshape(8, 8) * 255 + 128, 0, 255)
        return imaging.encode_png(imaging.resize(x, 32, 32).round().astype(np.uint8))

    png = F.udf(draw, "binary", useArrow=True)
    e = fixtures.spread(table(spark, sf_dir, "embeddings")).select("vec_id", png("embedding").alias("pred"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pred").alias("ref"))
    pairs = e.join(after, "vec_id").withColumn("filename", F.concat(F.lit("v"), F.col("vec_id"), F.lit(".png")))
    return pipelines.evaluated(fixtures.spread(pairs)).select("filename", *(F.round(c, 4).alias(c) for c in ("mse", "mse_nocanny", "ssim", "psnr")))


@query(f"""WITH {_TURNS}, f AS (SELECT key, CASE key % 3 WHEN 0 THEN 'x' ELSE p END AS p, key % 3 <> 0 AS ok FROM c) SELECT key AS index, md5(p) AS new_code FROM f WHERE ok""")
def rewrite(spark, sf_dir):
    """A rewriting run whose recorded model gives back the code in a fence, or no fence at all."""
    rows = fixtures.turns(spark, sf_dir).withColumn("code", F.when(F.col("index") % 3 == 0, "x").otherwise(F.col("predicted")))
    done = pipelines.rewritten(rows, EchoModel(), "Go")
    return done.select("index", F.md5(text.strip(F.col("new_code")).cast("binary")).alias("new_code"))


class EchoModel:
    """Gives back what the fence of a prompt holds; a code of "x" without a fence."""

    def generate(self, prompts):
        fenced = lambda p: p[p.index("```") :]
        return ["nothing" if fenced(p["prompt"]) == "```latex\nx\n```" else "Thought.\n" + fenced(p["prompt"]) for p in prompts]


from limn.plans import round_trips  # noqa: E402, F401  registers its queries
