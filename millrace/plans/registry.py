"""Named queries over the tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions import textexpr as X
from ..functions.formulas import duckdb
from ..operators import analysis, dedup, evaluation, filters, ml, pipeline, scoring, select, urd
from .oracle import ENTROPY, on_profile

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _table(spark, d, name: str) -> DataFrame:
    """A table of the folder, spread over the cores if it is smaller than one partition: its files may be one row group."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    one = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= one else df


def _docs(spark, d) -> DataFrame:
    return _table(spark, d, "documents")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _r(sql: str, name: str) -> str:
    return f"round({sql}, 6) AS {name}"


def _on_docs(f):
    return lambda spark, d: f(_docs(spark, d))


# --- scalar text functions and profiles

_add(
    "text_quality_profile",
    _on_docs(
        lambda df: _rounded(
            X.with_formulas(X.with_ratios(X.profile(df)), {"quality_score": formulas.QUALITY_PROFILE}).select(
                "doc_id", (X.strip(X.text()) == "").alias("empty"), F.col("n_tok").alias("token_count"), "symbol_ratio", "punctuation_ratio", "repeated_line_ratio", "unique_word_ratio",
                F.col("n_url").alias("url_count"), F.col("n_html").alias("html_tag_count"), "quality_score",
            ), "symbol_ratio", "punctuation_ratio", "repeated_line_ratio", "unique_word_ratio", "quality_score")
    ),
    on_profile(
        "SELECT doc_id, regexp_matches(text, '^[\\s\\p{Z}]*$') AS empty, n_tok AS token_count, "
        + ", ".join(_r(c, c) for c in ("symbol_ratio", "punctuation_ratio", "repeated_line_ratio", "unique_word_ratio"))
        + f", n_url AS url_count, n_html AS html_tag_count, {_r(duckdb(formulas.QUALITY_PROFILE), 'quality_score')} FROM r"
    ),
)
_LANG = ("latin_fraction", "cjk_fraction", "control_character_ratio")
_add(
    "language_profile",
    _on_docs(lambda df: _rounded(X.with_formulas(X.with_ratios(X.profile(df)), {"dominant_script": formulas.DOMINANT_SCRIPT}).select("doc_id", "dominant_script", *_LANG, "is_readable"), *_LANG)),
    on_profile(f"SELECT doc_id, {formulas.DOMINANT_SCRIPT} AS dominant_script, {', '.join(_r(c, c) for c in _LANG)}, is_readable FROM r"),
)
_RATIO = ("stopword_ratio", "language_text_ratio", "repeated_line_ratio")
_add("text_ratios", _on_docs(lambda df: _rounded(X.with_ratios(X.profile(df)).select("doc_id", *_RATIO), *_RATIO)), on_profile(f"SELECT doc_id, {', '.join(_r(c, c) for c in _RATIO)} FROM r"))
_add(
    "normalized_hash",
    _on_docs(lambda df: df.select("doc_id", F.sha2(X.normalise(X.text()), 256).alias("hash"), F.sha2(F.concat(F.lit("salt\n"), X.text()), 256).alias("stable_id"))),
    r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS hash, sha256('salt' || chr(10) || text) AS stable_id FROM documents",
)
_add(
    "hdqs_components",
    _on_docs(lambda df: _rounded(scoring.hdqs(df).select("doc_id", *[F.col(f"h_{k}").alias(k) for k in formulas.HDQS], "score"), *formulas.HDQS, "score")),
    on_profile(f"SELECT doc_id, {', '.join(_r('h_' + k, k) for k in formulas.HDQS)}, {_r(duckdb(formulas.weighted(formulas.WEIGHTS['hdqs'], 'h_')), 'score')} FROM q", ENTROPY),
)
_LOCAL = [*formulas.LOCAL, "score", "perplexity_proxy"]
_LOCAL_SQL = ", ".join(f"{duckdb(v)} AS {k}" for k, v in formulas.LOCAL.items()) + f", {duckdb(formulas.PERPLEXITY_PROXY)} AS perplexity_proxy"
_add(
    "local_scores",
    _on_docs(lambda df: _rounded(scoring.local_scores(df).select("doc_id", *_LOCAL), *_LOCAL)),
    on_profile(f"SELECT doc_id, {', '.join(_r(c, c) for c in _LOCAL)} FROM (SELECT *, local_utility + 0.25::DOUBLE * local_diversity - 0.5::DOUBLE * local_risk AS score FROM (SELECT *, {_LOCAL_SQL} FROM r))"),
)
_add(
    "baseline_scores",
    _on_docs(lambda df: _rounded(scoring.baseline_scores(df).select("doc_id", *formulas.BASELINES), *formulas.BASELINES)),
    on_profile("SELECT doc_id, " + ", ".join(_r(duckdb(v), k) for k, v in formulas.BASELINES.items()) + " FROM e", ENTROPY),
)
_add(
    "clean_pages",
    lambda spark, d: _table(spark, d, "pages").select("page_id", F.sha2(pipeline.clean(F.col("html")), 256).alias("clean_sha256"), X.count(F.col("html"), X.HTML).alias("tags"), X.count(F.col("html"), X.URL).alias("urls")),
    rf"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://\S+', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))) AS clean_sha256,
    len(regexp_extract_all(html, '<[^>]+>'))::INT AS tags, len(regexp_extract_all(html, '{X.URL}'))::INT AS urls FROM pages""",
)
_REDACT_SQL = f"regexp_replace(regexp_replace(regexp_replace(text, '{X.EMAIL}', '<EMAIL>', 'g'), '{X.PHONE}', '<PHONE>', 'g'), '{X.ID}', '<ID>', 'g')"
_add("redact_pii", _on_docs(lambda df: df.select("doc_id", F.sha2(pipeline.redact(X.text()), 256).alias("redacted_sha256"))), f"SELECT doc_id, sha256({_REDACT_SQL}) AS redacted_sha256 FROM documents")
_add(
    "safe_excerpt",
    _on_docs(lambda df: df.select("doc_id", pipeline.excerpt(X.text()).alias("excerpt"))),
    f"SELECT doc_id, left(regexp_replace(regexp_replace(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')), '{X.EMAIL}', '[EMAIL]', 'g'), '{X.PHONE}', '[PHONE]', 'g'), 220) AS excerpt FROM documents",
)
_add(
    "token_counter_compare",
    _on_docs(lambda df: df.agg(F.sum(F.size(X.words(X.text()))).alias("whitespace"), F.sum(X.count_tokens(X.text())).alias("word_mark"), F.sum(F.char_length(X.text())).alias("characters"))),
    rf"SELECT sum(len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')))::BIGINT AS whitespace, sum(len(regexp_extract_all(text, '{X.WORD}+|[^\p{{L}}\p{{N}}_\s]')))::BIGINT AS word_mark, sum(length(text))::BIGINT AS characters FROM documents",
)
_METRICS = ["length_chars", "token_count", "token_diversity", "repetition_rate", "trigram_repetition_rate", "token_entropy", "char_entropy", "symbol_fraction", "dev_loss_proxy", "information_density"]
_add(
    "document_metrics",
    # 1e-9: sums in another order must not tip a figure that lies between two roundings
    lambda spark, d: _rounded(scoring.document_metrics(_docs(spark, d), _table(spark, d, "benchmark")).withColumn("information_density", F.col("information_density") + 1e-9), *_METRICS),
    on_profile(
        """, b AS (SELECT t AS token, count(*) AS c FROM (SELECT unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS t FROM benchmark) GROUP BY t),
s AS (SELECT sum(c) AS total, count(*) AS vocab FROM b), k AS (SELECT doc_id, t AS token, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS t FROM p) GROUP BY ALL),
m AS (SELECT doc_id, sum(n) AS al, count(*) FILTER (c IS NULL) AS nw, sum(n * ln(coalesce(c, 0) + 1e-9)) AS lg FROM k LEFT JOIN b USING (token) GROUP BY doc_id)
SELECT e.doc_id, n_len::DOUBLE AS length_chars, n_tok::DOUBLE AS token_count, round(n_uniq / greatest(1, n_tok), 6) AS token_diversity,
round(1 - n_bigrams / greatest(1, n_tok - 1), 6) AS repetition_rate, round(1 - n_trigrams / greatest(1, n_tok - 2), 6) AS trigram_repetition_rate, round(token_entropy_bits, 6) AS token_entropy, round(char_entropy_bits, 6) AS char_entropy,
round(n_sym / greatest(1, n_len), 6) AS symbol_fraction, round(token_entropy_bits * n_uniq / greatest(1, n_tok) + 1e-9, 6) AS information_density,
round(coalesce(ln(total + 1e-9 * (vocab + nw)) - lg / al, 0), 6) AS dev_loss_proxy FROM e CROSS JOIN s LEFT JOIN m ON m.doc_id = e.doc_id""".lstrip(),
        ENTROPY,
    ).replace("\n, b AS", ", b AS", 1),
)

# --- row-local filters

for _name, (_score, _keep) in formulas.FILTERS.items():
    if _name == "length_filter":
        continue
    _add(
        _name,
        _on_docs(lambda df, n=_name: _rounded(filters.decide(df, n), "score")),
        on_profile(f"SELECT doc_id, {duckdb(_keep)} AS keep, {_r('score', 'score')}, '{_name}' AS reason FROM (SELECT *, {duckdb(_score)} AS score FROM r)"),
    )
_W = r"len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> ''))"
_add(
    "length_filter",
    _on_docs(lambda df: filters.length_filter(df, 32, 2048)),
    f"SELECT doc_id, n BETWEEN 32 AND 2048 AS keep, CASE WHEN n BETWEEN 32 AND 2048 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN n BETWEEN 32 AND 2048 THEN 'length_in_range' WHEN n < 32 THEN 'length_below_min' ELSE 'length_above_max' END AS reason FROM (SELECT doc_id, {_W} AS n FROM documents)",
)
_add(
    "rule_filter",
    _on_docs(lambda df: _rounded(filters.rule_filter(df), "score")),
    on_profile("SELECT doc_id, keep, round(unique_word_ratio, 6) AS score, CASE WHEN keep THEN 'rule_pass' ELSE 'rule_reject' END AS reason FROM (SELECT *, n_words >= 5 AND symbol_ratio <= 0.25::DOUBLE AND unique_word_ratio >= 0.16::DOUBLE AS keep FROM r)"),
)
_add(
    "c4_quality_reasons",
    _on_docs(lambda df: _rounded(filters.c4_quality(df), "score")),
    on_profile(
        f"SELECT doc_id, reason = 'c4_style_quality_pass' AS keep, round(alpha_fraction, 6) AS score, reason FROM (SELECT *, {duckdb(formulas.C4_REASON)} AS reason FROM (SELECT *, {_LOCAL_SQL}, contains(folded, 'lorem ipsum') OR contains(folded, 'javascript') AS blocked FROM r))"
    ),
)
_HDQS_SCORE = duckdb(formulas.weighted(formulas.WEIGHTS["hdqs"], "h_"))
_add("hdqs_threshold", _on_docs(lambda df: scoring.hdqs(df).select("doc_id", (F.col("score") >= 0.58).alias("keep"))), on_profile(f"SELECT doc_id, {_HDQS_SCORE} >= 0.58::DOUBLE AS keep FROM q", ENTROPY))

# --- dedup

_NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"
_add(
    "exact_dedup",
    _on_docs(dedup.exact_dedup),
    f"SELECT doc_id, k AS keep, CASE WHEN k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN k THEN 'first_normalized_hash' ELSE 'duplicate_normalized_hash' END AS reason FROM (SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY {_NORM}) AS k FROM documents)",
)
_add("exact_dedup_sha1_clusters", _on_docs(dedup.sha1_clusters), "SELECT m AS representative, doc_id AS member FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM documents) WHERE m <> doc_id")


def _pairs_sql(tokens: str, threshold: float) -> str:
    """All pairs of documents with a common shingle, exactly."""
    return rf"""WITH t AS (SELECT doc_id, {tokens} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, k / (p.n + q.n - k) AS similarity FROM j JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE k / (p.n + q.n - k) >= {threshold}::DOUBLE)
"""


_TOK = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')"
_FOLDED = r"list_filter(string_split_regex(replace(lower(text), 'ß', 'ss'), '\s+'), lambda t: t <> '')"
#: The least id of the documents with an equal shingle set.
_LEADS = ", keys AS (SELECT doc_id, md5(string_agg(g, chr(31) ORDER BY g)) AS h FROM s GROUP BY doc_id), leads AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS lead FROM keys) "
_add("near_dup_pairs_jaccard", _on_docs(lambda df: _rounded(dedup.jaccard_pairs(df), "similarity")), _pairs_sql(_TOK, 0.82) + _LEADS + "SELECT a, b, round(similarity, 6) AS similarity FROM pairs JOIN leads x ON x.doc_id = a JOIN leads y ON y.doc_id = b WHERE x.lead = a AND (y.lead = b OR y.lead = a)")
_add(
    "dup_components",
    _on_docs(lambda df: dedup.clusters(df, 0.86)),
    _pairs_sql(_FOLDED, 0.86).replace("WITH t AS", "WITH RECURSIVE t AS", 1)
    + """, e AS (SELECT a::VARCHAR AS a, b::VARCHAR AS b FROM pairs UNION SELECT b::VARCHAR, a::VARCHAR FROM pairs),
c(node, seen) AS (SELECT a, a FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen)
SELECT doc_id::VARCHAR AS doc_id, coalesce((SELECT min(seen) FROM c WHERE node = documents.doc_id::VARCHAR), doc_id::VARCHAR) AS representative FROM documents""",
)
def _split():
    return F.when(F.substring(F.sha2(F.concat(F.lit("split:"), F.col("doc_id").cast("string")), 256), 1, 1) < "d", "train").otherwise("valid")


_SPLIT_SQL = "CASE WHEN substr(sha256('split:' || doc_id), 1, 1) < 'd' THEN 'train' ELSE 'valid' END"
_add("split_audit_exact", _on_docs(lambda df: dedup.split_audit(df.withColumn("split", _split())).select("hash", F.array_join("splits", ",").alias("splits"))), f"SELECT hash, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM (SELECT sha256({_NORM}) AS hash, {_SPLIT_SQL} AS split FROM documents) GROUP BY hash HAVING count(DISTINCT split) > 1")
_add("benchmark_overlap", lambda spark, d: dedup.containment(_docs(spark, d), _table(spark, d, "benchmark")), "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
_add("removed_documents", _on_docs(lambda df: df.join(dedup.exact_dedup(df).where("not keep"), "doc_id", "left_semi").select("doc_id", "source")), f"SELECT doc_id, source FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY {_NORM}) AS m FROM documents) WHERE doc_id <> m")

# --- selection

_add(
    "keep_rate_topk",
    _on_docs(lambda df: select.topk(scoring.hdqs(df).select("doc_id", F.round("score", 9).alias("score")), 0.6).select("doc_id", "keep")),
    on_profile(f"SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) <= greatest(1, ceil((SELECT count(*) FROM q) * 0.6::DOUBLE)) AS keep FROM (SELECT doc_id, round({_HDQS_SCORE}, 9) AS s FROM q)", ENTROPY),
)
_add("longest_docs", _on_docs(lambda df: select.topk(df.select("doc_id", F.char_length(X.text()).alias("score")), 0.1).select("doc_id", "keep")), "SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) <= greatest(1, ceil((SELECT count(*) FROM documents) * 0.1::DOUBLE)) AS keep FROM documents")


def _band(df: DataFrame, low: float = 0.05, high: float = 0.95, rate: float = 0.75) -> DataFrame:
    """Keep the lowest scores between two order statistics."""
    s = select.saved(scoring.local_scores(df).select("doc_id", F.round("perplexity_proxy", 9).alias("score")), "scores")
    r = select.global_rank(s, F.col("score"), F.col("doc_id"))
    n = s.count()
    lo, hi = (r.where(F.col("rank") == int(q * (n - 1)) + 1).head()["score"] if n else 0.0 for q in (low, high))
    inside = F.col("score").between(lo, hi)
    below = s.where(F.col("score") < lo).count()
    return r.select("doc_id", (inside & (F.col("rank") <= below + int(n * rate))).alias("keep"))


_add(
    "perplexity_band",
    _on_docs(_band),
    on_profile(
        f""", s AS (SELECT doc_id, round({duckdb(formulas.PERPLEXITY_PROXY)}, 9) AS v FROM r), k AS (SELECT doc_id, v, row_number() OVER (ORDER BY v, doc_id) - 1 AS i, count(*) OVER () AS n FROM s),
b AS (SELECT max(v) FILTER (i = floor(0.05::DOUBLE * (n - 1))) AS lo, max(v) FILTER (i = floor(0.95::DOUBLE * (n - 1))) AS hi FROM k),
f AS (SELECT doc_id, row_number() OVER (ORDER BY v, doc_id) AS i, n FROM k, b WHERE v BETWEEN lo AND hi)
SELECT s.doc_id, coalesce(f.i <= floor(f.n * 0.75::DOUBLE), false) AS keep FROM s LEFT JOIN f ON f.doc_id = s.doc_id"""
    ).replace("\n, s AS", ", s AS", 1),
)
_BUDGET = 60_000
_words = lambda df: df.select("doc_id", F.size(X.words(X.text())).cast("long").alias("n"))
_add("prefix_budget", _on_docs(lambda df: select.prefix_budget(_words(df), "n", _BUDGET)), f"SELECT doc_id, n FROM (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) AS t, row_number() OVER (ORDER BY doc_id) AS i FROM (SELECT doc_id, {_W}::BIGINT AS n FROM documents)) WHERE i = 1 OR (t <= {_BUDGET} AND t - n < {_BUDGET})")
_add("sha_rank_sample", _on_docs(lambda df: select.random_keep(df, 0.25).select("doc_id", "keep")), "SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id)) <= greatest(1, ceil((SELECT count(*) FROM documents) * 0.25::DOUBLE)) AS keep FROM documents")
_add(
    "token_target_split",
    _on_docs(lambda df: select.token_target_split(_words(df), "n", {"train": 50_000, "valid": 5_000, "test": 5_000}).select("doc_id", "n", "split")),
    f"SELECT doc_id, n, CASE WHEN t - n < 50000 THEN 'train' WHEN t - n < 55000 THEN 'valid' WHEN t - n < 60000 THEN 'test' END AS split FROM (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) AS t FROM (SELECT doc_id, {_W}::BIGINT AS n FROM documents))",
)
_add(
    "curriculum_interleave",
    _on_docs(lambda df: select.curriculum_interleave(df.select("doc_id", F.char_length(X.text()).alias("score")))),
    "SELECT doc_id, (CASE WHEN r % 2 = 0 THEN r ELSE 2 * (n // 2 - 1 - (r - 1) // 2) + 1 END)::BIGINT AS position FROM (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)",
)

# --- multi-objective selection

_URD = ["utility_score", "risk_score", "diversity_score", "shift_penalty", "cost_score", "urd_score"]
_LN2 = "0.6931471805599453::DOUBLE"
_URD_SQL = f""", tc AS (SELECT t, count(*) AS c FROM (SELECT unnest(toks) AS t FROM p) GROUP BY t),
rare AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, unnest(list_distinct(toks)) AS t FROM p) JOIN tc USING (t) WHERE c <= 1 GROUP BY doc_id),
st AS (SELECT max(n_tok) AS mx, avg(n_tok) AS mean_tok, max(n_len) AS max_len, count(DISTINCT source) AS srcs, count(source) AS with_source FROM r), vc AS (SELECT count(*) AS vocab FROM tc),
sets AS (SELECT doc_id, n_uniq AS n, unnest(list_distinct(toks)) AS t FROM p),
pr AS (SELECT x.doc_id AS a, x.n, y.n AS m, count(*) AS k FROM sets x JOIN sets y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n),
nv AS (SELECT a, sum(k / (n + m - k)) AS s FROM pr GROUP BY a),
u AS (SELECT e.*, coalesce(rare.k, 0) AS n_rare, CASE WHEN count(*) OVER (PARTITION BY {_NORM}) > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS duplicate_hint,
  CASE WHEN {' OR '.join(f"contains(folded, '{t}')" for t in X.BOILERPLATE)} THEN 1.0 ELSE 0.0 END::DOUBLE AS boilerplate_hint, 1 - count(*) OVER (PARTITION BY source) / with_source AS source_shift, 1.0::DOUBLE / srcs AS source_coverage,
  greatest(1, mx) AS max_tok, mx AS max_tok_raw, mean_tok, max_len, vocab, 1 - coalesce(nv.s, 0) / ((SELECT count(*) FROM r) - 1) AS novelty,
  token_entropy_bits * {_LN2} / greatest(1.0, ln(greatest(2, n_uniq))) AS token_entropy_nat, char_entropy_bits * {_LN2} / greatest(1.0, ln(greatest(2, n_char_kinds))) AS char_entropy_nat
  FROM e CROSS JOIN st CROSS JOIN vc LEFT JOIN rare ON rare.doc_id = e.doc_id LEFT JOIN nv ON nv.a = e.doc_id),
v AS (SELECT *, {", ".join(f"{duckdb(x)} AS {k}" for k, x in formulas.URD.items())}, {duckdb(formulas.URD_DIVERSITY)} AS diversity_score FROM u),
w AS (SELECT *, {duckdb(formulas.URD_FIXED)} AS urd_score FROM v)
"""
_urd = lambda body: on_profile(_URD_SQL + body, ENTROPY).replace("\n, tc AS", ", tc AS", 1)
_add("urd_scores", _on_docs(lambda df: _rounded(urd.scores(df).select("doc_id", *_URD), *_URD)), _urd("SELECT doc_id, " + ", ".join(_r(c, c) for c in _URD) + " FROM w"))
_add("urd_fixed", _on_docs(lambda df: urd.select_fixed(df, 0.6).select("doc_id", "keep", "reason")), _urd("SELECT doc_id, keep, CASE WHEN keep THEN 'urd_fixed_weight_selected' ELSE 'urd_fixed_weight_rejected_by_rank_risk_or_budget' END AS reason FROM (SELECT doc_id, row_number() OVER (ORDER BY urd_score DESC, doc_id::VARCHAR) <= ceil((SELECT count(*) FROM w) * 0.6::DOUBLE) AS keep FROM w)"))
_add(
    "pareto_frontier",
    _on_docs(lambda df: select.pareto_front(df.select("doc_id", *_pareto_cols(df)), ["a", "b"], ["c"]).select("doc_id")),
    r"""WITH v AS (SELECT doc_id, len(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'))) / greatest(1, len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'))) AS a, length(text) AS b, length(regexp_replace(text, '[\p{L}\p{N}\s\p{Z}]', '', 'g')) / length(text) AS c FROM documents)
SELECT doc_id FROM v x WHERE NOT EXISTS (SELECT 1 FROM v y WHERE y.a >= x.a AND y.b >= x.b AND y.c <= x.c AND (y.a > x.a OR y.b > x.b OR y.c < x.c))""",
)


def _pareto_cols(df: DataFrame) -> list:
    """Objectives by the SQL: nulls for a null text; an empty one has more symbols than any, as nothing by nothing comes last there."""
    x = F.col("text")
    t, n = X.tokens(x), F.char_length(x)
    symbols = F.when(n > 0, X.without(x, r"[\p{L}\p{N}\s\p{Z}]") / F.nullif(n, F.lit(0))).when(n == 0, F.lit(float("inf")))
    return [F.when(x.isNotNull(), F.size(F.array_distinct(t)) / F.greatest(F.lit(1), F.size(t))).alias("a"), n.cast("double").alias("b"), symbols.alias("c")]


_add(
    "perplexity_proxy",
    _on_docs(lambda df: _rounded(scoring.unigram_surprisal(df), "score")),
    on_profile(
        """, tc AS (SELECT t, count(*) AS c FROM (SELECT unnest(toks) AS t FROM p) GROUP BY t), al AS (SELECT (sum(c) + greatest(1, count(*)))::DOUBLE AS n FROM tc),
m AS (SELECT doc_id, avg(-ln((c + 1) / n)) AS s FROM (SELECT doc_id, unnest(toks) AS t FROM p) JOIN tc USING (t) CROSS JOIN al GROUP BY doc_id)
SELECT p.doc_id, round(CASE WHEN s IS NULL THEN 0 ELSE 1 / (1 + s) END, 6) AS score FROM p LEFT JOIN m ON m.doc_id = p.doc_id"""
    ).replace("\n, tc AS", ", tc AS", 1),
)

# --- scoring with corpus statistics

_V3 = ["base_quality", "quality_diversity_balance", "repetition_capped", "length_guardrail", "score"]
_V2 = ["base_quality", "length_distribution_match", "token_frequency_preservation", "quality_diversity_balance", "repetition_capped", "score"]
_BINS_SQL = """sl AS (SELECT list(n_tok ORDER BY n_tok) AS a, count(*) AS n FROM p),
e1 AS (SELECT greatest(1, a[1 + floor(0.2::DOUBLE * n)::INT]) AS b1, a, n FROM sl), e2 AS (SELECT *, greatest(b1 + 1, a[1 + floor(0.4::DOUBLE * n)::INT]) AS b2 FROM e1),
e3 AS (SELECT *, greatest(b2 + 1, a[1 + floor(0.6::DOUBLE * n)::INT]) AS b3 FROM e2), e4 AS (SELECT *, greatest(b3 + 1, a[1 + floor(0.8::DOUBLE * n)::INT]) AS b4 FROM e3)"""
_BIN_SQL = "CASE WHEN n_tok < b1 THEN '0-' || b1 WHEN n_tok < b2 THEN b1 || '-' || b2 WHEN n_tok < b3 THEN b2 || '-' || b3 WHEN n_tok < b4 THEN b3 || '-' || b4 ELSE b4 || '-1000000000' END"
_add(
    "hdqs_v2",
    _on_docs(lambda df: _rounded(scoring.hdqs_v2(df).select("doc_id", *_V2, "length_bin"), *_V2)),
    on_profile(
        f""", {_BINS_SQL}, ps AS (SELECT doc_id, unnest(toks) AS t, unnest(range(0, len(toks))) AS i FROM p),
top AS (SELECT t FROM (SELECT t, count(*) AS c, min(struct_pack(d := doc_id, i := i)) AS f FROM ps GROUP BY t) ORDER BY c DESC, f LIMIT 1500),
hv AS (SELECT doc_id, count(*) AS k FROM ps JOIN top USING (t) GROUP BY doc_id),
x AS (SELECT q.*, {duckdb(formulas.weighted(formulas.WEIGHTS["hdqs_v2"], "h_"))} AS base_quality, coalesce(k, 0) / greatest(1, n_tok) AS token_frequency_preservation FROM q LEFT JOIN hv ON hv.doc_id = q.doc_id),
y AS (SELECT *, 0.75::DOUBLE + 0.25::DOUBLE * least(1.0, ln(1 + n_tok) / ln(1201)) AS length_distribution_match, 0.5::DOUBLE * base_quality + 0.25::DOUBLE * least(1.0, token_entropy_bits / 8) + 0.25::DOUBLE * n_uniq / greatest(1, n_tok) AS quality_diversity_balance,
  greatest(0.45::DOUBLE, n_bigrams / greatest(1, n_tok - 1)) AS repetition_capped FROM x),
z AS (SELECT *, 0.42::DOUBLE * base_quality + 0.18::DOUBLE * length_distribution_match + 0.18::DOUBLE * token_frequency_preservation + 0.14::DOUBLE * quality_diversity_balance + 0.08::DOUBLE * repetition_capped AS score FROM y)
SELECT doc_id, {", ".join(_r(c, c) for c in _V2)}, {_BIN_SQL} AS length_bin FROM z CROSS JOIN e4""",
        ENTROPY,
    ).replace("\n, sl AS", ", sl AS", 1),
)
_add(
    "hdqs_v3",
    _on_docs(lambda df: _rounded(scoring.hdqs_v3(df).select("doc_id", *_V3, "length_bin"), *_V3)),
    on_profile(
        f""", {_BINS_SQL}, g AS (SELECT *, a[1 + n // 2] AS mid, a[1 + floor(0.1::DOUBLE * (n - 1))::INT] AS lo, a[1 + floor(0.9::DOUBLE * (n - 1))::INT] AS hi FROM e4),
x AS (SELECT q.*, g.b1, g.b2, g.b3, g.b4, mid, lo, hi, {duckdb(formulas.weighted(formulas.WEIGHTS["hdqs_v3"], "h_"))} AS base_quality FROM q CROSS JOIN g),
y AS (SELECT *, 0.5::DOUBLE * base_quality + 0.25::DOUBLE * least(1.0, token_entropy_bits / 8) + 0.25::DOUBLE * n_uniq / greatest(1, n_tok) AS quality_diversity_balance, greatest(0.5::DOUBLE, n_bigrams / greatest(1, n_tok - 1)) AS repetition_capped,
  greatest(0.0, least(1.0, 1 - 0.5::DOUBLE * abs(ln(1 + n_tok) - ln(1 + mid)) / greatest(1.0, ln(1 + hi) - ln(1 + lo)))) AS length_guardrail FROM x),
z AS (SELECT *, 0.55::DOUBLE * base_quality + 0.23::DOUBLE * quality_diversity_balance + 0.14::DOUBLE * repetition_capped + 0.08::DOUBLE * length_guardrail AS score FROM y)
SELECT doc_id, {", ".join(_r(c, c) for c in _V3)}, {_BIN_SQL} AS length_bin FROM z""",
        ENTROPY,
    ).replace("\n, sl AS", ", sl AS", 1),
)

# --- reports

_add(
    "filter_summary",
    _on_docs(lambda df: _rounded(filters.summary(df, filters.length_filter(df, 32, 2048)), "document_keep_rate", "token_keep_rate")),
    f"SELECT count(*) AS input_documents, count(*) FILTER (n BETWEEN 32 AND 2048) AS kept_documents, sum(n)::BIGINT AS input_tokens, sum(n) FILTER (n BETWEEN 32 AND 2048)::BIGINT AS kept_tokens, round(kept_documents / input_documents, 6) AS document_keep_rate, round(kept_tokens / input_tokens, 6) AS token_keep_rate FROM (SELECT {_W} AS n FROM documents)",
)
_RISK = ["url_ratio", "html_ratio", "symbol_ratio", "digit_ratio", "duplicate_hint_rate"]
_add(
    "risk_report",
    _on_docs(lambda df: _rounded(analysis.risk_report(df), *_RISK)),
    on_profile(
        f"SELECT round(sum(n_url) / count(*), 6) AS url_ratio, round(sum(n_html) / count(*), 6) AS html_ratio, round(sum(n_sym) / (sum(n_len) + count(*) - 1), 6) AS symbol_ratio, round(sum(n_digit) / (sum(n_len) + count(*) - 1), 6) AS digit_ratio, (sum(n_email) + sum(n_phone))::BIGINT AS estimated_pii_hits, round((count(*) - count(DISTINCT {_NORM})) / count(*), 6) AS duplicate_hint_rate FROM r"
    ),
)
_add(
    "diversity_report",
    _on_docs(lambda df: _rounded(analysis.diversity_report(df), "length_mean", "length_std", "unique_token_ratio")),
    on_profile("SELECT round(avg(n_tok), 6) AS length_mean, round(stddev_pop(n_tok), 6) AS length_std, count(DISTINCT source) AS source_count, round((SELECT count(DISTINCT t) / count(*) FROM (SELECT unnest(toks) AS t FROM p)), 6) AS unique_token_ratio FROM r"),
)
_add(
    "quality_metrics",
    _on_docs(lambda df: _rounded(analysis.quality_metrics(df), "duplicate_rate", "pass_rate", "mean_score")),
    on_profile(
        f"SELECT count(*) AS documents, sum(n_len)::BIGINT AS characters, count(*) - count(DISTINCT text) AS duplicate_documents, round((count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_rate, sum(q_email)::BIGINT AS email_hits, sum(q_phone)::BIGINT AS phone_hits, sum(q_id)::BIGINT AS id_hits, round(count(*) FILTER (n_words >= 5 AND symbol_ratio <= 0.25::DOUBLE AND unique_word_ratio >= 0.16::DOUBLE) / count(*), 6) AS pass_rate, round(avg(s), 6) AS mean_score FROM (SELECT *, {_HDQS_SCORE} AS s FROM q)",
        ENTROPY,
    ),
)
_CA = ["len_mean", "tok_mean", "share_len_20"]
_add(
    "corpus_analyze",
    _on_docs(lambda df: _rounded(analysis.corpus_analysis(df), *_CA)),
    rf"""SELECT count(*) AS documents, {", ".join(f"min({c})::INT AS {c}_min, max({c})::INT AS {c}_max, round(avg({c}), 6) AS {c}_mean, list_sort(list({c}))[1 + count(*) // 2]::INT AS {c}_p50" for c in ("len", "tok"))},
count(*) FILTER (regexp_matches(text, '^[\s\p{{Z}}]*$')) AS empty_documents, count(*) FILTER (regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS control_documents, count(*) FILTER (contains(text, '�')) AS replacement_documents,
count(*) FILTER (regexp_matches(text, '<[^>]+>')) AS html_documents, count(*) FILTER (regexp_matches(text, '{X.URL}')) AS url_documents, count(*) - count(DISTINCT text) AS duplicate_rows, round(avg((len >= 20)::INT), 6) AS share_len_20
FROM (SELECT text, length(text) AS len, len(regexp_extract_all(text, '{X.WORD}+|[^\p{{L}}\p{{N}}_\s]')) AS tok FROM documents)""",
)
_add("token_topk", _on_docs(lambda df: analysis.token_topk(df, 50)), f"WITH t AS (SELECT doc_id, {_TOK} AS k FROM documents), u AS (SELECT doc_id, unnest(k) AS token, unnest(range(0, len(k))) AS i FROM t) SELECT token, count(*) AS c FROM u GROUP BY token ORDER BY c DESC, min(struct_pack(d := doc_id, i := i)) LIMIT 50")
_add("length_histogram", _on_docs(analysis.length_histogram), f"SELECT CASE {' '.join(f'''WHEN n < {b} THEN '{a}-{b}' ''' for a, b in zip(analysis.BINS, analysis.BINS[1:]))} END AS bin, count(*) AS c FROM (SELECT len({_TOK}) AS n FROM documents) GROUP BY 1")
_add(
    "js_divergence_by_lang",
    _on_docs(lambda df: _rounded(analysis.divergence_by(df, "lang"), "js")),
    f"""WITH u AS (SELECT lang, unnest({_TOK}) AS t FROM documents), c AS (SELECT lang, t, count(*) AS x FROM u GROUP BY ALL), w AS (SELECT t, sum(x) AS y FROM c GROUP BY t), s AS (SELECT count(*) AS v, sum(y) AS n FROM w),
g AS (SELECT lang, sum(x) AS al FROM c GROUP BY lang), f AS (SELECT g.lang, (coalesce(x, 0) + 1e-9) / (al + 1e-9 * v) AS p, (y + 1e-9) / (n + 1e-9 * v) AS q FROM g CROSS JOIN w CROSS JOIN s LEFT JOIN c ON c.lang = g.lang AND c.t = w.t)
SELECT lang, round(0.5 * (sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2)))), 6) AS js FROM f GROUP BY lang""",
)
_add(
    "divergence_documents_benchmark",
    lambda spark, d: _rounded(analysis.divergence(scoring.token_counts(_docs(spark, d)), scoring.token_counts(_table(spark, d, "benchmark"))), "kl", "js"),
    f"""WITH l AS (SELECT t, count(*) AS x FROM (SELECT unnest({_TOK}) AS t FROM documents) GROUP BY t), r AS (SELECT t, count(*) AS y FROM (SELECT unnest({_TOK}) AS t FROM benchmark) GROUP BY t),
b AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM l FULL JOIN r USING (t)), s AS (SELECT count(*) AS v, sum(x) AS nx, sum(y) AS ny FROM b), f AS (SELECT (x + 1e-9) / (nx + 1e-9 * v) AS p, (y + 1e-9) / (ny + 1e-9 * v) AS q FROM b CROSS JOIN s)
SELECT round(sum(p * log2(p / q)), 6) AS kl, round(0.5 * (sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2)))), 6) AS js FROM f""",
)
_add(
    "component_correlation",
    _on_docs(lambda df: X.with_ratios(X.profile(df)).agg(*[F.round(analysis.correlation(df, "n_tok", c), 6).alias(c) for c in ("unique_word_ratio", "symbol_ratio", "stopword_ratio", "control_character_ratio")])),
    on_profile("SELECT " + ", ".join(f"round(coalesce(CASE WHEN isnan(corr(n_tok, {c})) THEN 0 ELSE corr(n_tok, {c}) END, 0), 6) AS {c}" for c in ("unique_word_ratio", "symbol_ratio", "stopword_ratio")) + ", 0.0::DOUBLE AS control_character_ratio FROM r"),
)
_add(
    "split_manifest",
    _on_docs(lambda df: df.select(_split().alias("split"), F.size(X.words(X.text())).alias("n"), F.octet_length(X.text()).alias("b")).groupBy("split").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum("b").alias("bytes"))),
    f"SELECT {_SPLIT_SQL} AS split, count(*) AS documents, sum({_W})::BIGINT AS tokens, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1",
)

# --- statistics: events stand in for runs of methods (event_type) over seeds (user_id)

_events = lambda spark, d: _table(spark, d, "events")
_CI = ["mean", "std", "ci95_low", "ci95_high"]
_CI_SQL = "n, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN n > 1 THEN mean - 1.96::DOUBLE * std / sqrt(n) END, 6) AS ci95_low, round(CASE WHEN n > 1 THEN mean + 1.96::DOUBLE * std / sqrt(n) END, 6) AS ci95_high"
_add("metric_summary_ci", lambda spark, d: _rounded(analysis.summarize(_events(spark, d), "event_type", "value"), *_CI), f"SELECT event_type, {_CI_SQL} FROM (SELECT event_type, count(value) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM events GROUP BY event_type)")
_add(
    "paired_difference",
    lambda spark, d: _rounded(analysis.paired_difference(_events(spark, d), "event_type", "user_id", "value", "click"), *_CI),
    f"WITH p AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL), x AS (SELECT p.event_type, b.v - p.v AS d FROM p JOIN p b ON b.user_id = p.user_id AND b.event_type = 'click' WHERE p.event_type <> 'click') SELECT event_type, {_CI_SQL}, mean > 0 AS positive_mean_improvement FROM (SELECT event_type, count(d) AS n, avg(d) AS mean, coalesce(stddev_samp(d), 0) AS std FROM x GROUP BY event_type)",
)
_add(
    "spearman_ordinal",
    _on_docs(lambda df: _rounded(analysis.spearman(X.profile(df), "n_tok", "n_sym", "doc_id"), "rho")),
    on_profile(", k AS (SELECT row_number() OVER (ORDER BY n_tok, doc_id) AS a, row_number() OVER (ORDER BY n_sym, doc_id) AS b FROM r) SELECT round(1 - 6 * sum((a - b)::DOUBLE * (a - b)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS rho FROM k").replace("\n, k AS", ", k AS", 1),
)
_add(
    "method_ranking",
    lambda spark, d: _rounded(analysis.ranking(_events(spark, d).withColumn("day", F.to_date("ts")), "day", "event_type", "value"), "mean_rank"),
    "WITH m AS (SELECT ts::DATE AS day, event_type, avg(value) AS v FROM events GROUP BY ALL), r AS (SELECT event_type, row_number() OVER (PARTITION BY day ORDER BY v, event_type) AS r FROM m) SELECT event_type, round(avg(r), 6) AS mean_rank, min(r)::INT AS best_rank, max(r)::INT AS worst_rank FROM r GROUP BY event_type",
)
_add("latest_run", lambda spark, d: analysis.latest(_events(spark, d).select("event_id", "event_type", "user_id", "ts", "value"), ["event_type", "user_id"], ["ts", "event_id"]).select("event_type", "user_id", "event_id", "value"), "SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
_add("bootstrap_ci", lambda spark, d: _rounded(analysis.bootstrap_mean(_events(spark, d), "event_type", "value", ["event_id"]), "mean", "ci_low", "ci_high"))

# --- pipelines

def _sweep_sql() -> str:
    """Every set of weights, cut by threshold and by share: the lists are written out here, apart from the code's."""
    own = "1.0 * h_lexical_diversity + 1.0 * h_char_entropy + 0.8 * h_token_entropy + 1.3 * h_repetition_penalty + 1.0 * h_ngram_repetition_penalty + 1.2 * h_pii_density_penalty + 1.0 * h_url_html_noise_penalty + 1.0 * h_non_linguistic_symbol_penalty + 0.8 * h_length_prior + 0.7 * h_language_consistency"
    sets = {
        "balanced_default": (own, 9.8),
        "privacy_heavy": (own.replace("1.2 * h_pii", "2.0 * h_pii").replace("1.0 * h_url", "1.4 * h_url"), 11.0),
        "anti_repetition_heavy": (own.replace("1.3 * h_rep", "2.0 * h_rep").replace("1.0 * h_ngram", "1.6 * h_ngram"), 11.1),
        "diversity_heavy": (own.replace("1.0 * h_lex", "1.8 * h_lex").replace("0.8 * h_tok", "1.4 * h_tok"), 11.2),
    }
    typed = lambda sums: re.sub(r"([0-9.]+) \*", r"\1::DOUBLE *", sums)
    scores = ", ".join(f"{{weights: '{name}', s: round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({typed(sums)}) / {total}::DOUBLE)), 9)}}" for name, (sums, total) in sets.items())
    return on_profile(
        f"""SELECT weights, kind, cut, documents, characters, round(mean_score, 6) AS mean_score, pii_hits, round(objective, 6) AS objective, kind = 'threshold' AND row_number() OVER (PARTITION BY weights, kind ORDER BY objective DESC, cut) = 1 AS best FROM (
  SELECT *, round(mean_score * documents / (SELECT count(*) FROM q) - 0.02 * pii_hits, 9) AS objective FROM (
    SELECT weights, kind, cut, count(*) FILTER (hit) AS documents, coalesce(sum(n) FILTER (hit), 0)::BIGINT AS characters, coalesce(avg(s) FILTER (hit), 0) AS mean_score, coalesce(sum(hits) FILTER (hit), 0)::BIGINT AS pii_hits FROM (
      SELECT *, CASE WHEN kind = 'threshold' THEN s >= cut ELSE r <= ceil((SELECT count(*) FROM q) * cut) END AS hit FROM (
        SELECT weights, s, n, hits, row_number() OVER (PARTITION BY weights ORDER BY s DESC, doc_id) AS r FROM (SELECT doc_id, n_len AS n, q_email + q_phone + q_id AS hits, unnest([{scores}], recursive := true) FROM q)
      ) CROSS JOIN (SELECT 'threshold' AS kind, unnest([0.74, 0.76, 0.78, 0.80, 0.82, 0.84, 0.86]::DOUBLE[]) AS cut UNION ALL SELECT 'ratio', unnest([0.25, 0.50, 0.75]::DOUBLE[])))
    GROUP BY ALL))""",
        ENTROPY,
    )


_add("hdqs_sweep", _on_docs(lambda df: _rounded(pipeline.sweep(df), "mean_score", "objective")), _sweep_sql())
_add("ablation_variants", _on_docs(lambda df: _rounded(pipeline.ablation(df), "mean_hdqs")))
_add("pipeline_orders", _on_docs(lambda df: _rounded(pipeline.order_report(df), "mean_hdqs", "retention")))
_add(
    "fixed_chunks",
    _on_docs(lambda df: pipeline.chunks(df).select("doc_id", "chunk", "text")),
    r"SELECT doc_id, (unnest(range(0, len(c))))::INT AS chunk, unnest(c) AS text FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(13) || chr(10), chr(10)), '(?s).{1,360}') AS c FROM documents)",
)
_add(
    "equal_budget",
    _on_docs(lambda df: pipeline.equal_budget(df, "lang")),
    "WITH n AS (SELECT lang, doc_id, length(text) AS n FROM documents), b AS (SELECT min(t) AS b FROM (SELECT sum(n) + 2 * (count(*) - 1) AS t FROM n GROUP BY lang)), s AS (SELECT *, sum(n + 2) OVER (PARTITION BY lang ORDER BY doc_id) - n - 2 AS st FROM n) SELECT lang, doc_id, greatest(0, least(n, b - st))::BIGINT AS take FROM s CROSS JOIN b",
)
_add(
    "training_blocks",
    _on_docs(lambda df: pipeline.training_blocks(df).select("doc_id", "block", F.md5(F.concat_ws(" ", "tokens")).alias("tokens_md5"))),
    f"WITH t AS (SELECT doc_id, {_TOK} AS k FROM documents), b AS (SELECT doc_id, k, unnest(range(0, len(k) - 64)) AS block FROM t WHERE len(k) > 64) SELECT doc_id, block::INT AS block, md5(array_to_string(k[block + 1:block + 65], ' ')) AS tokens_md5 FROM b",
)
_add(
    "cooccurrence_ppmi",
    lambda spark, d: _rounded(pipeline.cooccurrence(_docs(spark, d)), "ppmi"),
    f"""WITH t AS (SELECT {_TOK} AS k FROM documents), o AS (SELECT k[i] AS a, k[i + w] AS b FROM (SELECT k, w, unnest(range(1, len(k) - w + 1)) AS i FROM t CROSS JOIN (SELECT unnest([1, 2]) AS w))),
c AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM o UNION ALL SELECT b, a FROM o) GROUP BY ALL), l AS (SELECT a, sum(n) AS na FROM c GROUP BY a), s AS (SELECT sum(n)::DOUBLE AS al FROM c)
SELECT c.a, c.b, n, round(greatest(0, log2(n * al / (l.na * r.na))), 6) AS ppmi FROM c JOIN l ON l.a = c.a JOIN l r ON r.a = c.b CROSS JOIN s""",
)


# --- comparisons of methods

_add("lm_metrics", lambda spark, d: _rounded(evaluation.lm_metrics(_events(spark, d).withColumn("nll", F.col("value") / 100), "event_type", "nll"), "mean_nll", "perplexity"), "SELECT event_type, count(value) AS n, round(avg(value / 100), 6) AS mean_nll, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY event_type")
_PAIRED = f"WITH p AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL), x AS (SELECT p.event_type, b.v - p.v AS d FROM p JOIN p b ON b.user_id = p.user_id AND b.event_type = 'click' WHERE p.event_type <> 'click'), s AS (SELECT event_type, {_CI_SQL}, mean > 0 AS positive_mean_improvement FROM (SELECT event_type, count(d) AS n, avg(d) AS mean, coalesce(stddev_samp(d), 0) AS std FROM x GROUP BY event_type))"
_add("registry_significance", lambda spark, d: _rounded(evaluation.significance(_events(spark, d), "event_type", "user_id", "value", "click"), *_CI), _PAIRED + " SELECT *, CASE WHEN n < 3 THEN 'insufficient_pairs' WHEN ci95_low > 0 THEN 'improvement' WHEN ci95_high < 0 THEN 'regression' ELSE 'inconclusive' END AS status FROM s")
_add("seed_sets", lambda spark, d: evaluation.seed_sets(_events(spark, d), "event_type", "user_id", "click"), "WITH s AS (SELECT event_type, list_sort(list(DISTINCT user_id)) AS l FROM events GROUP BY event_type) SELECT event_type, l = (SELECT l FROM s WHERE event_type = 'click') AS same_seeds FROM s")
_add(
    "cross_dataset_audit",
    lambda spark, d: _rounded(evaluation.audit(_events(spark, d).withColumn("day", F.to_date("ts").cast("string")), "day", "event_type", "value", "click"), "mean", "ratio"),
    "WITH m AS (SELECT ts::DATE::VARCHAR AS day, event_type, avg(value) AS mean FROM events GROUP BY ALL) SELECT m.day, m.event_type, round(m.mean, 6) AS mean, round(m.mean / b.mean, 6) AS ratio, CASE WHEN b.mean IS NULL THEN 'no_baseline' WHEN m.event_type = 'click' THEN 'baseline' WHEN m.mean / b.mean < 1 THEN 'better' ELSE 'not_better' END AS verdict FROM m LEFT JOIN m b ON b.day = m.day AND b.event_type = 'click'",
)
_MECH = ["document_keep_rate", "token_keep_rate", "vocabulary_keep_rate", "source_keep_rate"]
_add(
    "overfiltering",
    _on_docs(lambda df: _rounded(evaluation.mechanism(df, pipeline.kept(df, filters.length_filter(df, 32, 2048))), *_MECH)),
    f"""WITH d AS (SELECT *, {_W} BETWEEN 32 AND 2048 AS keep, {_TOK} AS toks FROM documents), t AS (SELECT keep, unnest(toks) AS t FROM d)
SELECT round(count(*) FILTER (keep) / count(*), 6) AS document_keep_rate, round(sum(len(toks)) FILTER (keep) / sum(len(toks)), 6) AS token_keep_rate, round((SELECT count(DISTINCT t) FILTER (keep) / count(DISTINCT t) FROM t), 6) AS vocabulary_keep_rate,
round(count(DISTINCT source) FILTER (keep) / count(DISTINCT source), 6) AS source_keep_rate, count(*) FILTER (keep) / count(*) < 0.7 AS overfiltered FROM d""",
)
_JS = [f"{what}_js_selected_vs_{other}" for what in ("token", "length") for other in ("raw", "dev")]
_CALIBRATION_SQL = f"""WITH d AS (SELECT doc_id, {_W} BETWEEN 32 AND 2048 AS keep, {_TOK} AS k FROM documents),
c AS (SELECT 'raw' AS c, doc_id, k FROM d UNION ALL SELECT 'selected', doc_id, k FROM d WHERE keep UNION ALL SELECT 'dev', item_id, {_TOK} FROM benchmark),
u AS (SELECT c, doc_id, unnest(k) AS t, unnest(range(0, len(k))) AS i FROM c), g AS (SELECT c, t, count(*) AS x, min(struct_pack(d := doc_id, i := i)) AS f FROM u GROUP BY ALL),
tops AS (SELECT c, 'token' AS what, t, x FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY x DESC, f) AS r FROM g) WHERE r <= 5000
  UNION ALL SELECT c, 'length', (CASE {' '.join(f"WHEN len(k) < {b} THEN '{a}-{b}'" for a, b in zip(analysis.BINS, analysis.BINS[1:]))} END), count(*) FROM c GROUP BY ALL),
o AS (SELECT unnest(['raw', 'dev']) AS other), b AS (SELECT other, what, t, sum(x) FILTER (c = 'selected') AS x, sum(x) FILTER (c = other) AS y FROM tops JOIN o ON c = 'selected' OR c = other GROUP BY ALL),
s AS (SELECT other, what, count(*) AS v, sum(x) AS nx, sum(y) AS ny FROM b GROUP BY ALL),
f AS (SELECT other, what, (coalesce(x, 0) + 1e-9) / (nx + 1e-9 * v) AS p, (coalesce(y, 0) + 1e-9) / (ny + 1e-9 * v) AS q FROM b JOIN s USING (other, what)),
j AS (SELECT other, what, 0.5 * (sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2)))) AS js FROM f GROUP BY ALL)
SELECT {', '.join(f"round(max(js) FILTER (what = '{x.split('_')[0]}' AND other = '{x.split('_')[-1]}'), 6) AS {x}" for x in _JS)}, (SELECT round(count(*) FILTER (keep) / count(*), 6) FROM d) AS retention_rate FROM j"""
_add(
    "calibration_objective",
    lambda spark, d: _rounded(evaluation.calibration(_docs(spark, d), pipeline.kept(_docs(spark, d), filters.length_filter(_docs(spark, d), 32, 2048)), _table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")), *_JS, "retention_rate"),
    _CALIBRATION_SQL,
)
_add("split_overlap", _on_docs(lambda df: evaluation.split_overlap(df.withColumn("split", _split()), "split")), f"WITH h AS (SELECT DISTINCT {_SPLIT_SQL} AS split, sha256({_NORM}) AS hash FROM documents) SELECT x.split AS a, y.split AS b, count(*) AS shared FROM h x JOIN h y ON x.hash = y.hash AND x.split < y.split GROUP BY ALL")
_add(
    "turn_overlap",
    lambda spark, d: _rounded(_turns(spark, d).select("conv_id", "turn", evaluation.lcs_f1(F.col("text"), F.col("next")).alias("lcs_f1")), "lcs_f1"),
)
_add(
    "turn_paraphrase",
    lambda spark, d: _rounded(_turns(spark, d).select("conv_id", "turn", *[c.alias(n) for n, c in evaluation.paraphrase(F.col("text"), F.col("next")).items()]), "jaccard"),
    """WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda v: v <> '')) AS x, list_distinct(list_filter(string_split_regex(lower(coalesce(next, '')), '\\s+'), lambda v: v <> '')) AS y FROM t WHERE next IS NOT NULL),
n AS (SELECT *, len(list_intersect(x, y)) AS k FROM w)
SELECT conv_id, turn, round(k / greatest(1, len(x) + len(y) - k), 6) AS jaccard, abs(len(x) - len(y))::INT AS size_difference, k = len(x) + len(y) - k AS same_words FROM n""",
)
_add(
    "component_means",
    _on_docs(lambda df: _rounded(scoring.components(df).groupBy("source").agg(*[F.avg(f"h_{k}").alias(k) for k in formulas.HDQS]), *formulas.HDQS)),
    on_profile("SELECT source, " + ", ".join(f"round(avg(h_{k}), 6) AS {k}" for k in formulas.HDQS) + " FROM q GROUP BY source", ENTROPY),
)


def _turns(spark, d) -> DataFrame:
    """Each turn with the next of its conversation."""
    c = _table(spark, d, "conversations")
    return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])


# --- curricula, selections and numeric methods

_scored = lambda df: scoring.hdqs(df).select("doc_id", F.round("score", 9).alias("score"))
for _name in select.STRATEGIES:
    if _name == "random_baseline":
        _order = "sha256('23:' || doc_id)"
    else:
        _order = {"high": "s DESC, doc_id", "easy": "s DESC, doc_id", "low_": "s, doc_id DESC", "hard": "s, doc_id DESC"}.get(_name[:4], "")
    _sql = on_profile(f"SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY {_order}) - 1 AS position, count(*) OVER () AS n FROM (SELECT doc_id, round({_HDQS_SCORE}, 9) AS s FROM q)) WHERE position < round_even(n * 0.75::DOUBLE, 0)", ENTROPY) if _order else None
    _add(f"curriculum_{_name}", _on_docs(lambda df, n=_name: select.curriculum(_scored(df), n).select("doc_id", "position")), _sql)
_add("select_hdqs_v3", _on_docs(lambda df: select.select_v3_variant(df).select("doc_id", "keep")))
_add(
    "truncate_by_budget",
    _on_docs(lambda df: select.truncate_by_budget(df.select("doc_id", "text"), 100, 50_000, 400_000).select("doc_id", F.sha2("text", 256).alias("text_sha256"))),
    rf"""SELECT doc_id, sha256(text) AS text_sha256 FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS i, sum(len(regexp_extract_all(text, '{X.WORD}+|[^\p{{L}}\p{{N}}_\s]'))) OVER (ORDER BY doc_id) AS t, sum(strlen(text)) OVER (ORDER BY doc_id) AS b FROM documents)
WHERE i <= 100 AND t <= 50000 AND b <= 400000""",
)
_add(
    "cloze_examples",
    _on_docs(lambda df: df.select("doc_id", X.tokens(X.text()).alias("t")).where(F.size("t") >= 64).select("doc_id", F.array_join(F.slice("t", 1, 48), " ").alias("prompt"), F.array_join(F.slice("t", 49, 16), " ").alias("target"))),
    f"SELECT doc_id, array_to_string(t[1:48], ' ') AS prompt, array_to_string(t[49:64], ' ') AS target FROM (SELECT doc_id, {_TOK} AS t FROM documents) WHERE len(t) >= 64",
)
_add(
    "knn",
    lambda spark, d: _rounded(ml.nearest(_table(spark, d, "embeddings"), _table(spark, d, "embeddings").where("vec_id % 50 = 0"), 5).select("query", "neighbour", "rank", "distance"), "distance"),
    """SELECT query, neighbour, rank::INT AS rank, round(distance, 6) AS distance FROM (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
)
_add("kmeans", lambda spark, d: ml.kmeans(_table(spark, d, "embeddings"), "embedding", 10).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters")))
_add("pca", lambda spark, d: ml.pca(_table(spark, d, "embeddings"), "embedding", 4).select("vec_id", F.transform("components", lambda c: F.round(F.abs(c), 4)).alias("components")))
_add(
    "linear_fit",
    _on_docs(lambda df: _rounded(ml.linear_fit(X.profile(df), "n_tok", "n_len"), "slope", "intercept", "r2")),
    on_profile("SELECT round(regr_slope(n_len, n_tok), 6) AS slope, round(regr_intercept(n_len, n_tok), 6) AS intercept, round(regr_r2(n_len, n_tok), 6) AS r2 FROM r"),
)
_add(
    "anomaly_density",
    lambda spark, d: _rounded(ml.anomaly(_table(spark, d, "lineitem"), ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "log_density"), "log_density"),
    """WITH s AS (SELECT avg(l_quantity) AS m, var_pop(l_quantity) AS v, avg(l_discount) AS n, var_pop(l_discount) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, round(-pow(l_quantity - m, 2) / (2 * v) - 0.5 * ln(2 * pi() * v) - pow(l_discount - n, 2) / (2 * w) - 0.5 * ln(2 * pi() * w), 6) AS log_density FROM lineitem, s""",
)
_add(
    "conversation_tokens",
    lambda spark, d: _table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.size(X.tokens(X.text()))).alias("tokens"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles")),
    f"SELECT conv_id, count(*) AS turns, sum(len({_TOK}))::BIGINT AS tokens, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id",
)


def queries() -> dict:
    from . import more  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more  # noqa: F401

    return dict(_SQL)
