"""More named queries: greedy walks, variants and reports, with recursive SQL where an oracle has to walk too."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import counters, formulas
from ..functions import textexpr as X
from ..functions.formulas import duckdb
from ..operators import analysis, dedup, evaluation, filters, index, matrix, ml, pipeline, reports, scoring, select, urd
from ..operators.storage import shared_dir
from .oracle import ENTROPY, on_profile
from .registry import _BIN_SQL, _BINS_SQL, _BUDGET, _FOLDED, _HDQS_SCORE, _LOCAL_SQL, _NORM, _PAIRED, _REDACT_SQL, _SPLIT_SQL, _TOK, _URD_SQL, _W, _add, _docs, _events, _on_docs, _pairs_sql, _r, _rounded, _split, _table, _words

# --- greedy walks


def _walk(kind: str, pairs: str) -> str:
    """CTEs after pairs (a, b, similarity): kept has the ids that no lesser kept id is linked to."""
    return f""", nb AS (SELECT b AS id, list(a) AS l FROM {pairs} GROUP BY b), nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT a AS id FROM {pairs} UNION SELECT b FROM {pairs})),
g(i, kept) AS (SELECT 0::BIGINT, []::{kind}[] UNION ALL SELECT n.i, CASE WHEN len(list_intersect(g.kept, coalesce(nb.l, []::{kind}[]))) > 0 THEN g.kept ELSE list_append(g.kept, n.id) END
  FROM g JOIN nodes n ON n.i = g.i + 1 LEFT JOIN nb ON nb.id = n.id),
kept AS (SELECT unnest(kept) AS id FROM g WHERE i = (SELECT max(i) FROM g))
"""


_add(
    "near_dedup_greedy",
    _on_docs(lambda df: _rounded(dedup.near_dedup(df), "similarity")),
    _pairs_sql(_TOK, 0.82).replace("WITH t AS", "WITH RECURSIVE t AS", 1) + _walk("BIGINT", "pairs")
    + "SELECT b AS member, min(a) AS representative, round(arg_min(similarity, a), 6) AS similarity FROM pairs WHERE a IN (SELECT id FROM kept) AND b NOT IN (SELECT id FROM kept) GROUP BY b",
)
_add(
    "minhash_near_dedup",
    _on_docs(lambda df: _rounded(dedup.minhash_filter(df), "score")),
    _pairs_sql(_FOLDED, 0.86).replace("WITH t AS", "WITH RECURSIVE t AS", 1)
    + ", named AS (SELECT least(a::VARCHAR, b::VARCHAR) AS a, greatest(a::VARCHAR, b::VARCHAR) AS b, similarity FROM pairs)" + _walk("VARCHAR", "named")
    + """, gone AS (SELECT b AS id, max(similarity) AS best FROM named WHERE a IN (SELECT id FROM kept) AND b NOT IN (SELECT id FROM kept) GROUP BY b)
SELECT doc_id::VARCHAR AS doc_id, best IS NULL AS keep, round(1 - coalesce(best, 0), 6) AS score, CASE WHEN best IS NULL THEN 'no_near_duplicate' ELSE 'near_duplicate' END AS reason FROM documents LEFT JOIN gone ON gone.id = doc_id::VARCHAR""",
)
_WALK_BUDGET = """n AS MATERIALIZED (SELECT doc_id, {w}::BIGINT AS n, row_number() OVER (ORDER BY sha256('42:' || doc_id)) AS i FROM documents),
g(i, doc_id, left_, take) AS (SELECT 0::BIGINT, NULL::BIGINT, ({budget})::BIGINT, false UNION ALL SELECT n.i, n.doc_id, CASE WHEN n.n <= g.left_ THEN g.left_ - n.n ELSE g.left_ END, n.n <= g.left_ FROM g JOIN n ON n.i = g.i + 1)"""
_add("first_fit_budget", _on_docs(lambda df: select.first_fit(_words(df).withColumn("h", select.sha_rank(42)), "n", _BUDGET, "h")), "WITH RECURSIVE " + _WALK_BUDGET.format(w=_W, budget=_BUDGET) + " SELECT doc_id FROM g WHERE take")


def _matched(spark, d):
    n = _words(_docs(spark, d))
    target = n.where(F.col("n").between(32, 2048)).agg(F.sum("n")).head()[0] or 0
    return select.random_matched(n, "n", target).select("doc_id", "keep")


_add("random_token_matched", _matched, "WITH RECURSIVE " + _WALK_BUDGET.format(w=_W, budget=f"SELECT sum({_W}) FROM documents WHERE {_W} BETWEEN 32 AND 2048") + " SELECT doc_id, take AS keep FROM g WHERE i > 0")
_add(
    "embedding_diversity_proxy",
    _on_docs(lambda df: _rounded(select.farthest_first(df, 0.25), "score")),
    f"""WITH RECURSIVE t AS (SELECT doc_id AS id, list_distinct({_TOK}) AS s FROM documents), w AS (SELECT id, len(s) AS n, unnest(s) AS t FROM t),
j AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) / (x.n + y.n - count(*)) AS sim FROM w x JOIN w y ON x.t = y.t GROUP BY x.id, y.id, x.n, y.n UNION ALL SELECT x.id, y.id, 1.0 FROM t x JOIN t y ON len(x.s) = 0 AND len(y.s) = 0),
f(step, id, d, keep) AS (
  SELECT 1, t.id, CASE WHEN t.id = m.id THEN 2.0::DOUBLE ELSE 1 - coalesce(j.sim, 0) END, t.id = m.id FROM t CROSS JOIN (SELECT min(id) AS id FROM t) m LEFT JOIN j ON j.a = t.id AND j.b = m.id
  UNION ALL
  SELECT f.step + 1, f.id, CASE WHEN f.keep OR f.id = p.id THEN f.d ELSE least(f.d, 1 - coalesce(j.sim, 0)) END, f.keep OR f.id = p.id
  FROM f CROSS JOIN (SELECT id FROM f WHERE NOT keep ORDER BY d DESC, id LIMIT 1) p LEFT JOIN j ON j.a = f.id AND j.b = p.id WHERE f.step < greatest(1, ceil((SELECT count(*) FROM t) * 0.25::DOUBLE)))
SELECT id AS doc_id, keep, round(CASE WHEN d > 1 THEN 1.0 ELSE d END, 6) AS score, 'embedding_diversity_proxy' AS reason FROM f WHERE step = (SELECT max(step) FROM f)""",
)
_NINE = ", ".join(f"round({c}, 9) AS {c}" for c in ("utility_score", "diversity_score", "risk_score", "shift_penalty", "cost_score", "urd_score"))
_add(
    "urd_pareto",
    _on_docs(lambda df: urd.select_pareto(df, 0.6).select("doc_id", "keep", "reason")),
    on_profile(
        _URD_SQL
        + f""", z AS MATERIALIZED (SELECT doc_id, {_NINE} FROM w),
dom AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM z x JOIN z y ON x.utility_score >= y.utility_score AND x.diversity_score >= y.diversity_score AND x.risk_score <= y.risk_score AND x.shift_penalty <= y.shift_penalty AND x.cost_score <= y.cost_score
  AND (x.utility_score > y.utility_score OR x.diversity_score > y.diversity_score OR x.risk_score < y.risk_score OR x.shift_penalty < y.shift_penalty OR x.cost_score < y.cost_score)),
lv(k, id) AS (SELECT 0, doc_id FROM z UNION SELECT k + 1, d.b FROM lv JOIN dom d ON d.a = lv.id),
rk AS (SELECT id, max(k) AS layer FROM lv GROUP BY id),
o AS (SELECT doc_id, row_number() OVER (ORDER BY layer, urd_score DESC, doc_id::VARCHAR) <= ceil((SELECT count(*) FROM z) * 0.6::DOUBLE) AS keep FROM z JOIN rk ON rk.id = z.doc_id)
SELECT doc_id, keep, CASE WHEN keep THEN 'urd_pareto_selected' ELSE 'urd_pareto_rejected_by_rank_risk_or_budget' END AS reason FROM o""",
        ENTROPY,
    ).replace("\n, tc AS", ", tc AS", 1).replace("WITH", "WITH RECURSIVE", 1),
)

# --- selection

for _ties, _order in (("first", "doc_id"), ("largest", "doc_id DESC")):
    _add(
        f"local_top_fraction_{_ties}",
        _on_docs(lambda df, t=_ties: select.local_top_fraction(df.select("doc_id", F.floor(F.char_length(X.text()) / 100).alias("score")), 0.333, t).select("doc_id", "keep")),
        f"SELECT doc_id, row_number() OVER (ORDER BY length(text) // 100 DESC, {_order}) <= greatest(1, floor((SELECT count(*) FROM documents) * 0.333::DOUBLE)) AS keep FROM documents",
    )
_add(
    "deterministic_split",
    _on_docs(lambda df: select.deterministic_split(df.select("doc_id")).select("doc_id", "split")),
    "WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('13:' || doc_id)) AS r, count(*) OVER () AS n FROM documents), c AS (SELECT *, floor(n * 0.8::DOUBLE) AS a, floor(n * 0.1::DOUBLE) AS b FROM k) SELECT doc_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + CASE WHEN n >= 3 AND b = 0 THEN 1 ELSE b END THEN 'dev' ELSE 'test' END AS split FROM c",
)
for _name in ("quality_stratified_sampling", "mixed_quality_curriculum"):
    _place = "least(n - 1, CASE WHEN r < n // 2 THEN 2 * r ELSE 2 * (n - 1 - r) + 1 END)"
    _add(
        f"curriculum_{_name}",
        _on_docs(lambda df, m=_name: select.curriculum(scoring.hdqs(df).select("doc_id", F.round("score", 9).alias("score")), m).select("doc_id", "position")),
        on_profile(f"SELECT doc_id, position FROM (SELECT doc_id, n, ({_place if _name[0] == 'q' else f'n - 1 - {_place}'})::BIGINT AS position FROM (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT doc_id, round({_HDQS_SCORE}, 9) AS s FROM q))) WHERE position < round_even(n * 0.75::DOUBLE, 0)", ENTROPY),
    )

# --- variants of the second and third score

_V2_SQL = f""", {_BINS_SQL}, ps AS (SELECT doc_id, unnest(toks) AS t, unnest(range(0, len(toks))) AS i FROM p),
top AS (SELECT t FROM (SELECT t, count(*) AS c, min(struct_pack(d := doc_id, i := i)) AS f FROM ps GROUP BY t) ORDER BY c DESC, f LIMIT 1500),
hv AS (SELECT doc_id, count(*) AS k FROM ps JOIN top USING (t) GROUP BY doc_id),
x AS (SELECT q.*, {duckdb(formulas.weighted(formulas.WEIGHTS["hdqs_v2"], "h_"))} AS base_quality, coalesce(k, 0) / greatest(1, n_tok) AS token_frequency_preservation FROM q LEFT JOIN hv ON hv.doc_id = q.doc_id),
y AS (SELECT *, 0.75::DOUBLE + 0.25::DOUBLE * least(1.0, ln(1 + n_tok) / ln(1201)) AS length_distribution_match, 0.5::DOUBLE * base_quality + 0.25::DOUBLE * least(1.0, token_entropy_bits / 8) + 0.25::DOUBLE * n_uniq / greatest(1, n_tok) AS quality_diversity_balance,
  greatest(0.45::DOUBLE, n_bigrams / greatest(1, n_tok - 1)) AS repetition_capped FROM x)"""
_V3_SQL = f""", {_BINS_SQL}, g AS (SELECT *, a[1 + n // 2] AS mid, a[1 + floor(0.1::DOUBLE * (n - 1))::INT] AS lo, a[1 + floor(0.9::DOUBLE * (n - 1))::INT] AS hi FROM e4),
x AS (SELECT q.*, mid, lo, hi, {duckdb(formulas.weighted(formulas.WEIGHTS["hdqs_v3"], "h_"))} AS base_quality FROM q CROSS JOIN g),
y AS (SELECT *, 0.5::DOUBLE * base_quality + 0.25::DOUBLE * least(1.0, token_entropy_bits / 8) + 0.25::DOUBLE * n_uniq / greatest(1, n_tok) AS quality_diversity_balance, greatest(0.5::DOUBLE, n_bigrams / greatest(1, n_tok - 1)) AS repetition_capped,
  greatest(0.0, least(1.0, 1 - 0.5::DOUBLE * abs(ln(1 + n_tok) - ln(1 + mid)) / greatest(1.0, ln(1 + hi) - ln(1 + lo)))) AS length_guardrail FROM x)"""


def _scores_of(score, weights: dict, variants: dict):
    """(doc_id, a score for each variant): the terms are computed once, as a variant changes their weights only."""

    def run(spark, d):
        rows = score(_docs(spark, d))
        return _rounded(rows.select("doc_id", *[F.expr(formulas.spark(scoring.variant_score(weights, v.get("off", ())))).alias(k) for k, v in variants.items()]), *variants)

    return run


def _scores_sql(ctes: str, weights: dict, variants: dict) -> str:
    cols = ", ".join(_r(duckdb(scoring.variant_score(weights, v.get("off", ()))), k) for k, v in variants.items())
    return on_profile(f"{ctes} SELECT doc_id, {cols} FROM y", ENTROPY).replace("\n, sl AS", ", sl AS", 1)


_add("hdqs_v2_variants", _scores_of(scoring.hdqs_v2, scoring.V2, scoring.V2_VARIANTS), _scores_sql(_V2_SQL, scoring.V2, scoring.V2_VARIANTS))
_add("hdqs_v3_variants", _scores_of(scoring.hdqs_v3, scoring.V3, scoring.V3_VARIANTS), _scores_sql(_V3_SQL, scoring.V3, scoring.V3_VARIANTS))


def _quota_ctes(name: str, off: tuple[str, ...] = ()) -> str:
    """name (doc_id, keep) after y: each length bin's share of 85 % by score, filled up or cut by score."""
    return f""", {name}_b AS (SELECT doc_id, round({duckdb(scoring.variant_score(scoring.V2, off))}, 9) AS s, {_BIN_SQL} AS bin FROM y CROSS JOIN e4),
{name}_n AS (SELECT *, count(*) OVER () AS n, greatest(1, ceil(count(*) OVER () * 0.85::DOUBLE)) AS k, count(*) OVER (PARTITION BY bin) AS c, row_number() OVER (PARTITION BY bin ORDER BY s DESC, doc_id) AS r FROM {name}_b),
{name} AS (SELECT doc_id, row_number() OVER (ORDER BY r <= greatest(1, round_even(c * k / n, 0)) DESC, s DESC, doc_id) <= k AS keep FROM {name}_n)"""


_add("select_hdqs_v2", _on_docs(lambda df: select.select_v2_variant(df).select("doc_id", "keep")), on_profile(f"{_V2_SQL}{_quota_ctes('v2')} SELECT doc_id, keep FROM v2", ENTROPY).replace("\n, sl AS", ", sl AS", 1))
_RANKED = {"length_filter": "n_len", "c4_gopher_heuristic": "heuristic_quality", "perplexity_quality_ngram": "ngram_proxy", "independent_quality_score": "independent_quality"}
_KEPT_SQL = {n: f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY round({duckdb(formulas.BASELINES.get(c, c))}, 9) DESC, doc_id) <= ceil((SELECT count(*) FROM q) * 0.7::DOUBLE) AS keep FROM q) WHERE keep" for n, c in _RANKED.items()} | {
    "hdqspp": f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY round({_HDQS_SCORE}, 9) DESC, doc_id) <= ceil((SELECT count(*) FROM q) * 0.7::DOUBLE) AS keep FROM q) WHERE keep",
    "raw": "SELECT doc_id FROM q",
    "dedup_only": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "random_same_keep_rate": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id)) <= ceil((SELECT count(*) FROM documents) * 0.7::DOUBLE) AS keep FROM documents) WHERE keep",
    "hdqspp_v2": "SELECT doc_id FROM v2 WHERE keep",
    "hdqspp_v2_no_token_frequency": "SELECT doc_id FROM v2t WHERE keep",
    "optional_external_wrapper": "SELECT doc_id FROM q WHERE false",
}
_add(
    "baseline_suite",
    _on_docs(lambda df: pipeline.baseline_suite(df, names=tuple(_KEPT_SQL))),
    on_profile(
        f"{_V2_SQL}{_quota_ctes('v2')}{_quota_ctes('v2t', ('token_frequency_preservation',))}, m AS (SELECT doc_id, len(regexp_extract_all(text, '{X.WORD}+|[^\\p{{L}}\\p{{N}}_\\s]')) AS tokens, q_email + q_phone + q_id AS pii FROM q) "
        + " UNION ALL ".join(
            f"SELECT '{n}' AS name, count(*) AS output_documents, coalesce(sum(tokens), 0)::BIGINT AS output_tokens, coalesce(sum(pii), 0)::BIGINT AS pii_after, {'true' if n == 'optional_external_wrapper' else 'false'} AS skipped FROM m WHERE doc_id IN ({k})" for n, k in _KEPT_SQL.items()
        ),
        ENTROPY,
    ).replace("\n, sl AS", ", sl AS", 1),
)
_add("baseline_hdqs_v3", _on_docs(lambda df: pipeline.baseline_suite(df, names=("hdqspp_v3",))))  # a draw by a hash that SQL lacks

# --- controlled noise


def _noise_sql() -> str:
    """pipeline.noise as a chain of CTEs, a step for each family."""
    steps, last = ["b0 AS (SELECT doc_id AS i, coalesce(text, '') AS text FROM documents)"], "b0"

    def step(expr: str) -> None:
        nonlocal last
        steps.append(f"b{len(steps)} AS (SELECT i, {expr} AS text FROM {last})")
        last = f"b{len(steps) - 1}"

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for name, (every, rest, before, after) in pipeline.NOISE.items():
        if name == "mojibake":
            for old, new in (("the", "tbe"), ("ing", "1ng")):
                step(f"CASE WHEN i % 9 = 0 AND instr(text, '{old}') > 0 THEN left(text, instr(text, '{old}') - 1) || '{new}' || substr(text, instr(text, '{old}') + 3) ELSE text END")
        added = f"replace(replace(replace({quoted(after)}, '{{i}}', i::VARCHAR), '{{p}}', printf('%04d', i + 1000)), '{{j}}', printf('%04d', i))"
        step(f"CASE WHEN i % {every} = {rest} THEN {quoted(before)} || text || {added} ELSE text END")
    rows = [f"SELECT i, 'document' AS kind, text FROM {last}", f"SELECT i, 'exact_duplicates', text FROM {last} WHERE i % 5 = 0", f"SELECT i, 'near_duplicates', text || ' updated' FROM {last} WHERE i % 8 = 0"]
    rows += [f"SELECT i, '{n}', trim(repeat('{phrase}', (({times} + i % {more}))::INT)) FROM b0 WHERE i % {every} = 0" for n, (every, phrase, times, more) in pipeline.EXTRA.items()]
    return f"WITH {', '.join(steps)} SELECT i AS doc_id, kind, sha256(text) AS text_sha256 FROM ({' UNION ALL '.join(rows)})"


_add("noise_injection", _on_docs(lambda df: pipeline.noise(df).select("doc_id", "kind", F.sha2("text", 256).alias("text_sha256"))), _noise_sql())

_add("noise_counts", _on_docs(lambda df: pipeline.noise_counts(df)), "SELECT * FROM (SELECT f AS family, (SELECT count(*) FROM documents WHERE doc_id % e = r) AS n FROM (VALUES ('html_boilerplate', 3, 0), ('url_spam', 4, 0), ('pii_canaries', 7, 0), ('ocr_corruption', 9, 0), ('mojibake', 10, 0), ('repeated_ngrams', 11, 0), ('mixed_language', 13, 0), ('excessive_symbols', 6, 0), ('navigation_bars', 4, 1), ('footer_copyright', 5, 2), ('seo_keyword_stuffing', 6, 2), ('ad_blocks', 7, 3), ('cookie_banners', 8, 3), ('malformed_html', 9, 4), ('boilerplate_templates', 10, 4), ('multilingual_fragments', 11, 5), ('encoding_artifacts', 12, 5), ('exact_duplicates', 5, 0), ('near_duplicates', 8, 0), ('low_information_templates', 8, 0), ('generated_repetition', 12, 0), ('low_information_pages', 14, 0), ('repeated_template_pages', 15, 0)) t(f, e, r)) WHERE n > 0")


def _canaries(df):
    raw = pipeline.noise(df).where("kind = 'document'").select("doc_id", "text")
    done = raw.select("doc_id", pipeline.redact(X.text()).alias("text"))
    return _rounded(pipeline.canaries(raw, done, pipeline.canary_values(df)), "recall", "precision", "false_positive_rate", "exposure_bits")


_add(
    "canary_redaction",
    _on_docs(_canaries),
    _noise_sql().rsplit(" SELECT i AS doc_id", 1)[0]
    + f""", raw AS (SELECT text FROM b{_noise_sql().count(" AS (SELECT i, ")}), done AS (SELECT {_REDACT_SQL} AS text FROM raw),
v AS (SELECT unnest(['editor' || doc_id || '@example.org', '+1 412 555 ' || printf('%04d', doc_id + 1000), 'ID-13-' || printf('%04d', doc_id)]) AS value FROM documents WHERE doc_id % 7 = 0),
c AS (SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM raw WHERE contains(text, value))) AS b, count(*) FILTER (EXISTS (SELECT 1 FROM done WHERE contains(text, value))) AS a FROM v),
m AS (SELECT sum((length(text) - length(replace(replace(replace(text, '<EMAIL>', '123456'), '<PHONE>', '123456'), '<ID>', '123'))))::BIGINT AS k FROM done),
x AS (SELECT *, b - a AS removed, greatest(0, k - (b - a)) AS side FROM c, m)
SELECT n AS canaries, b AS detected_before, a AS residual_after, k AS placeholders, side AS side_effects, round(removed / greatest(1, b), 6) AS recall, round(removed / greatest(1, removed + side), 6) AS precision,
  round(side / greatest(1, k), 6) AS false_positive_rate, round(log2((b + 1) / (a + 1)), 6) AS exposure_bits, CASE WHEN a = 0 THEN 'no_residual_synthetic_canary_values' ELSE 'residual_synthetic_canary_values_detected' END AS status FROM x""",
)

# --- methods over data sets: the languages, one that isn't there, and one that something else stands in for


def _matrix(spark, d):
    df = _docs(spark, d)
    missing = lambda: spark.read.parquet(f"{d}/no-such-table.parquet")
    sets = {lang: matrix.Dataset(lambda lang=lang: df.where(F.col("lang") == lang)) for lang in ("de", "en", "es", "fr")}
    sets |= {"gone": matrix.Dataset(missing), "replaced": matrix.Dataset(missing, lambda: df.where("lang = 'en'")), "remote": matrix.Dataset(missing, lambda: df, optional=True)}
    methods = {"raw": lambda x: x, "length_filter": lambda x: pipeline.kept(x, filters.length_filter(x, 32, 2048))}
    return _rounded(matrix.run(spark, sets, methods, "full").drop("note"), "retention")


_add(
    "dataset_matrix",
    _matrix,
    f"""WITH k AS (SELECT unnest(['de', 'en', 'es', 'fr', 'replaced']) AS dataset), m AS (SELECT unnest(['raw', 'length_filter']) AS method), d AS (SELECT lang, length(coalesce(text, ''))::BIGINT AS n, {_W} BETWEEN 32 AND 2048 AS fits FROM documents),
s AS (SELECT dataset, method, count(lang) FILTER (method = 'raw' OR fits) AS documents, coalesce(sum(n) FILTER (method = 'raw' OR fits), 0)::BIGINT AS characters, coalesce(sum(n), 0) AS every FROM k CROSS JOIN m LEFT JOIN d ON lang = CASE dataset WHEN 'replaced' THEN 'en' ELSE dataset END GROUP BY ALL)
SELECT dataset, 'ok' AS status, dataset = 'replaced' AS used_fallback, method, documents, characters, round(characters / greatest(1, every), 6) AS retention FROM s
UNION ALL SELECT 'gone', 'error', false, NULL, NULL, NULL, NULL UNION ALL SELECT 'remote', 'fallback_recorded', true, NULL, NULL, NULL, NULL""",
)

# --- splits and the kept index


def _indexed(spark, d):
    """The documents added in three batches; the clusters don't depend on how they came."""
    df = _docs(spark, d)
    kept = index.MinHashIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    for k in (2, 0, 1):
        kept.add(df.where(F.col("doc_id") % 3 == k))
    return kept.clusters()


from .registry import _SQL as _ORACLES  # noqa: E402

_add("minhash_index_clusters", _indexed, _ORACLES["dup_components"])
_add(
    "split_token_pairs",
    _on_docs(lambda df: _rounded(dedup.split_token_pairs(df.withColumn("split", _split())), "similarity")),
    f"""WITH t AS (SELECT doc_id, {_FOLDED} AS w, {_SPLIT_SQL} AS split FROM documents), d AS (SELECT doc_id, split, list_sort(list_distinct(w)) AS s FROM t WHERE len(w) > 40),
l AS (SELECT min(doc_id) AS id, split, s FROM d GROUP BY split, s), v AS (SELECT id, split, len(s) AS n, unnest(s) AS v FROM l),
j AS (SELECT x.id AS a, y.id AS b, x.split AS a_split, y.split AS b_split, x.n AS n, y.n AS m, count(*) AS k FROM v x JOIN v y ON x.v = y.v AND x.id < y.id AND x.split <> y.split AND least(x.n, y.n) >= 0.98::DOUBLE * greatest(x.n, y.n) - 1e-9::DOUBLE GROUP BY ALL)
SELECT a, b, round(k / (n + m - k), 6) AS similarity, a_split, b_split FROM j WHERE k / (n + m - k) >= 0.98::DOUBLE""",
)
_add("novelty_estimate", _on_docs(lambda df: _rounded(urd.novelty_estimate(df), "novelty")))
_add(
    "split_near_pairs",
    _on_docs(lambda df: _rounded(dedup.split_near_pairs(df.withColumn("split", _split())), "similarity")),
    _pairs_sql(_FOLDED, 0.9)
    + f""", keys AS (SELECT doc_id, md5(string_agg(g, chr(31) ORDER BY g)) AS h FROM s GROUP BY doc_id), named AS (SELECT doc_id::VARCHAR AS id, h, {_SPLIT_SQL} AS split FROM keys),
leads AS (SELECT min(id) AS id, h, split FROM named GROUP BY h, split), p2 AS (SELECT a::VARCHAR AS a, b::VARCHAR AS b, similarity FROM pairs UNION ALL SELECT b::VARCHAR, a::VARCHAR, similarity FROM pairs),
firsts AS (SELECT h, min(id) AS id FROM leads GROUP BY h)
SELECT x.id AS a, y.id AS b, round(similarity, 6) AS similarity, x.split AS a_split, y.split AS b_split FROM p2 JOIN leads x ON x.id = p2.a JOIN leads y ON y.id = p2.b JOIN firsts fx ON fx.h = x.h JOIN firsts fy ON fy.h = y.h
WHERE x.id < y.id AND x.split <> y.split AND (x.h = y.h OR (x.id = fx.id AND y.id = fy.id))""",
)
_add("id_conflicts", lambda spark, d: dedup.id_conflicts(_table(spark, d, "conversations").withColumnRenamed("conv_id", "doc_id")), "SELECT conv_id AS doc_id, count(*) AS rows FROM conversations GROUP BY conv_id HAVING count(*) > 1")

# --- reports of filters

_lengths = lambda df: filters.length_filter(df, 32, 2048)
_add(
    "keep_rate_check",
    _on_docs(lambda df: _rounded(filters.summary(df, _lengths(df)).select("document_keep_rate", reports.keep_rate_check(F.col("document_keep_rate"), 0.5).alias("c")).select("document_keep_rate", "c.status", "c.difference"), "document_keep_rate", "difference")),
    f"SELECT round(a, 6) AS document_keep_rate, CASE WHEN abs(a - 0.5) <= 0.25 THEN 'passed' ELSE 'warning' END AS status, round(abs(a - 0.5), 6) AS difference FROM (SELECT count(*) FILTER ({_W} BETWEEN 32 AND 2048) / count(*) AS a FROM documents)",
)
_add(
    "cost_report",
    _on_docs(lambda df: reports.cost_report(df, _lengths(df)).drop("filter_runtime_seconds")),
    f"SELECT count(*) AS input_docs, count(*) FILTER ({_W} BETWEEN 32 AND 2048) AS kept_docs, count(*) AS estimated_operations, false AS external_dependency_used FROM documents",
)
_LOCAL_REPORT = ["mean_risk", "max_risk", "mean_diversity", "document_keep_rate", "token_keep_rate"]
_add(
    "local_report",
    _on_docs(lambda df: _rounded(reports.local_report(df, _lengths(df)), *_LOCAL_REPORT)),
    on_profile(
        f""", x AS (SELECT n_words, n_words BETWEEN 32 AND 2048 AS keep, {_LOCAL_SQL} FROM r)
SELECT count(*) AS input_documents, count(*) FILTER (keep) AS kept_documents, sum(n_words)::BIGINT AS source_tokens, sum(n_words) FILTER (keep)::BIGINT AS selected_tokens, round(avg(local_risk) FILTER (keep), 6) AS mean_risk, round(max(local_risk) FILTER (keep), 6) AS max_risk,
round(avg(local_diversity) FILTER (keep), 6) AS mean_diversity, round(kept_documents / input_documents, 6) AS document_keep_rate, round(selected_tokens / source_tokens, 6) AS token_keep_rate, count(*) AS filter_cost_units FROM x"""
    ).replace("\n, x AS", ", x AS", 1),
)
_PII_SQL = f"len(regexp_extract_all(text, '{X.EMAIL}')) + len(regexp_extract_all(text, '{X.PHONE}')) + len(regexp_extract_all(text, '{X.ID}'))"
_add(
    "dataset_card",
    _on_docs(lambda df: _rounded(reports.dataset_card(df, pipeline.kept(df, _lengths(df))), "retention_rate")),
    _pairs_sql(_TOK, 0.82).replace("WITH t AS", "WITH RECURSIVE t AS", 1) + _walk("BIGINT", "pairs")
    + f""", d AS (SELECT text, length(text) AS n, {_W} BETWEEN 32 AND 2048 AS keep, {_PII_SQL} AS pii FROM documents)
SELECT count(*) AS num_docs, count(*) FILTER (keep) AS retained_docs, sum(n)::BIGINT AS raw_chars, sum(n) FILTER (keep)::BIGINT AS retained_chars, round(sum(n) FILTER (keep) / sum(n), 6) AS retention_rate, count(*) - count(DISTINCT text) AS num_duplicates_removed,
(SELECT count(DISTINCT b) FROM pairs WHERE b NOT IN (SELECT id FROM kept)) AS num_near_duplicates_removed, sum(pii)::BIGINT AS pii_count_before, sum(pii) FILTER (keep)::BIGINT AS pii_count_after FROM d""",
)
_add(
    "removed_examples",
    _on_docs(lambda df: reports.removed(df, pipeline.apply(pipeline.kept(df, _lengths(df)), ("clean", "redact")), examples=5)),
    rf"""WITH c AS (SELECT doc_id, {_W} BETWEEN 32 AND 2048 AS keep, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), 'https?://\S+', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS t FROM documents),
e AS (SELECT doc_id, keep, regexp_replace(regexp_replace(regexp_replace(t, '{X.EMAIL}', '<EMAIL>', 'g'), '{X.PHONE}', '<PHONE>', 'g'), '{X.ID}', '<ID>', 'g') AS t FROM c)
SELECT doc_id, left(t, 180) AS excerpt FROM e WHERE t NOT IN (SELECT t FROM e WHERE keep) ORDER BY doc_id LIMIT 5""",
)
_FAIL = ["mean_token_count", "mean_token_diversity", "mean_repetition_rate", "mean_token_entropy"]
_add(
    "score_failure_summary",
    lambda spark, d: _rounded(reports.score_failures(_docs(spark, d), _table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id"), 0.7)[1].drop("score_loss_correlation"), *_FAIL),
    on_profile(
        f"""SELECT kept_by_hdqs, count(*) AS documents, round(avg(n_tok), 6) AS mean_token_count, round(avg(n_uniq / greatest(1, n_tok)), 6) AS mean_token_diversity, round(avg(1 - n_bigrams / greatest(1, n_tok - 1)), 6) AS mean_repetition_rate, round(avg(token_entropy_bits), 6) AS mean_token_entropy
FROM (SELECT *, row_number() OVER (ORDER BY round({_HDQS_SCORE}, 9) DESC, doc_id) <= greatest(1, round_even((SELECT count(*) FROM q) * 0.7::DOUBLE, 0)) AS kept_by_hdqs FROM q) GROUP BY kept_by_hdqs""",
        ENTROPY,
    ),
)

# --- reports of runs: events and languages stand in for methods and datasets

_add(
    "generation_repetition",
    lambda spark, d: _rounded(reports.generation_repetition(_table(spark, d, "conversations")).select("conv_id", "turn", "sample_characters", "repeated_trigrams", "repetition_rate"), "repetition_rate"),
    r"""WITH t AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM conversations),
g AS (SELECT *, CASE WHEN len(t) < 3 THEN 0 ELSE len(t) - 2 - len(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || chr(31) || t[i + 1] || chr(31) || t[i + 2]))) END AS k FROM t)
SELECT conv_id, turn, length(text)::INT AS sample_characters, k::INT AS repeated_trigrams, round(k / greatest(1, len(t) - 2), 6) AS repetition_rate FROM g""",
)
_runs = lambda spark, d: _events(spark, d).select(F.col("event_type").alias("variant"), F.col("user_id").alias("seed"), "value", F.lit(None).cast("string").alias("x"))


def _retention(spark, d):
    named = pipeline.compared(pipeline.variants(_docs(spark, d), ("raw_noisy_baseline", "clean_only", "pii_redact_only", "exact_dedup_only", "rule_filter_only")))
    runs = _events(spark, d).where("event_type = 'click'").select(F.lit("exact_dedup_only").alias("variant"), F.col("value").alias("perplexity"))
    return _rounded(reports.retention_rows(named, runs).where("variant in ('raw_noisy_baseline', 'exact_dedup_only', 'rule_filter_only')"), "retention_ratio", "mean_hdqs", "perplexity_mean")


_add(
    "retention_rows",
    _retention,
    on_profile(
        f""", k AS (SELECT *, {_HDQS_SCORE} AS s, n_words >= 5 AND symbol_ratio <= 0.25::DOUBLE AND unique_word_ratio >= 0.16::DOUBLE AS rule, doc_id = min(doc_id) OVER (PARTITION BY {_NORM}) AS first FROM q),
v AS (SELECT 'raw_noisy_baseline' AS variant, * FROM k UNION ALL SELECT 'exact_dedup_only', * FROM k WHERE first UNION ALL SELECT 'rule_filter_only', * FROM k WHERE rule)
SELECT variant, round(sum(n_len) / (SELECT sum(n_len) FROM k), 6) AS retention_ratio, count(*) AS retained_documents, round(avg(s), 6) AS mean_hdqs, sum(q_email + q_phone + q_id)::BIGINT AS pii_like_hits,
CASE WHEN variant = 'exact_dedup_only' THEN (SELECT round(avg(value), 6) FROM events WHERE event_type = 'click') END AS perplexity_mean, CASE WHEN variant = 'exact_dedup_only' THEN 'trained' ELSE 'data_only' END AS status FROM v GROUP BY variant""",
        ENTROPY,
    ).replace("\n, k AS", ", k AS", 1),
)
_add(
    "downstream_rows",
    lambda spark, d: _rounded(reports.downstream_rows(_runs(spark, d).select("variant", (F.col("value") / 100).alias("accuracy"), F.col("value").alias("perplexity"))), "next_character_accuracy", "held_out_perplexity", "held_out_noisy_robustness_proxy"),
    "SELECT event_type AS variant, round(avg(value / 100), 6) AS next_character_accuracy, round(avg(value), 6) AS held_out_perplexity, round(1 / greatest(1.0, avg(value)), 6) AS held_out_noisy_robustness_proxy FROM events GROUP BY event_type",
)
_add(
    "decision_table",
    lambda spark, d: _rounded(reports.decision_table(_runs(spark, d), {"raw": 49.9, "random": 49.0, "dedup": 49.5}, "click", "view"), "mean", "delta_raw", "delta_random", "delta_dedup"),
    """WITH m AS (SELECT event_type AS variant, count(DISTINCT user_id) AS seeds, avg(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type), f AS (SELECT max(mean) AS full_ FROM m WHERE variant = 'click'),
x AS (SELECT m.*, 49.9::DOUBLE - mean AS delta_raw, 49.0::DOUBLE - mean AS delta_random, 49.5::DOUBLE - mean AS delta_dedup, coalesce(mean < full_ - 1, false) AS over_ FROM m CROSS JOIN f)
SELECT variant, seeds, round(mean, 6) AS mean, round(delta_raw, 6) AS delta_raw, round(delta_random, 6) AS delta_random, round(delta_dedup, 6) AS delta_dedup,
CASE WHEN variant = 'view' THEN 'promote_to_3seed' WHEN (over_ AND delta_random > -0.25 AND delta_dedup > -0.25) OR delta_raw > 0 THEN 'needs_more_diagnostics' WHEN over_ THEN 'keep_debug_only' ELSE 'reject' END AS decision FROM x""",
)
_add(
    "paired_status",
    lambda spark, d: reports.paired_status(evaluation.significance(_events(spark, d), "event_type", "user_id", "value", "click").drop("status")).select("event_type", "n", "status", "claim"),
    _PAIRED + """ SELECT event_type, n, CASE WHEN n < 3 THEN 'insufficient_seeds' WHEN ci95_low > 0 AND n >= 5 THEN 'supported_over_reference' WHEN ci95_low > 0 THEN 'positive_preliminary_trend' WHEN ci95_high < 0 THEN 'negative_preliminary_trend' ELSE 'trend_only_ci_crosses_zero' END AS status,
CASE WHEN n < 3 THEN 'engineering_observation_only' WHEN ci95_low > 0 AND n >= 5 THEN 'method_supported' WHEN ci95_low > 0 OR ci95_high < 0 THEN 'preliminary_trend_only_no_significance_claim' ELSE 'trend_only_no_significance_claim' END AS claim FROM s""",
)
_add(
    "eligible_runs",
    lambda spark, d: reports.eligible(
        _events(spark, d).select("event_id", F.when(F.col("event_type") == "click", "failed").otherwise("completed_training").alias("run_status"), F.when(F.col("user_id") % 3 == 0, "smoke").otherwise("official_split").alias("dataset_scope"), F.col("value").alias("tokens"), "props"), 20, ("props",)
    ).select("event_id"),
    "SELECT event_id FROM events WHERE event_type <> 'click' AND user_id % 3 <> 0 AND value >= 20 AND coalesce(props, '') <> ''",
)


def _methods(spark, d):
    """(dataset, method, risk, diversity, loss): languages and sources of the documents."""
    s = scoring.local_scores(_docs(spark, d))
    return s.groupBy(F.col("lang").alias("dataset"), F.col("source").alias("method")).agg(F.avg("local_risk").alias("risk"), F.avg("local_diversity").alias("diversity"), F.round(F.avg("perplexity_proxy"), 9).alias("loss"))


_METHODS_SQL = f", z AS (SELECT lang AS dataset, source AS method, avg(local_risk) AS risk, avg(local_diversity) AS diversity, round(avg(perplexity_proxy), 9) AS loss FROM (SELECT lang, source, {_LOCAL_SQL} FROM r) GROUP BY ALL) "
_methods_sql = lambda body: on_profile(_METHODS_SQL + body).replace("\n, z AS", ", z AS", 1)
_add(
    "proxy_mismatch",
    lambda spark, d: _rounded(reports.proxy_mismatch(_methods(spark, d)), "proxy_utility", "observed_utility", "diversity_loss_proxy"),
    _methods_sql("SELECT dataset, method, round(diversity - risk, 6) AS proxy_utility, round(-loss, 6) AS observed_utility, round(1 - diversity, 6) AS diversity_loss_proxy FROM z"),
)
_add("best_by_dataset", lambda spark, d: _rounded(reports.best_by_dataset(_methods(spark, d)), "mean_loss"), _methods_sql("SELECT dataset, arg_min(method, struct_pack(l := loss, m := method)) AS best_method, round(avg(loss), 6) AS mean_loss FROM z GROUP BY dataset"))
_add(
    "compared_with",
    lambda spark, d: _rounded(reports.compared_with(_methods(spark, d), "src0", ("src1", "src2")), "reference_loss", "method_loss"),
    _methods_sql("SELECT a.dataset, 'src0_vs_' || b.method AS comparison, round(b.loss, 6) AS reference_loss, round(a.loss, 6) AS method_loss FROM z a JOIN z b ON a.dataset = b.dataset WHERE a.method = 'src0' AND b.method IN ('src1', 'src2')"),
)
_add(
    "rank_stability",
    lambda spark, d: _rounded(reports.rank_stability(_methods(spark, d).select("method", F.row_number().over(_by_loss()).alias("rank"))), "mean_rank"),
    _methods_sql(", k AS (SELECT method, row_number() OVER (PARTITION BY dataset ORDER BY loss, method) AS rank FROM z) SELECT method, round(avg(rank), 6) AS mean_rank, (max(rank) - min(rank))::INT AS rank_range FROM k GROUP BY method"),
)


def _by_loss():
    from pyspark.sql import Window

    return Window.partitionBy("dataset").orderBy("loss", "method")


_COMPONENTS = ["h_lexical_diversity", "h_char_entropy", "h_length_prior"]
_add(
    "column_summary",
    _on_docs(lambda df: _rounded(reports.column_summary(scoring.components(df), "lang", _COMPONENTS), "mean", "std", "standard_error")),
    on_profile(
        ", u AS (" + " UNION ALL ".join(f"SELECT lang, '{c}' AS component, {c} AS v FROM q" for c in _COMPONENTS)
        + ") SELECT lang, component, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(stddev_samp(v) / sqrt(count(v)), 6) AS standard_error FROM u GROUP BY lang, component",
        ENTROPY,
    ).replace("\n, u AS", ", u AS", 1),
)
_add(
    "evidence_levels",
    lambda spark, d: _docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n")).select("lang", "source", reports.evidence(F.when(F.col("lang") == "fr", "smoke").when(F.col("lang") == "de", "main_protocol").otherwise("sample"), F.col("n")).alias("e")).select("lang", "source", "e.*"),
    """SELECT lang, source, CASE WHEN lang = 'fr' THEN 'smoke_only' WHEN lang = 'de' THEN 'protocol_only' WHEN n < 30 THEN 'sample_partial' ELSE 'level2_candidate' END AS evidence_level,
CASE WHEN lang = 'fr' THEN 'smoke_diagnostic_only' WHEN lang = 'de' THEN 'protocol_only' WHEN n < 30 THEN 'insufficient' ELSE 'sufficient' END AS evidence_sufficiency, lang IN ('fr', 'de') OR n < 30 AS insufficient_evidence FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)""",
)
_add(
    "timing_percentiles",
    lambda spark, d: _rounded(reports.timing(_events(spark, d), "event_type", "value"), "mean"),
    "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type",
)
_FAILURE_SQL = "CASE " + " ".join("WHEN " + " OR ".join("contains(lower(text), '" + w.replace("'", "''") + "')" for w in words) + f" THEN '{name}'" for name, words in reports.FAILURES.items()) + " ELSE 'failed_due_to_environment' END"
_add("failure_classes", lambda spark, d: _table(spark, d, "conversations").select("conv_id", "turn", reports.failure_class(F.col("text")).alias("class")), f"SELECT conv_id, turn, {_FAILURE_SQL} AS class FROM conversations")
_add(
    "normalised_runs",
    lambda spark, d: reports.normalised_runs(_events(spark, d).select("event_id", "event_type", "user_id", "props"), ("event_type", "user_id", "event_id"), "props").select("event_id", "run_id", "config_hash"),
    "SELECT event_id, replace(event_type, ' ', '_') || ':' || user_id || ':' || event_id AS run_id, sha256(coalesce(props, '')) AS config_hash FROM events",
)
_add(
    "readiness_gates",
    _on_docs(lambda df: reports.gates(df.withColumn("n", F.size(X.words(X.text()))), {"english": ("lang = 'en'", 100), "long": ("n > 2000", 10_000)})),
    f"SELECT 'english' AS gate, 100 AS needed, count(*) FILTER (lang = 'en') AS found, found >= 100 AS passed FROM documents UNION ALL SELECT 'long', 10000, count(*) FILTER ({_W} > 2000) AS f, f >= 10000 FROM documents",
)

# --- estimators

_add(
    "logistic_accuracy",
    lambda spark, d: _rounded(ml.classifier_accuracy(_table(spark, d, "embeddings").withColumn("label", (F.col("label") % 2).cast("double")), "embedding", "label"), "accuracy"),
)
_add(
    "multivariate_fit",
    _on_docs(lambda df: ml.linear_model(X.profile(df), ["n_tok", "n_lines"], "n_len").withColumn("value", F.round("value", 4))),
    # the normal equations of two variables
    on_profile(
        "SELECT unnest(['intercept', 'n_tok', 'n_lines']) AS term, round(unnest([my - b1 * m1 - b2 * m2, b1, b2]), 4) AS value FROM (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM ("
        "SELECT avg(n_len) AS my, avg(n_tok) AS m1, avg(n_lines) AS m2, var_pop(n_tok) AS v1, var_pop(n_lines) AS v2, covar_pop(n_tok, n_lines) AS c12, covar_pop(n_tok, n_len) AS c1, covar_pop(n_lines, n_len) AS c2 FROM r))"
    ),
)
_add(
    "scaling_fit",
    _on_docs(lambda df: _rounded(ml.linear_fit(X.profile(df).where("n_tok > 0"), "n_tok", "n_len", logs=True), "slope", "intercept", "r2")),
    on_profile("SELECT round(regr_slope(ln(n_len), ln(n_tok)), 6) AS slope, round(regr_intercept(ln(n_len), ln(n_tok)), 6) AS intercept, round(regr_r2(ln(n_len), ln(n_tok)), 6) AS r2 FROM r WHERE n_tok > 0"),
)
_MORE = {"optional_lm_surprisal": 0.5, "duplicate_cluster_penalty": 0.9}


def _optional(df):
    """The first score with a loss of a language model and a penalty of clusters, here made from the ids."""
    i = F.col("doc_id")
    df = df.withColumns({"loss": F.when(i % 3 != 0, (i % 7) / 2.0), "copied": F.when(i % 5 == 0, 0.25)})
    return _rounded(scoring.hdqs(df, surprisal="loss", duplicate="copied", more=_MORE).select("doc_id", "score"), "score")


_add(
    "hdqs_optional_components",
    _on_docs(_optional),
    on_profile(
        f"SELECT doc_id, round({duckdb(formulas.weighted(formulas.WEIGHTS['hdqs'] | _MORE, 'h_'))}, 6) AS score FROM (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN 1 / (1 + (doc_id % 7) / 2.0::DOUBLE) ELSE 1.0::DOUBLE END AS h_optional_lm_surprisal, CASE WHEN doc_id % 5 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS h_duplicate_cluster_penalty FROM q)",
        ENTROPY,
    ),
)
_add("factorisation", lambda spark, d: ml.factorise(_events(spark, d).where("value IS NOT NULL").groupBy("user_id", F.pmod(F.xxhash64("event_type"), F.lit(1000)).cast("int").alias("item")).agg(F.avg("value").alias("rating")).withColumn("user_id", F.col("user_id").cast("int")), "user_id", "item", "rating").select("user_id", "item", F.col("prediction").isNotNull().alias("predicted")))
_add("method_summary", lambda spark, d: _rounded(analysis.method_summary(_events(spark, d), "event_type", "value"), "mean", "std"), "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
_add(
    "token_counters",
    _on_docs(lambda df: df.select("doc_id", *[counters.count(F.col("text"), n).cast("long").alias(n) for n in ("whitespace", "word", "word_mark", "characters", "bytes")])),
    rf"SELECT doc_id, {_W}::BIGINT AS whitespace, len({_TOK})::BIGINT AS word, len(regexp_extract_all(text, '{X.WORD}+|[^\p{{L}}\p{{N}}_\s]'))::BIGINT AS word_mark, length(text)::BIGINT AS characters, strlen(text)::BIGINT AS bytes FROM documents",
)
_risk_sql = lambda terms, pad: " + ".join(f"(length({pad}) - length(replace({pad}, '{t}', ''))) // {len(t)}" for t in terms)
_LOW = "replace(lower(text), 'ß', 'ss')"
_add(
    "risk_term_variants",
    _on_docs(lambda df: df.select("doc_id", *[X.risk_terms(X.text(), k).cast("long").alias(k) for k in ("padded", "short", "anywhere")])),
    f"SELECT doc_id, ({_risk_sql([f' {t} ' for t in X.RISK_TERMS], f"' ' || {_LOW} || ' '")})::BIGINT AS padded, ({_risk_sql([f' {t} ' for t in X.RISK_TERMS[:5]], f"' ' || {_LOW} || ' '")})::BIGINT AS short, ({_risk_sql(X.RISK_TERMS[:5], _LOW)})::BIGINT AS anywhere FROM documents",
)
