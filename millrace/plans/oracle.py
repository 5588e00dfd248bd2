"""DuckDB SQL of the queries, on a common profile of documents."""

from __future__ import annotations

from ..functions import formulas, textexpr as X
from ..functions.formulas import duckdb


def _quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def _n(pattern: str, x: str = "text") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))::INT"


def _only(cls: str, x: str = "text") -> str:
    return f"length(regexp_replace({x}, '[^{cls}]', '', 'g'))::INT"


_PUNCT = X.PUNCTUATION.replace("'", "''")
_RISK = " + ".join(f"((length(' ' || folded || ' ') - length(replace(' ' || folded || ' ', ' {t} ', ''))) // {len(t) + 2})" for t in X.RISK_TERMS)


def _grams(n: int) -> str:
    parts = " || ' ' || ".join(f"toks[i + {k}]" for k in range(n))
    return f"CASE WHEN len(toks) < {n} THEN 0 ELSE len(list_distinct(list_transform(range(1, len(toks) - {n - 2}), lambda i: {parts})))::INT END"


PROFILE = f"""
d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, replace(lower(coalesce(text, '')), 'ß', 'ss') AS folded FROM documents),
l AS (SELECT *, regexp_extract_all(folded, '{X.WORD}+') AS toks, list_filter(string_split_regex(folded, '\\s+'), lambda t: t <> '') AS ws,
  list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda t: regexp_replace(t, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda t: t <> '') AS ls FROM d),
p AS (SELECT *, length(text)::INT AS n_len, len(toks)::INT AS n_tok, len(list_distinct(toks))::INT AS n_uniq,
  len(list_filter(toks, lambda v: v IN ({_quoted(X.STOPWORDS)})))::INT AS n_stop, len(ws)::INT AS n_words, len(list_distinct(ws))::INT AS n_uniq_words,
  len(ls)::INT AS n_lines, (len(ls) - len(list_distinct(ls)))::INT AS n_dup_lines,
  length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s\\p{{Z}}]', '', 'g'))::INT AS n_sym, (length(text) - length(translate(text, '{_PUNCT}', '')))::INT AS n_punct,
  (length(text) - length(regexp_replace(text, '{X.ASCII_PUNCTUATION}', '', 'g')))::INT AS n_ascii_punct,
  {_only(r"\p{L}")} AS n_alpha, {_only("A-Za-z")} AS n_ascii_alpha, {_only(r"\p{L}\s\p{Z}")} AS n_letspace, {_only(r"\p{Nd}")} AS n_digit, {_only("a-z", "lower(text)")} AS n_latin,
  {_only(r"\x{4e00}-\x{9fff}")} AS n_cjk, {_only(r"\x00-\x08\x0b\x0c\x0e-\x1f")} AS n_control,
  {_n(X.URL)} AS n_url, {_n(X.HTML)} AS n_html, {_n(X.RISK_EMAIL)} AS n_email, {_n(X.RISK_PHONE)} AS n_phone,
  {_n(X.EMAIL)} AS q_email, {_n(X.PHONE)} AS q_phone, {_n(X.ID)} AS q_id, {_n(X.URL_HTML)} AS q_url_html, ({_RISK})::INT AS n_risk_terms, {_n("https?://", "folded")} AS n_http FROM l),
r AS (SELECT *, {", ".join(f"{duckdb(v)} AS {k}" for k, v in formulas.RATIOS.items())} FROM p)"""

ENTROPY = f"""
te AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(toks) AS t FROM p) GROUP BY ALL) GROUP BY doc_id),
ce AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h, count(*)::INT AS kinds FROM (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS t FROM p) GROUP BY ALL) GROUP BY doc_id),
e AS (SELECT r.*, greatest(0.0::DOUBLE, coalesce(te.h, 0)) AS token_entropy_bits, greatest(0.0::DOUBLE, coalesce(ce.h, 0)) AS char_entropy_bits, coalesce(kinds, 0) AS n_char_kinds, {_grams(2)} AS n_bigrams, {_grams(3)} AS n_trigrams
  FROM r LEFT JOIN te ON te.doc_id = r.doc_id LEFT JOIN ce ON ce.doc_id = r.doc_id),
q AS (SELECT *, {", ".join(f"{duckdb(v)} AS h_{k}" for k, v in formulas.HDQS.items())} FROM e)"""


def on_profile(body: str, *more: str) -> str:
    """body over the profile r, and over what more CTEs (ENTROPY: e and q) add."""
    return "WITH " + ",".join([PROFILE, *more]) + "\n" + body
