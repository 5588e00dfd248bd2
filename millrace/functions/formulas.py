"""Score formulas over the columns of a text profile, as SQL of both engines' common ground.

Numbers with a point are doubles: spark() and duckdb() write them so.
"""

from __future__ import annotations

import re

_NUMBER = re.compile(r"(?<![\w.])(\d+\.\d+(?:e-?\d+)?)(?![\w.])")


def spark(sql: str) -> str:
    return _NUMBER.sub(r"\1D", sql)


def duckdb(sql: str) -> str:
    return _NUMBER.sub(r"\1::DOUBLE", sql)


def clamp(sql: str) -> str:
    return f"greatest(0.0, least(1.0, {sql}))"


# fixed values: the weights, caps, thresholds, names and reasons in the tables below are those that scores are defined by

RATIOS = {
    "symbol_ratio": "n_sym / greatest(1, n_len)",
    "punctuation_ratio": "n_punct / greatest(1, n_len)",
    "repeated_line_ratio": "n_dup_lines / greatest(1, n_lines)",
    "unique_word_ratio": "n_uniq / greatest(1, n_tok)",
    "stopword_ratio": "n_stop / greatest(1, n_tok)",
    "language_text_ratio": "n_letspace / greatest(1, n_len)",
    "latin_fraction": "n_latin / greatest(1, n_alpha)",
    "cjk_fraction": "n_cjk / greatest(1, n_alpha)",
    "control_character_ratio": "n_control / greatest(1, n_len)",
    "is_readable": "(n_tok > 0 AND n_control = 0)",
}

DOMINANT_SCRIPT = "CASE WHEN n_alpha = 0 THEN 'unknown' WHEN n_latin >= n_cjk THEN 'latin_script' ELSE 'cjk_script' END"

QUALITY_PROFILE = clamp(
    "(least(1.0, n_tok / 20) + (1.0 - least(1.0, symbol_ratio * 3)) + (1.0 - repeated_line_ratio) + CASE WHEN is_readable THEN 1.0 ELSE 0.0 END) / 4"
)

RULE = "(n_words >= 5 AND symbol_ratio <= 0.25 AND unique_word_ratio >= 0.16)"

#: Score and keep rule of each row-local filter, over the profile and RATIOS.
FILTERS = {
    "raw": ("1.0", "true"),
    "length_filter": ("CASE WHEN n_words BETWEEN 1 AND 1000000000 THEN 1.0 ELSE 0.0 END", "n_words BETWEEN 1 AND 1000000000"),
    "c4_style_proxy": (
        clamp(
            "0.20 * least(1.0, n_tok / 5) + 0.20 * (1.0 - least(1.0, 4 * symbol_ratio)) + 0.15 * (1.0 - least(1.0, 3 * punctuation_ratio)) + "
            "0.15 * (1.0 - least(1.0, 0.4 * (n_url + n_html))) + 0.15 * (1.0 - repeated_line_ratio) + 0.15 * language_text_ratio"
        ),
        "is_readable AND score >= 0.25",
    ),
    "gopher_style_proxy": (
        clamp(
            "0.20 * least(1.0, n_tok / 8) + 0.20 * (1.0 - repeated_line_ratio) + 0.15 * least(1.0, 3.0 * stopword_ratio) + "
            "0.15 * (1.0 - least(1.0, 4 * symbol_ratio)) + 0.15 * unique_word_ratio + 0.15 * language_text_ratio"
        ),
        "score >= 0.25",
    ),
    "ccnet_style_proxy": (clamp("0.50 * language_text_ratio + 0.35 * unique_word_ratio + 0.15 * (1.0 - symbol_ratio)"), "score >= 0.25"),
    "hdqspp_historical": (clamp("0.45 * unique_word_ratio + 0.35 * language_text_ratio + 0.20 * (1.0 - symbol_ratio)"), "true"),
    "classifier_quality_proxy": (
        clamp("0.30 * least(1.0, n_tok / 12) + 0.25 * unique_word_ratio + 0.25 * language_text_ratio + 0.20 * (1.0 - symbol_ratio)"),
        "score >= 0.20",
    ),
}

#: Components of the heuristic data quality score, over the profile and its entropies and n-gram counts.
HDQS = {
    "lexical_diversity": "n_uniq / greatest(1, n_tok)",
    "char_entropy": "least(1.0, char_entropy_bits / 5.0)",
    "token_entropy": "least(1.0, token_entropy_bits / 8.0)",
    "repetition_penalty": "CASE WHEN n_tok < 2 THEN 1.0 ELSE greatest(0.0, n_bigrams / greatest(1, n_tok - 1)) END",
    "ngram_repetition_penalty": "CASE WHEN n_tok < 3 THEN 1.0 ELSE greatest(0.0, n_trigrams / greatest(1, n_tok - 2)) END",
    "pii_density_penalty": "greatest(0.0, 1.0 - 10.0 * (q_email + q_phone + q_id) / greatest(1, n_words))",
    "url_html_noise_penalty": "greatest(0.0, 1.0 - 0.35 * q_url_html)",
    "non_linguistic_symbol_penalty": "greatest(0.0, 1.0 - 4.0 * n_sym / greatest(1, n_len))",
    "length_prior": "CASE WHEN n_len < 40 THEN n_len / 40.0 WHEN n_len > 1000 THEN greatest(0.0, 1.0 - (n_len - 1000) / 2000.0) ELSE 1.0 END",
    "language_consistency": "CASE WHEN n_alpha = 0 THEN 0.0 ELSE n_ascii_alpha / n_alpha END",
}

WEIGHTS = {
    "hdqs": dict(zip(HDQS, (1.0, 1.0, 0.8, 1.3, 1.0, 1.2, 1.0, 1.0, 0.8, 0.7))),
    "hdqs_v2": dict(zip(HDQS, (0.9, 0.8, 0.8, 0.45, 0.35, 1.0, 0.45, 0.25, 0.25, 0.6))),
    "hdqs_v3": dict(zip(HDQS, (0.95, 0.75, 0.85, 0.65, 0.55, 1.0, 0.55, 0.35, 0.05, 0.6))),
}


def weighted(weights: dict[str, float], prefix: str = "") -> str:
    """The weighted mean of the components, clamped."""
    return clamp("(" + " + ".join(f"{float(w)} * {prefix}{c}" for c, w in weights.items()) + f") / {float(sum(weights.values()))}")


#: Cheaper scores of single documents.
LOCAL = {
    "local_risk": "least(1.0, 0.05 * n_risk_terms + 0.02 * n_http)",
    "local_diversity": "CASE WHEN n_words = 0 THEN 0.0 ELSE n_uniq_words / n_words END",
    "local_utility": "least(1.0, ln(1 + greatest(n_words, 1)) / ln(2049.0))",
    "symbol_fraction": "CASE WHEN n_len = 0 THEN 1.0 ELSE n_sym / greatest(1, n_len) END",
    "alpha_fraction": "CASE WHEN n_len = 0 THEN 0.0 ELSE n_alpha / greatest(1, n_len) END",
}

#: A text without words has none, so no band of order statistics below infinity keeps it.
PERPLEXITY_PROXY = (
    "CASE WHEN n_words = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 1.0 - n_uniq_words / greatest(1, n_words) + 0.8 * n_ascii_punct / greatest(1, n_len) + 0.5 * n_digit / greatest(1, n_len) + "
    "0.35 * abs(ln(1.0 + n_words) - ln(385.0)) / ln(4097.0) END"
)

BASELINES = {
    "heuristic_quality": "0.3 * least(1.0, n_tok / 80) + 0.3 * n_alpha / greatest(1, n_len) + 0.2 * greatest(0.0, 1.0 - 4.0 * n_sym / greatest(1, n_len)) + 0.2 * greatest(0.0, 1.0 - 0.4 * q_url_html)",
    "ngram_proxy": "CASE WHEN n_tok = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.65 * n_uniq / n_tok + 0.35 * n_bigrams / greatest(1, n_tok - 1))) END",
    "independent_quality": "CASE WHEN n_tok = 0 THEN 0.0 ELSE 0.45 * n_uniq / n_tok + 0.35 * least(1.0, n_tok / 120) + 0.20 * greatest(0.0, 1.0 - 3.0 * n_sym / greatest(1, n_len)) END",
}

C4_REASON = (
    "CASE WHEN n_words < 24 THEN 'too_short_c4_style' WHEN n_words > 4096 THEN 'too_long_c4_style' WHEN symbol_fraction > 0.35 THEN 'symbol_fraction_too_high' "
    "WHEN alpha_fraction < 0.45 THEN 'alpha_fraction_too_low' WHEN blocked THEN 'blocked_term' ELSE 'c4_style_quality_pass' END"
)

URD = {
    "utility_score": clamp(
        "0.35 * " + clamp("least(1.0, ln(1.0 + n_tok) / greatest(1.0, ln(1.0 + max_tok))) * (0.5 + 0.5 * n_uniq / greatest(1, n_tok))")
        + " + 0.25 * " + clamp("n_rare / greatest(1, n_uniq)") + " + 0.25 * " + clamp("token_entropy_nat") + " + 0.15 * " + clamp("n_uniq / greatest(1, vocab)")
    ),
    "risk_score": clamp(
        "(" + clamp("n_url / greatest(1, n_tok)") + " + " + clamp("n_html / greatest(1, n_tok)") + " + " + clamp("symbol_ratio * 3.0") + " + repeated_line_ratio + "
        + clamp("3.0 * n_digit / greatest(1, n_len)") + " + " + clamp("(n_email + n_phone) / 2.0") + " + boilerplate_hint + duplicate_hint) / 8.0"
    ),
    "shift_penalty": clamp(
        "0.40 * " + clamp("abs(n_tok - mean_tok) / greatest(1.0, max_tok_raw)") + " + 0.40 * " + clamp("CASE WHEN vocab = 0 THEN 0.0 ELSE 1.0 - n_uniq / vocab END") + " + 0.20 * " + clamp("source_shift")
    ),
    "cost_score": clamp("(" + clamp("n_len / greatest(1, max_len)") + " + 3 * " + clamp("n_tok / greatest(1, max_tok)") + ") / 5.0"),
}

URD_DIVERSITY = clamp("0.45 * (n_uniq / greatest(1, n_tok)) + 0.20 * " + clamp("(char_entropy_nat + token_entropy_nat) / 2.0") + " + 0.15 * source_coverage + 0.20 * " + clamp("novelty"))
URD_FIXED = "0.35 * utility_score + 0.25 * diversity_score - 0.20 * risk_score - 0.10 * shift_penalty - 0.10 * cost_score"
