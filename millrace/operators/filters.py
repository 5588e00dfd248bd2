"""Document filters: each row gets a decision (keep, score, reason); none is dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions import textexpr as X
from . import dedup, scoring, select, urd


def local_filter(df: DataFrame, kind: str) -> DataFrame:
    """Decision of a row-local filter: formulas.FILTERS[kind]. Needs doc_id and text."""
    score, keep = formulas.FILTERS[kind]
    rows = X.with_ratios(X.profile(df)).withColumn("score", F.expr(formulas.spark(score)))
    reason = F.lit(kind)
    if kind == "length_filter":
        reason = F.when(F.col("n_words") < 1, "length_below_min").when(F.col("n_words") > 1000000000, "length_above_max").otherwise("length_in_range")
    return rows.select("doc_id", F.expr(formulas.spark(keep)).alias("keep"), "score", reason.alias("reason"))


def length_filter(df: DataFrame, least: int = 1, most: int = 1_000_000_000, tokens: str | None = None) -> DataFrame:
    """Bounds on the words between white space, or on a column of token counts (null: none)."""
    n = F.size(X.words(X.text())) if tokens is None else F.coalesce(F.col(tokens), F.lit(0))
    keep = n.between(least, most)
    reason = F.when(keep, "length_in_range").when(n < least, "length_below_min").otherwise("length_above_max")
    return df.select("doc_id", keep.alias("keep"), F.when(keep, 1.0).otherwise(0.0).alias("score"), reason.alias("reason"))


def rule_filter(df: DataFrame) -> DataFrame:
    """At least 5 words between white space, at most a quarter symbols, at least 16 % different tokens."""
    p = X.with_ratios(X.profile(df))
    keep = F.expr(formulas.spark(formulas.RULE))
    return p.select("doc_id", keep.alias("keep"), F.col("unique_word_ratio").alias("score"), F.when(keep, "rule_pass").otherwise("rule_reject").alias("reason"))


def c4_quality(df: DataFrame, blocked: tuple[str, ...] = ("lorem ipsum", "javascript")) -> DataFrame:
    """The first failing rule is the reason."""
    p = X.with_formulas(X.profile(df), {k: formulas.LOCAL[k] for k in ("symbol_fraction", "alpha_fraction")})
    folded = X.fold(X.text())
    hit = F.lit(False)
    for term in blocked:
        hit = hit | folded.contains(term)
    reason = F.expr(formulas.spark(formulas.C4_REASON))
    return p.withColumn("blocked", hit).withColumn("reason", reason).select("doc_id", (F.col("reason") == "c4_style_quality_pass").alias("keep"), F.col("alpha_fraction").alias("score"), "reason")


def hdqs_historical(df: DataFrame) -> DataFrame:
    """Scored, and kept: lexical, script and symbol shares in equal parts."""
    return local_filter(df, "hdqspp_historical")


def unigram_surprisal(df: DataFrame) -> DataFrame:
    return scoring.unigram_surprisal(df).select("doc_id", F.lit(True).alias("keep"), "score", F.lit("perplexity_proxy").alias("reason"))


#: Filters by name; each takes (df, keep rate) and ignores the rate if it has no use for it.
REGISTRY = {
    "raw": lambda df, rate: local_filter(df, "raw"),
    "random_same_keep_rate": lambda df, rate: select.random_keep(df, rate),
    "exact_dedup": lambda df, rate: dedup.exact_dedup(df),
    "minhash_near_dedup": lambda df, rate: dedup.minhash_filter(df),
    "length_filter": lambda df, rate: length_filter(df),
    "hdqspp_historical": lambda df, rate: hdqs_historical(df),
    "c4_style_proxy": lambda df, rate: local_filter(df, "c4_style_proxy"),
    "gopher_style_proxy": lambda df, rate: local_filter(df, "gopher_style_proxy"),
    "ccnet_style_proxy": lambda df, rate: local_filter(df, "ccnet_style_proxy"),
    "perplexity_proxy": lambda df, rate: unigram_surprisal(df),
    "classifier_quality_proxy": lambda df, rate: local_filter(df, "classifier_quality_proxy"),
    "embedding_diversity_proxy": lambda df, rate: select.farthest_first(df, rate),
    "urd_fixed": lambda df, rate: urd.select_fixed(df, rate),
    "urd_pareto": lambda df, rate: urd.select_pareto(df, rate),
} | {f"urd_ablation_no_{c}": (lambda df, rate, c=c: urd.select_fixed(df, rate, disabled=(c,))) for c in urd.PARTS}
#: Other names of the same filters.
ALIASES = {
    "dedup_only": "exact_dedup",
    "minhash_dedup_proxy": "minhash_near_dedup",
    "minhash_lsh_near_dedup": "minhash_near_dedup",
    "hdqspp": "hdqspp_historical",
    "hdqspp_v2": "hdqspp_historical",
    "hdqspp_v3": "hdqspp_historical",
    "ccnet_style_protocol": "ccnet_style_proxy",
    "classifier_proxy_protocol": "classifier_quality_proxy",
}


def register(name: str, decide_: Callable[[DataFrame, float | None], DataFrame], *aliases: str) -> None:
    """Add a filter: decide_(df, keep rate) returns (doc_id, keep, score, reason) for every row. A name that is taken is an error."""
    for n in (name, *aliases):
        if n in REGISTRY or n in ALIASES:
            raise ValueError(f"the filter {n} is there already")
    REGISTRY[name] = decide_
    ALIASES.update(dict.fromkeys(aliases, name))


def decide(df: DataFrame, name: str, rate: float | None = None) -> DataFrame:
    """(doc_id, keep, score, reason) by the filter of that name; an unknown name is an error."""
    name = ALIASES.get(name, name)
    if name not in REGISTRY:
        raise ValueError(f"unknown filter: {name}")
    return REGISTRY[name](df, rate)


def summary(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: documents and tokens before and after, and both keep rates."""
    rows = df.select("doc_id", F.size(X.words(X.text())).alias("n")).join(decisions.select("doc_id", "keep"), "doc_id")
    total = rows.agg(
        F.count("*").alias("input_documents"),
        F.count_if("keep").alias("kept_documents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(F.col("keep"), F.col("n"))), F.lit(0)).alias("kept_tokens"),
    )
    return total.withColumns(
        {
            "document_keep_rate": F.col("kept_documents") / F.greatest(F.lit(1), "input_documents"),
            "token_keep_rate": F.col("kept_tokens") / F.greatest(F.lit(1), "input_tokens"),
        }
    )
