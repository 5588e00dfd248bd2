"""Quality scores of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions import textexpr as X
from .storage import saved

#: Tokens that are as frequent as the last of the most frequent ones, and are looked up as a list; more are joined.
FEW = 10_000


def components(df: DataFrame) -> DataFrame:
    """A profile with the entropies, n-grams and the components of the heuristic score, as h_<name>."""
    p = X.profile(df, entropies=True)
    return X.with_formulas(p, {f"h_{k}": v for k, v in formulas.HDQS.items()})


def hdqs(df: DataFrame, weights: str = "hdqs", surprisal: str | None = None, duplicate: str | None = None, more: dict[str, float] | None = None) -> DataFrame:
    """components() with the weighted score.

    surprisal and duplicate name columns of df for two more components, a language model's loss as 1 / (1 + max(0, loss))
    and a penalty of duplicate clusters, each 1 where it is null or not given; more has their weights, 0 by default.
    """
    rows = components(df)
    loss = F.when(F.col(surprisal).isNull(), 1.0).otherwise(1 / (1 + F.greatest(F.lit(0.0), F.col(surprisal)))) if surprisal else F.lit(1.0)
    rows = rows.withColumns({"h_optional_lm_surprisal": loss, "h_duplicate_cluster_penalty": F.coalesce(F.col(duplicate).cast("double"), F.lit(1.0)) if duplicate else F.lit(1.0)})
    return rows.withColumn("score", F.expr(formulas.spark(formulas.weighted(formulas.WEIGHTS[weights] | (more or {}), "h_"))))


def token_counts(df: DataFrame) -> DataFrame:
    """(token, c) over the corpus; a text's equal tokens are counted before they are shuffled."""
    return df.select(F.explode(X.tokens(X.text())).alias("token")).groupBy("token").agg(F.count("*").alias("c"))


def unigram_surprisal(df: DataFrame) -> DataFrame:
    """(doc_id, score): 1 / (1 + mean surprisal) under the corpus's smoothed unigram model; 0 for a text without tokens."""
    counts = token_counts(df)
    total = counts.agg(F.sum("c"), F.count("*")).head()
    all_ = (total[0] or 0) + max(1, total[1])
    each = df.select("doc_id", F.explode(X.tokens(X.text())).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    mean = each.join(counts, "token").groupBy("doc_id").agg((F.sum(-F.ln((F.col("c") + 1) / F.lit(float(all_))) * F.col("n")) / F.sum("n")).alias("mean"))
    return df.select("doc_id").join(mean, "doc_id", "left").select("doc_id", F.when(F.col("mean").isNull(), 0.0).otherwise(1 / (1 + F.col("mean"))).alias("score"))


def local_scores(df: DataFrame) -> DataFrame:
    p = X.with_formulas(X.profile(df), formulas.LOCAL)
    return p.withColumns({"score": F.expr("local_utility + 0.25D * local_diversity - 0.5D * local_risk"), "perplexity_proxy": F.expr(formulas.spark(formulas.PERPLEXITY_PROXY))})


def _lengths(df: DataFrame) -> DataFrame:
    """(n, c): how many texts have n tokens. Written, as several places of the order are looked up in it."""
    return saved(df.select(F.size(X.tokens(X.text())).alias("n")).groupBy("n").agg(F.count("*").alias("c")), "lengths")


def length_edges(df: DataFrame, lengths: DataFrame | None = None) -> list[int]:
    """Inner edges of five length bins: the token counts at places int(q * n) of their order, each over the one before."""
    at = _order_statistics(_lengths(df) if lengths is None else lengths, lambda n: [min(n - 1, int(q * n)) for q in (0.2, 0.4, 0.6, 0.8)])
    edges = [0]
    for x in at:
        edges.append(max(edges[-1] + 1, x))
    return edges + [10**9]


def _order_statistics(lengths: DataFrame, places) -> list[int]:
    """The numbers of tokens at places (from 0) of their order, by their histogram: no sort of all rows."""
    n = lengths.agg(F.sum("c")).head()[0] or 0
    if not n:
        return []
    upto = lengths.withColumn("upto", F.sum("c").over(Window.orderBy("n")))  # a row for each different length
    return list(upto.agg(*[F.min(F.when(F.col("upto") > p, F.col("n"))).alias(f"x{k}") for k, p in enumerate(places(n))]).head())


def _bin(edges: list[int]) -> F.Column:
    out = None
    for a, b in zip(edges, edges[1:]):
        inside = (F.col("n_tok") >= a) & (F.col("n_tok") < b)
        out = F.when(inside, f"{a}-{b}") if out is None else out.when(inside, f"{a}-{b}")
    return out


# fixed values: weights and switches of the variants by name; what a variant doesn't name is as in the first
V2 = {"base_quality": 0.42, "length_distribution_match": 0.18, "token_frequency_preservation": 0.18, "quality_diversity_balance": 0.14, "repetition_capped": 0.08}
V2_VARIANTS = {
    "hdqspp_v2": {},
    "v2_without_length_prior": {"off": ("length_distribution_match",)},
    "v2_without_distribution_preservation": {"quota": False},
    "v2_without_token_frequency_preservation": {"off": ("token_frequency_preservation",)},
    "v2_without_repetition_penalty": {"off": ("repetition_capped",)},
    "v2_without_quality_diversity_balance": {"off": ("quality_diversity_balance",)},
    "v2_hard_filtering": {"rate": 0.6, "quota": False},
    "v2_soft_weighting_curriculum": {"rate": 0.9},
}
V3 = {"base_quality": 0.55, "quality_diversity_balance": 0.23, "repetition_capped": 0.14, "length_guardrail": 0.08}
V3_VARIANTS = {
    "hdqspp_v3": {},
    "v3_without_soft_weighting": {"soft": False, "interleave": False},
    "v3_without_keep_rate_calibration": {"rate": 0.6},
    "v3_without_quality_diversity_balance": {"off": ("quality_diversity_balance",)},
    "v3_hard_filtering_only": {"rate": 0.6, "off": ("quality_diversity_balance", "repetition_capped", "length_guardrail"), "soft": False, "interleave": False},
    "v3_soft_weighting_only": {"rate": 1.0, "soft": False},
    "v3_without_length_guardrails": {"off": ("length_guardrail",)},
    "v3_without_repetition_penalty": {"off": ("repetition_capped",)},
}


def variant_score(weights: dict[str, float], off: tuple[str, ...] = ()) -> str:
    """The weighted mean of a variant's terms, clamped, as SQL; terms that are off have no weight."""
    return formulas.weighted({k: w for k, w in weights.items() if k not in off})


def _variant(variants: dict, name: str) -> dict:
    if name not in variants:
        raise ValueError(f"unknown variant: {name}")
    return variants[name]


def frequent_tokens(df: DataFrame, top: int) -> list[str]:
    """The top most frequent tokens; of equally frequent ones the first to occur by (doc_id, place).

    Where tokens stand is only looked up for those that are as frequent as the last, if not all of these are in.
    """
    counts = saved(token_counts(df), "counts")
    best = counts.orderBy(F.desc("c")).limit(top + 1).collect()  # top tokens
    if len(best) <= top:
        return [r["token"] for r in best]
    known, last = [r["token"] for r in best if r["c"] > best[-1]["c"]], best[-1]["c"]
    if len(known) == top:
        return known
    ties = counts.where(F.col("c") == last).select("token")
    few = ties.limit(FEW + 1).collect()
    each = df.select("doc_id", F.posexplode(X.tokens(X.text())).alias("at", "token"))
    each = each.where(F.col("token").isin([r["token"] for r in few])) if len(few) <= FEW else each.join(ties, "token", "left_semi")
    first = each.groupBy("token").agg(F.min(F.struct("doc_id", "at")).alias("first")).orderBy("first").limit(top - len(known))
    return known + [r["token"] for r in first.select("token").collect()]


def with_v2(rows: DataFrame, reference: DataFrame, top: int = 1500) -> DataFrame:
    """components() with the terms of the second score and a length bin, against the reference's lengths and tokens."""
    base = F.expr(formulas.spark(formulas.weighted(formulas.WEIGHTS["hdqs_v2"], "h_")))
    known = frequent_tokens(reference, top)
    have = F.size(F.filter("toks", lambda t: t.isin(known))) if known else F.lit(0)
    return rows.withColumn("base_quality", base).withColumns(
        {
            "length_distribution_match": F.expr("0.75D + 0.25D * least(1.0D, ln(1.0D + n_tok) / ln(1201.0D))"),
            "token_frequency_preservation": have / F.greatest(F.lit(1), "n_tok"),
            "quality_diversity_balance": F.expr("0.5D * base_quality + 0.25D * least(1.0D, token_entropy_bits / 8.0D) + 0.25D * n_uniq / greatest(1, n_tok)"),
            "repetition_capped": F.expr("greatest(0.45D, n_bigrams / greatest(1, n_tok - 1))"),
            "length_bin": _bin(length_edges(reference)),
        }
    )


def with_v3(rows: DataFrame, df: DataFrame, reference: DataFrame) -> DataFrame:
    """components() of df with the terms of the third score and a length bin, with a guard around the reference's median."""
    base = F.expr(formulas.spark(formulas.weighted(formulas.WEIGHTS["hdqs_v3"], "h_")))
    lengths = _lengths(reference)
    mid, low, high = _order_statistics(lengths, lambda n: [n // 2, int(0.1 * (n - 1)), int(0.9 * (n - 1))]) or (0, 0, 0)
    guard = f"abs(ln(1.0D + n_tok) - ln(1.0D + {mid})) / greatest(1.0D, ln(1.0D + {high}) - ln(1.0D + {low}))"
    return rows.withColumn("base_quality", base).withColumns(
        {
            "quality_diversity_balance": F.expr("0.5D * base_quality + 0.25D * least(1.0D, token_entropy_bits / 8.0D) + 0.25D * n_uniq / greatest(1, n_tok)"),
            "repetition_capped": F.expr("greatest(0.50D, n_bigrams / greatest(1, n_tok - 1))"),
            "length_guardrail": F.expr(f"greatest(0.0D, least(1.0D, 1.0D - 0.5D * ({guard})))"),
            "length_bin": _bin(length_edges(df, lengths if reference is df else None)),
        }
    )


def hdqs_v2(df: DataFrame, top: int = 1500, variant: str = "hdqspp_v2", reference: DataFrame | None = None) -> DataFrame:
    """components() with base, length, token frequency, diversity and repetition terms, and their score.

    Bins and tokens are those of the reference, without one of df itself. Its tokens are the top most frequent; of equally
    frequent ones the first to occur by (doc_id, place).
    """
    off = _variant(V2_VARIANTS, variant).get("off", ())
    rows = with_v2(hdqs(df, "hdqs_v2"), df if reference is None else reference, top)
    return rows.withColumn("score", F.expr(formulas.spark(variant_score(V2, off))))


def hdqs_v3(df: DataFrame, variant: str = "hdqspp_v3", reference: DataFrame | None = None) -> DataFrame:
    """components() with base, diversity, repetition and a length guard around the reference's median, and their score."""
    off = _variant(V3_VARIANTS, variant).get("off", ())
    rows = with_v3(hdqs(df, "hdqs_v3"), df, df if reference is None else reference)
    return rows.withColumn("score", F.expr(formulas.spark(variant_score(V3, off))))


def baseline_scores(df: DataFrame) -> DataFrame:
    return X.with_formulas(X.profile(df, entropies=True), formulas.BASELINES)


def document_metrics(df: DataFrame, dev: DataFrame | None = None) -> DataFrame:
    """Ten metrics of each document; dev_loss_proxy against dev's token distribution, 0 without one.

    dev's vocabulary and total are two numbers; its counts are joined, whatever their size.
    """
    p = X.profile(df, entropies=True)
    out = p.select(
        "doc_id",
        F.col("n_len").cast("double").alias("length_chars"),
        F.col("n_tok").cast("double").alias("token_count"),
        F.expr("n_uniq / greatest(1, n_tok)").alias("token_diversity"),
        F.expr("1.0D - n_bigrams / greatest(1, n_tok - 1)").alias("repetition_rate"),
        F.expr("1.0D - n_trigrams / greatest(1, n_tok - 2)").alias("trigram_repetition_rate"),
        F.col("token_entropy_bits").alias("token_entropy"),
        F.col("char_entropy_bits").alias("char_entropy"),
        F.expr("n_sym / greatest(1, n_len)").alias("symbol_fraction"),
        F.expr("token_entropy_bits * n_uniq / greatest(1, n_tok)").alias("information_density"),
    )
    if dev is None:
        return out.withColumn("dev_loss_proxy", F.lit(0.0))
    counts = token_counts(dev)
    total, vocab = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    each = df.select("doc_id", F.explode(X.tokens(X.text())).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    found = each.join(counts, "token", "left").groupBy("doc_id").agg(
        F.sum("n").alias("all"), F.count_if(F.col("c").isNull()).alias("new"), F.sum(F.ln(F.coalesce("c", F.lit(0)) + F.lit(1e-9)) * F.col("n")).alias("ln")
    )
    loss = F.ln(F.lit(float(total)) + F.lit(1e-9) * (F.lit(vocab) + F.col("new"))) - F.col("ln") / F.col("all")
    return out.join(found.select("doc_id", loss.alias("loss")), "doc_id", "left").withColumn("dev_loss_proxy", F.coalesce("loss", F.lit(0.0))).drop("loss")
