"""Tables that compare methods: losses, significance, what filtering took away, and agreement of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textexpr as X
from . import analysis, scoring


def lm_metrics(df: DataFrame, group: str, nll: str) -> DataFrame:
    """(group, n, mean_nll, perplexity): exp of the mean loss, null where that overflows."""
    a = df.groupBy(group).agg(F.count(nll).alias("n"), F.avg(nll).alias("mean_nll"))
    return a.withColumn("perplexity", F.when(F.col("mean_nll") <= 709.0, F.exp("mean_nll")))


def significance(df: DataFrame, method: str, seed: str, value: str, baseline: str) -> DataFrame:
    """Paired improvement over the baseline with a status: too few pairs, improvement, regression or inconclusive."""
    p = analysis.paired_difference(df, method, seed, value, baseline)
    status = F.when(F.col("n") < 3, "insufficient_pairs").when(F.col("ci95_low") > 0, "improvement").when(F.col("ci95_high") < 0, "regression").otherwise("inconclusive")
    return p.withColumn("status", status)


def seed_sets(df: DataFrame, method: str, seed: str, baseline: str) -> DataFrame:
    """(method, same_seeds): whether a method ran with just the baseline's seeds. Seeds are compared by count and sums
    of hashes, so no list of them is gathered."""
    h = F.xxhash64(seed).cast("decimal(38,0)")
    sets = df.select(method, seed).distinct().groupBy(method).agg(F.count("*").alias("n"), F.sum(h).alias("s"))
    base = sets.where(F.col(method) == baseline).select(F.col("n").alias("bn"), F.col("s").alias("bs"))
    return sets.join(F.broadcast(base)).select(method, ((F.col("n") == F.col("bn")) & (F.col("s") == F.col("bs"))).alias("same_seeds"))


def audit(df: DataFrame, dataset: str, method: str, value: str, baseline: str) -> DataFrame:
    """(dataset, method, mean, ratio, verdict) against the baseline's mean in the same dataset; lower is better."""
    m = df.groupBy(dataset, method).agg(F.avg(value).alias("mean"))
    base = m.where(F.col(method) == baseline).select(dataset, F.col("mean").alias("base"))
    out = m.join(base, dataset, "left").withColumn("ratio", F.col("mean") / F.col("base"))
    return out.withColumn("verdict", F.when(F.col("base").isNull(), "no_baseline").when(F.col(method) == baseline, "baseline").when(F.col("ratio") < 1, "better").otherwise("not_better")).drop("base")


def mechanism(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: keep rates of documents, tokens, vocabulary and sources, and whether too much was taken (under 0.7)."""
    b, a = analysis.diversity_report(before), analysis.diversity_report(after)
    n = lambda df, p: df.agg(F.count("*").alias(f"{p}_docs"), F.coalesce(F.sum(F.size(X.tokens(X.text()))), F.lit(0)).alias(f"{p}_tokens"))
    v = lambda df, p: scoring.token_counts(df).agg(F.count("*").alias(f"{p}_vocab"))
    one = n(before, "b").join(n(after, "a")).join(v(before, "b")).join(v(after, "a")).join(b.select(F.col("source_count").alias("b_src"))).join(a.select(F.col("source_count").alias("a_src")))
    rate = lambda x: F.col(f"a_{x}") / F.greatest(F.lit(1), F.col(f"b_{x}"))
    return one.select(rate("docs").alias("document_keep_rate"), rate("tokens").alias("token_keep_rate"), rate("vocab").alias("vocabulary_keep_rate"), rate("src").alias("source_keep_rate")).withColumn(
        "overfiltered", F.col("document_keep_rate") < 0.7
    )


def calibration(before: DataFrame, after: DataFrame, dev: DataFrame, top: int = 5000) -> DataFrame:
    """One row: divergences of the selected corpus's tokens and lengths from the raw and the dev corpus's, and the share kept.

    Tokens are the top most frequent of each corpus, of equally frequent ones the first to occur.
    """
    tokens = {k: analysis.token_topk(df, top) for k, df in (("selected", after), ("raw", before), ("dev", dev))}
    bins = {k: analysis.length_histogram(df).select(F.col("bin").alias("token"), "c") for k, df in (("selected", after), ("raw", before), ("dev", dev))}
    out = before.agg(F.count("*").alias("n")).join(after.agg(F.count("*").alias("m"))).select((F.col("m") / F.greatest(F.lit(1), "n")).alias("retention_rate"))
    for what, of in (("token", tokens), ("length", bins)):
        for other in ("raw", "dev"):
            out = out.join(analysis.divergence(of["selected"], of[other]).select(F.col("js").alias(f"{what}_js_selected_vs_{other}")))  # one row each
    return out


def split_hashes(df: DataFrame, split: str) -> DataFrame:
    """(split, hash): the different normalised texts of each split."""
    return df.select(split, F.sha2(X.normalise(X.text()), 256).alias("hash")).distinct()


def split_overlap(df: DataFrame, split: str) -> DataFrame:
    """(a, b, shared): how many normalised texts each pair of splits has in common."""
    h = split_hashes(df, split)
    other = h.select(F.col(split).alias("b"), "hash")
    return h.select(F.col(split).alias("a"), "hash").join(other, "hash").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each word of a at a time.

    A word of b moves, in each stretch of a that is still free, the mark of the first such word: an addition whose carries
    run through the stretch. Words that a lacks do nothing. 20,000 words against as many take some tenths of a second.
    """
    at: dict[str, int] = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    free = full
    for w in b:
        if here := free & at.get(w, 0):
            free = ((free + here) | (free - here)) & full
    return len(a) - free.bit_count()


def lcs_f1(a: Column, b: Column) -> Column:
    """F1 of the longest common subsequence of two texts' tokens; two empty texts agree. A null text is empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            out = []
            for s, t in zip(x, y):
                s, t = (s or "").casefold().split(), (t or "").casefold().split()
                out.append(1.0 if not s and not t else 2 * lcs_length(s, t) / (len(s) + len(t)))
            yield pd.Series(out)

    return run(a, b)


def paraphrase(a: Column, b: Column) -> dict[str, Column]:
    """Columns of two texts' different words in lower case: jaccard, the difference of their numbers, and whether they are equal."""
    x, y = (F.array_distinct(X.words(F.lower(F.coalesce(c, F.lit(""))))) for c in (a, b))
    same = F.array_sort(x) == F.array_sort(y)
    return {"jaccard": X.jaccard(x, y), "size_difference": F.abs(F.size(x) - F.size(y)), "same_words": same}
