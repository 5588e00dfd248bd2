"""Corpus reports, distributions and their divergence, and statistics of repeated measurements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions import textexpr as X
from . import scoring, select

SMOOTHING = 1e-9
BINS = (0, 40, 80, 160, 320, 640, 1280, 2560, 10**9)


def risk_report(df: DataFrame) -> DataFrame:
    """One row over kept documents: links, tags, symbols, digits, personal data and duplicates.

    Ratios are of the texts joined by line breaks; a link or tag that would reach over two texts isn't counted.
    """
    p = X.profile(df).withColumn("norm", F.sha2(X.normalise(X.text()), 256))
    dup = F.count("*") - F.count_distinct("norm")
    n = F.greatest(F.lit(1), F.count("*"))
    chars = F.greatest(F.lit(1), F.sum("n_len") + F.count("*") - 1)
    return p.agg(
        (F.sum("n_url") / n).alias("url_ratio"),
        (F.sum("n_html") / n).alias("html_ratio"),
        (F.sum("n_sym") / chars).alias("symbol_ratio"),
        (F.sum("n_digit") / chars).alias("digit_ratio"),
        (F.sum("n_email") + F.sum("n_phone")).alias("estimated_pii_hits"),
        (dup / n).alias("duplicate_hint_rate"),
    )


def diversity_report(df: DataFrame) -> DataFrame:
    n = df.select(F.size(X.tokens(X.text())).alias("n"), F.when(F.col("source") != "", F.col("source")).alias("source"))
    a = n.agg(F.avg("n").alias("length_mean"), F.stddev_pop("n").alias("length_std"), F.count_distinct("source").alias("source_count"))
    t = scoring.token_counts(df).agg((F.count("*") / F.greatest(F.lit(1), F.sum("c"))).alias("unique_token_ratio"))
    return a.join(t)  # two one-row aggregates


def quality_metrics(df: DataFrame) -> DataFrame:
    """One row: sizes, copies, personal data, the share that passes the rule filter, and the mean score."""
    rows = X.with_ratios(scoring.hdqs(df)).withColumns({"raw": F.sha2(X.text(), 256), "passes": F.expr(formulas.spark(formulas.RULE))})
    n, kinds = F.count("*"), F.count_distinct("raw")
    return rows.agg(
        n.alias("documents"),
        F.sum("n_len").alias("characters"),
        (n - kinds).alias("duplicate_documents"),
        ((n - kinds) / F.greatest(F.lit(1), n)).alias("duplicate_rate"),
        F.sum("q_email").alias("email_hits"),
        F.sum("q_phone").alias("phone_hits"),
        F.sum("q_id").alias("id_hits"),
        (F.count_if("passes") / F.greatest(F.lit(1), n)).alias("pass_rate"),
        F.avg("score").alias("mean_score"),
    )


def corpus_analysis(df: DataFrame) -> DataFrame:
    """One row: lengths and tokens (the median is the upper one), issue counts and duplicates."""
    x = X.text()
    rows = df.select(
        F.char_length(x).alias("len"), X.count_tokens(x).alias("tok"), (X.strip(x) == "").alias("empty"), x.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]").alias("control"),
        x.contains("�").alias("replacement"), x.rlike(X.HTML).alias("html"), x.rlike(X.URL).alias("url"), F.sha2(x, 256).alias("raw"),
    )
    n = rows.count()
    share = (n // 2 + 0.5) / n if n else 0.5
    dist = lambda c: [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.expr(f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY {c})").alias(f"{c}_p50")]
    return rows.agg(
        F.count("*").alias("documents"), *dist("len"), *dist("tok"),
        *[F.count_if(c).alias(f"{c}_documents") for c in ("empty", "control", "replacement", "html", "url")],
        (F.count("*") - F.count_distinct("raw")).alias("duplicate_rows"), F.avg((F.col("len") >= 20).cast("double")).alias("share_len_20"),
    )


def token_topk(df: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent tokens; of equally frequent ones the first to occur by (doc_id, place)."""
    each = df.select("doc_id", F.posexplode(X.tokens(X.text())).alias("at", "token"))
    counts = each.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "at")).alias("first"))
    return counts.orderBy(F.desc("c"), "first").limit(k).select("token", "c")


def length_histogram(df: DataFrame, bins: tuple[int, ...] = BINS) -> DataFrame:
    n = F.size(X.tokens(X.text()))
    label = F.coalesce(*[F.when((n >= a) & (n < b), f"{a}-{b}") for a, b in zip(bins, bins[1:])])
    return df.select(label.alias("bin")).groupBy("bin").agg(F.count("*").alias("c"))


def divergence(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (kl, js) of two (token, c) counts, in bits, smoothed over their common vocabulary."""
    both = left.select("token", F.col("c").alias("x")).join(right.select("token", F.col("c").alias("y")), "token", "full_outer")
    both = both.select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    s = both.agg(F.count("*"), F.sum("x"), F.sum("y")).head()
    v = s[0] or 0
    p = (F.col("x") + SMOOTHING) / F.lit((s[1] or 0) + SMOOTHING * v)
    q = (F.col("y") + SMOOTHING) / F.lit((s[2] or 0) + SMOOTHING * v)
    r = both.select(p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    kl = F.coalesce(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))), F.lit(0.0))
    js = F.coalesce(F.sum(F.col("p") * F.log2(F.col("p") / F.col("m"))) + F.sum(F.col("q") * F.log2(F.col("q") / F.col("m"))), F.lit(0.0)) / 2
    return r.agg(kl.alias("kl"), js.alias("js"))


def divergence_by(df: DataFrame, group: str) -> DataFrame:
    """(group, js) of each group's token distribution against the whole corpus's, in one pass over the tokens."""
    counts = df.select(F.col(group).alias("g"), F.explode(X.tokens(X.text())).alias("token")).groupBy("g", "token").agg(F.count("*").alias("x"))
    counts = select.saved(counts, "counts")
    whole = counts.groupBy("token").agg(F.sum("x").alias("y"))
    vocab, total = whole.agg(F.count("*"), F.sum("y")).head()
    vocab, total = vocab or 0, total or 0
    sums = counts.groupBy("g").agg(F.sum("x").alias("all"), F.count("*").alias("kinds"))
    q = (F.col("y") + SMOOTHING) / F.lit(total + SMOOTHING * vocab)
    rows = counts.join(whole, "token").join(sums, "g").select("g", "x", q.alias("q"), ((F.col("x") + SMOOTHING) / (F.col("all") + SMOOTHING * vocab)).alias("p"), ((F.lit(0) + SMOOTHING) / (F.col("all") + SMOOTHING * vocab)).alias("p0"))
    m = (F.col("p") + F.col("q")) / 2
    m0 = (F.col("p0") + F.col("q")) / 2
    term = lambda p, mid: p * F.log2(p / mid) + F.col("q") * F.log2(F.col("q") / mid)
    # all tokens as if the group had none of them, then the difference where it has some
    some = rows.groupBy("g").agg(F.sum(term(F.col("p"), m) - term(F.col("p0"), m0)).alias("d"))
    # tokens with equal corpus counts contribute the same: a few different counts stand for the vocabulary
    hist = whole.groupBy("y").agg(F.count("*").alias("times"))
    base = sums.join(hist).select("g", "times", q.alias("q"), ((F.lit(0) + SMOOTHING) / (F.col("all") + SMOOTHING * vocab)).alias("p0"))
    zero = base.groupBy("g").agg(F.sum(F.col("times") * term(F.col("p0"), m0)).alias("z"))
    return zero.join(some, "g", "left").select(F.col("g").alias(group), ((F.col("z") + F.coalesce("d", F.lit(0.0))) / 2).alias("js"))


def correlation(df: DataFrame, a: str, b: str) -> Column:
    """Pearson's, 0 where it is undefined."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def summarize(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sample deviation (0 of one value) and the normal 95 % interval (null of one value) of each group."""
    n, std = F.count(value), F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(None)), F.lit(0.0))
    a = df.groupBy(group).agg(n.alias("n"), F.avg(value).alias("mean"), std.alias("std"))
    margin = F.when(F.col("n") > 1, 1.96 * F.col("std") / F.sqrt("n"))
    return a.withColumns({"ci95_low": F.col("mean") - margin, "ci95_high": F.col("mean") + margin})


def method_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, std) with the deviation of a whole population, 0 for a single value."""
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"))


def paired_difference(df: DataFrame, method: str, seed: str, value: str, baseline: str, lower_is_better: bool = True) -> DataFrame:
    """Improvement of each method over the baseline, matched by seed."""
    per = df.groupBy(method, seed).agg(F.avg(value).alias("v"))
    base = per.where(F.col(method) == baseline).select(seed, F.col("v").alias("base"))
    diff = per.where(F.col(method) != baseline).join(base, seed).select(method, (F.col("base") - F.col("v") if lower_is_better else F.col("v") - F.col("base")).alias("d"))
    return summarize(diff, method, "d").withColumn("positive_mean_improvement", F.col("mean") > 0)


def spearman(df: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Spearman's correlation on ordinal ranks, of equal values by order: one row."""
    r = select.global_rank(select.global_rank(df.select(order, a, b), F.col(a), F.col(order), name="ra"), F.col(b), F.col(order), name="rb")
    n = F.count("*")
    d2 = F.sum((F.col("ra") - F.col("rb")).cast("double") * (F.col("ra") - F.col("rb")))
    return r.agg(F.when(n < 2, 0.0).otherwise(1 - 6 * d2 / (n.cast("double") * (n.cast("double") * n - 1))).alias("rho"))


def ranking(df: DataFrame, dataset: str, method: str, value: str) -> DataFrame:
    """Mean, best and worst rank of each method over datasets; lower values rank first, of equal ones by name."""
    mean = df.groupBy(dataset, method).agg(F.avg(value).alias("v"))
    r = mean.withColumn("r", F.row_number().over(Window.partitionBy(dataset).orderBy("v", method)))
    return r.groupBy(method).agg(F.avg("r").alias("mean_rank"), F.min("r").alias("best_rank"), F.max("r").alias("worst_rank"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


#: Bootstraps by name: (samples, places of the low and the high bound among n sorted means, what single values give).
BOOTSTRAPS = {
    "interval": (1000, lambda n: (int(0.025 * n), int(0.975 * n) - 1), "itself"),
    "inclusive": (200, lambda n: (int(0.025 * (n - 1)), int(0.975 * (n - 1))), "null"),
    "registry": (500, lambda n: (int(0.025 * n), int(0.975 * n) - 1), "null"),
    "methods": (1000, lambda n: (int(0.025 * (n - 1)), int(0.975 * (n - 1))), "itself"),
    "runs": (1000, lambda n: (int(0.025 * (n - 1)), int(0.975 * (n - 1))), "itself, or zero"),
}


def bootstrap_mean(df: DataFrame, group: str, value: str, key: list[str], kind: str = "inclusive", seed: int = 13) -> DataFrame:
    """(group, n, mean, ci_low, ci_high) by a Poisson bootstrap: each row's weight in each sample is drawn from a hash of its
    key, which must tell rows apart: the same for any partitioning. kind: of BOOTSTRAPS.

    A row's weights are made in one array and summed place by place, so no row is exploded; nulls are left out.
    """
    samples, places, single = BOOTSTRAPS[kind]
    low, high = places(samples)
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), *key).alias("k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for name, part in b.groupby(group, dropna=False, sort=False):
                v, k = part["v"].to_numpy(), part["k"].to_numpy().view(np.uint64)
                for at in range(0, len(v), 4096):
                    x = k[at : at + 4096, None] + np.arange(1, samples + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                    w = np.searchsorted(np.array(cdf), (x >> np.uint64(11)).astype(float) / 2.0**53, side="right")
                    got = sums.setdefault(name, np.zeros((2, samples)))
                    got[0] += (w * v[at : at + 4096, None]).sum(axis=0)
                    got[1] += w.sum(axis=0)
        yield pd.DataFrame([(name, s, x, y) for name, (a, b) in sums.items() for s, (x, y) in enumerate(zip(a, b))], columns=[group, "b", "x", "w"])

    kind_ = dict(df.dtypes)[group]
    means = rows.mapInPandas(run, f"`{group}` {kind_}, b int, x double, w double").groupBy(group, "b").agg((F.sum("x") / F.greatest(F.lit(1.0), F.sum("w"))).alias("m"))
    ordered = means.groupBy(group).agg(F.array_sort(F.collect_list("m")).alias("m"))  # samples numbers
    out = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).join(ordered, group, "left")
    alone = {"itself": F.col("mean"), "null": F.lit(None).cast("double"), "itself, or zero": F.coalesce("mean", F.lit(0.0))}[single]
    bound = lambda at: F.when(F.col("n") > 1, F.get("m", F.lit(at))).otherwise(alone)
    return out.select(group, "n", "mean", bound(low).alias("ci_low"), bound(high).alias("ci_high"))
