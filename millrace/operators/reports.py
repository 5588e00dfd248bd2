"""Reports on what a filter did, on runs that were trained, and on the artefacts that a project has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textexpr as X
from . import analysis, dedup, ranking, scoring, select
from .storage import saved

# fixed values: scopes that only describe a protocol
PROTOCOL = ("main_protocol", "level2_protocol", "level3_heavy_protocol")


# --- filters


def keep_rate_check(actual: Column, target: float | None, tolerance: float = 0.25) -> Column:
    """A struct (status, difference): passed or warning, or not_applicable without a target."""
    if target is None:
        return F.struct(F.lit("not_applicable").alias("status"), F.lit(None).cast("double").alias("difference"))
    difference = F.abs(actual - F.lit(float(target)))
    return F.struct(F.when(difference <= tolerance, "passed").otherwise("warning").alias("status"), difference.alias("difference"))


def cost_report(df: DataFrame, decisions: DataFrame, seconds: float = 0.0, external: bool = False) -> DataFrame:
    """One row: rows in and kept, one operation for each row, and the run's seconds as given."""
    counts = df.agg(F.count("*").alias("input_docs")).join(decisions.agg(F.count_if("keep").alias("kept_docs")))  # one row each
    return counts.withColumns({"estimated_operations": F.col("input_docs"), "filter_runtime_seconds": F.lit(float(seconds)), "external_dependency_used": F.lit(external)})


def local_report(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: documents and words in and kept, keep rates, and mean and greatest risk and mean diversity of what is kept."""
    rows = scoring.local_scores(df).select("doc_id", "n_words", "local_risk", "local_diversity").join(decisions.select("doc_id", "keep"), "doc_id")
    kept = lambda c: F.when(F.col("keep"), F.col(c))
    out = rows.agg(
        F.count("*").alias("input_documents"), F.count_if("keep").alias("kept_documents"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("source_tokens"), F.coalesce(F.sum(kept("n_words")), F.lit(0)).alias("selected_tokens"),
        F.coalesce(F.avg(kept("local_risk")), F.lit(0.0)).alias("mean_risk"), F.coalesce(F.max(kept("local_risk")), F.lit(0.0)).alias("max_risk"), F.coalesce(F.avg(kept("local_diversity")), F.lit(0.0)).alias("mean_diversity"),
    )
    rate = lambda a, b: F.col(a) / F.greatest(F.lit(1), b)
    return out.withColumns({"document_keep_rate": rate("kept_documents", "input_documents"), "token_keep_rate": rate("selected_tokens", "source_tokens"), "filter_cost_units": F.col("input_documents")})


def dataset_card(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: sizes, retention, removed copies and near copies, and personal data before and after."""
    x = X.text()
    pii = X.guarded(x, X.EMAIL, x.contains("@")) + X.guarded(x, X.PHONE, x.rlike("[0-9]")) + X.guarded(x, X.ID, x.contains("ID-"))
    size = lambda df, p: df.agg(F.count("*").alias(f"{p}_docs"), F.coalesce(F.sum(F.char_length(x)), F.lit(0)).alias(f"{p}_chars"), F.coalesce(F.sum(pii), F.lit(0)).alias(f"pii_count_{p}"))
    exact = dedup.sha1_clusters(raw).agg(F.count("*").alias("num_duplicates_removed"))
    near = dedup.near_dedup(raw).agg(F.count("*").alias("num_near_duplicates_removed"))
    one = size(raw, "before").join(size(kept, "after")).join(exact).join(near)  # one row each
    return one.select(
        F.col("before_docs").alias("num_docs"), F.col("after_docs").alias("retained_docs"), F.col("before_chars").alias("raw_chars"), F.col("after_chars").alias("retained_chars"),
        (F.col("after_chars") / F.greatest(F.lit(1), "before_chars")).alias("retention_rate"), "num_duplicates_removed", "num_near_duplicates_removed", "pii_count_before", "pii_count_after",
    )


def removed(raw: DataFrame, cleaned: DataFrame, examples: int = 3, size: int = 180) -> DataFrame:
    """(doc_id, excerpt): the first documents by id whose cleaned and redacted text the cleaned corpus lacks."""
    from . import pipeline

    done = raw.select("doc_id", pipeline.redact(pipeline.clean(X.text())).alias("text"))
    have = cleaned.select(F.sha2(X.text(), 256).alias("h")).distinct()
    gone = done.withColumn("h", F.sha2("text", 256)).join(have, "h", "left_anti")
    return gone.orderBy("doc_id").limit(examples).select("doc_id", F.left("text", F.lit(size)).alias("excerpt"))


def score_failures(df: DataFrame, dev: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """What the first score's hard cut does, beside the second score's selection.

    A table (doc_id, hdqs_score, hdqs_v2_score, kept_by_hdqs, kept_by_hdqs_v2, excerpt, the document metrics against dev), and
    a row for kept and for dropped documents: mean metrics, and the first score's correlation with dev_loss_proxy.
    """
    from . import pipeline

    first = scoring.hdqs(df).select("doc_id", F.round("score", 9).alias("score"))
    kept = max(1, round(first.count() * rate))
    first = saved(first, "scored")
    best = ranking.first_rows(first, kept, [("score", True), ("doc_id", False)]).select("doc_id").distinct().withColumn("kept_by_hdqs", F.lit(True))
    second = select.select_v2_variant(df, rate=rate, reference=dev).select("doc_id", F.col("score").alias("hdqs_v2_score"), F.col("keep").alias("kept_by_hdqs_v2"))
    rows = first.withColumnRenamed("score", "hdqs_score").join(best, "doc_id", "left").withColumn("kept_by_hdqs", F.coalesce("kept_by_hdqs", F.lit(False)))
    rows = rows.join(second, "doc_id").join(df.select("doc_id", pipeline.excerpt(X.text()).alias("excerpt")), "doc_id").join(scoring.document_metrics(df, dev), "doc_id")
    means = [F.avg(c).alias(f"mean_{c}") for c in ("token_count", "token_diversity", "repetition_rate", "token_entropy")]
    summary = rows.groupBy("kept_by_hdqs").agg(F.count("*").alias("documents"), *means, analysis.correlation(rows, "hdqs_score", "dev_loss_proxy").alias("score_loss_correlation"))
    return rows, summary


# --- runs


def generation_repetition(df: DataFrame, text: str = "text") -> DataFrame:
    """df with sample_characters, repeated_trigrams and repetition_rate of what a model wrote."""
    t = X.words(X.text(text))
    grams = F.transform(F.sequence(F.lit(0), F.size("__t") - 3), lambda i: F.struct(F.get("__t", i), F.get("__t", i + 1), F.get("__t", i + 2)))
    repeated = F.when(F.size("__t") < 3, 0).otherwise(F.size(grams) - F.size(F.array_distinct(grams)))
    out = df.withColumn("__t", t).withColumns({"sample_characters": F.char_length(X.text(text)), "repeated_trigrams": repeated})
    return out.withColumn("repetition_rate", F.col("repeated_trigrams") / F.greatest(F.lit(1), F.size("__t") - 2)).drop("__t")


def retention_rows(variants: DataFrame, runs: DataFrame, raw: str = "raw_noisy_baseline") -> DataFrame:
    """Variants (see pipeline.compared) beside their runs' mean perplexity (variant, perplexity); those without are data only."""
    base = variants.where(F.col("variant") == raw).select(F.col("characters").alias("raw_characters"))
    rows = variants.join(base).join(runs.groupBy("variant").agg(F.avg("perplexity").alias("perplexity_mean")), "variant", "left")  # base: one row
    return rows.select(
        "variant", (F.col("characters") / F.greatest(F.lit(1.0), "raw_characters")).alias("retention_ratio"), F.col("documents").alias("retained_documents"), "mean_hdqs", F.col("pii_hits").alias("pii_like_hits"),
        "perplexity_mean", F.when(F.col("perplexity_mean").isNull(), "data_only").otherwise("trained").alias("status"),
    )


def downstream_rows(runs: DataFrame) -> DataFrame:
    """(variant, next_character_accuracy, held_out_perplexity, robustness) of runs (variant, accuracy, perplexity)."""
    a = runs.groupBy("variant").agg(F.avg("accuracy").alias("next_character_accuracy"), F.avg("perplexity").alias("held_out_perplexity"))
    return a.withColumn("held_out_noisy_robustness_proxy", 1 / F.greatest(F.lit(1.0), "held_out_perplexity"))


def decision_table(runs: DataFrame, references: dict[str, float], full: str, promote: str | None = None) -> DataFrame:
    """(variant, seeds, mean, delta_<reference>, decision) of runs (variant, seed, value); lower values are better.

    promote is the variant that a diagnosis has singled out. Others need more diagnostics if they better the full variant by
    over 1 and come within 0.25 of the random and the dedup reference, or if they better the raw one.
    """
    mean = runs.where(F.col("value").isNotNull()).groupBy("variant").agg(F.count_distinct("seed").alias("seeds"), F.avg("value").alias("mean"))
    base = mean.where(F.col("variant") == full).agg(F.max("mean").alias("__full"))
    out = mean.join(base)  # one row
    for name in ("raw", "random", "dedup"):
        out = out.withColumn(f"delta_{name}", F.lit(references.get(name)).cast("double") - F.col("mean"))
    over = F.coalesce(F.col("mean") < F.col("__full") - 1, F.lit(False))
    near = lambda name: F.coalesce(F.col(f"delta_{name}") > -0.25, F.lit(False))
    decision = F.when((over & near("random") & near("dedup")) | F.coalesce(F.col("delta_raw") > 0, F.lit(False)), "needs_more_diagnostics").when(over, "keep_debug_only").otherwise("reject")
    if promote is not None:
        decision = F.when(F.col("variant") == promote, "promote_to_3seed").otherwise(decision)
    return out.withColumn("decision", decision).drop("__full")


def paired_status(paired: DataFrame) -> DataFrame:
    """Paired differences (n, ci95_low, ci95_high) with what may be claimed: nothing under three pairs, support from five on."""
    low, high, n = F.col("ci95_low"), F.col("ci95_high"), F.col("n")
    status = F.when(n < 3, "insufficient_seeds").when((low > 0) & (n >= 5), "supported_over_reference").when(low > 0, "positive_preliminary_trend").when(high < 0, "negative_preliminary_trend").otherwise("trend_only_ci_crosses_zero")
    claim = F.when(n < 3, "engineering_observation_only").when((low > 0) & (n >= 5), "method_supported").when((low > 0) | (high < 0), "preliminary_trend_only_no_significance_claim").otherwise("trend_only_no_significance_claim")
    return paired.withColumns({"status": status, "claim": claim})


def eligible(runs: DataFrame, least_tokens: int = 0, needed: tuple[str, ...] = ()) -> DataFrame:
    """Runs (run_status, dataset_scope, tokens, ...) that a comparison may use: completed, not of a smoke or protocol scope,
    of enough tokens, with all that is needed."""
    ok = (F.col("run_status") == "completed_training") & ~F.coalesce(F.col("dataset_scope"), F.lit("")).isin("smoke", *PROTOCOL) & (F.coalesce(F.col("tokens"), F.lit(0)) >= least_tokens)
    for c in needed:
        ok = ok & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return runs.where(ok)


def proxy_mismatch(df: DataFrame) -> DataFrame:
    """Rows (dataset, method, risk, diversity, loss) with what the proxies promise and what training showed."""
    return df.select("dataset", "method", (F.col("diversity") - F.col("risk")).alias("proxy_utility"), (-F.col("loss")).alias("observed_utility"), (1 - F.col("diversity")).alias("diversity_loss_proxy"))


def rank_stability(ranks: DataFrame) -> DataFrame:
    """(method, mean_rank, rank_range) of rows (method, rank)."""
    return ranks.groupBy("method").agg(F.avg("rank").alias("mean_rank"), (F.max("rank") - F.min("rank")).alias("rank_range"))


def best_by_dataset(df: DataFrame) -> DataFrame:
    """(dataset, best_method, mean_loss) of rows (dataset, method, loss); of equal losses the first name."""
    return df.groupBy("dataset").agg(F.min_by("method", F.struct("loss", "method")).alias("best_method"), F.avg("loss").alias("mean_loss"))


def compared_with(df: DataFrame, method: str, references: tuple[str, ...]) -> DataFrame:
    """(dataset, comparison, reference_loss, method_loss) of the method beside each reference that a dataset has."""
    mine = df.where(F.col("method") == method).select("dataset", F.col("loss").alias("method_loss"))
    theirs = df.where(F.col("method").isin(*references)).select("dataset", F.concat(F.lit(f"{method}_vs_"), "method").alias("comparison"), F.col("loss").alias("reference_loss"))
    return theirs.join(mine, "dataset").select("dataset", "comparison", "reference_loss", "method_loss")


def column_summary(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """(group, component, n, mean, std, standard_error) of columns; the last two are null for a single value."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")
    a = df.select(group, each).select(group, "x.component", "x.v").groupBy(group, "component").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    std = F.when(F.col("n") > 1, F.col("std"))
    return a.withColumns({"std": std, "standard_error": std / F.sqrt("n")})


def evidence(scope: Column, size: Column, smoke: Column | None = None, protocol: Column | None = None) -> Column:
    """A struct (evidence_level, evidence_sufficiency, insufficient_evidence): 30 or more of a proper scope are a candidate."""
    is_smoke = (scope == "smoke") | (smoke if smoke is not None else F.lit(False))
    is_protocol = scope.isin(*PROTOCOL) | (protocol if protocol is not None else F.lit(False))
    few = size.isNull() | (size < 30)
    level = F.when(is_smoke, "smoke_only").when(is_protocol, "protocol_only").when(few, "sample_partial").otherwise("level2_candidate")
    enough = F.when(is_smoke, "smoke_diagnostic_only").when(is_protocol, "protocol_only").when(few, "insufficient").otherwise("sufficient")
    return F.struct(level.alias("evidence_level"), enough.alias("evidence_sufficiency"), (is_smoke | is_protocol | few).alias("insufficient_evidence"))


def timing(df: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(group, n, mean, p50, ...): percentiles that are values of the column."""
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *[F.expr(f"percentile_disc({s}D) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(s * 100)}") for s in shares])


# fixed values: words in the text of an error, and the class that they say it is of; the first class with one counts
FAILURES = {
    "failed_due_to_auth": ("401", "403", "auth", "token", "permission", "gated"),
    "failed_due_to_disk": ("no space", "disk", "quota"),
    "failed_due_to_network": ("connection", "connect", "timeout", "timed out", "network", "ssl", "proxy", "http", "remote", "couldn't reach", "could not reach"),
}


def failure_class(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    cases = [F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), name) for name, words in FAILURES.items()]
    return F.coalesce(*cases, F.lit("failed_due_to_environment"))


# --- artefacts


def normalised_runs(runs: DataFrame, parts: tuple[str, ...], config: str | None = None, root: str = "") -> DataFrame:
    """runs with run_id, of parts without blanks and backslashes, config_hash, and no path of this machine in any string."""
    clean = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("/")), F.lit(" "), F.lit("_"))
    out = runs.withColumn("run_id", F.concat_ws(":", *[clean(p) for p in parts]))
    if config:
        out = out.withColumn("config_hash", F.sha2(F.coalesce(F.col(config).cast("string"), F.lit("")), 256))
    if root:
        out = out.withColumns({c: F.replace(F.replace(F.col(c), F.lit(root.rstrip("/") + "/"), F.lit("")), F.lit(root), F.lit(".")) for c, t in out.dtypes if t == "string"})
    return out


def scanned(spark, path: str) -> DataFrame:
    """(path, artifact_type, bytes, sha256) of every file under a folder: reports, tables, rows, configs and what else there is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.lower("path")
    kind = F.when(name.endswith("manifest.json"), "manifest").when(name.endswith(".csv"), "table").when(name.rlike(r"\.jsonl(\.gz)?$"), "rows").when(name.endswith(".json"), "report").when(name.rlike(r"\.ya?ml$"), "config").otherwise("other")
    return files.select("path", kind.alias("artifact_type"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lineage(artifacts: DataFrame) -> DataFrame:
    """(child, parent, known): the edges of rows (path, parent_artifacts), and whether the parent is a row itself."""
    edges = artifacts.select(F.col("path").alias("child"), F.explode("parent_artifacts").alias("parent"))
    have = artifacts.select(F.col("path").alias("parent"), F.lit(True).alias("known")).distinct()
    return edges.join(have, "parent", "left").select("child", "parent", F.coalesce("known", F.lit(False)).alias("known"))


def lineage_warnings(artifacts: DataFrame) -> DataFrame:
    """(path): main tables that are evidence without a parent."""
    return artifacts.where(F.col("main_evidence") & (F.col("artifact_type") == "main_table") & (F.coalesce(F.size("parent_artifacts"), F.lit(0)) <= 0)).select("path")


def gates(artifacts: DataFrame, needed: dict[str, tuple[str, int]]) -> DataFrame:
    """(gate, needed, found, passed): whether there are enough rows for each gate, {name: (condition in SQL, least)}, in one pass."""
    counts = artifacts.agg(*[F.count_if(F.expr(cond)).alias(name) for name, (cond, _) in needed.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.lit(least).alias("needed"), F.col(n).alias("found")) for n, (_, least) in needed.items()])).alias("g")
    return counts.select(each).select("g.*").withColumn("passed", F.col("found") >= F.col("needed"))
