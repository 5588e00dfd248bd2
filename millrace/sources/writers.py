"""Writers: results and reports as files. Each commits by job, so a reader never sees half of one."""

from __future__ import annotations

import hashlib
import json
import re
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, filters, reports, select, urd


def jsonl(df: DataFrame, path: str, by: str | None = None, gzip: bool = False) -> None:
    """Lines of JSON, in a folder for each value of by."""
    w = df.write.mode("errorifexists").option("compression", "gzip" if gzip else "none")
    (w.partitionBy(by) if by else w).json(path)


def parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("errorifexists")
    (w.partitionBy(by) if by else w).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def filter_bundle(df: DataFrame, decisions: DataFrame, path: str, target: float | None = None) -> dict:
    """Decisions, selected ids, kept rows, and summary, risk, diversity and cost reports under path; returns the manifest.

    Decisions, with their scores, are written first and read back, so all reports are of the same ones. The summary says
    whether the keep rate is near the target.
    """
    began = time.monotonic()
    spark = df.sparkSession
    decisions.write.mode("errorifexists").parquet(f"{path}/decisions")
    decisions = spark.read.parquet(f"{path}/decisions")
    decisions.where("keep").select("doc_id").write.parquet(f"{path}/selected_ids")
    kept = df.join(decisions.where("keep").select("doc_id"), "doc_id", "left_semi")
    kept.write.parquet(f"{path}/kept")
    kept = spark.read.parquet(f"{path}/kept")
    summary = filters.summary(df, decisions).withColumn("target_keep_rate_check", reports.keep_rate_check(F.col("document_keep_rate"), target))
    made = {
        "summary": summary, "risk": analysis.risk_report(kept), "diversity": analysis.diversity_report(kept), "local": reports.local_report(df, decisions),
        "cost": reports.cost_report(df, decisions, time.monotonic() - began),
    }
    out = {}
    for name, report in made.items():
        report.write.json(f"{path}/{name}")
        out[name] = report.first().asDict(recursive=True)
    out["content_hash"] = content_hash(decisions)
    return out


def urd_bundle(df: DataFrame, path: str, rate: float, pareto: bool = True) -> dict:
    """A filter bundle of the multi-objective selection, with component scores, and the Pareto layers and frontier as CSV."""
    parts = ["utility_score", "diversity_score", "risk_score", "shift_penalty", "cost_score"]
    urd.scores(df).write.mode("errorifexists").parquet(f"{path}/component_scores")
    scores = df.sparkSession.read.parquet(f"{path}/component_scores")
    decisions = urd.select_pareto(df, rate) if pareto else urd.select_fixed(df, rate)
    out = filter_bundle(df, decisions, path, rate)
    out["urd_summary"] = {"selection_mode": "pareto" if pareto else "fixed_weight", "components": parts}
    if pareto:
        layers = select.pareto_layers(scores, parts[:2], parts[2:])
        chosen = df.sparkSession.read.parquet(f"{path}/decisions").select("doc_id", F.col("keep").alias("selected"))
        csv(scores.join(layers, "doc_id").join(chosen, "doc_id").select("doc_id", "pareto_rank", "selected", *parts, F.col("urd_score").alias("tie_break_score")), f"{path}/pareto_frontier")
        layers.groupBy("pareto_rank").agg(F.count("*").alias("documents")).coalesce(1).write.json(f"{path}/pareto_layers")
    return out


def split_shards(df: DataFrame, path: str, tokens: str, targets: dict[str, int]) -> None:
    """Gzip shards of JSON lines in a folder for each split; rows in id order fill the splits' token targets, the rest is left out."""
    jsonl(select.token_target_split(df, tokens, targets).where("split is not null"), path, by="split", gzip=True)


def table_text(df: DataFrame, kind: str = "markdown", most: int = 1000) -> str:
    """A small report as a Markdown or LaTeX table; one of more rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as files")
    shown = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    if kind == "markdown":
        line = lambda cells: "| " + " | ".join(shown(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
        return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)]) + "\n"
    if kind == "latex":
        safe = lambda c: re.sub(r"([&%$#_{}])", r"\\\1", shown(c))
        body = [" & ".join(map(safe, r)) + r" \\" for r in (df.columns, *rows)]
        return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", body[0], r"\hline", *body[1:], r"\end{tabular}"]) + "\n"
    raise ValueError(f"unknown kind of table: {kind}")


def canonical(text: str) -> str:
    """Line feeds only, and one at the end."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if text.endswith("\n") or not text else text + "\n"


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that doesn't depend on their order: of the sums of their hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns) if not df.schema[c].dataType.typeName() == "map"])
    n, s = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)"))).head()
    return hashlib.sha256(f"{n}:{s}".encode()).hexdigest()


def manifest(df: DataFrame, name: str, config: dict, split: str = "split") -> dict:
    """What a dataset is: documents, tokens and bytes by split, its content's hash and the config's."""
    from ..functions import textexpr as X

    h = F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns) if df.schema[c].dataType.typeName() != "map"]).cast("decimal(38,0)"))
    per = df.groupBy(split).agg(F.count("*").alias("documents"), F.sum(F.size(X.words(X.text()))).alias("tokens"), F.sum(F.octet_length(X.text())).alias("bytes"), h.alias("h"))
    return {
        "name": name,
        "splits": {r[split]: {"documents": r["documents"], "tokens": r["tokens"], "bytes": r["bytes"], "hash": hashlib.sha256(str(r["h"]).encode()).hexdigest()} for r in per.collect()},  # splits
        "content_hash": content_hash(df),
        "config_hash": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(),
    }


def validate(df: DataFrame, expected: dict, config: dict) -> list[str]:
    """What differs from a manifest; empty if nothing does."""
    got = manifest(df, expected.get("name", ""), config)
    return [k for k in ("splits", "content_hash", "config_hash") if got[k] != expected.get(k)]
