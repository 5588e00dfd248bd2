"""Cleaning, redaction, controlled noise, ablations, sweeps, splits and chunks."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions import textexpr as X
from . import dedup, filters, ranking, scoring, select

MOJIBAKE = " Encoding sample: cafÃ© â€™ â€œ."


def clean(x: Column) -> Column:
    """Without tags, then without links, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, X.HTML, " "), r"https?://\S+", " "), r"[\s\p{Z}]+", " "))


def redact(x: Column) -> Column:
    """Mail addresses, then phone numbers, then ids replaced by their kind. Texts without what every match needs are left as they are."""
    for pattern, kind, needs in ((X.EMAIL, "<EMAIL>", "@"), (X.PHONE, "<PHONE>", "[0-9]"), (X.ID, "<ID>", "ID-")):
        # named by a lambda, as x written three times would triple all that it is made of
        x = F.get(F.transform(F.array(x), lambda t: F.when(t.rlike(needs), F.regexp_replace(t, pattern, kind)).otherwise(t)), F.lit(0))  # noqa: B023
    return x


def excerpt(x: Column, size: int = 220) -> Column:
    x = F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " "))
    return F.left(F.regexp_replace(F.regexp_replace(x, X.EMAIL, "[EMAIL]"), X.PHONE, "[PHONE]"), F.lit(size))


def chunks(df: DataFrame, size: int = 360) -> DataFrame:
    """(doc_id, chunk, text): runs of size code points, line breaks made one character; an empty text has none."""
    x = F.replace(X.text(), F.lit("\r\n"), F.lit("\n"))
    return df.select("doc_id", F.posexplode(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("chunk", "text"))


# fixed values: what the noise families add, as (every k-th, remainder, text before, text after)
NOISE = {
    "html_boilerplate": (3, 0, "<article><nav>archive</nav>", "</article>"),
    "url_spam": (4, 0, "", " https://spam.example.invalid/archive/{i}?ref=promo"),
    "pii_canaries": (7, 0, "", " Contact editor{i}@example.org or +1 412 555 {p}; reference ID-13-{j}."),
    "mojibake": (10, 0, "", MOJIBAKE),
    "repeated_ngrams": (11, 0, "", " repeated phrase repeated phrase repeated phrase"),
    "mixed_language": (13, 0, "", " mixed language snippet bonjour mundo"),
    "excessive_symbols": (6, 0, "", " !!! ### $$$ %%%"),
    "navigation_bars": (4, 1, "Home Archive About Login Search :: ", ""),
    "footer_copyright": (5, 2, "", " Copyright 2024 Example Media. Terms Privacy Contact."),
    "seo_keyword_stuffing": (6, 2, "", " AI benchmark data quality language model best guide tutorial"),
    "ad_blocks": (7, 3, "", " Sponsored: buy cloud credits now now now."),
    "cookie_banners": (8, 3, "", " Cookie settings accept reject manage preferences."),
    "malformed_html": (9, 4, "", " <div><span><p>broken markup"),
    "boilerplate_templates": (10, 4, "", " template header sidebar footer template header sidebar footer"),
    "multilingual_fragments": (11, 5, "", " hola mundo bonjour données modelo texto"),
    "encoding_artifacts": (12, 5, "", " mojibake sample: Ã© â€™ �"),
}
#: Rows that are added after every k-th document: (k, text, times, times more by index modulo).
EXTRA = {
    "low_information_templates": (8, "template navigation footer ", 8, 3),
    "generated_repetition": (12, "generated continuation loop ", 10, 4),
    "low_information_pages": (14, "login signup settings profile ", 12, 1),
    "repeated_template_pages": (15, "article card related links ", 14, 1),
}


def noise_counts(df: DataFrame, families: set[str] | None = None, intensity: float = 1.0) -> DataFrame:
    """(family, n): how often noise() puts each family in, of those that are on and come at least once."""
    if intensity <= 0:
        return df.limit(0).select(F.lit("").alias("family"), F.lit(0).cast("long").alias("n"))
    i = F.col("doc_id")
    hits = {name: i % every == rest for name, (every, rest, _, _) in NOISE.items()} | {name: i % every == 0 for name, (every, *_) in EXTRA.items()}
    hits |= {"ocr_corruption": i % 9 == 0, "exact_duplicates": i % 5 == 0, "near_duplicates": i % 8 == 0}
    each = [F.struct(F.lit(name).alias("family"), F.count_if(hit).alias("n")) for name, hit in hits.items() if families is None or name in families]
    if not each:
        return noise_counts(df, intensity=0)
    return df.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*").where("n > 0")


def noise(df: DataFrame, families: set[str] | None = None, intensity: float = 1.0) -> DataFrame:
    """(doc_id, kind, text): documents with controlled noise by their id, and the rows that it adds.

    families chooses among NOISE, EXTRA, "ocr_corruption", "exact_duplicates" and "near_duplicates"; none is all. Without
    intensity there is no noise. Rows are in no order: shuffle by a hash where one is needed.
    """
    families = families if intensity > 0 else set()
    on = lambda name: families is None or name in families
    i = F.col("doc_id")
    base = df.select("doc_id", X.text().alias("text"))

    def first(old: str, new: str) -> Column:
        at = F.instr("text", old)
        return F.when((i % 9 == 0) & (at > 0), F.overlay("text", F.lit(new), at, F.lit(len(old)))).otherwise(F.col("text"))

    for name, (every, rest, before, after) in NOISE.items():
        if name == "mojibake" and on("ocr_corruption"):
            base = base.withColumn("text", first("the", "tbe")).withColumn("text", first("ing", "1ng"))
        if not on(name):
            continue
        added = F.lit(after)
        for mark, with_ in (("{i}", i.cast("string")), ("{p}", F.format_string("%04d", i + 1000)), ("{j}", F.format_string("%04d", i))):
            added = F.replace(added, F.lit(mark), with_) if mark in after else added
        hit = i % every == rest
        base = base.withColumn("text", F.concat(F.when(hit, before).otherwise(""), "text", F.when(hit, added).otherwise("")))
    rows = [base.select("doc_id", F.lit("document").alias("kind"), "text")]
    if on("exact_duplicates"):
        rows.append(base.where(i % 5 == 0).select("doc_id", F.lit("exact_duplicates").alias("kind"), "text"))
    if on("near_duplicates"):
        rows.append(base.where(i % 8 == 0).select("doc_id", F.lit("near_duplicates").alias("kind"), F.concat("text", F.lit(" updated")).alias("text")))
    for name, (every, phrase, times, more) in EXTRA.items():
        if on(name):
            rows.append(df.where(i % every == 0).select("doc_id", F.lit(name).alias("kind"), F.trim(F.repeat(F.lit(phrase), (F.lit(times) + i % more).cast("int"))).alias("text")))
    return reduce(DataFrame.unionByName, rows)


def apply(df: DataFrame, steps: tuple[str, ...] = ("clean", "redact", "rule", "hdqs", "exact", "near"), threshold: float = 0.80) -> DataFrame:
    """df after the steps, in their order; an unknown step is an error. "hdqs+x" is the quality step at a threshold higher by x."""
    for step in steps:
        if step == "clean":
            df = df.withColumn("text", clean(X.text()))
        elif step == "redact":
            df = df.withColumn("text", redact(X.text()))
        elif step == "rule":
            df = kept(df, filters.rule_filter(df))
        elif step.partition("+")[0] == "hdqs":
            least = threshold + float(step.partition("+")[2] or 0)
            s = scoring.hdqs(df).select("doc_id", (F.round("score", 9) >= round(least, 9)).alias("keep"))
            df = kept(df, s)
        elif step == "exact":
            df = kept(df, dedup.exact_dedup(df))
        elif step == "minhash":
            gone = dedup.greedy(dedup.near_pairs(df, toks=dedup.folded_words()))
            df = df.join(gone.select(F.col("member").cast(dict(df.dtypes)["doc_id"]).alias("doc_id")), "doc_id", "left_anti")
        elif step == "near":
            df = df.join(dedup.near_dedup(df).select(F.col("member").alias("doc_id")), "doc_id", "left_anti")
        else:
            raise ValueError(f"unknown step: {step}")
    return df


def kept(df: DataFrame, decisions: DataFrame) -> DataFrame:
    return df.join(decisions.where("keep").select("doc_id"), "doc_id", "left_semi")


# fixed values: the variants by name, as steps; see variant() for those that match the full pipeline's retention
FULL = ("clean", "redact", "hdqs", "exact", "near")
VARIANTS = {
    "raw_noisy_baseline": (),
    "clean_only": ("clean",),
    "pii_redact_only": ("redact",),
    "exact_dedup_only": ("exact",),
    "near_dedup_only": ("near",),
    "jaccard_near_dedup_only": ("near",),
    "rule_filter_only": ("rule",),
    "rule_quality_filter": ("rule",),
    "perplexity_filter_proxy": ("hdqs+0.04",),
    "proxy_perplexity_filter": ("hdqs+0.04",),
    "hdqs_filter": ("hdqs",),
    "hdqs_curriculum": ("hdqs",),
    "full_pipeline_without_clean": ("redact", "hdqs", "exact", "near"),
    "full_pipeline_without_redact": ("clean", "hdqs", "exact", "near"),
    "full_pipeline_without_exact_dedup": ("clean", "redact", "hdqs", "near"),
    "full_pipeline_without_near_dedup": ("clean", "redact", "hdqs", "exact"),
    "full_without_hdqs": ("clean", "redact", "rule", "exact", "near"),
    "full_pipeline": FULL,
    "full_pipeline_without_hdqs": ("clean", "redact", "rule", "exact", "near"),
    "minhash_lsh_near_dedup_only": ("minhash",),
}
MATCHED = ("random_retention_matched_baseline", "length_matched_baseline", "quality_retention_matched_baseline")
ORDERS = {
    "clean_redact_exact_near_hdqs": ("clean", "redact", "exact", "near", "hdqs"),
    "clean_dedup_redact_hdqs": ("clean", "exact", "near", "redact", "hdqs"),
    "hdqs_clean_dedup": ("hdqs", "clean", "exact", "near"),
    "redact_before_dedup": ("redact", "exact", "near", "hdqs"),
    "redact_after_dedup": ("exact", "near", "redact", "hdqs"),
    "near_dedup_before_hdqs": ("clean", "redact", "near", "hdqs"),
    "near_dedup_after_hdqs": ("clean", "redact", "hdqs", "near"),
}


def _walked(df: DataFrame, named: dict[str, tuple[str, ...]], threshold: float) -> dict[str, DataFrame]:
    """The result of each row of steps. Rows that begin alike share what they begin with, written once."""
    known = {(): df}
    begun = Counter(steps[:k] for steps in set(named.values()) for k in range(1, len(steps) + 1))
    out = {}
    for name, steps in named.items():
        for k in range(1, len(steps) + 1):
            if steps[:k] not in known:
                done = apply(known[steps[: k - 1]], steps[k - 1 : k], threshold)
                # near dedup runs jobs of its own, and its result would be computed anew for each reader
                known[steps[:k]] = select.saved(done, "steps") if begun[steps[:k]] > 1 or steps[k - 1] in ("near", "minhash", "hdqs") else done
        out[name] = known[steps]
    return out


def variants(df: DataFrame, names: tuple[str, ...] | None = None, threshold: float = 0.80) -> dict[str, DataFrame]:
    """The documents of each named variant, all by default.

    The matched ones have as many documents as the full pipeline: the first by id, the longest, or the best by score.
    """
    names = tuple(names or (*VARIANTS, *MATCHED))
    if unknown := set(names) - set(VARIANTS) - set(MATCHED):
        raise ValueError(f"unknown variants: {sorted(unknown)}")
    steps = {n: VARIANTS[n] for n in names if n in VARIANTS}
    matched = [n for n in names if n in MATCHED]
    got = _walked(df, steps | ({"full_pipeline": FULL} if matched else {}), threshold)
    if matched:
        kept_, n = got["full_pipeline"].count(), df.count()
        k = max(1, kept_)
        for name in matched:
            if name == "random_retention_matched_baseline":
                ids = ranking.first_rows(df, k, [("doc_id", False)])
            elif name == "length_matched_baseline":
                ids = ranking.first_rows(df.select("doc_id", F.char_length(X.text()).alias("l")), k, [("l", True), ("doc_id", False)])
            else:
                scored = scoring.hdqs(df).select("doc_id", F.round("score", 9).alias("score"))
                ids = select.topk(scored, kept_ / max(1, n)).where("keep") if kept_ else scored.limit(0)
            got[name] = df.join(ids.select("doc_id"), "doc_id", "left_semi")
    return {n: got[n] for n in names}


def compared(named: dict[str, DataFrame], column: str = "variant") -> DataFrame:
    """(column, documents, characters, tokens, pii_hits, mean_hdqs) of each named corpus."""
    out = []
    for name, df in named.items():
        s = scoring.hdqs(df).withColumn("__tokens", X.count_tokens(X.text()))
        out.append(
            s.agg(
                F.lit(name).alias(column), F.count("*").alias("documents"), F.coalesce(F.sum("n_len"), F.lit(0)).alias("characters"), F.coalesce(F.sum("__tokens"), F.lit(0)).alias("tokens"),
                F.coalesce(F.sum(F.col("q_email") + F.col("q_phone") + F.col("q_id")), F.lit(0)).cast("long").alias("pii_hits"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_hdqs"),
            )
        )
    return reduce(DataFrame.unionByName, out)


#: Steps that change a text, and do nothing else.
TEXT_STEPS = {"clean": clean, "redact": redact}


class _Measured:
    """Documents with what every step decides by, of each state that their texts pass through: all steps are then filters of
    a narrow table. Equal states of a text are measured once, and near copies among all texts are looked for once: whether
    two texts are similar doesn't depend on the others.
    """

    def __init__(self, df: DataFrame, named: dict[str, tuple[str, ...]], threshold: float) -> None:
        known = {*TEXT_STEPS, "rule", "exact", "near", "minhash"}
        if unknown := {s for steps in named.values() for s in steps if s not in known and s.partition("+")[0] != "hdqs"}:
            raise ValueError(f"unknown steps: {sorted(unknown)}")
        self.threshold, self.named = threshold, named
        begun = [steps[:k] for steps in named.values() for k in range(len(steps) + 1)]
        self.states = sorted({(), *map(self._state, begun)})
        texts = [reduce(lambda x, step: TEXT_STEPS[step](x), state, X.text()) for state in self.states]
        rows = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array(*texts).alias("x"))
        rows = rows.select("row", "doc_id", "x", F.explode(F.array_distinct("x")).alias("text"))
        states = F.filter(F.sequence(F.lit(0), F.lit(len(texts) - 1)), lambda k: F.get("x", k) == F.col("text"))
        rows = rows.select("row", "doc_id", "text", states.alias("states"))
        self.texts = select.saved(rows.withColumn("id", F.col("row") * len(texts) + F.get("states", F.lit(0))), "texts")
        s = X.with_ratios(scoring.hdqs(self.texts))
        m = F.struct(
            "id", "n_len", X.count_tokens(X.text()).alias("tokens"), (F.col("q_email") + F.col("q_phone") + F.col("q_id")).alias("hits"), "score",
            F.expr(formulas.spark(formulas.RULE)).alias("rule"), F.sha2(X.normalise(X.text()), 256).alias("hash"),
        )
        s = select.saved(s.select("row", "doc_id", "states", m.alias("m")), "measures")
        wide = s.groupBy("row", "doc_id").agg(*[F.max(F.when(F.array_contains("states", k), F.col("m"))).alias(f"m{k}") for k in range(len(texts))])
        self.rows = select.saved(wide, "measured")
        self.near_states = sorted({self.states.index(self._state(steps)) for steps in begun if steps and steps[-1] == "near"})
        self.done: dict[tuple[str, ...], DataFrame] = {(): self.rows}
        for steps in begun:
            self._walk(steps)

    def _state(self, steps: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(s for s in steps if s in TEXT_STEPS)

    def of(self, steps: tuple[str, ...], field: str) -> Column:
        """A measure of the texts as they are after the steps."""
        return F.col(f"m{self.states.index(self._state(steps))}.{field}")

    def _walk(self, steps: tuple[str, ...]) -> DataFrame:
        if steps not in self.done:
            if steps[-1] == "near":
                self._near()
            if steps not in self.done:
                self.done[steps] = self._step(self._walk(steps[:-1]), steps)
        return self.done[steps]

    def _step(self, rows: DataFrame, steps: tuple[str, ...]) -> DataFrame:
        step = steps[-1]
        if step in TEXT_STEPS:
            return rows
        if step == "rule":
            return kept(rows, rows.withColumn("keep", self.of(steps, "rule")))
        if step == "exact":
            first = rows.groupBy(self.of(steps, "hash").alias("hash")).agg(F.min(F.struct("doc_id")).alias("first"))
            return kept(rows, first.select("first.doc_id", F.lit(True).alias("keep")))
        if step == "minhash":
            texts = self.texts.where(F.array_contains("states", self.states.index(self._state(steps)))).join(rows.select("row"), "row", "left_semi")
            gone = dedup.greedy(dedup.near_pairs(texts, toks=dedup.folded_words())).select(F.col("member").cast(dict(rows.dtypes)["doc_id"]).alias("doc_id"))
            return select.saved(rows.join(gone, "doc_id", "left_anti"), "steps")
        least = self.threshold + float(step.partition("+")[2] or 0)
        return kept(rows, rows.withColumn("keep", F.round(self.of(steps, "score"), 9) >= round(least, 9)))

    def _near(self) -> None:
        """All near steps that aren't done, those first that others wait for."""
        if not hasattr(self, "close"):
            used = F.exists("states", lambda k: k.isin(self.near_states))
            member, self.close = dedup.jaccard_classes(self.texts.where(used).select(F.col("id").alias("doc_id"), "text"))
            self.member, self.close = select.saved(member.select(F.col("doc_id").alias("id"), F.col("lead").alias("set")), "members"), select.saved(self.close, "close")
        open_ = sorted({steps[:k] for steps in self.named.values() for k in range(1, len(steps) + 1) if steps[k - 1] == "near"} - set(self.done))
        now = [s for s in open_ if "near" not in s[:-1] or s[: len(s) - 1 - s[:-1][::-1].index("near")] in self.done]
        before = {s: self._walk(s[:-1]) for s in now}
        ids = [before[s].select(F.lit(k).alias("part"), "doc_id", self.of(s, "id").alias("id")) for k, s in enumerate(now)]
        gone = select.saved(dedup.near_members(reduce(DataFrame.unionByName, ids).join(self.member, "id").drop("id"), self.close), "gone")
        for k, s in enumerate(now):
            self.done[s] = before[s].join(gone.where(F.col("part") == k).select(F.col("member").alias("doc_id")), "doc_id", "left_anti")
        if len(now) < len(open_):
            self._near()

    def figures(self, name: str, rows: DataFrame, steps: tuple[str, ...], column: str) -> DataFrame:
        total = lambda field: F.coalesce(F.sum(self.of(steps, field)), F.lit(0)).cast("long").alias(field)
        one = rows.agg(F.lit(name).alias(column), F.count("*").alias("documents"), total("n_len"), total("tokens"), total("hits"), F.coalesce(F.avg(self.of(steps, "score")), F.lit(0.0)).alias("mean_hdqs"))
        return one.withColumnsRenamed({"n_len": "characters", "hits": "pii_hits"})


def ablation(df: DataFrame, names: tuple[str, ...] | None = None, threshold: float = 0.80) -> DataFrame:
    """compared() of variants(), from measures that are taken once."""
    names = tuple(names or (*VARIANTS, *MATCHED))
    if unknown := set(names) - set(VARIANTS) - set(MATCHED):
        raise ValueError(f"unknown variants: {sorted(unknown)}")
    matched = [n for n in names if n in MATCHED]
    m = _Measured(df, {n: VARIANTS[n] for n in names if n in VARIANTS} | ({"full_pipeline": FULL} if matched else {}), threshold)
    got = {n: (m.done[VARIANTS[n]], VARIANTS[n]) for n in names if n in VARIANTS}
    if matched:
        kept_, n = m.done[FULL].count(), m.rows.count()
        rows = m.rows.select("doc_id", m.of((), "n_len").alias("l"), F.round(m.of((), "score"), 9).alias("score"))
        for name in matched:
            if name == "quality_retention_matched_baseline":
                ids = select.topk(rows, kept_ / max(1, n)).where("keep") if kept_ else rows.limit(0)
            else:
                ids = ranking.first_rows(rows, max(1, kept_), ([("l", True)] if name == "length_matched_baseline" else []) + [("doc_id", False)])
            got[name] = (m.rows.join(ids.select("doc_id"), "doc_id", "left_semi"), ())
    return reduce(DataFrame.unionByName, [m.figures(n, *got[n], "variant") for n in names])


def order_report(df: DataFrame, names: tuple[str, ...] = tuple(ORDERS), threshold: float = 0.80) -> DataFrame:
    """(pipeline_order, steps, documents, characters, tokens, pii_hits, mean_hdqs, retention) of each order of steps."""
    m = _Measured(df, {n: ORDERS[n] for n in names}, threshold)
    rows = reduce(DataFrame.unionByName, [m.figures(n, m.done[ORDERS[n]], ORDERS[n], "pipeline_order") for n in names])
    steps = F.create_map(*[F.lit(x) for n in names for x in (n, " -> ".join(ORDERS[n]))])
    return rows.withColumns({"steps": steps[F.col("pipeline_order")], "retention": F.col("documents") / max(1, m.rows.count())})


# fixed values: what the first score is cut by
THRESHOLDS, RATIOS = (0.74, 0.76, 0.78, 0.80, 0.82, 0.84, 0.86), (0.25, 0.50, 0.75)
#: Weights that differ from the score's own in each named set, and what a hit of personal data costs.
WEIGHT_SETS = {
    "balanced_default": {},
    "privacy_heavy": {"pii_density_penalty": 2.0, "url_html_noise_penalty": 1.4},
    "anti_repetition_heavy": {"repetition_penalty": 2.0, "ngram_repetition_penalty": 1.6},
    "diversity_heavy": {"lexical_diversity": 1.8, "token_entropy": 1.4},
}
HIT_COST = 0.02


def sweep(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, ratios: tuple[float, ...] = RATIOS, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(weights, kind, cut, documents, characters, mean_score, pii_hits, objective, best) of every cut by the first score.

    A cut is a least score (kind threshold) or a share of the documents (kind ratio, of equal scores the least ids). The
    objective is mean score times share kept, less a price for hits of personal data; best is the threshold with the
    greatest, the first of equals. weights: sets of weights that replace some of the score's own; all of WEIGHT_SETS by default.
    """
    sets = WEIGHT_SETS if weights is None else weights
    if unknown := {k for w in sets.values() for k in w} - set(formulas.WEIGHTS["hdqs"]):
        raise ValueError(f"unknown weights: {sorted(unknown)}")
    s = scoring.hdqs(df)
    named = {n: F.round(F.expr(formulas.spark(formulas.weighted(formulas.WEIGHTS["hdqs"] | w, "h_"))), 9) for n, w in sets.items()}
    rows = s.select("doc_id", F.col("n_len").cast("long").alias("n"), (F.col("q_email") + F.col("q_phone") + F.col("q_id")).alias("hits"), *[c.alias(f"s{k}") for k, c in enumerate(named.values())])
    rows = select.saved(rows, "sweep")
    count, sums = rows.count(), lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("long")
    cuts, figures = [], []
    for k, name in enumerate(sets):
        score = F.col(f"s{k}")
        for kind, at, hit in [("threshold", t, score >= t) for t in thresholds] + [("ratio", r, ranking.within(rows, select.keep_count(count, r) if count else 0, [(f"s{k}", True), ("doc_id", False)])) for r in ratios]:
            cuts.append((name, kind, at))
            figures.append(F.struct(F.count_if(hit).alias("documents"), sums(hit, F.col("n")).alias("characters"), F.coalesce(F.avg(F.when(hit, score)), F.lit(0.0)).alias("mean_score"), sums(hit, F.col("hits")).alias("pii_hits")))
    tags = [F.struct(F.lit(n).alias("weights"), F.lit(kind).alias("kind"), F.lit(at).alias("cut"), f.alias("f")) for (n, kind, at), f in zip(cuts, figures)]
    out = rows.agg(F.array(*tags).alias("x")).select(F.explode("x").alias("x")).select("x.weights", "x.kind", "x.cut", "x.f.*")
    objective = F.col("mean_score") * F.col("documents") / F.lit(max(1, count)) - HIT_COST * F.col("pii_hits")
    out = out.withColumn("objective", F.round(objective, 9))
    first = F.row_number().over(Window.partitionBy("weights", "kind").orderBy(F.desc("objective"), "cut"))  # a few rows each
    return out.withColumn("best", (F.col("kind") == "threshold") & (first == 1))


# fixed values: the baselines by name, and what they rank by
BASELINES = {
    "raw": None, "length_filter": "n_len", "c4_gopher_heuristic": "heuristic_quality", "perplexity_quality_ngram": "ngram_proxy", "independent_quality_score": "independent_quality", "hdqspp": "hdqs",
    "dedup_only": None, "random_same_keep_rate": None, "hdqspp_v2": None, "hdqspp_v2_no_token_frequency": None, "hdqspp_v3": None, "optional_external_wrapper": None,
}


def baseline_suite(df: DataFrame, rate: float = 0.7, names: tuple[str, ...] = tuple(BASELINES)) -> DataFrame:
    """(name, output_documents, output_tokens, pii_after, skipped) of each baseline at the rate.

    The second and third scores keep the share that is their own. The external one has no command to run and is skipped.
    """
    if unknown := set(names) - set(BASELINES):
        raise ValueError(f"unknown baselines: {sorted(unknown)}")
    s = scoring.baseline_scores(df)
    s = X.with_formulas(s, {f"h_{k}": v for k, v in formulas.HDQS.items()}).withColumn("hdqs", F.expr(formulas.spark(formulas.weighted(formulas.WEIGHTS["hdqs"], "h_"))))
    s = s.withColumns({"tokens": X.count_tokens(X.text()), "pii": F.col("q_email") + F.col("q_phone") + F.col("q_id")})
    # all that comes from texts is made in one pass over them
    second = {n: "hdqspp_v2" if n == "hdqspp_v2" else "v2_without_token_frequency_preservation" for n in names if n.startswith("hdqspp_v2")}
    more = {}
    if second:
        s = scoring.with_v2(s, df)
        more = {n: F.round(F.expr(formulas.spark(scoring.variant_score(scoring.V2, scoring.V2_VARIANTS[v].get("off", ())))), 9) for n, v in second.items()} | {"v2_bin": F.col("length_bin")}
        s = s.withColumns(more)
    if "hdqspp_v3" in names:
        s = scoring.with_v3(s, df, df).withColumns(third := {"hdqspp_v3": F.round(F.expr(formulas.spark(scoring.variant_score(scoring.V3))), 9), "v3_bin": F.col("length_bin")})
        more = more | third
    if "dedup_only" in names:
        s = s.withColumns(h := {"h": F.sha1(X.text())})
        more = more | h
    s = select.saved(s.select("doc_id", "n_len", *formulas.BASELINES, "hdqs", "tokens", "pii", *more), "baselines")
    scored = lambda name, bins: s.select("doc_id", F.col(name).alias("score"), F.col(bins).alias("length_bin"))
    count, out = s.count(), []
    for name in names:
        if score := BASELINES[name]:
            d = ranking.first_rows(s.withColumn("score", F.round(score, 9)), select.keep_count(count, rate), [("score", True), ("doc_id", False)])
        elif name == "dedup_only":
            d = s.join(dedup.equal_hashes(s.select("doc_id", "h")).select(F.col("member").alias("doc_id")), "doc_id", "left_anti")
        elif name == "random_same_keep_rate":
            d = kept(s, select.random_keep(s, rate))
        elif name in second:
            d = kept(s, select.select_v2_variant(df, second[name], scored=scored(name, "v2_bin")))
        elif name == "hdqspp_v3":
            d = kept(s, select.select_v3_variant(df, seed=13, scored=scored("hdqspp_v3", "v3_bin")))
        else:
            d = s.limit(0) if name == "optional_external_wrapper" else s
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        out.append(d.agg(F.lit(name).alias("name"), F.count("*").alias("output_documents"), total("tokens").alias("output_tokens"), total("pii").alias("pii_after"), F.lit(name == "optional_external_wrapper").alias("skipped")))
    return reduce(DataFrame.unionByName, out)


def equal_budget(df: DataFrame, variant: str, gap: int = 2) -> DataFrame:
    """(variant, doc_id, take): code points of each document that a common budget leaves, with gap between documents.

    The budget is the least total of the variants.
    """
    n = df.select(variant, "doc_id", F.char_length(X.text()).alias("n"))
    totals = n.groupBy(variant).agg((F.sum("n") + gap * (F.count("*") - 1)).alias("all"))
    budget = totals.agg(F.min("all")).head()[0] or 0
    # one sort for all variants: a document starts where the running sum stands, less where its variant began
    rows = select.running(n.withColumn("m", F.col("n") + gap), "m", F.col(variant), F.col("doc_id")).withColumn("start", F.col("total") - F.col("m"))
    begins = rows.groupBy(F.col(variant).alias("__variant")).agg(F.min("start").alias("__begin"))
    rows = rows.join(begins, F.col(variant).eqNullSafe(F.col("__variant")))
    return rows.select(variant, "doc_id", F.greatest(F.lit(0), F.least("n", F.lit(budget) - (F.col("start") - F.col("__begin")))).cast("long").alias("take"))


def canary_values(df: DataFrame) -> DataFrame:
    """(value) of all canaries that noise() puts into documents: three in every seventh."""
    every, rest, _, _ = NOISE["pii_canaries"]
    i = F.col("doc_id")
    forms = [F.format_string("editor%d@example.org", i), F.format_string("+1 412 555 %04d", i + 1000), F.format_string("ID-13-%04d", i)]
    return df.where(i % every == rest).select(F.explode(F.array(*forms)).alias("value"))


def canaries(raw: DataFrame, processed: DataFrame, values: DataFrame) -> DataFrame:
    """One row: how many of the canaries (value) stand in the raw and in the processed texts, and how well they were removed.

    A canary is found wherever its characters stand in one text. Each placeholder beyond the canaries removed is a side
    effect; precision and false positives count those. Repeated values count as often as they come.
    """
    items = select.saved(values.select(F.col("value").alias("text")).withColumn("item_id", F.sha2("text", 256)), "canaries")
    different = items.dropDuplicates(["item_id"])

    def found(df: DataFrame, name: str) -> DataFrame:
        hits = dedup.containment(df, different).select("item_id").distinct()
        return items.join(hits, "item_id", "left_semi").agg(F.count("*").alias(name))

    marks = [F.regexp_count(X.text(), F.lit(mark)) for mark in ("<EMAIL>", "<PHONE>", "<ID>")]
    # of the processed texts only those are written that may hold a canary
    parts = dedup.beginnings(different, "text")
    processed = processed.select("doc_id", F.when(dedup.holds(X.text(), parts), X.text()).alias("text"), sum(marks[1:], marks[0]).alias("marks"))
    processed = select.saved(processed, "processed")
    placed = processed.agg(F.coalesce(F.sum("marks"), F.lit(0)).cast("long").alias("placeholders"))
    one = items.agg(F.count("*").alias("canaries")).join(found(raw, "detected_before")).join(found(processed.where("text is not null"), "residual_after")).join(placed)  # a row each
    one = one.withColumn("removed", F.col("detected_before") - F.col("residual_after")).withColumn("side_effects", F.greatest(F.lit(0), F.col("placeholders") - F.col("removed")))
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), b)
    return one.select(
        "canaries", "detected_before", "residual_after", "placeholders", "side_effects",
        share("removed", "detected_before").alias("recall"), share("removed", F.col("removed") + F.col("side_effects")).alias("precision"), share("side_effects", F.col("placeholders")).alias("false_positive_rate"),
        F.log2((F.col("detected_before") + 1) / (F.col("residual_after") + 1)).alias("exposure_bits"),
        F.when(F.col("residual_after") == 0, "no_residual_synthetic_canary_values").otherwise("residual_synthetic_canary_values_detected").alias("status"),
    )


def training_blocks(df: DataFrame, context: int = 64, stride: int = 1) -> DataFrame:
    """(doc_id, block, tokens): runs of context + 1 tokens, one from every place by default; none from where they don't fit."""
    t = X.tokens(X.text())
    rows = df.select("doc_id", t.alias("t")).where(F.size("t") > context)
    starts = F.sequence(F.lit(0), F.size("t") - context - 1, F.lit(stride))
    return rows.select("doc_id", "t", F.posexplode(starts).alias("block", "s")).select("doc_id", "block", F.slice("t", F.col("s") + 1, context + 1).alias("tokens"))


def cooccurrence(df: DataFrame, window: int = 2, key=F.xxhash64) -> DataFrame:
    """(a, b, n, ppmi): ordered token pairs within the window, and their positive mutual information.

    A pair and its reverse are as frequent, so each is counted once, by keys of its tokens; a token's own sum is that of the
    neighbours its places have. key makes short keys of tokens; where two tokens clash, the tokens themselves are keys.
    """
    t = df.select(X.tokens(X.text()).alias("t"))
    each = t.select(F.size("t").alias("size"), F.posexplode_outer("t").alias("i", "token")).where(F.col("i").isNotNull())
    beside = F.least("i", F.lit(window)) + F.least(F.col("size") - 1 - F.col("i"), F.lit(window))
    words = each.groupBy("token").agg(F.sum(beside).alias("n"))
    words = select.saved(words.where("n > 0").withColumn("key", key("token")), "words")
    kinds, keys, total = words.agg(F.count("*"), F.count_distinct("key"), F.sum("n")).head()
    if keys < kinds:
        key, words = (lambda c: F.col(c) if isinstance(c, str) else c), words.withColumn("key", F.col("token"))
    # outer ones, as an inner one would look for empty arrays first and make the tokens for that
    ids = t.select(F.transform("t", lambda x: key(x)).alias("ids"))
    places = ids.select("ids", F.posexplode_outer("ids").alias("i", "p"))
    pairs = places.select("p", F.explode(F.array(*[F.get("ids", F.col("i") + d) for d in range(1, window + 1)])).alias("q")).where(F.col("q").isNotNull())
    pairs = pairs.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.count("*").alias("n"))
    pairs = pairs.select("p", "q", F.when(F.col("p") == F.col("q"), 2 * F.col("n")).otherwise(F.col("n")).alias("n"))
    left, right = (words.select(F.col("key").alias(k), F.col("token").alias(name), F.col("n").alias(f"n{name}")).hint("shuffle_hash") for k, name in (("p", "a"), ("q", "b")))
    both = pairs.join(left, "p").join(right, "q")
    both = both.select("a", "b", "n", F.greatest(F.lit(0.0), F.log2(F.col("n") * F.lit(float(total or 1)) / (F.col("na") * F.col("nb")))).alias("ppmi"))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return both.select(F.explode(ways).alias("way"), "n", "ppmi").select("way.a", "way.b", "n", "ppmi")
