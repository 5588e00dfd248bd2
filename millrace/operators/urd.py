"""Utility, risk and diversity: multi-objective scores and selection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions import textexpr as X
from . import dedup, ranking, scoring, select
from .storage import saved

PARTS = ("utility", "risk", "diversity", "shift", "cost")
_SCORE = {"utility": "utility_score", "risk": "risk_score", "diversity": "diversity_score", "shift": "shift_penalty", "cost": "cost_score"}


#: Sets that are compared with as many others at once, sets of a group, two of which a task gets, and counts made at once (so many
#: that they stay in a core's cache).
TILE, GROUP, CELLS = 1024, 1 << 15, 1 << 18


def novelty(df: DataFrame) -> DataFrame:
    """(doc_id, novelty): 1 less the mean Jaccard similarity of its token set to all others'.

    Documents with equal sets are one class, so a group of copies is compared once. Sets are numbers of their tokens, dealt
    out to groups; a task compares two groups, tile by tile, and hands on a sum for each set, so no pair is ever written. Tiles
    are indexed by value once, and hold sets alike in frequent tokens and size.
    The time is quadratic in the classes, as the measure is; bytes are those of the sets, once for each group.
    """
    rows = df.select("doc_id", F.array_sort(F.array_distinct(X.tokens(X.text()))).alias("s"))
    rows = saved(rows.select("doc_id", "s", F.sha2(F.array_join("s", " "), 256).alias("h")), "rows")
    n = rows.count()
    sets = saved(rows.groupBy("h").agg(F.count("*").alias("w"), F.first("s").alias("s")), "sets")
    # 64-bit hashes stand for tokens, unless two of them clash in this vocabulary
    vocab = sets.select(F.explode("s").alias("t")).groupBy(F.xxhash64("t").alias("v")).agg((F.min("t") != F.max("t")).alias("clash"))
    if not vocab.where("clash").isEmpty():
        vocab = saved(sets.select(F.explode("s").alias("t")).distinct().select("t", F.monotonically_increasing_id().alias("v")), "vocabulary")
        named = sets.select("h", F.explode("s").alias("t")).join(vocab, "t").groupBy("h").agg(F.collect_list("v").alias("v"))
        sets = sets.join(named, "h", "left").withColumn("v", F.coalesce("v", F.array().cast("array<bigint>")))
    else:
        sets = sets.withColumn("v", F.transform("s", lambda t: F.xxhash64(t)))
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-sets.count() // GROUP), math.ceil(math.sqrt(8 * cores)))
    g = F.pmod(F.xxhash64("h"), F.lit(groups)).cast("int")
    others = F.sequence(F.lit(0), F.lit(groups - 1))
    sent = sets.select("h", "w", "v", g.alias("g"), F.explode(others).alias("o")).select(F.least("g", "o").alias("x"), F.greatest("g", "o").alias("y"), "g", "h", "w", "v")
    # a partition for each two groups: two of them in one task would double the time of the last
    cell = (F.col("y") * (F.col("y") + 1) / 2 + F.col("x")).cast("int")
    sent = sent.select(cell.alias("cell"), F.col("x") == F.col("y"), "g", "h", "w", "v").toDF("cell", "own", "g", "h", "w", "v")
    sent = sent.repartitionById(groups * (groups + 1) // 2, F.col("cell"))
    sums = sent.groupBy("cell").applyInArrow(_similarities, "h string, x double").groupBy("h").agg(F.sum("x").alias("x"))
    return rows.join(sums, "h").select("doc_id", (F.lit(1.0) if n < 2 else 1 - (F.col("x") - 1) / (n - 1)).alias("novelty"))


class _Tile:
    """Some sets by value: the different values in order, how many of the sets have each, and which, one value's after the other's."""

    def __init__(self, flat: np.ndarray, n: np.ndarray, sets: np.ndarray) -> None:
        order = np.argsort(flat)
        flat, self.n, self.sets = flat[order], n, sets
        self.owner = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
        self.first = np.flatnonzero(np.concatenate([flat[:1] == flat[:1], flat[1:] != flat[:-1]]))
        self.values, self.count = flat[self.first], np.diff(np.append(self.first, len(flat)))


def _numbered(tiles: list[_Tile]) -> int:
    """Values become numbers from 0, in all tiles the same; those that only one set has are left out. Returns how many there are."""
    values = np.concatenate([t.values for t in tiles])
    order = np.argsort(values)
    new = np.concatenate([[True], np.diff(values[order]) != 0])[: len(values)]
    several = np.add.reduceat(np.concatenate([t.count for t in tiles])[order], np.flatnonzero(new)) > 1 if len(values) else new
    number = np.empty(len(values), dtype=np.int32)
    number[order] = np.where(several, np.cumsum(several) - 1, -1).astype(np.int32)[np.cumsum(new) - 1] if len(values) else 0
    done = 0
    for t in tiles:
        mine = number[done : done + len(t.values)]
        done += len(t.values)
        use = mine >= 0
        t.values, t.first, t.count = mine[use], t.first[use], t.count[use]
    return int(several.sum())


def _alike_beside(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An order of sets by which of eight frequent values they have, then by size: two tiles then share values with most sets or few."""
    low = flat.view(np.uint16)[::4]  # 16 bits of each: an order needs no more
    often = sum((np.bincount(low[k : k + CELLS], minlength=1 << 16) for k in range(0, len(low), CELLS)), np.zeros(1 << 16, dtype=np.int64))
    bit = np.zeros(1 << 16, dtype=np.uint8)
    bit[np.argsort(-often, kind="stable")[:8]] = 1 << np.arange(7, -1, -1)
    have = np.zeros(len(at) - 1, dtype=np.uint8)
    hit = np.flatnonzero(bit[low])
    np.bitwise_or.at(have, np.searchsorted(at, hit, side="right") - 1, bit[low[hit]])
    return np.lexsort((np.diff(at), have))


def _similarities(table: pa.Table) -> pa.Table:
    """(h, x): sums of each set's similarities to the documents (w of each set) of the other group, or of its own."""
    g, w, own = table["g"].to_numpy(), table["w"].to_numpy().astype(np.float64), table["own"][0].as_py()
    v = table["v"].combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    at, flat = v.offsets.to_numpy().astype(np.int64), v.values.to_numpy(zero_copy_only=False)
    flat, at = flat[at[0] : at[-1]], at - at[0]
    sizes, order = np.diff(at), _alike_beside(flat, at)
    sides = []
    for one in [g[order] == g[0]] if own else [g[order] == g.min(), g[order] != g.min()]:
        sets = order[one]
        parts = [sets[k : k + TILE] for k in range(0, len(sets), TILE)]
        sides.append([_Tile(flat[_runs(at[k], sizes[k])], sizes[k], k) for k in parts])
    kinds = _numbered([t for side in sides for t in side])
    out, place = np.zeros(len(w)), np.full(kinds, -1, dtype=np.int32)
    for k, a in enumerate(sides[0]):
        place[a.values] = np.arange(len(a.values), dtype=np.int32)
        for b in sides[0][k:] if own else sides[1]:
            j = _both(a, b, place)
            union = np.add.outer(np.maximum(a.n, 0.5), np.maximum(b.n, 0.5))  # an empty set has nothing in common with any
            union -= j
            j /= union
            if a is b:
                np.fill_diagonal(j, 1.0)  # an empty set's copies are alike too
            out[a.sets] += j @ w[b.sets]
            if a is not b:
                out[b.sets] += w[a.sets] @ j
        place[a.values] = -1
    return pa.table({"h": table["h"], "x": out})


def _runs(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... times[0] of them, then the same from first[1] on, ..."""
    return np.arange(int(times.sum())) + np.repeat(first - (np.cumsum(times) - times), times)


def _both(a: _Tile, b: _Tile, place: np.ndarray) -> np.ndarray:
    """How many values each set of a has in common with each of b; place has where a value stands in a, or -1.

    Values that many have are counted by a product of matrices, the others pair by pair.
    """
    mine = place[b.values]
    theirs = np.flatnonzero(mine >= 0)
    mine = mine[theirs]
    ca, fa, cb, fb = a.count[mine], a.first[mine], b.count[theirs], b.first[theirs]
    dense = ca * cb > len(a.n) * len(b.n) // 250
    column = np.arange(int(dense.sum()))
    x, y = np.zeros((len(a.n), len(column)), dtype=np.float32), np.zeros((len(b.n), len(column)), dtype=np.float32)
    x[a.owner[_runs(fa[dense], ca[dense])], np.repeat(column, ca[dense])] = 1
    y[b.owner[_runs(fb[dense], cb[dense])], np.repeat(column, cb[dense])] = 1
    both = (x @ y.T).ravel()
    # every place of a value in a meets all its places in b
    ca, fa, cb, fb = ca[~dense], fa[~dense], cb[~dense], fb[~dense]
    row, times = a.owner[_runs(fa, ca)] * np.int32(len(b.n)), np.repeat(cb, ca)
    ends = np.cumsum(times)
    shift = np.repeat(fb, ca) - (ends - times)
    for lo, hi in _parts(ends):
        begin, t = ends[lo] - times[lo], times[lo:hi]
        cells = np.repeat((shift[lo:hi] + begin).astype(np.int32), t)
        cells += np.arange(len(cells), dtype=np.int32)
        cells = b.owner[cells]
        cells += np.repeat(row[lo:hi], t)
        np.add.at(both, cells, np.float32(1))  # numbers under 2^24 are exact
    return both.reshape(len(a.n), len(b.n)).astype(np.float64)


def tile_of(sets: list[np.ndarray], values: np.ndarray) -> _Tile:
    """Sets as a tile whose values are places in the sorted values; those that aren't there are left out."""
    n = np.array([len(x) for x in sets], dtype=np.int64)
    t = _Tile(np.concatenate([np.zeros(0, dtype=np.int64), *sets]), n, np.arange(len(sets)))
    at = np.minimum(np.searchsorted(values, t.values), max(0, len(values) - 1))
    use = values[at] == t.values if len(values) else np.zeros(len(at), dtype=bool)
    t.values, t.first, t.count = at[use].astype(np.int32), t.first[use], t.count[use]
    return t


def together(a: _Tile, b: _Tile, places: np.ndarray) -> np.ndarray:
    """_both() of two tiles by tile_of(); places is 0, 1, ... of as many numbers as there are values."""
    place = np.full(len(places), -1, dtype=np.int32)
    place[a.values] = places[: len(a.values)]
    return _both(a, b, place)


def _parts(ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs of places whose counts, summed up in ends, come to about CELLS each."""
    part = ends // CELLS
    cut = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return list(zip(cut, [*cut[1:], len(ends)]))


def _common(left: np.ndarray, n: np.ndarray, right: np.ndarray, m: np.ndarray) -> np.ndarray:
    """_both() of two runs of sets: these are one after the other, n or m values long."""
    a, b = (_Tile(flat, sizes, np.arange(len(sizes))) for flat, sizes in ((left, n), (right, m)))
    place = np.full(_numbered([a, b]), -1, dtype=np.int32)
    place[a.values] = np.arange(len(a.values), dtype=np.int32)
    return _both(a, b, place)


#: Permutations of the estimate of novelty.
PERMUTATIONS = 256


def novelty_error(permutations: int = PERMUTATIONS, miss: float = 0.01) -> float:
    """An error that novelty_estimate() exceeds with at most the probability of miss, for each document (Hoeffding)."""
    return math.sqrt(math.log(2 / miss) / (2 * permutations))


def novelty_estimate(df: DataFrame, permutations: int = PERMUTATIONS, seed: int = 42) -> DataFrame:
    """(doc_id, novelty): novelty() within novelty_error(), in time and bytes in proportion to the rows.

    Two sets have the same least value under a random permutation with a probability that is their similarity. So how many
    others have a document's value, counted once for each permutation and value over the whole table, averages to its
    similarity to all others: no pair is ever made. Values that one document has alone are not sent back.
    """
    sets = F.array_distinct(F.transform(X.tokens(X.text()), lambda t: F.xxhash64(t)))
    sig = saved(df.select("doc_id", dedup.signature(sets, permutations, seed).alias("sig")), "signatures")
    n = sig.count()
    each = sig.select("doc_id", F.posexplode("sig").alias("p", "v"))
    shared = saved(each.groupBy("p", "v").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    mean = each.join(shared, ["p", "v"]).groupBy("doc_id").agg((F.sum(F.col("c") - 1) / F.lit(float(permutations * max(1, n - 1)))).alias("m"))
    return sig.select("doc_id").join(mean, "doc_id", "left").select("doc_id", (1 - F.coalesce("m", F.lit(0.0))).alias("novelty"))


def scores(df: DataFrame, disabled: tuple[str, ...] = (), permutations: int | None = None) -> DataFrame:
    """(doc_id, source, n_words, the five scores, urd_score). Corpus statistics are a few numbers, or joins.

    With permutations novelty is estimated by so many, as it must be for more than some 100,000 documents.
    """
    p = X.with_ratios(X.profile(df, entropies=True))
    p = saved(p.withColumns({"norm": F.sha2(X.normalise(X.text()), 256), "boilerplate_hint": F.when(F.greatest(*[X.fold(X.text()).contains(t) for t in X.BOILERPLATE]), 1.0).otherwise(0.0)}).drop("text"), "profile")
    counts = saved(scoring.token_counts(df), "tokens")
    s = p.agg(F.max("n_tok"), F.avg("n_tok"), F.max("n_len"), F.count_distinct(F.when(F.col("source") != "", F.col("source"))), F.count_if(F.coalesce(F.col("source"), F.lit("")) != "")).head()
    vocab = counts.count()
    rare = p.select("doc_id", F.explode(F.array_distinct("toks")).alias("token")).join(counts.where("c <= 1"), "token").groupBy("doc_id").agg(F.count("*").alias("n_rare"))
    copies = p.groupBy("norm").agg(F.count("*").alias("n_norm"))
    per_source = p.where("source <> ''").groupBy("source").agg(F.count("*").alias("n_source"))
    p = p.join(rare, "doc_id", "left").join(copies, "norm").join(per_source, "source", "left").join(novelty_estimate(df, permutations) if permutations else novelty(df), "doc_id")
    ln2 = 0.6931471805599453
    p = p.withColumns(
        {
            "n_rare": F.coalesce("n_rare", F.lit(0)),
            "duplicate_hint": F.when(F.col("n_norm") > 1, 1.0).otherwise(0.0),
            "source_shift": F.when(F.col("n_source").isNull(), 0.0).otherwise(1 - F.col("n_source") / max(1, s[4] or 0)),
            "source_coverage": F.when(F.col("n_source").isNull(), 0.0).otherwise(1.0 / max(1, s[3] or 0)),
            "token_entropy_nat": F.col("token_entropy_bits") * ln2 / F.greatest(F.lit(1.0), F.ln(F.greatest(F.lit(2), "n_uniq"))),
            "char_entropy_nat": F.col("char_entropy_bits") * ln2 / F.greatest(F.lit(1.0), F.ln(F.greatest(F.lit(2), "n_char_kinds"))),
            "max_tok": F.lit(max(1, s[0] or 0)),
            "max_tok_raw": F.lit(s[0] or 0),
            "mean_tok": F.lit(float(s[1] or 0)),
            "max_len": F.lit(s[2] or 0),
            "vocab": F.lit(vocab),
        }
    )
    p = X.with_formulas(p, formulas.URD | {"diversity_score": formulas.URD_DIVERSITY})
    for part in disabled:
        p = p.withColumn(_SCORE[part], F.lit(0.0))
    return p.withColumn("urd_score", F.expr(formulas.spark(formulas.URD_FIXED))).select("doc_id", "source", "n_words", *_SCORE.values(), "urd_score")


def _decisions(rows: DataFrame, rate: float | None, mode: str, order: ranking.Order, budget: int | None, max_risk: float) -> DataFrame:
    k = select.keep_count(rows.count(), rate)
    allowed = rows.where(F.col("risk_score") <= max_risk).withColumn("id_text", F.col("doc_id").cast("string"))
    if budget is None:
        chosen = ranking.first_rows(allowed, k, order)
    else:
        ranked = saved(select.global_rank(allowed, *ranking.sort_columns(order)), "ranked")
        taken = saved(select.first_fit(ranked, "n_words", budget, "rank").join(ranked.select("doc_id", "rank"), "doc_id"), "taken")
        chosen = ranking.first_rows(taken, k, [("rank", False)])
    chosen = chosen.select(F.col("doc_id").alias("__id")).distinct()
    keep = F.col("__id").isNotNull()
    return rows.join(chosen, F.col("doc_id") == F.col("__id"), "left").select(
        "doc_id", keep.alias("keep"), F.col("urd_score").alias("score"), F.when(keep, f"urd_{mode}_selected").otherwise(f"urd_{mode}_rejected_by_rank_risk_or_budget").alias("reason")
    )


def select_fixed(df: DataFrame, rate: float | None = None, budget: int | None = None, max_risk: float = 1.0, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Decisions by the weighted score, of equal ones the least id as a string, within rate, risk and token budget."""
    return _decisions(saved(scores(df, disabled), "urd"), rate, "fixed_weight", [("urd_score", True), ("id_text", False)], budget, max_risk)


def select_pareto(df: DataFrame, rate: float | None = None, budget: int | None = None, max_risk: float = 1.0) -> DataFrame:
    """Decisions by Pareto layer, then by the weighted score. Scores count to 9 places, so that no order of a sum decides."""
    rows = saved(scores(df).withColumns({c: F.round(c, 9) for c in (*_SCORE.values(), "urd_score")}), "urd")
    ranks = select.pareto_layers(rows, ["utility_score", "diversity_score"], ["risk_score", "shift_penalty", "cost_score"])
    return _decisions(saved(rows.join(ranks, "doc_id"), "urd"), rate, "pareto", [("pareto_rank", False), ("urd_score", True), ("id_text", False)], budget, max_risk)
