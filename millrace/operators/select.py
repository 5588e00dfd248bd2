"""Selection by keep rate, by budgets, at random and by diversity; Pareto layers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textexpr as X
from . import ranking, scoring
from .storage import forget, saved


def keep_count(n: int, rate: float | None) -> int:
    """max(1, min(n, ceil(n * rate))), in doubles; without a rate all."""
    if rate is None:
        return n
    if not 0 < rate <= 1:
        raise ValueError("the rate must be in (0, 1]")
    return max(1, min(n, math.ceil(n * rate)))


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with its place, from 1, in the order: ranges are sorted apart and their sizes added up, so no task sees all."""
    ordered = df.orderBy(*order).withColumn("__part", F.spark_partition_id())
    ordered = saved(ordered.withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)), "ranked")
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each range
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ordered.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__n", "__before")


def topk(scored: DataFrame, rate: float | None, order: str = "doc_id") -> DataFrame:
    """scored with keep: the highest scores, of equal ones the first in order."""
    scored = saved(scored, "scored")
    return scored.withColumn("keep", ranking.within(scored, keep_count(scored.count(), rate), [("score", True), (order, False)]))


def sha_rank(seed: int, id_col: str = "doc_id") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)


def random_keep(df: DataFrame, rate: float | None, seed: int = 42) -> DataFrame:
    """Decisions: the least hashed ids, whatever the order of rows."""
    scored = saved(df.select("doc_id", sha_rank(seed).alias("h")), "hashed")
    keep = ranking.within(scored, keep_count(scored.count(), rate), [("h", False)])
    return scored.select("doc_id", keep.alias("keep"), F.when(keep, 1.0).otherwise(0.0).alias("score"), F.when(keep, "random_selected").otherwise("random_rejected").alias("reason"))


def running(df: DataFrame, value: str, *order: Column) -> DataFrame:
    """df with total: the running sum of value in the order, by ranges as in global_rank."""
    part = df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    part = saved(part, "running")
    sums = part.groupBy("__part").agg(F.sum(value).alias("__s"))
    before = sums.select("__part", (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__part").orderBy("__at"))
    return part.withColumn("__w", within).join(F.broadcast(before), "__part").withColumn("total", F.col("__before") + F.col("__w")).drop("__part", "__at", "__w", "__before")


def prefix_budget(df: DataFrame, tokens: str, budget: int, order: str = "doc_id") -> DataFrame:
    """Rows in order up to the first that goes over the budget, or the first that reaches it; the first row always."""
    if budget < 0:
        raise ValueError("the budget can't be negative")
    rows = running(df, tokens, F.col(order))
    rows = saved(rows, "budget")
    stop = rows.agg(F.min(F.when(F.col("total") > budget, F.col(order))).alias("over"), F.min(F.when(F.col("total") >= budget, F.col(order))).alias("full"), F.min(order).alias("first")).head()
    keep = F.lit(True)
    if stop["over"] is not None:
        keep = keep & (F.col(order) < F.lit(stop["over"]))
    if stop["full"] is not None:
        keep = keep & (F.col(order) <= F.lit(stop["full"]))
    return rows.where(keep | (F.col(order) == F.lit(stop["first"]))).drop("total") if stop["first"] is not None else rows.drop("total")


def first_fit(df: DataFrame, tokens: str, budget: int, *order: str, parts: int | None = None) -> DataFrame:
    """The ids that a walk in the order takes, skipping each row that would go over the budget.

    Rows are sorted by ranges, and of each range the driver gets the sum and least of each size class (powers of two). A
    range whose rows of classes that may fit add up to no more than what is left is taken with them, one in which none
    fits is skipped: neither is read again. Only a range that straddles what is left is walked row by row, in one task that
    reads nothing else. That needs rows that nearly fill what is left, so few ranges are.
    """
    rows = df.select("doc_id", F.col(tokens).cast("long").alias("n"), *[F.col(c) for c in order if c not in ("doc_id", "n")]).where(F.col("n") <= budget)
    if parts:
        rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    else:
        rows = rows.orderBy(*order)
    size = F.when(F.col("n") <= 0, 0).otherwise(F.floor(F.log2(F.col("n").cast("double"))) + 1).cast("int")
    rows = saved(rows.withColumns({"__part": F.spark_partition_id(), "__class": size}), "ranges", "__part")
    sums: dict[int, list[tuple[int, int, int]]] = {}
    for r in rows.groupBy("__part", "__class").agg(F.min("n").alias("least"), F.sum("n").alias("sum")).collect():
        sums.setdefault(r["__part"], []).append((r["__class"], r["least"], r["sum"]))
    left, whole, walked = budget, [], []
    for part in sorted(sums):
        fit = [x for x in sums[part] if x[1] <= left]
        if not fit:
            continue
        total = sum(max(0, x[2]) for x in fit)
        if total <= left:
            # each of them fits at its turn; rows of other classes are larger than what is left
            whole.append((part, max(x[0] for x in fit)))
            left -= sum(x[2] for x in fit)
            continue
        found = saved(rows.where(F.col("__part") == part).repartition(1).sortWithinPartitions(*order).select("doc_id", "n").mapInPandas(_walk(left), f"doc_id {dict(df.dtypes)['doc_id']}, n long"), "walked")
        left -= found.agg(F.sum("n")).head()[0] or 0
        walked.append(found.select("doc_id"))
    taken = df.sparkSession.createDataFrame(whole, "__taken int, __most int")
    out = rows.join(F.broadcast(taken), F.col("__part") == F.col("__taken")).where("__class <= __most").select("doc_id")
    for found in walked:
        out = out.unionByName(found)
    return out


def _walk(left: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = left
        for b in batches:
            n = b["n"].to_numpy()
            take = np.zeros(len(n), dtype=bool)
            for k in np.flatnonzero(n <= room):
                if n[k] <= room:
                    room -= int(n[k])
                    take[k] = True
            yield b[take]

    return run


def token_target_split(df: DataFrame, tokens: str, targets: dict[str, int], order: str = "doc_id") -> DataFrame:
    """df with split: rows in order go to the first split whose target the tokens before them don't fill; then to none."""
    rows = running(df, tokens, F.col(order)).withColumn("__before", F.col("total") - F.col(tokens))
    split, upto = None, 0
    for name, n in targets.items():
        upto += n
        cond = F.col("__before") < upto
        split = F.when(cond, name) if split is None else split.when(cond, name)
    return rows.withColumn("split", split).drop("__before", "total")


#: Parts whose fronts one task merges.
FAN = 16


def _first_layers(df: DataFrame, maximise: list[str], minimise: list[str], most: int) -> DataFrame:
    """The rows of the first most layers of df, with their layer.

    A part's layers are no lower than a row's in the whole table, so rows beyond a part's first layers can't be in the
    table's. Parts are merged FAN at a time, so no task sees more than that many parts' first layers.
    """
    cols = maximise + minimise
    sign = np.array([1.0] * len(maximise) + [-1.0] * len(minimise))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __layer int"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            rows["__layer"] = layers(rows[cols].to_numpy(dtype=float) * sign, most).astype(np.int32)
            held = rows[rows["__layer"] < most].reset_index(drop=True)
        if held is not None:
            yield held

    now = saved(df.withColumn("__layer", F.lit(0)).mapInPandas(first, fields), "layers")
    parts = df.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        now = saved(now.repartition(parts).mapInPandas(first, fields), "layers")
    return now


def pareto_front(df: DataFrame, maximise: list[str], minimise: list[str]) -> DataFrame:
    """df's rows that no row dominates: at least as good in all objectives, and better in one.

    A row with a null objective is compared with none, and so is one of them.
    """
    return _first_layers(df, maximise, minimise, 1).drop("__layer")


def layers(v: np.ndarray, most: int | None = None) -> np.ndarray:
    """Layer of each row of values to maximise, from 0; most for all that aren't in the first most ones."""
    rank = np.full(len(v), -1 if most is None else most)
    # a row can only be dominated by one of a larger sum, or of an equal one (by rounding, or infinite) and a greater first value that differs
    left = np.lexsort((*-v.T[::-1], -v.sum(axis=1)))
    k = 0
    while len(left) and (most is None or k < most):
        front = np.empty((len(left), v.shape[1]))
        size, behind = 0, []
        for i in left:
            f = front[:size]
            if size and ((f >= v[i]).all(axis=1) & (f > v[i]).any(axis=1)).any():
                behind.append(i)
            else:
                front[size] = v[i]
                size += 1
                rank[i] = k
        left = np.array(behind, dtype=np.int64)
        k += 1
    return rank


#: Different rows of objectives that are ranked at once, about; fewer than this many are one task's work.
BLOCK = 1 << 15


def _above(v: np.ndarray, rank: np.ndarray, x: np.ndarray, least: np.ndarray, tile: int = 512) -> np.ndarray:
    """least, raised to 1 + the highest rank of the rows of v that dominate each row of x.

    Rows of v that are under the least of x in any objective can't dominate one of them. The others are looked through from
    the highest rank down, and a row of x is done once what is left can't raise it.
    """
    use = (v >= x.min(axis=0)).all(axis=1) & (rank + 1 > least.min())
    v, rank = v[use], rank[use]
    order = np.argsort(-rank, kind="stable")
    v, rank, least = v[order], rank[order], least.copy()
    open_ = np.arange(len(x))
    for k in range(0, len(v), tile):
        open_ = open_[least[open_] < rank[k] + 1]
        if not len(open_):
            break
        w, r = v[k : k + tile], rank[k : k + tile]
        for at in range(0, len(open_), 4096):
            i = open_[at : at + 4096]
            some = np.ones((len(i), len(w)), dtype=bool)
            more = np.zeros_like(some)
            for c in range(v.shape[1]):
                some &= w[:, c] >= x[i, c, None]
                more |= w[:, c] > x[i, c, None]
            hit = some & more
            least[i] = np.maximum(least[i], np.where(hit, r + 1, 0).max(axis=1))
    return least


def _ranked(x: np.ndarray, least: np.ndarray, tile: int = 256) -> np.ndarray:
    """Ranks of rows in an order in which nothing is dominated by what comes later, given what earlier rows make them at least."""
    rank = least.copy()
    for k in range(0, len(x), tile):
        rows = slice(k, k + tile)
        rank[rows] = _above(x[:k], rank[:k], x[rows], rank[rows]) if k else rank[rows]
        for i in range(k + 1, min(k + tile, len(x))):
            w = x[k:i]
            hit = (w >= x[i]).all(axis=1) & (w > x[i]).any(axis=1)
            if hit.any():
                rank[i] = max(rank[i], int(rank[k:i][hit].max()) + 1)
    return rank


def pareto_layers(df: DataFrame, maximise: list[str], minimise: list[str], block: int = BLOCK) -> DataFrame:
    """(doc_id, pareto_rank): the layer of each row, from 0. A null objective is worse than any value.

    A row's layer is one more than the highest of those that dominate it, and what dominates it has a greater sum of
    objectives (or an equal one, and a greater first objective that differs). So the different rows are cut into ranges of
    that order, of about block rows, and settled one range after the other: all ranges before it are compared with a range
    in parallel, each task by its own rows; one task then settles the range by itself. A range is all that a task or a
    broadcast holds besides its input. Comparisons grow with the square of the rows, as far as ranks don't rule them out.
    """
    spark, names = df.sparkSession, [f"m{k}" for k in range(len(maximise) + len(minimise))]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in maximise] + [F.coalesce(-F.col(c).cast("double"), F.lit(float("-inf"))) for c in minimise]
    rows = saved(df.select("doc_id", *[(v + 0.0).alias(n) for v, n in zip(values, names)]), "objectives")
    different = saved(rows.select(*names).distinct().withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0]))), "objectives")
    parts = max(1, -(-different.count() // block))
    order = [F.desc(c) for c in ("total", *names)]
    ranges = saved(different.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranges", "part")
    fields = ", ".join(f"{n} double" for n in names)
    done = None

    def raised(now: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            least = np.zeros(len(now), dtype=np.int64)
            for b in batches:
                least = _above(b[names].to_numpy(), b["pareto_rank"].to_numpy(), now, least)
            at = np.flatnonzero(least)
            yield pd.DataFrame({"at": at, "least": least[at]})

        return run

    def settled(now: np.ndarray, at: np.ndarray, least: np.ndarray):
        def run(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start = np.zeros(len(now), dtype=np.int64)
            start[at] = least
            yield pd.DataFrame(now, columns=names).assign(pareto_rank=_ranked(now, start).astype(np.int32))

        return run

    for part in range(parts):
        now = ranges.where(F.col("part") == part).orderBy(*order).select(*names).toPandas().to_numpy()  # about block rows
        if not len(now):
            continue
        raises = done.mapInPandas(raised(now), "at long, least long").groupBy("at").agg(F.max("least").alias("least")).toPandas() if done is not None else pd.DataFrame({"at": [], "least": []})
        at, least = (raises[c].to_numpy().astype(np.int64) for c in ("at", "least"))
        found = saved(spark.range(0, 1, 1, 1).mapInPandas(settled(now, at, least), f"{fields}, pareto_rank int"), "front")
        done = found if done is None else done.unionByName(found)
    if done is None:
        return rows.select("doc_id", F.lit(0).alias("pareto_rank"))
    return rows.join(done, names).select("doc_id", "pareto_rank")


def curriculum_interleave(scored: DataFrame) -> DataFrame:
    """(doc_id, position): best, then worst of the odd places, next best, ... by score, of equal ones by id."""
    n = scored.count()
    r = global_rank(scored.select("doc_id", "score"), F.desc("score"), F.col("doc_id")).withColumn("r", F.col("rank") - 1)
    low = n // 2 - 1 - (F.col("r") - 1) / 2
    return r.select("doc_id", F.when(F.col("r") % 2 == 0, F.col("r")).otherwise(2 * low + 1).cast("long").alias("position"))


#: Candidates that a round of farthest_first() looks at, and choices that it settles at most.
POOL, SETTLED = 4096, 1024


def farthest_first(df: DataFrame, rate: float | None) -> DataFrame:
    """Decisions by greedy farthest-first choice on token sets, from the least id on; of equal distances the least id is next.

    A round takes the POOL rows that are farthest so far, and goes on choosing among them as long as the next choice is
    certain: distances only shrink, so a row outside of them is no farther than the last of them was. Then all rows are
    compared with the round's choices at once. The score is the least distance to a choice, of a choice to earlier ones.
    Sets are dealt out by id once; a round writes ids with distances only, and takes the place of the one before it.
    """
    h = F.array_sort(F.array_distinct(F.transform(X.tokens(X.text()), lambda t: F.xxhash64(t))))
    rows = saved(df.select("doc_id", h.alias("s")), "sets")
    k, parts = keep_count(rows.count(), rate), max(1, rows.rdd.getNumPartitions())
    kind = dict(df.dtypes)["doc_id"]
    dealt = rows.repartition(parts, "doc_id").persist(StorageLevel.DISK_ONLY)
    dist = saved(rows.select("doc_id", F.lit(2.0).alias("d"), F.lit(False).alias("keep")), "far")
    taken = 0
    while taken < k:
        pool = dist.where("not keep").orderBy(F.desc("d"), "doc_id").limit(POOL).select("doc_id", "d").collect()
        ids = df.sparkSession.createDataFrame([(r["doc_id"],) for r in pool], f"doc_id {kind}")
        sets = rows.join(F.broadcast(ids), "doc_id").toArrow()
        last = (-pool[-1]["d"], pool[-1]["doc_id"]) if len(pool) == POOL else None
        chosen = _choices({r["doc_id"]: r["d"] for r in pool}, sets["doc_id"].to_pylist(), sets["s"].combine_chunks(), last, min(SETTLED, k - taken))
        before = dist.repartition(parts, "doc_id").hint("shuffle_hash")  # as the sets lie
        done = saved(dealt.join(before, "doc_id").select("doc_id", "s", "d", "keep").mapInArrow(_nearer(chosen), f"doc_id {kind}, d double, keep boolean"), "far")
        forget(dist)
        dist = done
        taken += len(chosen)
    dealt.unpersist()
    return dist.select("doc_id", "keep", F.when(F.col("d") > 1, 1.0).otherwise(F.col("d")).alias("score"), F.lit("embedding_diversity_proxy").alias("reason"))


class _Sets:
    """Sets of numbers, by value: how many numbers another set has in common with each of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values = np.concatenate([np.zeros(0, dtype=np.int64), *sets])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def distances(self, s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.values, s, side="left"), np.searchsorted(self.values, s, side="right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(s) else np.zeros(0, dtype=np.int64)
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        union = len(s) + self.sizes - both
        return 1 - np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _choices(far: dict, ids: list, sets: pa.ListArray, last: tuple | None, most: int) -> list[tuple]:
    """(distance, id, set) of the next choices among a pool, by distances so far; last is where rows outside of it may begin."""
    order = sorted(range(len(ids)), key=lambda k: ids[k])  # so that argmax takes the least id
    ids = [ids[k] for k in order]
    flat, at = sets.flatten().to_numpy(), np.cumsum([0, *sets.value_lengths().to_pylist()])
    sets = [flat[at[k] : at[k + 1]] for k in order]
    d, pool = np.array([far[i] for i in ids]), _Sets(sets)
    chosen: list[tuple] = []
    gone = np.zeros(len(ids), dtype=bool)
    while len(chosen) < most and not gone.all():
        best = int(np.where(gone, -np.inf, d).argmax())
        if chosen and last is not None and (-d[best], ids[best]) >= last:
            break  # a row that isn't in the pool may come first
        chosen.append((float(d[best]), ids[best], sets[best]))
        gone[best] = True
        d = np.minimum(d, pool.distances(sets[best]))
    return chosen


def _nearer(chosen: list[tuple]):
    """A step that lowers distances to those from (distance, id, set) choices, and marks these. Rows are compared tile by tile."""
    number = {key: d for d, key, _ in chosen}
    sets = [np.asarray(s, dtype=np.int64) for _, _, s in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .urd import TILE, tile_of, together

        values = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *sets]))
        places = np.arange(len(values), dtype=np.int32)
        theirs = [tile_of(sets[k : k + TILE], values) for k in range(0, len(sets), TILE)]
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                b = whole.slice(at, TILE)
                ids, keep, d = b["doc_id"].to_pylist(), b["keep"].to_numpy(zero_copy_only=False), b["d"].to_numpy().copy()
                n, flat = b["s"].value_lengths().to_numpy(), b["s"].flatten().to_numpy(zero_copy_only=False)
                mine = tile_of(np.split(flat, np.cumsum(n)[:-1]), values)
                new = np.array([key in number for key in ids], dtype=bool) & ~keep
                for t in theirs:
                    both = together(mine, t, places)
                    union = np.add.outer(mine.n, t.n) - both
                    far = 1 - np.where(union > 0, both / np.maximum(union, 1), 1.0)
                    d = np.where(keep | new, d, np.minimum(d, far.min(axis=1)))
                d[new] = [number[key] for key, one in zip(ids, new) if one]
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(d), pa.array(keep | new)], names=["doc_id", "d", "keep"])

    return run


def soft_sample(scored: DataFrame, k: int, temperature: float = 0.2, seed: int = 0) -> DataFrame:
    """(doc_id) of k rows drawn without replacement, with weights exp((score - 1) / temperature).

    The draw is by Gumbel's trick: the greatest of log weight plus noise hashed from the id, so a top-k is all it takes.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    drawn = saved(scored.select("doc_id", ((F.col("score") - 1) / max(temperature, 1e-6) - F.log(-F.log(u))).alias("g")), "drawn")
    return ranking.first_rows(drawn, k, [("g", True), ("doc_id", False)]).select("doc_id").distinct()


def length_quota(scored: DataFrame, bin_col: str, k: int) -> DataFrame:
    """scored with keep: of each bin its share of k, rounded half to even and one at least; filled up or cut by score.

    scored: (doc_id, score, bin). Bins are few; only their sizes come to the driver.
    """
    n = scored.count()
    first = scored.groupBy(bin_col).agg(F.count("*").alias("c"), F.min("doc_id").alias("first")).orderBy("first").collect()
    quotas, taken = [], 0
    for r in first:
        quota = round(r["c"] * k / max(1, n))
        if quota == 0 and taken < k:
            quota = 1
        quotas.append((r[bin_col], quota))
        taken += min(quota, r["c"])
    if not quotas:
        return scored.withColumn("keep", F.lit(False))
    # one sort by (bin, score): a row's place in its bin is its rank less the rows of the bins before
    ranked = global_rank(scored.select("doc_id", "score", bin_col), F.asc_nulls_first(bin_col), F.desc("score"), F.col("doc_id"))
    sizes, before = {r[bin_col]: r["c"] for r in first}, 0
    room = F.lit(0)
    for name, quota in sorted(quotas, key=lambda q: (q[0] is not None, q[0])):
        room = F.when(F.col(bin_col).eqNullSafe(name), before + min(quota, sizes[name])).otherwise(room)
        before += sizes[name]
    ranked = saved(ranked.withColumn("chosen", F.col("rank") <= room), "quota")
    have, best = ranked.where("chosen").count(), [("score", True), ("doc_id", False)]
    if have < k:
        rest = ranked.where("NOT chosen")
        chosen = F.col("chosen") | ranking.within(rest, k - have, best)
    elif have > k:
        chosen = F.col("chosen") & ranking.within(ranked.where("chosen"), k, best)
    else:
        chosen = F.col("chosen")
    ids = ranked.where(chosen).select(F.col("doc_id").alias("__id")).distinct()
    return scored.join(ids, F.col("doc_id") == F.col("__id"), "left").withColumn("keep", F.col("__id").isNotNull()).drop("__id")


def weak_rebalance(scored: DataFrame, bin_col: str, k: int, fraction: float = 0.45) -> DataFrame:
    """scored (doc_id, score, bin, keep) with keep changed: a bin with less than its floor gets its best rows instead of
    the lowest chosen ones. The floor is fraction of the bin's share of k.

    Bins are worked off in the order of their first rows. Each row of a bin that comes in, the best ones first, sends the
    lowest of all rows that are in at that time out, once k are in. Within a bin the rows that come in fall and those that
    go rise, so there is one place where they cross: up to it the t-th to come sends the t-th lowest out, from there on
    each sends out the one that came in before it. The place is found by a join of both on their ranks. Of equal scores
    those go first that were in before, by id, then what came in last. Ids must be unique.
    """
    n = scored.count()
    bins = scored.groupBy(bin_col).agg(F.count("*").alias("c"), F.count_if("keep").alias("have"), F.min("doc_id").alias("first")).orderBy("first").collect()
    kept, inside = sum(r["have"] for r in bins), None
    low = [F.col("score"), F.col("doc_id")]
    for r in bins:
        more = math.floor(r["c"] * k / max(1, n) * fraction) - r["have"]
        if more <= 0:
            continue
        if inside is None:
            inside = saved(scored.where("keep").select("doc_id", "score"), "kept")
        rows = scored.where(F.col(bin_col).eqNullSafe(r[bin_col])).join(inside, "doc_id", "left_anti").select("doc_id", "score")
        come = global_rank(ranking.first_rows(saved(rows, "bin"), more, [("score", True), ("doc_id", False)]), F.desc("score"), F.col("doc_id"))
        come = saved(come.where(F.col("rank") <= more), "come")
        free = max(0, min(more, k - kept))  # those that come before k are in send nothing out
        lowest = ranking.first_rows(inside, more, [("score", False), ("doc_id", False)])
        if free:  # and are in the pool at once
            lowest = ranking.first_rows(saved(lowest.unionByName(come.where(F.col("rank") <= free).select("doc_id", "score")), "pool"), more, [("score", False), ("doc_id", False)])
        go = global_rank(lowest, *low).select(F.col("doc_id").alias("o"), F.col("score").alias("os"), (F.col("rank") - 1 + free).alias("t"))
        # t rows have gone when the t-th after the free ones has come: is it lower than the next to go?
        both = come.join(go, F.col("rank") == F.col("t"))
        cross = both.where((F.col("rank") > free) & (F.col("score") < F.col("os"))).agg(F.min("rank")).head()[0] or more
        gone = go.where(F.col("t") < cross).select(F.col("o").alias("doc_id"))
        stay = come.where((F.col("rank") < cross) | (F.col("rank") == more)).select("doc_id", "score")
        inside = saved(inside.unionByName(stay).join(gone, "doc_id", "left_anti"), "kept")
        kept = min(k, kept + more) if kept < k else kept
    if inside is None:
        return scored
    ids = inside.select(F.col("doc_id").alias("__id")).distinct()
    return scored.drop("keep").join(ids, F.col("doc_id") == F.col("__id"), "left").withColumn("keep", F.col("__id").isNotNull()).drop("__id")


def select_v3(scored: DataFrame, rate: float = 0.85, bin_col: str = "length_bin", top_fraction: float = 0.72, temperature: float = 0.2, seed: int = 0, rebalance: bool = True) -> DataFrame:
    """scored with keep: the best by score, the rest of the quota drawn softly, then the weak rebalance by length."""
    k = keep_count(scored.count(), rate)
    top = max(1, min(k, round(k * top_fraction)))
    best = saved(ranking.first_rows(scored, top, [("score", True), ("doc_id", False)]).select("doc_id"), "best")
    soft = soft_sample(scored.join(best, "doc_id", "left_anti"), k - top, temperature, seed)
    chosen = best.unionByName(soft).select(F.col("doc_id").alias("__id"))
    out = saved(scored.join(chosen, F.col("doc_id") == F.col("__id"), "left").withColumn("keep", F.col("__id").isNotNull()).drop("__id"), "v3")
    return weak_rebalance(out, bin_col, k) if rebalance else out


def select_v2_variant(df: DataFrame, variant: str = "hdqspp_v2", rate: float = 0.85, reference: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, length_bin, keep) by a variant of the second score: quotas by length, or the best scores alone.

    scored: a written table (doc_id, score, length_bin) of df, where the variant's scores are known.
    """
    how = scoring.V2_VARIANTS[variant]
    rate = max(rate, how["rate"]) if variant == "v2_soft_weighting_curriculum" else how.get("rate", rate)
    if scored is None:
        scored = saved(scoring.hdqs_v2(df, variant=variant, reference=reference).select("doc_id", F.round("score", 9).alias("score"), "length_bin"), "v2")
    return length_quota(scored, "length_bin", keep_count(scored.count(), rate)) if how.get("quota", True) else topk(scored, rate)


def select_v3_variant(df: DataFrame, variant: str = "hdqspp_v3", rate: float = 0.85, seed: int = 0, reference: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, length_bin, keep) by a variant of the third score: softly, or the best scores; then the weak rebalance.

    scored: a written table (doc_id, score, length_bin) of df, where the variant's scores are known.
    """
    how = scoring.V3_VARIANTS[variant]
    rate = how.get("rate", rate)
    if scored is None:
        scored = saved(scoring.hdqs_v3(df, variant, reference).select("doc_id", F.round("score", 9).alias("score"), "length_bin"), "v3")
    k = keep_count(scored.count(), rate)
    guarded = "length_guardrail" not in how.get("off", ())
    if how.get("soft", True) and k < scored.count():
        return select_v3(scored, rate, seed=seed, rebalance=guarded)
    out = saved(topk(scored, rate), "v3")
    return weak_rebalance(out, "length_bin", k) if guarded else out


STRATEGIES = ("random_baseline", "high_quality_first", "low_quality_first", "easy_to_hard", "hard_to_easy", "quality_stratified_sampling", "mixed_quality_curriculum")


def curriculum(scored: DataFrame, strategy: str, ratio: float = 0.75, seed: int = 23) -> DataFrame:
    """(doc_id, score, position) of the first max(1, round(n * ratio)) rows in the strategy's order; an unknown one is an error."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    n = scored.count()
    keep = max(1, round(n * ratio))
    rows = scored.select("doc_id", "score")
    if strategy == "random_baseline":
        ranked = global_rank(rows.withColumn("__h", sha_rank(seed)), F.col("__h")).drop("__h")
        place = F.col("rank") - 1
    else:
        ranked = global_rank(rows, F.desc("score"), F.col("doc_id"))
        r = F.col("rank") - 1
        if strategy in ("high_quality_first", "easy_to_hard"):
            place = r
        elif strategy in ("low_quality_first", "hard_to_easy"):
            place = n - 1 - r
        else:
            half = n // 2
            place = F.when(r < half, 2 * r).otherwise(2 * (n - 1 - r) + 1)
            place = F.when(place >= n, n - 1).otherwise(place)
            place = n - 1 - place if strategy == "mixed_quality_curriculum" else place
    return ranked.select("doc_id", "score", place.cast("long").alias("position")).where(F.col("position") < keep)


def truncate_by_budget(df: DataFrame, max_documents: int | None = None, max_tokens: int | None = None, max_bytes: int | None = None, order: str = "doc_id") -> DataFrame:
    """Rows in order up to the first that goes over a budget. A first row that is too large is cut: to its first tokens,
    joined by spaces, and then to its first bytes, at a character's end."""
    x = X.text()
    first = df.orderBy(order).limit(1).select(F.col(order).alias("__first"))
    key = first.head()
    if key is None or max_documents == 0:
        return df.limit(0)
    is_first = F.col(order) == F.lit(key[0])
    text = x
    if max_tokens is not None:
        toks = F.regexp_extract_all(x, F.lit(rf"({X.WORD}+|[^\p{{L}}\p{{N}}_\s])"), F.lit(1))
        text = F.when(is_first & (F.size(toks) > max_tokens), F.array_join(F.slice(toks, 1, max(1, max_tokens)) if max_tokens else F.array().cast("array<string>"), " ")).otherwise(text)
    if max_bytes is not None:
        cut = F.regexp_replace(F.decode(F.substring(F.encode(text, "UTF-8"), 1, max_bytes), "ISO-8859-1"), "[À-ÿ][\u0080-¿]*$", "")
        whole = F.decode(F.substring(F.encode(text, "UTF-8"), 1, max_bytes), "ISO-8859-1")
        last = F.regexp_extract(whole, "([À-ß][\u0080-¿]|[à-ï][\u0080-¿]{2}|[ð-÷][\u0080-¿]{3})$", 1)
        kept = F.decode(F.encode(F.when(last != "", whole).otherwise(cut), "ISO-8859-1"), "UTF-8")
        text = F.when(is_first & (F.octet_length(text) > max_bytes), kept).otherwise(text)
    rows = df.withColumn("text", text)
    rows = rows.withColumns({"__t": X.count_tokens(X.text()).cast("long"), "__b": F.octet_length(X.text()).cast("long"), "__one": F.lit(1).cast("long")})
    stops = []
    for col, most in (("__t", max_tokens), ("__b", max_bytes), ("__one", max_documents)):
        if most is not None:
            over = running(rows.select(order, col), col, F.col(order)).where((F.col("total") > most) & (F.col(order) != F.lit(key[0])))
            stops.append(over.agg(F.min(order)).head()[0])
    out = rows
    for s in stops:
        if s is not None:
            out = out.where(F.col(order) < F.lit(s))
    return out.drop("__t", "__b", "__one")


def local_top_fraction(scored: DataFrame, rate: float, ties: str = "first") -> DataFrame:
    """scored (doc_id, score) with keep: the max(1, int(n * rate)) highest scores, of equal ones the first or the largest id."""
    if ties not in ("first", "largest"):
        raise ValueError("ties are kept by the first or the largest id")
    k = max(1, int(scored.count() * rate))
    scored = saved(scored, "scored")
    return scored.withColumn("keep", ranking.within(scored, k, [("score", True), ("doc_id", ties == "largest")]))


def random_matched(df: DataFrame, tokens: str, target: int, seed: int = 42, match: str = "token_budget", documents: int | None = None) -> DataFrame:
    """Decisions (doc_id, keep, reason) of a random control: rows in hashed order, as many as another method kept.

    match: "token_budget" takes each row that the target still has room for, "document_count" the first documents rows.
    """
    rows = df.select("doc_id", F.col(tokens).cast("long").alias("n"), sha_rank(seed).alias("h"))
    if match == "token_budget":
        chosen = first_fit(rows, "n", target, "h")
    elif match == "document_count":
        rows = saved(rows, "hashed")
        chosen = ranking.first_rows(rows, documents or 0, [("h", False)]).select("doc_id").distinct()
    else:
        raise ValueError(f"unknown match mode: {match}")
    keep = F.col("__id").isNotNull()
    out = rows.join(chosen.select(F.col("doc_id").alias("__id")), F.col("doc_id") == F.col("__id"), "left")
    return out.select("doc_id", keep.alias("keep"), F.when(keep, "random_same_keep_rate_selected").otherwise("random_same_keep_rate_rejected").alias("reason"))


def deterministic_split(df: DataFrame, train: float = 0.8, dev: float = 0.1, test: float = 0.1, seed: int = 13) -> DataFrame:
    """df with split: rows in hashed order, int(n * train) of them train, int(n * dev) dev, the rest test.

    Three rows or more have at least one in dev. Shares must add up to 1.
    """
    if abs(train + dev + test - 1) > 1e-9:
        raise ValueError("split ratios must sum to 1")
    n = df.count()
    a = int(n * train)
    b = a + int(n * dev)
    if n >= 3 and b == a:
        b = a + 1
    r = global_rank(df.withColumn("__h", sha_rank(seed)), F.col("__h")).drop("__h")
    return r.withColumn("split", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "dev").otherwise("test")).drop("rank")
