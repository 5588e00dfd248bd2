"""Best-fit packing by a configuration linear program.

Pieces differ by their length only, so the program is over the length histogram: at most as many numbers as a sequence
has tokens, whatever the corpus. A configuration is a multiset of lengths that fits a sequence. Multiplicative weights
price the lengths, higher the less they are covered so far; a knapsack dynamic program over the capacity finds the best
configurations at those prices; all within a small factor of the best are taken up. The fractional solution is rounded
down, and what that leaves is packed by best fit, again by histogram. Last, each piece gets its place: its rank among the
pieces of its length, counted in hashed buckets so that no length lands in one task, is looked up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shown_id, whole_id
from .tokens import default_path, encode

CAPACITY = 2048
ROUNDS = 40
#: How much of the weight a length loses each time that it is covered once.
ETA = 4.0
#: Configurations of this share of the best value are taken up.
NEAR = 0.995
#: Pieces in a bucket, on average.
BUCKET = 20_000


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but the first of a longer document may be shorter."""
    first = n if n <= capacity else n - (n - 1) // capacity * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c] and the last item taken at c (-1: none, look at c - 1), for the unbounded knapsack. sizes ascend."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            v = best[c - sizes[:k]] + prices[:k]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], taken[c] = v[j], j
    return best, taken


def _trace(c: int, taken: np.ndarray, sizes: np.ndarray) -> list[int]:
    out = []
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out.append(int(taken[c]))
            c -= int(sizes[taken[c]])
    return out


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Configurations (ascending places in sizes) and how often each is used, by multiplicative weights.

    The uses are scaled so that no length is covered more than its count.
    """
    covered, uses = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        prices = np.exp(-ETA * (covered - covered.min())) / counts
        best, taken = knapsack(sizes, prices, capacity)
        rest = capacity - sizes
        new: dict[tuple[int, ...], float] = {}
        for j in np.flatnonzero(prices + best[rest] >= NEAR * best[capacity]):
            new[tuple(sorted([int(j), *_trace(int(rest[j]), taken, sizes)]))] = float(counts[j])
        gain = np.zeros(len(sizes))
        for items, x in new.items():
            np.add.at(gain, list(items), x)
        step = 1 / (gain / counts).max()
        covered += gain * step / counts
        for items, x in new.items():
            uses[items] = uses.get(items, 0.0) + x * step
    scale = 1 / covered.max()
    return {k: v * scale for k, v in uses.items()}


def _best_fit(rest: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack the histogram rest: the longest first, then what fits best, in whole runs of equal sequences."""
    out, rest = [], rest.copy()
    while rest.any():
        left, items = capacity, []
        free = rest.copy()

        def take(s: int) -> None:
            nonlocal left
            items.append(s)
            free[s] -= 1
            left -= s

        take(int(np.flatnonzero(free).max()))
        while left and (fits := np.flatnonzero(free[: left + 1])).size:
            if fits[-1] != left:
                fill = fits[(free[left - fits] > (2 * fits == left)) & (fits < left)]
                if fill.size:
                    take(int(fill[-1]))
                    continue
            take(int(fits[-1]))
        need = np.bincount(items, minlength=len(rest))
        used = np.flatnonzero(need)
        times = int((rest[used] // need[used]).min())
        rest -= need * times
        out.append((tuple(sorted(items, reverse=True)), times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using each length as often as the histogram has it."""
    rest = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        rest[s] = n
    out = []
    if rest[capacity]:
        out.append(((capacity,), int(rest[capacity])))
        rest[capacity] = 0
    sizes = np.flatnonzero(rest)
    if sizes.size:
        uses = fractional(sizes, rest[sizes].astype(float), capacity, rounds)
        fill = lambda items: int(sizes[list(items)].sum())
        for items, x in sorted(uses.items(), key=lambda u: (-fill(u[0]), u[0])):
            need = np.bincount(sizes[list(items)], minlength=capacity + 1)
            used = np.flatnonzero(need)
            if times := min(int(x), int((rest[used] // need[used]).min())):
                rest -= need * times
                out.append((tuple(int(s) for s in sorted(sizes[list(items)], reverse=True)), times))
    return out + _best_fit(rest, capacity)


def _places(chosen: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Ranges of ranks: pieces of a length from rank first on lie in sequences from base on, each of them, from offset on."""
    rows, rank, base = [], {}, 0
    for items, times in chosen:
        at = 0
        for s in dict.fromkeys(items):
            each = items.count(s)
            rows.append((s, rank.get(s, 0), each, base, at))
            rank[s] = rank.get(s, 0) + each * times
            at += each * s
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "base", "at"]).sort_values(["length", "first"]).reset_index(drop=True)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids and the end id. A null text is empty, a null id NO_ID."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"].array, batch["text"].array):
                ids = np.array([*encode(text, path), end_id], dtype="<u4")
                rows += [(key, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    src = df.select(whole_id(F.col(id_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInPandas(run, "id long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """A row for each piece of each document: id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than capacity tokens are cut. Repeated rows are packed as often as they come; a null id stays
    null. An empty table gives no rows.
    """
    cuts = saved(pieces(df, id_col, text_col, path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    buckets = max(1, -(-sum(histogram.values()) // BUCKET))
    dealt = cuts.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(within)).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    places = _places(plan(histogram, capacity, rounds))
    key = places["length"].to_numpy() * 2**44 + places["first"].to_numpy()
    first, each, base, at = (places[c].to_numpy() for c in ("first", "each", "base", "at"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b.pop("rank").to_numpy()
            k = np.searchsorted(key, length * 2**44 + rank, side="right") - 1
            nth, slot = np.divmod(rank - first[k], each[k])
            yield b.assign(sequence_id=base[k] + nth, offset=at[k] + slot * length)

    cols = ["id", "piece", "start", "length", "ids_crc32"]
    out = ranked.select(*cols, "rank").mapInPandas(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(shown_id(F.col("id")).alias(id_col), *out.columns[1:])


def query(spark, sf_dir):
    """op2: all documents, packed into sequences of 2048 tokens."""
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
