"""Exact and near-duplicate detection, duplicate components and split audits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textexpr as X
from .storage import saved

PERMUTATIONS, BANDS, SEED = 64, 16, 42


def exact_dedup(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """Decision for each row: of equal normalised texts the first in order is kept."""
    rows = df.select("doc_id", F.col(order).alias("o"), F.sha2(X.normalise(X.text()), 256).alias("h"))
    first = rows.groupBy("h").agg(F.min(F.struct("o", "doc_id")).alias("first"))
    keep = F.struct("o", "doc_id") == F.col("first")
    return rows.join(first, "h").select("doc_id", keep.alias("keep"), F.when(keep, 1.0).otherwise(0.0).alias("score"), F.when(keep, "first_normalized_hash").otherwise("duplicate_normalized_hash").alias("reason"))


def sha1_clusters(df: DataFrame) -> DataFrame:
    """(representative, member): rows whose raw text an earlier row has."""
    return equal_hashes(df.select("doc_id", F.sha1(X.text()).alias("h")))


def equal_hashes(rows: DataFrame) -> DataFrame:
    """(representative, member): rows (doc_id, h) whose hash an earlier row has."""
    first = rows.groupBy("h").agg(F.min("doc_id").alias("representative"), F.count("*").alias("c")).where("c > 1")
    return rows.join(first, "h").where("doc_id <> representative").select("representative", F.col("doc_id").alias("member"))


def shingles(df: DataFrame, size: int = 3, toks: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns to keep, shingles): different hashed shingles of size tokens; a shorter text is one shingle."""
    rows = df.select("doc_id", *keep, (X.tokens(X.text()) if toks is None else toks).alias("t"))
    grams = F.transform(F.sequence(F.lit(0), F.size("t") - size), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("t", i + k) for k in range(size)])))
    return rows.select("doc_id", *keep, F.when(F.size("t") < size, F.array(F.xxhash64(F.concat_ws(" ", "t")))).otherwise(F.array_distinct(grams)).alias("shingles"))


def folded_words() -> Column:
    return X.words(X.fold(X.text()))


def minima(permutations: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function from 64-bit hashes to their least values under so many permutations: odd multiples, shifted."""
    rng = np.random.default_rng(seed)
    times, plus = (rng.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def least(hashes: np.ndarray) -> np.ndarray:
        h = np.asarray(hashes, dtype=np.int64).view(np.uint64)
        h = h ^ h >> np.uint64(29)
        out = np.full(permutations, 2**64 - 1, dtype=np.uint64)
        for k in range(0, len(h), 2048):
            np.minimum(out, (h[k : k + 2048, None] * times + plus).min(axis=0), out=out)
        return out.view(np.int64)

    return least


def signature(sh: Column, permutations: int = PERMUTATIONS, seed: int = SEED) -> Column:
    """Least values of hashed shingles under each permutation, a batch of rows at a time."""
    least = minima(permutations, seed)

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sets in batches:
            yield pd.Series([least(x) for x in sets])

    return run(sh)


def bands_of(sig: str, permutations: int, bands: int) -> Column:
    """(band, key) of each band of a signature, to be exploded."""
    rows = permutations // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.slice(sig, b * rows + 1, rows)).alias("key")))


def candidates(sh: DataFrame, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """(a, b), a < b by string order: documents that agree in a band of their signatures, each pair once.

    Rows with equal shingle sets share all bands, so only one of them is banded; the others are paired with it. Of a set
    only its name and the keys of its bands are handed on.
    """
    if permutations < 4 or bands < 1 or permutations % bands:
        raise ValueError("bands must divide permutations, of which there must be four or more")
    keyed = named(sh).withColumn("sig", signature(F.col("shingles"), permutations))
    keyed = saved(keyed.select(F.col("doc_id").cast("string").alias("s"), "set", bands_of("sig", permutations, bands).alias("bands")), "bands")
    same = keyed.groupBy("set").agg(F.min("s").alias("lead"), F.first("bands").alias("bands"))
    pairs = met(same.select(F.col("lead").alias("id"), "bands"))
    copies = keyed.select("s", "set").join(same.select("set", "lead"), "set").where("s <> lead")
    return pairs.unionByName(copies.select(F.col("lead").alias("a"), F.col("s").alias("b"))).distinct()


def met(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, once: rows (id, bands) that agree in a band."""
    banded = saved(rows.select("id", F.explode("bands").alias("x")).select("id", "x.band", "x.key"), "banded")
    pairs = banded.join(banded.select(F.col("id").alias("other"), "band", "key"), ["band", "key"]).where("id < other")
    return pairs.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()


def confirmed(pairs: DataFrame, sh: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact Jaccard similarity reaches the threshold."""
    keyed = sh.select(F.col("doc_id").cast("string").alias("id"), "shingles")
    return _alike(saved(pairs, "pairs"), lambda ids: only(keyed, ids), threshold)


def near_pairs(df: DataFrame, threshold: float = 0.82, size: int = 3, toks: Column | None = None) -> DataFrame:
    """(a, b, similarity): near-duplicate pairs by MinHash bands, confirmed exactly; of equal sets only with the first.

    At the threshold a pair is missed with probability (1 - t^4)^16: 7e-5 at 0.82.
    """
    sh = shingles(df, size, toks)  # made twice: of all documents, and of those that are in a pair
    return confirmed(candidates(sh), sh, threshold)


#: Ids up to which a table is cut to them by a broadcast.
FEW = 1 << 19


def only(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df whose id, the only column of ids, is among those (left_anti: isn't); a few ids are broadcast, and df then stays where it is."""
    return df.join(F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids, ids.columns[0], how)


def named(sh: DataFrame) -> DataFrame:
    """sh with sorted shingles and set, the SHA-256 of these, by which equal sets meet."""
    sh = sh.withColumn("shingles", F.array_sort("shingles"))
    return sh.withColumn("set", F.unhex(F.sha2(F.array_join("shingles", ","), 256)))


#: Rows whose shingles are made at once.
ROWS = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _shingled(tokens: pa.ListArray, size: int) -> pa.StructArray:
    """(shingles, set) of each row of hashed tokens: different shingles in order, and the SHA-256 of these."""
    n = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends, found, names = np.cumsum(n), [], []
    runs, times = _mixed(flat), np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, size):
        runs = _mixed(runs[:-1] * times + flat[k:])
    for a, b in zip((ends - n).tolist(), ends.tolist()):
        if b - a >= size:
            one = np.sort(runs[a : b - size + 1].view(np.int64))
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        else:  # a shorter text is one shingle, by how many tokens it has too
            one = np.array([b - a], dtype=np.uint64)
            for t in flat[a:b]:
                one = _mixed(one * times + t)
            one = one.view(np.int64)
        found.append(one)
        names.append(hashlib.sha256(one.tobytes()).digest())
    offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found])))
    return pa.StructArray.from_arrays([lists, pa.array(names, pa.binary())], names=["shingles", "set"])


def _sets(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles, set) like named(shingles(df, size)), with other hashes: tokens are hashed by the JVM, runs of these a batch at a time."""

    @F.arrow_udf("shingles array<bigint>, set binary")
    def run(tokens: pa.Array) -> pa.Array:
        parts = [_shingled(tokens.slice(k, ROWS), size) for k in range(0, max(1, len(tokens)), ROWS)]
        return pa.concat_arrays(parts)

    rows = df.select("doc_id", run(F.transform(X.tokens(X.text()), lambda t: F.xxhash64(t))).alias("__s"))
    return rows.select("doc_id", F.col("__s.shingles").alias("shingles"), F.col("__s.set").alias("set"))


def jaccard_classes(df: DataFrame, threshold: float = 0.82, size: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, lead) of every document, lead being the least id of those with an equal shingle set; and all pairs
    (a, b, similarity) of leads whose sets are similar, exactly. A group of copies is one set and costs its size.

    Sets are not handed around: what is written of a document is the part of its set by which it may meet others, and the
    sets of those that do meet are made again.
    """
    sh = _sets(df, size).withColumn("n", F.size("shingles"))
    heads = saved(sh.select("doc_id", "set", "n", F.slice("shingles", F.lit(1), _part(threshold)).alias("part")), "heads")
    member = saved(heads.select("doc_id", "set").join(heads.groupBy("set").agg(F.min("doc_id").alias("lead")), "set").select("doc_id", "lead"), "leads")
    first = only(heads.select("doc_id", "n", "part"), member.where("doc_id <> lead").select("doc_id"), "left_anti")
    pairs = saved(_meeting(first.withColumnRenamed("doc_id", "lead"), threshold, _least(threshold)), "meeting")
    return member, _alike(pairs, lambda ids: _sets(only(df, ids.withColumnRenamed("id", "doc_id")), size).withColumnRenamed("doc_id", "id"), threshold)


def _need(threshold: float, n: Column) -> Column:
    """How many values a set of n has in common with a similar one at least."""
    return F.ceil(n * threshold - 1e-9).cast("int")


def _more(threshold: float, n: Column) -> Column:
    """How many values two similar sets have in common, at least, in the parts that _part() takes of them, if the smaller has n."""
    return F.least(_need(threshold, n), F.lit(1) + F.floor(n * 0.3).cast("int"))


def _part(threshold: float) -> Column:
    """How many of a set's n values, in an order of all values, are enough to have l in common with a similar set's: n - need + l."""
    return F.col("n") - _need(threshold, F.col("n")) + _more(threshold, F.col("n"))


def _least(threshold: float) -> Column:
    """_more() of the smallest set that is similar to one of n."""
    return _more(threshold, _need(threshold, F.col("n")))


def _meeting(heads: DataFrame, threshold: float, common: Column) -> DataFrame:
    """(a, b), a < b: rows (lead, n, part) whose parts have one of their rarest values in common, each pair once.

    Parts of similar sets have common values in common, so that all but common - 1 of the most frequent ones are enough of
    each (prefix filter). Values that one part alone has are counted, not sent on.
    """
    v = heads.select("lead", "n", (F.size("part") - common + 1).alias("rarest"), F.size("part").alias("size"), F.explode("part").alias("v"))
    v = v.withColumn("c", F.count("*").over(Window.partitionBy("v"))).where("c > 1")
    mine = Window.partitionBy("lead")
    place = F.col("size") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("c", "v"))  # behind those that it has alone
    prefix = saved(v.withColumn("place", place).where("place <= rarest").select("lead", "n", "v"), "prefix")
    other = prefix.select(F.col("lead").alias("other"), F.col("n").alias("m"), "v")
    fit = (F.col("lead") < F.col("other")) & (F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9)
    return prefix.join(other, "v").where(fit).select(F.col("lead").alias("a"), F.col("other").alias("b")).distinct()


def _alike(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(a, b, similarity) of the saved pairs that reach the exact Jaccard similarity; sets makes (id, shingles) of ids (id)."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    have = saved(sets(ids).select("id", "shingles"), "sets")
    both = pairs.join(have.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(have.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).where(F.col("similarity") >= threshold)


def similar(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows (lead, shingles) of a saved table whose sets reach the Jaccard similarity, exactly."""
    heads = sets.select("lead", F.size("shingles").alias("n"), F.col("shingles").alias("part"))
    pairs = saved(_meeting(heads, threshold, _need(threshold, F.col("n"))), "meeting")
    return _alike(pairs, lambda ids: only(sets.withColumnRenamed("lead", "id"), ids), threshold)


def jaccard_pairs(df: DataFrame, threshold: float = 0.82, size: int = 3) -> DataFrame:
    """(a, b, similarity): all pairs of different shingle sets, by their least ids, and each copy of a set with its least id."""
    member, close = jaccard_classes(df, threshold, size)
    return close.unionByName(member.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) by least-label propagation with shortcuts; edges are (a, b), root the least of a component."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("new"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("jump"))
        step = saved(step.join(jump, F.col("new") == F.col("via"), "left").select("node", "root", F.least("new", F.coalesce("jump", "new")).alias("new")), "labels")
        if step.where("new <> root").isEmpty():
            return step.select("node", "root")
        labels = step.select("node", F.col("new").alias("root"))


def clusters(df: DataFrame, threshold: float = 0.86) -> DataFrame:
    """(doc_id, representative) of every document: the least id, as a string, of its near-duplicate component."""
    found = components(near_pairs(df, threshold, toks=folded_words()))
    ids = df.select(F.col("doc_id").cast("string").alias("doc_id"))
    return ids.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("representative"))


def greedy(edges: DataFrame, order: str = "string") -> DataFrame:
    """(member, representative, similarity): in order of ids a document is dropped if it is linked to a kept one.

    A chain a-b-c without a-c keeps a and c. In rounds: a node none of whose lesser links may still be kept is kept, and
    what it is linked to is dropped, so that each round settles the least of all that are left, wherever they are.
    Edges are (a, b, similarity), a before b.
    """
    edges = saved(edges.select("a", "b", "similarity"), "edges")
    state = saved(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "state")
    while True:
        a = state.select(F.col("node").alias("a"), F.col("kept").alias("ka"))
        least = edges.join(a, "a").groupBy("b").agg(F.max(F.col("ka").eqNullSafe(True)).alias("drop"), F.max(F.col("ka").isNull()).alias("open"))
        new = state.join(least, F.col("node") == F.col("b"), "left")
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("drop", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = saved(new.select("node", kept.alias("kept")), "state")
        if state.where("kept is null").isEmpty():
            break
    by = edges.join(state.where("kept").select(F.col("node").alias("a")), "a").join(state.where("not kept").select(F.col("node").alias("b")), "b")
    return by.select(F.col("b").alias("member"), F.col("a").alias("representative"), "similarity")


def minhash_filter(df: DataFrame, threshold: float = 0.86, size: int = 3) -> DataFrame:
    """Decisions by greedy near-dedup in string order of ids; the score is 1 less the best similarity to a kept document.

    The score of a kept document is 1: candidates below the threshold aren't looked up.
    """
    if not 0 < threshold <= 1 or size < 1:
        raise ValueError("threshold must be in (0, 1] and size 1 or more")
    sh = shingles(df, size, folded_words())
    found = saved(confirmed(candidates(sh), sh, threshold), "pairs")
    # different sets decide among their least ids; the other copies of a set are always dropped, by that or what drops it
    near, copies = found.where("similarity < 1"), found.where("similarity = 1").select(F.col("a").alias("lead"), F.col("b").alias("member"))
    gone = saved(greedy(near), "gone")
    members = gone.select("member").distinct()
    by_lead = copies.join(members.select(F.col("member").alias("lead")), "lead", "left_anti").select("member", F.lit(1.0).alias("similarity"))
    both = near.select(F.col("a").alias("lead"), F.col("b").alias("other"), "similarity").unionByName(near.select(F.col("b").alias("lead"), F.col("a").alias("other"), "similarity"))
    kept = both.join(members.select(F.col("member").alias("other")), "other", "left_anti")
    by_other = copies.join(kept, "lead").where("other < member").select("member", "similarity")
    dropped = gone.select("member", "similarity").unionByName(by_lead).unionByName(by_other).groupBy("member").agg(F.max("similarity").alias("best"))
    rows = df.select(F.col("doc_id").cast("string").alias("doc_id")).join(dropped, F.col("doc_id") == F.col("member"), "left")
    return rows.select("doc_id", F.col("best").isNull().alias("keep"), (1 - F.coalesce("best", F.lit(0.0))).alias("score"), F.when(F.col("best").isNull(), "no_near_duplicate").otherwise("near_duplicate").alias("reason"))


def near_dedup(df: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(member, representative, similarity): greedy in id order, by exact pairs; the first kept match represents.

    Only leads of equal sets are walked: the other copies of a kept lead have that, those of a dropped one what it has.
    """
    member, close = jaccard_classes(df, threshold)
    best = greedy(close).groupBy("member").agg(F.min(F.struct("representative", "similarity")).alias("m"))
    gone = saved(best.select("member", "m.representative", "m.similarity"), "gone")
    copies = member.where("doc_id <> lead").join(gone, F.col("lead") == F.col("member"), "left")
    copies = copies.select(F.col("doc_id").alias("member"), F.coalesce("representative", "lead").alias("representative"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    return gone.unionByName(copies)


def near_members(ids: DataFrame, close: DataFrame) -> DataFrame:
    """(part, member): what near_dedup() drops in each part of ids (part, doc_id, set), by the sets' pairs (a, b, similarity).

    A set's lead is its least id in the part. All parts are walked at once, so rounds are those of the longest chain.
    """
    ids = saved(ids.where("doc_id is not null"), "parts")
    lead = saved(ids.groupBy("part", "set").agg(F.min("doc_id").alias("lead")), "leads")
    x = lead.select("part", F.col("set").alias("a"), F.col("lead").alias("x"))
    y = lead.select(F.col("part").alias("other"), F.col("set").alias("b"), F.col("lead").alias("y"))
    pairs = close.join(x, "a").join(y, "b").where("part = other and x <> y")
    node = lambda c: F.struct("part", c.alias("id"))
    gone = greedy(pairs.select(node(F.least("x", "y")).alias("a"), node(F.greatest("x", "y")).alias("b"), "similarity"))
    gone = gone.select("member.part", F.col("member.id").alias("member"))
    copies = ids.join(lead, ["part", "set"]).where("doc_id <> lead").select("part", F.col("doc_id").alias("member"))
    return gone.unionByName(copies).distinct()


def id_conflicts(df: DataFrame) -> DataFrame:
    """(doc_id, rows): ids that several rows have."""
    return df.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")


def split_token_pairs(df: DataFrame, split: str = "split", threshold: float = 0.98, words: int = 40) -> DataFrame:
    """(a, b, similarity, a_split, b_split): documents of different splits with nearly the same set of words, all such pairs.

    Documents of no more than so many words don't count. Of those with equal sets in a split the least id stands for all.
    Sets are joined by their rarest words: of 100 words two are enough at 0.98.
    """
    rows = df.where(F.size(folded_words()) > words)
    found = shingles(rows, 1, folded_words(), keep=(split,))
    leads = found.groupBy(F.array_sort("shingles").alias("shingles"), split).agg(F.min("doc_id").alias("lead"))
    leads = saved(leads, "leads")
    named = leads.select(F.col("lead"), F.col(split).alias("s"))
    pairs = similar(leads.select("lead", "shingles"), threshold)
    pairs = pairs.join(named.select(F.col("lead").alias("a"), F.col("s").alias("a_split")), "a").join(named.select(F.col("lead").alias("b"), F.col("s").alias("b_split")), "b")
    return pairs.where(~F.col("a_split").eqNullSafe(F.col("b_split"))).select("a", "b", "similarity", "a_split", "b_split")


def split_near_pairs(df: DataFrame, split: str = "split", threshold: float = 0.9) -> DataFrame:
    """(a, b, similarity, a_split, b_split): near-duplicate pairs of different splits, copies by the first of their set in each.

    Sets are told apart by split, so that a group of copies in two splits is one pair.
    """
    sh = named(shingles(df, toks=folded_words(), keep=(split,))).withColumn("sig", signature(F.col("shingles")))
    rows = saved(sh.select(F.col("doc_id").cast("string").alias("id"), split, "set", bands_of("sig", PERMUTATIONS, BANDS).alias("bands")), "bands")
    lead = saved(rows.groupBy("set", split).agg(F.min("id").alias("doc_id"), F.first("bands").alias("bands")), "leads")
    first = lead.groupBy("set").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")).select("id", "bands")
    near = confirmed(met(first), shingles(df, toks=folded_words()), threshold)
    # equal sets of several splits are met by the first of them alone; here every two of them are a pair
    same = lead.groupBy("set").agg(F.collect_list(F.struct("doc_id", split)).alias("g")).where("size(g) > 1").select(F.array_sort("g").alias("g"))
    of = lead.select(F.col("doc_id"), F.col(split).alias("s"))
    near = near.join(of.select(F.col("doc_id").alias("a"), F.col("s").alias("a_split")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("s").alias("b_split")), "b")
    near = near.where("a_split <> b_split").select("a", "b", "similarity", "a_split", "b_split")
    x, y = F.col("x"), F.col("y")
    both = same.select(F.explode("g").alias("x"), "g").select("x", F.explode("g").alias("y")).where("x.doc_id < y.doc_id")  # splits are few
    return near.unionByName(both.select(x["doc_id"].alias("a"), y["doc_id"].alias("b"), F.lit(1.0).alias("similarity"), x[split].alias("a_split"), y[split].alias("b_split")))


def split_audit(df: DataFrame, split: str = "split") -> DataFrame:
    """(hash, splits): normalised texts that several splits have."""
    rows = df.select(F.sha2(X.normalise(X.text()), 256).alias("hash"), split)
    return rows.groupBy("hash").agg(F.array_sort(F.collect_set(split)).alias("splits")).where("size(splits) > 1")


def _pieces(lengths: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A step from words (id, word) to the different parts of them that have one of the lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, found = [], []
            for key, word in zip(b["id"], b["word"]):
                for n in lengths:
                    for at in range(len(word) - n + 1):
                        ids.append(key)
                        found.append(word[at : at + n])
                        if len(ids) >= 1 << 16:
                            yield pd.DataFrame({"id": ids, "piece": found}).drop_duplicates()
                            ids, found = [], []
            yield pd.DataFrame({"id": ids, "piece": found}, dtype=None).astype({"id": "int64", "piece": "object"}).drop_duplicates()

    return run


#: Beginnings of texts that others are searched for at once, and runs of words that are broadcast, at most.
BEGINNINGS, RUNS = 64, 1 << 12


def beginnings(texts: DataFrame, column: str) -> list[str] | None:
    """What each of the texts begins with: up to BEGINNINGS strings, as long as that many do; None if their first characters are more."""
    for n in (64, 32, 16, 8, 4, 2, 1):
        found = texts.select(F.left(column, F.lit(n)).alias("b")).distinct().limit(BEGINNINGS + 1).collect()
        if len(found) <= BEGINNINGS:
            return sorted(r["b"] for r in found)
    return None


def holds(x: Column, parts: list[str] | None) -> Column:
    """Whether x has one of the parts in it; without a list of them it may."""
    if not parts:
        return F.lit(parts is None)
    return F.coalesce(F.greatest(*[x.contains(b) for b in parts], F.lit(False)), F.lit(False))


def containment(df: DataFrame, protected: DataFrame, words: int = 8) -> DataFrame:
    """(item_id, doc_id): documents that hold a protected text verbatim.

    Only documents with the beginning of one are looked at further, if the texts begin in a few ways: these are written once.
    Candidates share a run of the protected text's words, by an equi-join of hashed runs, and then what its other words leave
    on either side of the run; of a text of one or two words the longer one is a part of a document's word. Then the text is
    looked for.
    """
    run = lambda t: F.xxhash64(F.concat_ws(" ", t))
    items = protected.select("item_id", F.col("text").alias("item"), X.words(F.col("text")).alias("w")).where("size(w) > 0")
    # the first and the last word may go on in the document; what is between stands there as it is
    long = items.where("size(w) > 2")
    short = long.withColumn("inner", F.slice("w", F.lit(2), F.least(F.lit(words), F.size("w") - 2)))
    # the first word ends what stands before the run; the last begins what stands behind it, if no words were left out
    last = F.when(F.size("w") - 2 <= words, F.element_at("w", -1)).otherwise("")
    short = short.select("item_id", "item", F.size("inner").alias("n"), F.get("inner", F.lit(0)).alias("head"), run(F.col("inner")).alias("h"), F.element_at("w", 1).alias("before"), last.alias("behind"))
    short = short.withColumns({"nb": F.char_length("before"), "na": F.char_length("behind")})
    sizes = [r[0] for r in short.select("n").distinct().collect()]  # words of them at most
    docs = df.select("doc_id", X.text().alias("body"))
    items = saved(items, "items")
    if (parts := beginnings(items, "item")) is not None:
        docs = saved(docs.where(holds(F.col("body"), parts)), "holding")
    of = lambda some: docs.where(holds(F.col("body"), beginnings(some, "item"))).select("doc_id", X.words(F.col("body")).alias("t"))
    found, texts = None, of(long) if sizes else None
    for n in sizes:
        mine = short.where(F.col("n") == n)
        sides = mine.groupBy("h").agg(F.collect_set(F.struct("nb", "na")).alias("sides"))
        word = lambda at: F.coalesce(F.when(at >= 0, F.get("t", at)), F.lit(""))
        gram = lambda i: F.struct(run(F.slice("t", i + 1, n)).alias("h"), word(i - 1).alias("p"), word(i + n).alias("q"))
        at, heads = F.sequence(F.lit(0), F.greatest(F.size("t") - n, F.lit(0))), mine.select("head").distinct().limit(BEGINNINGS + 1).collect()
        if len(heads) <= BEGINNINGS:
            at = F.filter(at, lambda i: F.get("t", i).isin([r["head"] for r in heads]))  # noqa: B023
        grams = texts.select("doc_id", F.explode(F.transform(at, gram)).alias("g")).select("doc_id", "g.*")
        sides = saved(sides, "sides")
        near = grams.join(F.broadcast(sides) if sides.count() <= RUNS else sides, "h").select("doc_id", "h", "p", "q", F.explode("sides").alias("side")).select("doc_id", "h", "p", "q", "side.*")
        near = near.select("doc_id", "h", "nb", "na", F.right("p", F.col("nb")).alias("before"), F.left("q", F.col("na")).alias("behind"))
        hits = near.join(mine, ["h", "nb", "na", "before", "behind"]).select("item_id", "item", "doc_id")
        found = hits if found is None else found.unionByName(hits)
    longer = F.when(F.char_length(F.element_at("w", -1)) > F.char_length(F.get("w", F.lit(0))), F.element_at("w", -1)).otherwise(F.get("w", F.lit(0)))
    tiny = saved(items.where("size(w) < 3").select("item_id", "item", longer.alias("piece")), "tiny")
    lengths = sorted(r[0] for r in tiny.select(F.char_length("piece")).distinct().collect())  # different lengths of words
    if lengths:
        # a text of one or two words may be parts of words: those that have a part of the right length that is the item's
        parts = beginnings(tiny, "piece")
        words_ = F.explode(F.array_distinct("t") if parts is None else F.col("t")).alias("word")  # few are left of those that may repeat
        have = of(tiny).select("doc_id", words_).where((F.char_length("word") >= lengths[0]) & holds(F.col("word"), parts)).select("doc_id", "word", F.xxhash64("word").alias("id"))
        pieces = have.select("id", "word").distinct().mapInPandas(_pieces(lengths), "id long, piece string")
        few = have.join(pieces.join(tiny, "piece").select("id", "item_id", "item").distinct(), "id").select("item_id", "item", "doc_id")
        found = few if found is None else found.unionByName(few)
    if found is None:
        return items.join(df.select("doc_id").limit(0)).select("item_id", "doc_id")
    return found.distinct().join(docs.select("doc_id", "body"), "doc_id").where(F.col("body").contains(F.col("item"))).select("item_id", "doc_id").distinct()
