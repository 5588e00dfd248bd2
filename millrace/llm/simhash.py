"""SimHash near-dedup by tiled exact comparison.

Fingerprints are made once for each document; each different one is compared once. They are sorted by the population
counts of their two halves and cut into tiles, and a pair of tiles is skipped if the counts differ by more than the
radius: halves differ in as many bits at least. The other pairs are compared whole with exclusive-or and bit counts in
numpy. A task hands on a spanning forest of the links it found, so a group of copies costs its size, not its square;
the groups are then joined over all tasks by star contraction, in DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_prefix, saved, scratch, shown_id, whole_id

WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a block that is sent to a task, at most, and in a tile that is compared at once. A block is sent once for
#: each other block that it is compared with: bytes grow with the square of the fingerprints only beyond 16 blocks, and then
#: by 1 / BLOCK; two blocks are some 17 thousand million pairs, 20 to 40 seconds.
BLOCK = 131_072
TILE = 512
#: Numbers of a fingerprint that are compared of all pairs; those after them only of pairs that these don't rule out.
LEAD = 2
#: Pairs of fingerprints that a task compares at least, on average.
TASK = 200_000_000
#: Links that a task takes in to contract them.
PART = 1_000_000


def _words(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(words of the text joined by spaces, start of each, end of each). Words as in ASCII white space, A-Z in lower case."""
    parts = text.encode().lower().split()
    ends = np.cumsum(np.array([len(p) + 1 for p in parts], dtype=np.int64)) - 1
    return b" ".join(parts), np.concatenate([[0], ends[:-1] + 1])[: len(parts)], ends


def hashes(text: str, words: int, seed: int = 0) -> np.ndarray:
    """A hash of each shingle, repeats included; of the whole sequence where that has fewer words; none without words."""
    import xxhash

    joined, starts, ends = _words(text)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(starts) - words + 1)
    last = ends[words - 1 :] if len(ends) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())], dtype=np.uint64)


def majority(found: list[np.ndarray]) -> np.ndarray:
    """Of each array of hashes one number with the bits that over half of them have set; 0 for an empty array.

    The bits of eight bytes are counted in the bytes of one number, 255 hashes at a time, before those overflow.
    """
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    out = np.zeros(len(found), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat, sizes = np.concatenate([found[k] for k in some]), sizes[some]
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs  # of each array, among the runs
    within = np.arange(int(runs.sum())) - np.repeat(first, runs)
    starts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * within
    counts = np.empty((len(some), 8, 8), dtype=np.int64)  # byte, bit
    for bit in range(8):
        lanes = flat >> np.uint64(bit) & np.uint64(0x0101010101010101)
        summed = np.add.reduceat(lanes, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts[:, :, bit] = np.add.reduceat(summed, first, axis=0, dtype=np.int64)
    bits = 2 * counts.reshape(-1, 64) > sizes[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 without words."""
    return int(majority([hashes(text, words, seed)])[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. A null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), TEXTS):
                part = b.iloc[k : k + TEXTS]
                yield pd.DataFrame({"id": part["id"], "fp": majority([hashes(t, words, SEED) for t in part["text"]]).view(np.int64)})

    rows = df.select(whole_id(F.col(id_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "id long, fp long").select(shown_id(F.col("id")).alias("id"), "fp")


def _halves(fps: np.ndarray) -> np.ndarray:
    """Set bits in the two halves of each fingerprint's first number."""
    u = fps[:, 0]
    return np.stack([np.bitwise_count(u >> np.uint64(32)), np.bitwise_count(u & np.uint64(0xFFFFFFFF))], axis=1).astype(np.int64)


def _boxes(fps: np.ndarray, size: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, least counts, most counts) of each tile."""
    counts = _halves(fps)
    return [(k, counts[k : k + size].min(axis=0), counts[k : k + size].max(axis=0)) for k in range(0, len(fps), size)]


def _gap(a: tuple, b: tuple) -> int:
    return int(np.maximum(0, np.maximum(a[1] - b[2], b[1] - a[2])).sum())


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of a[i] and b[i], for all i at once; parent[x] <= x, and roots are their own parents."""
    while True:
        pa, pb = parent[a], parent[b]
        differ = pa != pb
        if not differ.any():
            return
        a, b, pa, pb = a[differ], b[differ], pa[differ], pb[differ]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while (parent != (up := parent[parent])).any():
            parent[:] = up


def linked(x: np.ndarray, y: np.ndarray | None, radius: int, first: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root), as places in x and then y, of the links within x and y, or x alone where y is None.

    Fingerprints are rows of 64-bit numbers. A pair is a link if the first LEAD numbers differ in at most first bits, and
    all of them in at most radius. With y only pairs of one of each are compared.
    """
    both = x if y is None else np.concatenate([x, y])
    parent = np.arange(len(both))
    lead = np.ascontiguousarray(both[:, :LEAD].T)
    # kept for all tiles: fresh memory for each would take longer than the comparison
    differ, count, more, hit = (np.empty(tile * tile, dtype=t) for t in (np.uint64, np.uint8, np.uint8, bool))
    left, shift = _boxes(x, tile), 0 if y is None else len(x)
    right = left if y is None else _boxes(y, tile)
    for i, p in enumerate(left):
        rows = lead[:, p[0] : min(p[0] + tile, len(x)), None]
        for q in right[i:] if y is None else right:
            if _gap(p, q) > first:
                continue
            cols = lead[:, None, shift + q[0] : min(shift + q[0] + tile, len(both))]
            shape = rows.shape[1], cols.shape[2]
            d, c, m, h = (z[: shape[0] * shape[1]].reshape(shape) for z in (differ, count, more, hit))
            np.bitwise_count(np.bitwise_xor(rows[0], cols[0], out=d), out=c)
            for k in range(1, len(lead)):
                c += np.bitwise_count(np.bitwise_xor(rows[k], cols[k], out=d), out=m)
            if not np.less_equal(c, first, out=h).any():
                continue
            a, b = np.divmod(np.flatnonzero(h), shape[1])
            a, b = a + p[0], b + shift + q[0]
            real = a < b
            if both.shape[1] > LEAD and real.any():
                a, b = a[real], b[real]
                real = np.bitwise_count(both[a] ^ both[b]).sum(axis=1, dtype=np.int64) <= radius
            if real.any():
                _join(parent, a[real], b[real])
    child = np.flatnonzero(parent != np.arange(len(both)))
    return child, parent[child]


def links(x: np.ndarray, y: np.ndarray | None, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """The forest of linked() for fingerprints of one signed number each, as fingerprints."""
    both = x if y is None else np.concatenate([x, y])
    rows = lambda z: z.view(np.uint64).reshape(-1, 1)
    child, root = linked(rows(x), None if y is None else rows(y), radius, radius, tile)
    return both[child], both[root]


def _blocks(distinct: DataFrame, n: int, block: int) -> DataFrame:
    """(block, keys, fps, lo, hi): the fingerprints in order of the counts of their first halves, in blocks."""
    names = [c for c in distinct.columns if c != "key"]
    first = names[0] if names else "key"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        got = [(b["key"].to_numpy(), np.stack([b[c].to_numpy() for c in names or ["key"]], axis=1)) for b in batches]
        keys = np.concatenate([np.zeros(0, dtype=np.int64), *[k for k, _ in got]])
        fps = np.concatenate([np.zeros((0, max(1, len(names))), dtype=np.int64), *[f for _, f in got]]).view(np.uint64)
        counts = _halves(fps)
        order = np.lexsort((keys, counts[:, 1], counts[:, 0]))
        keys, fps, counts = keys[order], fps[order], counts[order]
        part = TaskContext.get().partitionId()
        rows = []
        for k in range(0, len(fps), block):
            c = counts[k : k + block]
            rows.append((part * 2**20 + k // block, keys[k : k + block].tobytes(), fps[k : k + block].tobytes() if names else b"", c.min(axis=0).tolist(), c.max(axis=0).tolist()))
        yield pd.DataFrame(rows, columns=["block", "keys", "fps", "lo", "hi"])

    top, low = F.bit_count(F.shiftrightunsigned(first, 32)), F.bit_count(F.col(first).bitwiseAND(F.lit(0xFFFFFFFF)))
    return distinct.repartitionByRange(max(1, -(-n // block)), top, low, "key").mapInPandas(run, "block long, keys binary, fps binary, lo array<int>, hi array<int>")


def forest(distinct: DataFrame, radius: int = RADIUS, first: int | None = None, block: int = BLOCK) -> DataFrame:
    """(u, v): a forest for each pair of blocks, u and v keys of linked fingerprints.

    distinct: (key, one column or more of 64-bit numbers, the fingerprint; none if the key is it), a row for each key. first: bits that the first
    LEAD numbers of a link differ in at most; the radius where they are all there is.
    """
    first = radius if first is None else first
    words = max(1, len(distinct.columns) - 1)
    n = distinct.count()
    # more blocks than tasks can run at once, so that a small table isn't compared by one of them
    blocks = saved(_blocks(distinct, n, max(1024, min(block, n // 16))), "blocks")
    boxes = blocks.select("block", "lo", "hi", (F.octet_length("keys") / 8).cast("long").alias("size"))
    other = boxes.select(F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("size").alias("size2"))
    # blocks meet by the counts of their first halves, those of one widened by the radius
    reach = boxes.withColumn("cell", F.explode(F.expr(f"sequence(lo[0] - {first}, hi[0] + {first})")))
    cells = other.withColumn("cell", F.explode(F.expr("sequence(lo2[0], hi2[0])")))
    gap = F.expr("greatest(0, lo[0] - hi2[0], lo2[0] - hi[0]) + greatest(0, lo[1] - hi2[1], lo2[1] - hi[1])")
    pairs = reach.join(cells, "cell").where((F.col("other") >= F.col("block")) & (gap <= first)).select("block", "other", (F.col("size") * F.col("size2")).alias("work"))
    pairs = saved(pairs.distinct(), "pairs")
    sent = pairs.join(blocks.select("block", "keys", "fps"), "block").join(blocks.select(F.col("block").alias("other"), F.col("keys").alias("keys2"), F.col("fps").alias("fps2")), "other")
    met, work = pairs.agg(F.count("*"), F.coalesce(F.sum("work"), F.lit(0))).head()
    sent = sent.select("block", "other", "keys", "keys2", "fps", "fps2").repartition(max(1, min(100_000, met, work // TASK + 1)), "block", "other")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = lambda fps: np.frombuffer(fps, dtype=np.uint64).reshape(-1, words)
        for b in batches:
            for p, q, k, k2, x, y in zip(b["block"], b["other"], b["keys"], b["keys2"], b["fps"], b["fps2"]):
                child, root = linked(rows(x or k), None if p == q else rows(y or k2), radius, first)
                keys = np.frombuffer(k if p == q else k + k2, dtype=np.int64)
                yield pd.DataFrame({"u": keys[child], "v": keys[root]})

    return sent.mapInPandas(run, "u long, v long")


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """A forest (u, v), v the least of u's tree, of each of so many parts of the edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b[["u", "v"]].to_numpy() for b in batches]
        nodes, at = np.unique(np.concatenate([np.zeros((0, 2), dtype=np.int64), *got]), return_inverse=True)
        at = at.reshape(-1, 2)
        parent = np.arange(len(nodes))
        _join(parent, at[:, 0], at[:, 1])
        child = np.flatnonzero(parent != np.arange(len(nodes)))
        yield pd.DataFrame({"u": nodes[child], "v": nodes[parent[child]]})

    return edges.repartition(tasks).mapInPandas(run, "u long, v long")


def components(edges: DataFrame, part: int = PART) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the least node of its component.

    Parts of the edges are contracted to forests, in tasks of at most part edges, as long as that leaves fewer; when no
    more than one part is left, its forest is the answer. A forest too large for that goes on by large-star and
    small-star contraction: each round replaces a node's links by links to its least neighbour, so a chain shortens by
    half or more. A node with many links is aggregated before it is shuffled.
    """
    now = saved(edges.select("u", "v"), "edges")
    n = now.count()
    while n > part:
        left = saved(_contracted(now, -(-n // part)), "edges")
        now, before, n = left, n, left.count()
        if n > 0.8 * before:
            now = _stars(now)
            break
    else:
        now = saved(_contracted(now, 1), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = saved(small.where("u <> v").distinct(), "edges")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if new == state:
            return now
        state = new


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """A row for each row of df: id, fingerprint (16 hexadecimal digits), component_id (the least id reachable by links).

    A null text is empty; texts without words share fingerprint 0 and are linked like others. A null id is kept, and is
    the least only of a component without other ids. Repeated rows come as often as before. An empty table gives no rows.
    """
    docs = saved(fingerprints(df, id_col, text_col, words), "simhash")
    with scratch(df.sparkSession) as keep:
        distinct = saved(docs.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
        roots = components(forest(distinct.select(F.col("fp").alias("key")), radius))
        named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
        by_fp = keep(named.join(groups, "root").select("fp", "component_id"), "components")
    return docs.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: For dropping near copies: words in a shingle, the least Jaccard similarity of a link's shingle sets, numbers of 64 bits in
#: a fingerprint; documents of a component that are verified against each other at once; texts that are hashed at once.
COPY_WORDS, SIMILARITY, NUMBERS, CHUNK, TEXTS = 5, 0.8, 4, 256, 64


def radii(similarity: float, numbers: int = NUMBERS) -> tuple[int, int]:
    """(bits that fingerprints of so similar sets differ in at most, bits that their first LEAD numbers differ in at most).

    Sets of similarity s have an overlap of 2s / (1 + s) of their mean size, so a bit, the sign of a sum over each set,
    differs with probability arccos(overlap) / pi for large sets. For sets of few shingles, whose sums are ties at times, it
    is up to a quarter more (counted out for all sets of up to 60 shingles, see the tests). The bounds lie four standard
    deviations over that higher mean. At 0.8 these are 73 of 256 bits and 41 of 128: a link of two large sets is missed once
    in 2 million, the worst of small ones once in 6,000; two unrelated texts pass for candidates once in 4 * 10^11 at most.
    """
    p = 1.25 * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    bound = lambda n: int(n * p + 4 * (n * p * (1 - p)) ** 0.5)
    return bound(64 * numbers), bound(64 * LEAD)


def shingle_set(text: str, words: int = COPY_WORDS) -> np.ndarray:
    """Sorted different hashes of the shingles. A text without words has one."""
    found = np.unique(hashes(text, words))
    return found if len(found) else np.zeros(1, dtype=np.uint64)


def sketch(sets: list[np.ndarray], numbers: int = NUMBERS) -> np.ndarray:
    """A row of 64-bit numbers for each set: majorities of its hashes, and of others made of these."""
    out = np.empty((len(sets), numbers), dtype=np.uint64)
    for k in range(numbers):
        mixed = []
        for h in sets:
            if k:
                h = (h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
                h = h ^ h >> np.uint64(32)
            mixed.append(h)
        out[:, k] = majority(mixed)
    return out


def sketches(rows: DataFrame, words: int = COPY_WORDS, numbers: int = NUMBERS) -> DataFrame:
    """(id, row, f0, f1, ...): the SimHash of a text's different shingles, of so many numbers. rows: (id, row, text), without nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), TEXTS):
                part = b.iloc[k : k + TEXTS]
                found = sketch([shingle_set(t, words) for t in part["text"]], numbers).view(np.int64)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "row": part["row"].to_numpy()} | {f"f{j}": found[:, j] for j in range(numbers)})

    return rows.mapInPandas(run, "id long, row long, " + ", ".join(f"f{j} long" for j in range(numbers)))


def verified(fps: np.ndarray, sets: list[np.ndarray], left: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links: pairs of places within the radius whose sets are similar enough.

    left: which places are of the first chunk; pairs within the second are left to another call. What is linked already
    is not verified again. A set is compared with all others at once, by the shingles it has in common with each.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mine = np.zeros(len(values), dtype=bool)
    label = np.arange(n)
    out = []
    for k in np.flatnonzero(left).tolist():
        ok = (label != label[k]) & (~left | (np.arange(n) > k)) & (np.minimum(sizes, sizes[k]) >= similarity * np.maximum(sizes, sizes[k]) - 1e-9)
        ok[ok] = np.bitwise_count(fps[ok] ^ fps[k]).sum(axis=1, dtype=np.int64) <= radius
        if not ok.any():
            continue
        own = codes[starts[k] : starts[k] + sizes[k]]
        mine[own] = True
        to = np.flatnonzero(ok)
        if 4 * len(to) > n:
            common = np.add.reduceat(mine[codes], starts, dtype=np.int64)[to]
        else:
            common = np.array([np.count_nonzero(mine[codes[starts[j] : starts[j] + sizes[j]]]) for j in to.tolist()])
        mine[own] = False
        for j in to[common >= similarity * (sizes[to] + sizes[k] - common) - 1e-9].tolist():
            if label[j] != label[k]:
                label[label == label[j]] = label[k]
                out.append((k, j))
    return out


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = COPY_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, row, root, stays) of every document that is linked to others, written: root is the least id of its group, and
    stays tells the document that stands for the group. A null text is empty. A document is an id with a text, whose hash is
    row: an id may come with several texts, the one with the least hash being first; repeated rows are one document.

    A link is a pair whose sets of shingles have at least the similarity. Candidates are components by fingerprints of the
    different shingles, wide enough that hardly a link is past the radius and hardly an unrelated pair within it (radii()
    has the figures), so that components don't grow together as a corpus grows: even among 10^9 documents unrelated pairs
    within the radius are some millions, a hundredth of a link for each document. In each component chunks of documents are
    verified against chunks, so none lands in one task whole. Where k documents are all candidates of each other but not
    similar enough, that copies each set k / CHUNK times.
    """
    with scratch(df.sparkSession) as keep:
        return keep(_near_groups(df, id_col, text_col, words, similarity), "groups")


def _near_groups(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    radius, first = radii(similarity)
    # documents by number, in the order of id and row: a number is what the graph is made of
    docs = sketches(rows, words).dropDuplicates(["id", "row"]).orderBy("id", "row").withColumn("doc", F.monotonically_increasing_id())
    docs = saved(docs, "simhash")
    numbers = [c for c in docs.columns if c not in ("id", "row", "doc")]
    # a row for each fingerprint; its least document stands for it
    distinct = saved(docs.groupBy(*numbers).agg(F.min("doc").alias("key")).select("key", *numbers), "distinct")
    roots = saved(components(forest(distinct, radius, first)), "roots")
    parts = distinct.join(roots, F.col("key") == F.col("node"), "left").select(F.coalesce("root", "key").alias("part"), *numbers)
    placed = saved(docs.join(parts, numbers).select("doc", "id", "row", "part"), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size")).where("size > 1").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    candidates = saved(placed.join(saved(sizes, "sizes"), "part").select("doc", "id", "row", "part", "chunks"), "candidates")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), TEXTS):
                part = b.iloc[k : k + TEXTS].copy()
                found = [shingle_set(t, words) for t in part.pop("text")]
                yield part.assign(fps=[f.tobytes() for f in sketch(found)], shingles=[x.tobytes() for x in found])

    texts = candidates.join(rows, ["id", "row"]).dropDuplicates(["id", "row"]).select("doc", "part", "chunks", "text")
    sets = texts.mapInPandas(shingled, "doc long, part long, chunks int, fps binary, shingles binary")
    dealt = sets.withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("part", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"), "chunk", "doc", "fps", "shingles")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc").reset_index(drop=True)
        left = (group["chunk"] == group["p"]).to_numpy()
        fps = np.stack([np.frombuffer(x, dtype=np.uint64) for x in group["fps"]])
        links_ = verified(fps, [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]], left, radius, similarity)
        ids = group["doc"].to_numpy()
        return pd.DataFrame([(ids[a], ids[b]) for a, b in links_], columns=["u", "v"]).astype("int64")

    found = components(dealt.groupBy("part", "p", "q").applyInPandas(verify, "u long, v long"))
    found = saved(candidates.join(found, F.col("doc") == F.col("node")).select("doc", "id", "row", F.col("root").alias("first")), "linked")
    roots = found.where("doc = first").select("first", F.col("id").alias("root"))
    return found.join(roots, "first").select("id", "row", "root", (F.col("doc") == F.col("first")).alias("stays"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df without the documents that another one of their group stands for, that of the least id (of equal ids, of the
    least text hash). Rows with a null id all stay; repeated rows do so together. Other columns may have any names."""
    own = own_prefix(df)
    drop = near_groups(df, id_col, text_col, **how).where("NOT stays").select(F.col("id").alias(own + "id"), F.col("row").alias(own + "row"))
    same = (F.col(id_col).cast("long") == F.col(own + "id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(own + "row"))
    return df.join(drop, same, "left_anti")


def query(spark, sf_dir):
    """op10: fingerprints and components of all documents."""
    from .common import table

    return near_dedup(table(spark, sf_dir, "documents"))
