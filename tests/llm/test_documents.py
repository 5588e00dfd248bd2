"""Every operator on documents against brute force, on a table with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, fingerprints, mixing, packing, quality, simhash, suffix_dedup, token_counts
from millrace.llm.common import NO_ID
from millrace.llm.tokens import default_path, encode

from .data import documents, frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(r[0], r[1] or "") for r in documents()]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


BIG = 2**53 + 1


def test_ids_beside_nulls(spark):
    """A null id in a batch doesn't round the others, which a float can't hold."""
    labels = spark.createDataFrame([(BIG, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(BIG, "some words of one document"), (None, "other words of another"), (BIG + 2, None)], "doc_id long, text string").coalesce(1)
    ids = lambda out: {r["doc_id"] for r in out.select("doc_id").collect()}
    for out in (
        fingerprints.with_next(df), fingerprints.fingerprint(df), packing.pack(df), token_counts.token_counts(df), quality.rate_documents(df, quality.train(df, labels)),
        exact_dedup.exact_dedup(df), suffix_dedup.suffix_dedup(df), simhash.near_dedup(df), simhash.keep_one(df),
    ):
        assert ids(out) == {BIG, BIG + 2, None}


def exact_expected():
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t.translate(LOW)].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        seen = False
        for i in sorted(ids, key=lambda x: (x is not None, x)):
            kept = i == top and not seen
            seen |= kept
            out[(i, top, len(ids), kept, sha(t))] += 1
    return out


@pytest.mark.parametrize("how", [{}, {"block": 3}, {"block": 64, "hashed": lambda c: F.pmod(F.xxhash64(c), F.lit(5))}])
def test_exact_dedup(docs, how):
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, **how).collect())
    assert got == exact_expected()


def test_exact_dedup_keeps_rows(docs, empty):
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns
    want = Counter((i, s) for (i, _, _, kept, s), n in exact_expected().items() if kept)
    assert Counter((r["doc_id"], sha((r["text"] or "").translate(LOW))) for r in got.collect()) == want
    assert exact_dedup.keep_first(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_fingerprints(docs, empty):
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, signed(r[1]), r[1].encode()))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = (fingerprints.signature(x) for x in (t, edited, after))
        want[(i, len(t), sha(edited), fingerprints.shown(a), fingerprints.shown(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c))] += 1
    for ranges in (500, 4, 1):
        old, fingerprints.RANGE = fingerprints.RANGE, ranges
        try:
            got = Counter(tuple(r) for r in fingerprints.with_next(docs).collect())
        finally:
            fingerprints.RANGE = old
        assert got == want
    assert fingerprints.with_next(empty).count() == 0
    assert fingerprints.fingerprint(docs).count() == len(ROWS)


def test_phrases_against_a_plain_parse():
    """Dictionary phrases as strings, hashed one by one, instead of the walk over numbered nodes."""

    def hashed(phrase):
        h = 0x9E3779B97F4A7C15
        for b in phrase:
            h = (h * 0x100000001B3 + b + 1) % 2**64
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ h >> shift) * factor % 2**64
        return h >> 32

    def phrases(data):
        out, now = set(), b""
        for b in data:
            now += bytes([b])
            if now not in out:
                out.add(now)
                now = b""
        return out

    for text in ["", "a", "aaaaaaaaaa", "abababab", "the cat and the dog and the cat", "é" * 40, *(t for _, t in ROWS if len(t) < 3000)]:
        want = sorted({hashed(p) for p in phrases(text.encode())})
        assert fingerprints.signature(text, 50).tolist() == want[:50], text[:40]
        for cut in (0, len(text) // 2):
            p = fingerprints.Parser()
            p.feed(text[:cut].encode())
            mark = p.mark()
            p.feed(b"something else, gone again")
            p.back(mark)
            p.feed(text[cut:].encode())
            assert p.signature(50).tolist() == want[:50]
    a, b = phrases(b"the cat sat"), phrases(b"the cat ran")
    x, y = (np.array(sorted({hashed(p) for p in s}), dtype=np.uint32) for s in (a, b))
    assert fingerprints.likeness(x, y) == len(a & b) / len(a | b)


def test_fingerprint_of_similar_texts():
    a = "the quick brown fox jumps over the lazy dog " * 20
    near, far = fingerprints.signature(a + "and more"), fingerprints.signature("0123456789" * 80)
    assert fingerprints.likeness(fingerprints.signature(a), near) > 0.8
    assert fingerprints.likeness(fingerprints.signature(a), far) < 0.2
    assert fingerprints.likeness(fingerprints.signature(""), fingerprints.signature("")) == 1.0
    assert (fingerprints.read(fingerprints.shown(near)) == near).all()


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=256).collect()
    want = Counter()
    for i, t in ROWS:
        ids = np.array([*encode(t, default_path()), 0], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 256)):
            want[(i, k, s, n, zlib.crc32(ids[s : s + n]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(r["length"] for r in got) // 256)
    assert len(sequences) <= 1.05 * least + 1
    assert packing.pack(empty).count() == 0


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(1, 4) == [(0, 1)]


def test_plan_uses_linear_program():
    histogram = {700: 3000, 650: 3000, 690: 3000, 1000: 1500, 48: 1500, 1500: 900, 540: 800}
    sizes = np.array(sorted(histogram))
    uses = packing.fractional(sizes, np.array([histogram[s] for s in sizes], dtype=float), 2048)
    assert all(sizes[list(c)].sum() <= 2048 for c in uses)
    chosen = packing.plan(histogram)
    count = Counter()
    for items, n in chosen:
        assert sum(items) <= 2048
        for s in items:
            count[s] += n
    assert count == Counter(histogram)
    best, _ = packing.knapsack(np.array([3, 5]), np.array([2.0, 4.0]), 11)
    assert best[11] == 8.0 and best[10] == 8.0 and best[9] == 6.0


def test_token_counts(docs, empty):
    got = defaultdict(list)
    for r in token_counts.token_counts(docs).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    want = defaultdict(list)
    from public_tokenizers import path
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    for i, t in ROWS:
        bounds = [0]
        for x in t.split("\n")[:-1]:
            bounds.append(bounds[-1] + len((x + "\n").encode()))
        bounds.append(len(t.encode()))
        starts = [0]
        for x in t.split("\n")[:-1]:
            starts.append(starts[-1] + len(x) + 1)
        counts, crossing, at = [0] * (len(bounds) - 1), [0] * (len(bounds) - 1), 0
        ids = slow.encode(t, add_special_tokens=False).ids
        assert ids == encode(t, default_path())
        for tok in ids:
            n = len(slow_bytes(slow, tok))
            over = [max(0, min(at + n, bounds[k + 1]) - max(at, bounds[k])) for k in range(len(counts))]
            k = over.index(max(over))
            counts[k] += 1
            crossing[k] += sum(x > 0 for x in over) > 1
            at += n
        for k in range(len(counts)):
            want[i].append((k, starts[k], (starts[k + 1] if k + 1 < len(starts) else len(t)) - starts[k], counts[k], crossing[k]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(x[4] for v in got.values() for x in v) > 0
    assert token_counts.token_counts(empty).count() == 0


def slow_bytes(tokenizer, tok):
    from millrace.llm.tokens import byte_lengths

    return b" " * int(byte_lengths(default_path())[tok])


def test_suffix_dedup(docs, empty, monkeypatch):
    least = {}
    key = lambda i: NO_ID if i is None else i
    for i, t in ROWS:
        b = t.encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(least.get(w, 2**63), key(i))
    want = Counter()
    for i, t in ROWS:
        b = t.encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < key(i):
                gone[p : p + 50] = True
        gone[-1] = False
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    tables = len(docs.sparkSession.catalog.listTables())
    for shard, hot in ((suffix_dedup.SHARD, suffix_dedup.HOT), (20_000, suffix_dedup.HOT), (20_000, 2)):
        monkeypatch.setattr(suffix_dedup, "SHARD", shard)
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(docs).collect())
        assert got == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert len(docs.sparkSession.catalog.listTables()) == tables


def test_merge_of_several_transforms():
    """Repeats by merged transforms against a dictionary of all substrings, whatever shards the texts come in."""
    from millrace.llm import bwt

    rng = np.random.default_rng(8)
    for trial in range(30):
        kinds = int(rng.integers(1, 5))
        texts = [bytes(rng.integers(97, 97 + kinds, int(rng.integers(0, 60)), dtype=np.uint8)) for _ in range(int(rng.integers(1, 30)))]
        depth = int(rng.choice([2, 4, 10]))
        want = defaultdict(set)
        for k, t in enumerate(texts):
            for p in range(len(t) - depth + 1):
                want[t[p : p + depth]].add((k, p))
        for size in (20, 60, 150, 10**6):
            text, start, interval = bwt.repeats(texts, depth, shard_bytes=size)
            got = defaultdict(set)
            for k, p, i in zip(text.tolist(), start.tolist(), interval.tolist()):
                got[i].add((k, p))
            assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())), (trial, size)


def test_simhash(docs, empty):
    fps = []
    for _, t in ROWS:
        parts = t.translate(LOW).encode().split()
        grams = [b" ".join(parts[k : k + 4]) for k in range(max(1, len(parts) - 3))] if parts else []
        bits = 0
        for j in range(64):
            if grams and 2 * sum(xxhash.xxh64_intdigest(g, 42) >> j & 1 for g in grams) > len(grams):
                bits |= 1 << j
        fps.append(bits)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    members = defaultdict(list)
    for k, (i, _) in enumerate(ROWS):
        members[find(k)].append(i)
    least = {k: min([i for i in v if i is not None], default=None) for k, v in members.items()}
    want = Counter((i, f"{fps[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(ROWS))
    assert Counter(tuple(r) for r in simhash.near_dedup(docs).collect()) == want
    assert simhash.near_dedup(empty).count() == 0


def test_keep_one(spark, docs, empty):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(5000)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(6)]
    rows = []
    for k, b in enumerate(base):
        parts = b.split()
        for j in range(5):
            edited = list(parts)
            for at in rng.choice(200, j // 2, replace=False):
                edited[at] = "edit"
            rows.append((10 * k + j, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    assert all(len(sets[10 * k] & sets[10 * k + j]) / len(sets[10 * k] | sets[10 * k + j]) >= 0.8 for k in range(6) for j in range(5))
    assert sorted(r[0] for r in simhash.keep_one(df).select("doc_id").collect()) == [0, 10, 20, 30, 40, 50]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert simhash.keep_one(empty).count() == 0
    assert kept.where("doc_id is null").count() == sum(i is None for i, _ in ROWS)


def test_repeated_ids_are_judged_by_text(spark):
    """The same rows stay whatever the partitioning; an unlike text of a repeated id is never lost."""
    rng = np.random.default_rng(4)
    a, b, c = (" ".join(rng.choice([f"w{k}" for k in range(900)], 120)) for _ in range(3))
    rows = [(0, a), (1, a), (1, b), (2, b), (3, c), (3, c), (None, a), (4, None), (5, ""), (4, c)]
    want = {3: [(None, a), (0, a), (1, b), (3, c), (3, c), (4, None)]}
    for parts in (1, 2, 3, 5, 8):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, F.rand(parts))
        got = sorted(map(tuple, simhash.keep_one(df).collect()), key=repr)
        assert got == sorted(want[3], key=repr)


@pytest.mark.parametrize("names", [("__kid", "__row", "__copies", "__n", "__id", "__drop"), ("__Copies", "__copy", "__u", "__key", "__rate", "__source"), ("___first", "__cdf", "__", "doc", "part", "chunk")])
def test_columns_of_any_name_keep_their_values(spark, names):
    rows = [(1, "some text here", "s"), (2, "some text here", "s"), (2, "some text here", "s"), (3, "Some other text", "t"), (None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = plain.withColumns({n: F.concat_ws("/", F.lit(n), F.coalesce("text", F.lit("-"))) for n in names})
    for op in (exact_dedup.keep_first, simhash.keep_one, mixing.mixed):
        got = op(df)
        assert got.columns == df.columns
        kept = got.collect()
        assert sorted(map(repr, (tuple(r)[:3] for r in kept))) == sorted(map(repr, map(tuple, op(plain).collect())))
        assert all(r[n] == f"{n}/{r['text'] if r['text'] is not None else '-'}" for r in kept for n in names)


def test_near_groups_is_exact(spark):
    """Pairs of a similarity of just 0.8, and repeated lines, whatever the distance of their fingerprints."""
    rng = np.random.default_rng(5)
    rows, far = [], 0
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 49)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:40] + [f"w{x}" for x in rng.integers(0, 10**6, 4)]))]
    line = " ".join(f"line{x}" for x in range(20))
    text = " ".join(f"v{x}" for x in range(300))
    rows += [(1000, f"{text} {line}"), (1001, " ".join([text] + [line] * 60)), (1002, line)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    assert all(len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) >= 0.73 for k in range(150))
    similar = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.73 * len(sets[a] | sets[b])}
    far = sum((simhash.simhash(dict(rows)[a], 5) ^ simhash.simhash(dict(rows)[b], 5)).bit_count() > 12 for a, b in similar)
    assert far > 10 and len(similar) == 151
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.73).collect()
    assert {(r["root"], r["id"]) for r in got if r["id"] != r["root"]} == similar


def test_radius_holds_for_small_sets():
    """The greatest probability that a bit of two similar sets differs, counted out, is what radii() goes by."""
    coins = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
    p = 1.25 * np.arccos(2 * 0.8 / 1.8) / np.pi
    for common in range(1, 61):
        for a in range(0, 16):
            for b in range(a, 16):
                if common < 0.8 * (common + a + b) - 1e-9:
                    continue
                k = np.arange(common + 1)[:, None]
                x = ((2 * (k + np.arange(a + 1)) > common + a) * coins(a)).sum(axis=1)
                y = ((2 * (k + np.arange(b + 1)) > common + b) * coins(b)).sum(axis=1)
                assert (coins(common) * (x * (1 - y) + y * (1 - x))).sum() <= p
    assert simhash.radii(0.8) == (73, 41)


def test_scratch_tables_go(docs, spark):
    import os

    from millrace.llm import common

    folder = common.shared_dir(spark).removeprefix("file://")
    groups = simhash.near_groups(docs)
    before = set(os.listdir(folder))
    got = sorted(map(tuple, groups.collect()))
    again = simhash.near_groups(docs)
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"groups"}
    assert sorted(map(tuple, again.collect())) == got


def test_near_groups_of_many_copies(spark, monkeypatch):
    """A large group of near copies, over several chunks, and one whose members are alike but not enough."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = np.random.default_rng(9)
    base, half = [f"w{x}" for x in rng.integers(0, 10**6, 120)], [f"v{x}" for x in rng.integers(0, 10**6, 70)]
    rows = []
    for k in range(100):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"x{k}"
        rows.append((k, " ".join(words)))
        rows.append((1000 + k, " ".join(half + [f"y{x}" for x in rng.integers(0, 10**6, 30)])))
    got = {r["id"]: r["root"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 for k in range(100)}


def test_links_is_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 700, dtype=np.int64)
    y = np.concatenate([x[:300] ^ (1 << rng.integers(0, 62, 300)), rng.integers(0, 2**63, 200, dtype=np.int64)])
    u, v = simhash.links(np.unique(x), np.unique(y), 4, tile=64)
    assert len(u) >= 300
    assert len(simhash.links(np.unique(np.concatenate([x, y])), None, 4, tile=64)[0]) == len(u)


def test_mixing(docs, empty):
    got = mixing.mix(docs, total=2.0)
    rows = got.collect()
    assert got.columns == [c for c in docs.columns if c != "copies"] + ["copies", "copy", "shuffle_key"]
    keys = [r["shuffle_key"] for r in rows]
    assert keys == sorted(keys)
    per = Counter()
    for r in rows:
        assert 0 <= r["copy"] < r["copies"]
        per[r["source"]] += len(r["text"] or "")
    assert set(per) <= {None, "hot", "s0", "s1"}
    assert mixing.mix(empty).count() == 0
    again = sorted(map(str, mixing.mix(docs.repartition(7), total=2.0).collect()))
    assert again == sorted(map(str, rows))


def test_mixing_meets_targets(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("source"), F.lit("0123456789").alias("text"))
    got = {r["source"]: r["n"] for r in mixing.mix(df, targets={"hot": 0.2, "b": 0.5, "c": 0.3}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, share in (("hot", 0.2), ("b", 0.5), ("c", 0.3)):
        assert abs(got[source] / 40_000 - share) < 0.01
    with pytest.raises(Exception, match="repetition rate too high"):
        mixing.mix(df, targets={"c": 1.0}, total=50.0, most=64).count()
    assert abs(mixing.mix(df, targets={"c": 1.0}, total=50.0).count() - 2_000_000) < 10_000
    kept = mixing.mixed(df.withColumns({"copies": F.lit(-7), "Copy": F.lit("x")}))
    assert kept.columns == ["doc_id", "source", "text", "copies", "Copy"]
    assert [tuple(r) for r in kept.select("copies", "Copy").distinct().collect()] == [(-7, "x")]


def test_mixing_serves_any_rate(spark):
    """Rare sources beside a large one: their counts have the mean and the variance of the Poisson distribution."""
    large = spark.range(40).select((F.col("id") + 10**6).alias("doc_id"), F.lit("large").alias("source"), F.repeat(F.lit("x"), 10**6).alias("text"))
    rare = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("rare").alias("source"), F.lit("0123456789").alias("text"))
    few = spark.createDataFrame([(-1, None, "abc")], "doc_id long, source string, text string")
    df = large.unionByName(rare).unionByName(few)
    rate = {r["source"]: r["rate"] for r in mixing.rates(df).collect()}
    assert rate["rare"] > mixing.TERMS / 4 and rate[None] > 2000
    counts = [r["n"] for r in mixing.mix(df).where("source = 'rare'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 200
    assert abs(np.mean(counts) - rate["rare"]) < 5 * (rate["rare"] / 200) ** 0.5
    assert 0.5 < np.var(counts) / rate["rare"] < 1.7
    assert abs(mixing.mix(df).where("source is null").count() - rate[None]) < 6 * rate[None] ** 0.5


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1, 20)] + [(None, 1, 0), (3, None, 0), (1001, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rated = quality.rate_documents(docs, model)
    assert rated.count() == len(ROWS)
    for r in rated.collect():
        assert 0 <= r["p_good"] <= r["p_acceptable"] <= 1
        assert abs(r["expected_grade"] - r["p_good"] - r["p_acceptable"]) < 1e-12
    kept = quality.select_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == rated.where("kept").count()
    assert quality.rate_documents(empty, model).count() == 0
    none = quality.train(empty, labels.limit(0))
    assert quality.rate_documents(docs, none).count() == len(ROWS)


def test_quality_sample_is_bounded_by_rows(spark):
    df = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).unionByName(spark.createDataFrame([(2, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows, grades = quality.sample(df, labels)
    assert len(rows) == 2 and grades.tolist() == [1, 2]
    assert [r.tolist() for r in quality.sample(df.repartition(5), labels)[0]] == [r.tolist() for r in rows]


def test_gradients_are_of_the_likelihood():
    """The fit of two thresholds and a few weights is where no small step makes the penalised likelihood better."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 6, 3)) for _ in range(600)]
    truth = np.array([1.5, -1.0, 0.5, 0.0, 2.0, -2.0])
    score = np.array([truth[r].sum() for r in rows]) + rng.logistic(size=600)
    grades = np.digitize(score, [-0.5, 1.0])
    model = quality.fit(rows, grades, rounds=4000)
    w = np.array([model.weights.get(k, 0.0) for k in range(6)])

    def loss(w, t):
        s = np.array([w[r].sum() for r in rows])
        over = 1 / (1 + np.exp(-(s[:, None] - t[None, :])))
        p = np.choose(grades, [1 - over[:, 0], over[:, 0] - over[:, 1], over[:, 1]])
        return -np.log(p).mean() + quality.PENALTY * np.abs(w).sum()

    best = loss(w, model.thresholds)
    for k in range(8):
        for step in (-0.02, 0.02):
            v, t = w.copy(), model.thresholds.copy()
            if k < 6:
                v[k] += step
            else:
                t[k - 6] += step
            assert loss(v, t) > best - 1e-6
    assert np.sign(w[[0, 1, 4, 5]]).tolist() == [1, -1, 1, -1]


def test_the_fit_settles():
    """More rounds change little, and neither does the order of documents, in which sums are made."""
    rng = np.random.default_rng(4)
    rows = [np.unique((rng.zipf(1.3, 300) % 5000).astype("<i4")) for _ in range(800)]
    grades = np.array([0 if 77 in r else 2 if 90 in r or 55 in r else 1 for r in rows])
    order = rng.permutation(800)
    a, b, c = quality.fit(rows, grades), quality.fit([rows[k] for k in order], grades[order]), quality.fit(rows, grades, rounds=2 * quality.ROUNDS)
    score = lambda m: np.array([sum(m.weights.get(int(k), 0.0) for k in r) for r in rows])
    assert np.abs(score(a) - score(b)).max() < 1e-6
    good = lambda m: quality.tails(score(m), m.thresholds)[:, 1] >= quality.KEEP
    assert (good(a) != good(c)).mean() < 0.02


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    test = labels.where("doc_id % 2 = 0")
    model = quality.train(d, labels.where("doc_id % 2 = 1"))
    got = quality.rate_documents(d, model).join(test, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {(r["quality"], r["toxic"]): r["kept"] for r in got}
    assert share[(1, 0)] > 0.975 and share[(1, 1)] < 0.1 and share[(0, 0)] < 0.1


def test_gradient():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 20)) for _ in range(400)]
    grades = np.array([0 if 7 in r else 2 if 9 in r else 1 for r in rows])
    model = quality.fit(rows, grades)
    assert model.weights[9] > 0 > model.weights[7] and model.thresholds[0] < model.thresholds[1]
