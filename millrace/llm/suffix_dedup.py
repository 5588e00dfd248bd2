"""Substring dedup across documents by merged Burrows-Wheeler transforms.

A byte is removed if a string of 50 bytes that covers it also starts in a document with a smaller id. To compare all
strings of 50 bytes on many machines, each is dealt out by its anchor, the 20 bytes in it with the least hash: equal
strings have equal anchors. Strings in a row with the same anchor make a fragment.

1. Documents are dealt to shards once, in a table bucketed by shard, so that later steps read them without a shuffle.
2. Each shard sends the hashes of its anchors; buckets of hashes tell which are in several documents.
3. Each shard sends the fragments with such anchors: equal ones of a shard once, with the least document. Copies
   of those within the shard are settled at once.
4. Each bucket takes equal fragments together, and of anchors with several different fragments merges the transforms of
   their text: an interval whose suffixes agree in 50 bytes is a repeat, and all but its least document lose it.
5. Each shard removes the spans from its documents.

An anchor that very many shards have is hot: its strings are dealt out by the next two least hashes in them as well, as
equal strings share those too. So neither the text of a shard, nor a bucket, nor anything sent grows with the corpus but in
number. Hashes only choose candidates: what is removed agrees byte for byte.

A shard sends a row to each bucket that it has an anchor for, so the rows of steps 2 and 3 grow with the square of the corpus
up to where buckets are as many as a shard's anchors, some 270,000 or 4 TB, and in proportion from there on.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeats
from .common import dropped, saved, shared_dir, shown_id, whole_id

DEPTH = 50
ANCHOR = 20
#: Bytes of documents for each shard, and for each bucket of hashes.
SHARD = 16 * 2**20
KEY_BITS = 40
#: Shards with an anchor from which on it is hot: its strings are dealt out by the next two least hashes in them as well.
HOT = 1024


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size bytes from each place on: of runs of doubling length, put together."""
    run, have, out = data.astype(np.uint64) + np.uint64(1), 1, None
    done, rest = 0, size
    while True:
        if rest & 1:
            if out is None:
                out, done = run, have
            else:
                n = min(len(out), len(run) - done)
                out = out[:n] * np.uint64(0x9E3779B97F4A7C15) + run[done : done + n]
                done += have
        rest >>= 1
        if not rest:
            break
        run = run[:-have] * np.uint64((0xD6E8FEB86659FD93 + 2 * have) | 1) + run[have:]
        have *= 2
    out = out ^ (out >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of width numbers from each place on."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return h if have == width else np.minimum(h[: len(h) - (width - have)], h[width - have :])


class Shard:
    """Documents of a shard in the order of (id, text), and the fragments of each."""

    def __init__(self, ids: np.ndarray, texts: list[str]) -> None:
        raw = [t.encode() for t in texts]
        order = sorted(range(len(raw)), key=lambda k: (ids[k], raw[k]))
        self.ids = np.asarray(ids, dtype=np.int64)[order]
        self.raw = [raw[k] for k in order]

    def fragments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first string, end of strings, anchor) of each fragment, by place in the shard."""
        found: list[tuple[np.ndarray, ...]] = []
        part: list[int] = []
        size = 0
        for k in range(len(self.raw) + 1):
            if part and (k == len(self.raw) or size > 2**17):
                found.append(self._fragments(part))
                part, size = [], 0
            if k < len(self.raw) and len(self.raw[k]) >= DEPTH:
                part.append(k)
                size += len(self.raw[k])
        if not found:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        return tuple(np.concatenate(c) for c in zip(*found))

    def _fragments(self, part: list[int]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(self.raw[k]) for k in part])
        ends = np.cumsum(sizes)
        least = _least(_hashes(np.frombuffer(b"".join([self.raw[k] for k in part]), dtype=np.uint8), ANCHOR), DEPTH - ANCHOR + 1)
        new = np.empty(len(least), dtype=bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        cut = np.concatenate([ends - sizes, ends - DEPTH + 1])
        new[cut[cut < len(least)]] = True  # strings that reach over a document's end are none
        first = np.flatnonzero(new)
        end = np.concatenate([first[1:], [len(least)]])
        doc = np.searchsorted(ends, first, side="right")
        ok = first + DEPTH <= ends[doc]
        first, end, doc = first[ok], end[ok], doc[ok]
        base = (ends - sizes)[doc]
        return np.array(part, dtype=np.int64)[doc], first - base, end - base, least[first]


def _keys(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 bits of the hash, in one number."""
    return (anchor >> np.uint64(KEY_BITS)) % np.uint64(buckets) << np.uint64(KEY_BITS) | anchor & np.uint64(2**KEY_BITS - 1)


def _next_least(h: np.ndarray, least: np.uint64) -> np.ndarray:
    """A number for each string, made of the two least hashes in it but for least; h: hashes of all ANCHOR bytes of its run."""
    top = np.uint64(2**64 - 1)
    one = np.where(h == least, top, h)
    rows = np.lib.stride_tricks.sliding_window_view(one, DEPTH - ANCHOR + 1)
    first = rows.min(axis=1)
    second = np.where(rows == first[:, None], top, rows).min(axis=1)
    out = (first * np.uint64(0x9E3779B97F4A7C15) ^ second) * np.uint64(0xD6E8FEB86659FD93) + least
    return out ^ (out >> np.uint64(32))


def _split(shard: Shard, fragments: tuple[np.ndarray, ...], hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """The fragments, those that are hot cut where their strings' next least hashes change, which become their anchors."""
    doc, first, end, anchor = fragments
    parts = [tuple(x[~hot] for x in fragments)]
    for d, a, b, least in zip(doc[hot].tolist(), first[hot].tolist(), end[hot].tolist(), anchor[hot]):
        h = _hashes(np.frombuffer(shard.raw[d][a : b + DEPTH - 1], dtype=np.uint8), ANCHOR)
        own = _next_least(h, least)
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        parts.append((np.full(len(cut), d), a + cut, a + np.concatenate([cut[1:], [len(own)]]), own[cut]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // KEY_BITS, 8), dtype=np.uint8)
    out[:, : KEY_BITS // 8] = np.frombuffer(data, dtype=np.uint8).reshape(-1, KEY_BITS // 8)
    return out.view("<u8").ravel()


def _by_bucket(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of sorted keys with the same bucket."""
    bucket = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(keys)]):
        yield int(bucket[a]), slice(a, b)


def _shard(group: pd.DataFrame) -> Shard:
    return Shard(group["id"].to_numpy(), group["text"].tolist())


def _anchors(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Each bucket's keys of the shard: those of a single document, and those of several."""
    shard = _shard(group)
    doc, _, _, anchor = shard.fragments()
    key, who = _keys(anchor, buckets), shard.ids[doc]
    order = np.argsort(key)
    key, who = key[order], who[order]
    rows = []
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        key = key[first]
        rows = [(b, int(group["shard"].iloc[0]), _packed(key[s][~several[s]]), _packed(key[s][several[s]])) for b, s in _by_bucket(key)]
    return pd.DataFrame(rows, columns=["bucket", "shard", "single", "several"])


def _shared(group: pd.DataFrame, least: int) -> pd.DataFrame:
    """Of a bucket's keys those that are in several documents, for each shard that has them, and which of these at least so many shards have."""
    mine = [np.concatenate([_unpacked(x), _unpacked(y)]) for x, y in zip(group["single"], group["several"])]
    keys, ends = np.concatenate(mine), np.cumsum([len(m) for m in mine])
    ordered = np.sort(np.concatenate([keys, *[_unpacked(y) for y in group["several"]]]))  # twice is several
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return pd.DataFrame([], columns=["shard", "bucket", "keys", "hot"])
    found, shards = np.unique(keys, return_counts=True)  # a shard has a key once
    hot = found[shards >= least]
    use = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
    rows = []
    for shard, end, m in zip(group["shard"], ends, mine):
        if (part := m[use[end - len(m) : end]]).size:
            rows.append((shard, int(group["bucket"].iloc[0]), _packed(part), _packed(np.intersect1d(part, hot))))
    return pd.DataFrame(rows, columns=["shard", "bucket", "keys", "hot"])


def _z(data: bytes) -> bytes:
    """Compressed: shuffles only look for repeats, and this has few; it also counts how often bytes come."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unz(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


_SENT = "kind int, bucket int, shard int, ids binary, refs binary, starts binary, sizes binary, anchors binary, text binary"


def _sent(group: pd.DataFrame, keys: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Fragments with shared anchors for each bucket (kind 0), and spans that the shard settles itself (kind 1), by any bucket."""
    rows: list[tuple] = []
    cols = [c.split()[0] for c in _SENT.split(", ")]
    if not len(group) or not len(keys):
        return pd.DataFrame(rows, columns=cols)
    shard, number = _shard(group), int(group["shard"].iloc[0])
    fragments = shard.fragments()
    whole = lambda col: np.sort(np.concatenate([_unpacked(x) | np.uint64(b << KEY_BITS) for b, x in zip(keys["bucket"], keys[col])]))
    key = _keys(fragments[3], buckets)
    use = np.isin(key, whole("keys"))
    fragments = tuple(x[use] for x in fragments)
    if len(hot := whole("hot")):
        fragments = _split(shard, fragments, np.isin(key[use], hot))
    doc, first, end, anchor = fragments
    key = _keys(anchor, buckets)
    order = np.lexsort((first, doc, key))
    # documents come in the order of ids within a key, so the first one to bring a fragment has the least id
    place: dict[bytes, int] = {}
    texts: list[bytes] = []
    ids: list[int] = []
    found: list[int] = []
    refs: list[tuple[int, int, int]] = []
    settled: list[tuple[int, int, int]] = []
    for k, d, s, e in zip(key[order].tolist(), doc[order].tolist(), first[order].tolist(), end[order].tolist()):
        text = shard.raw[d][s : e + DEPTH - 1]
        at = place.get(text)
        if at is None:
            at = place[text] = len(texts)
            texts.append(text)
            ids.append(int(shard.ids[d]))
            found.append(k)
            refs.append((at, d, s))
        elif ids[at] == shard.ids[d]:
            refs.append((at, d, s))
        else:
            settled.append((d, s, e + DEPTH - 1))
    by_key, by_ref = np.array(found, dtype=np.uint64), np.array(refs, dtype=np.int64).reshape(-1, 3)
    by_ref = by_ref[np.argsort(by_ref[:, 0], kind="stable")]
    for b, run in _by_bucket(by_key):
        lo, hi = np.searchsorted(by_ref[:, 0], [run.start, run.stop])
        ref = by_ref[lo:hi]
        rows.append(
            (
                0, b, number,
                _z(np.array(ids[run], dtype="<i8").tobytes()),
                _z(np.stack([ref[:, 0] - run.start, ref[:, 1]]).astype("<i4").tobytes()),
                _z(ref[:, 2].astype("<i8").tobytes()),
                _z(np.array([len(t) for t in texts[run]], dtype="<i8").tobytes()),
                _packed(by_key[run]),
                _z(b"".join(texts[run])),
            )
        )
    if settled:
        spans = np.array(settled, dtype="<i8")
        rows.append((1, number % buckets, number, None, spans[:, 0].astype("<i4").tobytes(), spans[:, 1:].tobytes(), None, None, None))
    return pd.DataFrame(rows, columns=cols)


def _resolved(group: pd.DataFrame) -> pd.DataFrame:
    """Spans, for each shard, that a bucket's fragments lose, and those that shards have settled, as they are."""
    settled = group[group["kind"] == 1][["shard", "refs", "starts"]].set_axis(["shard", "docs", "spans"], axis=1)
    group = group[group["kind"] == 0]
    if not len(group):
        return settled
    place: dict[bytes, int] = {}
    texts: list[bytes] = []
    entry_text, entry_id, entry_shard, ref_entry, ref_doc, ref_start, keys = ([] for _ in range(7))
    entries = 0
    for row in group.itertuples():
        sizes = np.frombuffer(_unz(row.sizes), dtype="<i8")
        ends = np.cumsum(sizes).tolist()
        joined = _unz(row.text)
        for a, b in zip([0, *ends], ends):
            text = joined[a:b]
            at = place.get(text)
            if at is None:
                at = place[text] = len(texts)
                texts.append(text)
            entry_text.append(at)
        entry_id.append(np.frombuffer(_unz(row.ids), dtype="<i8"))
        keys.append(_unpacked(row.anchors))
        entry_shard.append(np.full(len(sizes), row.shard))
        ref = np.frombuffer(_unz(row.refs), dtype="<i4").reshape(2, -1)
        ref_entry.append(ref[0].astype(np.int64) + entries)
        ref_doc.append(ref[1])
        ref_start.append(np.frombuffer(_unz(row.starts), dtype="<i8"))
        entries += len(sizes)
    text_of, owner, shard, key = np.array(entry_text), np.concatenate(entry_id), np.concatenate(entry_shard), np.concatenate(keys)
    entry, doc, start = np.concatenate(ref_entry), np.concatenate(ref_doc), np.concatenate(ref_start)
    size = np.array([len(t) for t in texts])
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, text_of, owner)
    # the same text as in a lesser document: all of it goes
    gone = (owner > least[text_of])[entry]
    out = [(shard[entry[gone]], doc[gone], start[gone], start[gone] + size[text_of[entry[gone]]])]
    # several texts of an anchor: what they have in common
    text_key = np.empty(len(texts), dtype=np.uint64)
    text_key[text_of] = key
    _, kind, count = np.unique(text_key, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(count[kind] > 1)
    if len(chosen):
        which, at, interval = repeats([texts[k] for k in chosen], DEPTH)
        which = chosen[which]
        first = np.flatnonzero(np.diff(interval, prepend=-1))
        lowest = np.repeat(np.minimum.reduceat(least[which], first), np.diff([*first, len(which)]))
        lost = least[which] > lowest
        which, at = which[lost], at[lost]
        order = np.lexsort((at, which))
        which, at = which[order], at[order]
        if len(which):
            cut = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)]))
            stop = np.concatenate([cut[1:], [len(which)]]) - 1
            run_text, run_a, run_b = which[cut], at[cut], at[stop] + DEPTH
            kept = np.flatnonzero(~gone)
            kept = kept[np.argsort(text_of[entry[kept]], kind="stable")]
            ref_text = text_of[entry[kept]]
            lo, hi = np.searchsorted(ref_text, run_text, side="left"), np.searchsorted(ref_text, run_text, side="right")
            run = np.repeat(np.arange(len(run_text)), hi - lo)
            ref = kept[np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[run]]
            out.append((shard[entry[ref]], doc[ref], start[ref] + run_a[run], start[ref] + run_b[run]))
    shard, doc, a, b = (np.concatenate(c) for c in zip(*out))
    order = np.argsort(shard, kind="stable")
    shard, doc, a, b = shard[order], doc[order], a[order], b[order]
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    rows = [(int(shard[i]), doc[i:j].astype("<i4").tobytes(), np.stack([a[i:j], b[i:j]], axis=1).astype("<i8").tobytes()) for i, j in zip(cut, [*cut[1:], len(shard)])]
    return pd.concat([settled, pd.DataFrame(rows, columns=["shard", "docs", "spans"])], ignore_index=True)


def _removed(group: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """Each document's removed runs and what is left."""
    shard = _shard(group)
    doc, at = np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
    if len(spans):
        doc = np.concatenate([np.frombuffer(x, dtype="<i4") for x in spans["docs"]]).astype(np.int64)
        at = np.concatenate([np.frombuffer(x, dtype="<i8").reshape(-1, 2) for x in spans["spans"]])
    order = np.lexsort((at[:, 0], doc))
    doc, at = doc[order], at[order]
    lo, hi = np.searchsorted(doc, np.arange(len(shard.raw))), np.searchsorted(doc, np.arange(len(shard.raw)), side="right")
    rows = []
    for k, raw in enumerate(shard.raw):
        runs: list[list[int]] = []
        for a, b in at[lo[k] : hi[k]].tolist():
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        left = hashlib.sha256()
        done = 0
        for a, b in runs:
            left.update(raw[done:a])
            done = b
        left.update(raw[done:])
        rows.append((int(shard.ids[k]), len(raw), sum(b - a for a, b in runs), len(runs), left.hexdigest(), [x for r in runs for x in r]))
    return pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row of df, written.

    spans are the removed runs in bytes of UTF-8: first, end, first, end, ... A null text is empty. A null id is less
    than any other; rows with equal ids don't remove each other's bytes. Repeated rows get the same result each. An empty
    table gives no rows.
    """
    spark, hot = df.sparkSession, HOT
    rows = df.select(whole_id(F.col(id_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = int(total) // SHARD + 1  # of files of the table, and of buckets of hashes
    name = f"millrace_shards_{uuid.uuid4().hex}"
    # by text too, as any number of rows may share an id, or have none
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(4 * n)).cast("int"))
    dealt.repartition(n, "shard").write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, "shard").sortBy("shard").saveAsTable(name)
    shards = spark.table(name)

    anchors = shards.groupBy("shard").applyInPandas(lambda g: _anchors(g, n), "bucket int, shard int, single binary, several binary")
    # a partition for each bucket, so that a task's share doesn't grow with the corpus
    shared = anchors.repartitionById(n, F.col("bucket")).groupBy("bucket").applyInPandas(lambda g: _shared(g, hot), "shard int, bucket int, keys binary, hot binary").repartition(n, "shard")
    sent = shards.groupBy("shard").cogroup(shared.groupBy("shard")).applyInPandas(lambda g, k: _sent(g, k, n), _SENT)
    spans = sent.repartitionById(n, F.col("bucket")).groupBy("bucket").applyInPandas(_resolved, "shard int, docs binary, spans binary")
    out = shards.groupBy("shard").cogroup(spans.repartition(n, "shard").groupBy("shard")).applyInPandas(_removed, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    out = saved(out, "removed")
    spark.sql(f"DROP TABLE {name}")
    dropped(spark, f"{shared_dir(spark)}/{name}")
    return out.select(shown_id(F.col("id")).alias(id_col), *out.columns[1:])


def query(spark, sf_dir):
    """op9: repeated passages of all documents removed."""
    from .common import table

    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, {2 * DEPTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, n - {DEPTH - 1})) AS p FROM d)
), m AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s HAVING count(*) > 1
), c AS (
  SELECT doc_id, p, p - max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap
  FROM w JOIN m USING (s) WHERE doc_id > lo
), r AS (
  SELECT doc_id, p, sum(CASE WHEN gap <= {DEPTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c
), x AS (SELECT doc_id, run, min(p) AS a, max(p) + {DEPTH} AS b FROM r GROUP BY doc_id, run
), k AS (
  SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev, b FROM x
), g AS (
  SELECT k.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head, max(k.b) AS done, sum(k.b - a)::BIGINT AS n_removed, count(*) AS n_spans
  FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(done, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
