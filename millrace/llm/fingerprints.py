"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed from left to right into dictionary phrases: each phrase is the longest one seen before,
and one byte more. The phrases are hashed, and the smallest hashes of the set are its signature. Likeness is the share of
phrases that two sets have in common, as estimated from the signatures: exact where the sets are no larger than those.
Texts that would compress well with each other's dictionary are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shown_id, whole_id

#: Hashes in a signature.
KEPT = 128
#: Documents in a range, on average; the ranges are what is dealt out. Ranges, and tasks, at most.
RANGE = 500
MOST_RANGES, MOST_TASKS = 2**20, 32_768


class Parser:
    """A dictionary that grows as bytes are fed; a mark can be gone back to."""

    def __init__(self) -> None:
        self.next: dict[int, int] = {}
        self.hashes: list[int] = [0x9E3779B97F4A7C15]  # of the phrase at each node; the first is the empty one
        self.added: list[int] = []
        self.at = 0

    def feed(self, data: bytes) -> None:
        nodes, hashes, added, at = self.next, self.hashes, self.added, self.at
        find = nodes.get
        for byte in data:
            key = at << 8 | byte
            to = find(key)
            if to is None:
                nodes[key] = len(hashes)
                added.append(key)
                hashes.append((hashes[at] * 0x100000001B3 + byte + 1) & 0xFFFFFFFFFFFFFFFF)
                at = 0
            else:
                at = to
        self.at = at

    def mark(self) -> tuple[int, int]:
        return len(self.hashes), self.at

    def back(self, mark: tuple[int, int]) -> None:
        size, self.at = mark
        for key in self.added[size - 1 :]:
            del self.next[key]
        del self.added[size - 1 :], self.hashes[size:]

    def signature(self, kept: int = KEPT) -> np.ndarray:
        """The smallest hashes of the phrases, ascending, 32 bits of each."""
        h = np.array(self.hashes[1:], dtype=np.uint64)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h = (h >> np.uint64(32)).astype(np.uint32)
        if len(h) > 4 * kept:
            h = np.partition(h, 2 * kept)[: 2 * kept]
        return np.unique(h)[:kept]


def signature(text: str, kept: int = KEPT) -> np.ndarray:
    p = Parser()
    p.feed(text.encode())
    return p.signature(kept)


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Of the smallest hashes of both, the share that is in both; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:kept]
    return float(np.isin(union, np.intersect1d(a, b)).sum() / len(union))


def shown(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """(id, fingerprint) of each row; a null text is empty, and an empty text has an empty fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["fingerprint"] = [shown(signature(t, kept)) for t in b.pop("text")]
            yield b

    rows = df.select(whole_id(F.col(id_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "id long, fingerprint string").select(shown_id(F.col("id")).alias(id_col), "fingerprint")


def _places(cut_ids: np.ndarray, cut_hashes: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many cuts are not above each key, whether it is a cut). Cuts and keys are (id, hash), cuts in order."""
    lo, hi = np.searchsorted(cut_ids, ids, side="left"), np.searchsorted(cut_ids, ids, side="right")
    k, first = lo.copy(), np.zeros(len(ids), dtype=bool)
    for at in np.unique(lo[hi > lo]):  # ids that cuts have, each once
        rows = np.flatnonzero((lo == at) & (hi > lo))
        own = cut_hashes[at : hi[rows[0]]]
        n = np.searchsorted(own, hashes[rows], side="right")
        k[rows] = at + n
        first[rows] = (n > 0) & (own[np.maximum(n - 1, 0)] == hashes[rows])
    return k, first


def _dealt(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, extra, id, text): the rows dealt out by ranges of (id, hash of the text); each also has, as extra, the first row after it.

    Ranges begin with keys of the table that a hash picks, one in RANGE, so a row knows by its own key whether the range
    before needs it. Only those keys come to the driver, MOST_RANGES at most; a larger table has longer ranges, which are
    sorted and streamed, never held.
    """
    rows = df.select(whole_id(F.col(id_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = df.count()
    every = max(RANGE, -(-n // MOST_RANGES))
    key = F.struct("id", "h")
    found = rows.agg(F.min(key).alias("least"), F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("id", "h"), F.lit(every)) == 0, key))).alias("cuts"))
    got = found.select("least", F.col("cuts.id").alias("ids"), F.col("cuts.h").alias("hashes")).head()
    least = (got["least"]["id"], got["least"]["h"]) if got["least"] else None
    cuts = [(i, h) for i, h in zip(got["ids"] or [], got["hashes"] or []) if (i, h) != least]
    cut_ids, cut_hashes = np.array([i for i, _ in cuts], dtype=np.int64), np.array([h for _, h in cuts], dtype=np.int64)

    @F.pandas_udf("k int, first boolean")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, hashes in batches:
            k, first = _places(cut_ids, cut_hashes, ids.to_numpy(), hashes.to_numpy())
            yield pd.DataFrame({"k": k, "first": first})

    is_least = (F.col("id") == least[0]) & (F.col("h") == least[1]) if least else F.lit(False)
    before = F.when(is_least, F.lit(len(cuts))).when(F.col("at.first"), F.col("at.k") - 1)
    to = F.array(F.struct(F.col("at.k").alias("range"), F.lit(0).alias("extra")), F.struct(before.alias("range"), F.lit(1).alias("extra")))
    each = rows.withColumn("at", place("id", "h")).select(F.explode(F.filter(to, lambda x: x["range"].isNotNull())).alias("to"), "id", "h", "text")
    dealt = each.select("to.range", "to.extra", "id", "h", "text").repartition(min(len(cuts) + 1, MOST_TASKS), "range")
    return dealt.sortWithinPartitions("range", "extra", "id", "h", "text").drop("h")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4, kept: int = KEPT) -> DataFrame:
    """Each document compared with an edit of itself and with its successor.

    The successor is the next in order of (id, XXH64 of the text, text), of the last the first; the edit replaces the last 1/share of the
    code points by the successor's first. Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The unchanged part is parsed once for both texts. A null text is empty and a null id comes
    first; repeated rows follow each other; a single document is its own successor; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        def both(text: str, after: str) -> tuple:
            keep = len(text) - len(text) // share
            head, tail, new = text[:keep].encode(), text[keep:].encode(), after[: len(text) - keep].encode()
            p = Parser()
            p.feed(head)
            mark = p.mark()
            p.feed(tail)
            own = p.signature(kept)
            p.back(mark)
            p.feed(new)
            return own, p.signature(kept), hashlib.sha256(head + new).hexdigest()

        def rows() -> Iterator[tuple]:
            held: tuple | None = None  # (id, text), whose successor has not come yet
            waits: tuple | None = None  # (id, n, sha, own, edited), which waits for its successor's fingerprint
            now = -1
            for batch in batches:
                for k, extra, key, text in zip(batch["range"].array, batch["extra"].array, batch["id"].array, batch["text"].array):
                    if k != now:
                        now, held, waits, over = k, None, None, False
                    if over:
                        continue
                    if held is not None:
                        own, edited, sha = both(held[1], text)
                        if waits:
                            yield *waits, likeness(waits[3], own, kept)
                        waits = held[0], len(held[1]), sha, own, edited
                    held = key, text
                    if extra:
                        yield *waits, likeness(waits[3], signature(text, kept), kept)
                        over = True

        def framed(part: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(
                [(key, n, sha, shown(own), shown(edited), likeness(own, edited, kept), near) for key, n, sha, own, edited, near in part],
                columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        part: list[tuple] = []
        for row in rows():
            part.append(row)
            if len(part) == 1000:
                yield framed(part)
                part = []
        if part:
            yield framed(part)

    out = _dealt(df, id_col, text_col).mapInPandas(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(shown_id(F.col("id")).alias(id_col), *out.columns[1:])


def query(spark, sf_dir):
    """op1: fingerprints of all documents and of their edits."""
    from .common import table

    return with_next(table(spark, sf_dir, "documents"))
