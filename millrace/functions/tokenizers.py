"""Learned tokenizers of the reference kind: byte-pair merges and characters. Counting is distributed, merging is not."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import saved
from . import textexpr as X


def bpe_merges(df: DataFrame, merges: int, at_once: int = 2_000_000, every: int = 50) -> list[tuple[bytes, bytes]]:
    """The merges, each of the most frequent pair of neighbours over all words, of equally frequent ones the least.

    Up to at_once different words are merged on the driver. More stay in a table: each merge counts the pairs of all words
    in one aggregation, and every so many merges the words are written as far as they are merged.
    """
    counts = saved(df.select(F.explode(X.words(X.text())).alias("w")).groupBy("w").agg(F.count("*").alias("c")), "words")
    if counts.count() > at_once:
        return _merges_of_a_table(counts, merges, every)
    words = [([bytes([b]) for b in r["w"].encode()], r["c"]) for r in counts.collect()]
    out = []
    for _ in range(merges):
        pairs: Counter = Counter()
        for parts, c in words:
            for p in zip(parts, parts[1:]):
                pairs[p] += c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        for parts, _c in words:
            _join(parts, best)
    return out


def _join(parts: list[bytes], pair: tuple[bytes, bytes]) -> None:
    k = 0
    while k < len(parts) - 1:
        if (parts[k], parts[k + 1]) == pair:
            parts[k : k + 2] = [pair[0] + pair[1]]
        k += 1


def _merges_of_a_table(counts: DataFrame, merges: int, every: int) -> list[tuple[bytes, bytes]]:
    """As on the driver, over words of any number: (parts, c), parts as hexadecimal strings with points between."""
    words = counts.select(F.regexp_replace(F.lower(F.hex(F.encode("w", "UTF-8"))), "(..)(?!$)", "$1.").alias("parts"), "c")
    out: list[tuple[bytes, bytes]] = []

    def merged(done: list[tuple[bytes, bytes]], text: str) -> list[bytes]:
        parts = [bytes.fromhex(p) for p in text.split(".")]
        for pair in done:
            _join(parts, pair)
        return parts

    def counted(done: list[tuple[bytes, bytes]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pairs: Counter = Counter()
            for b in batches:
                for text, c in zip(b["parts"], b["c"]):
                    parts = merged(done, text)
                    for p, q in zip(parts, parts[1:]):
                        pairs[p.hex(), q.hex()] += c
            yield pd.DataFrame([(p, q, n) for (p, q), n in pairs.items()], columns=["p", "q", "n"]).astype({"n": "int64"})

        return run

    def written(done: list[tuple[bytes, bytes]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(parts=[".".join(p.hex() for p in merged(done, t)) for t in b["parts"]])

        return run

    now: list[tuple[bytes, bytes]] = []  # since the words were written
    while len(out) < merges:
        best = words.mapInPandas(counted(list(now)), "p string, q string, n long").groupBy("p", "q").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p", "q").head()
        if best is None:
            break
        now.append((bytes.fromhex(best["p"]), bytes.fromhex(best["q"])))
        out.append(now[-1])
        if len(now) >= every:
            words = saved(words.mapInPandas(written(list(now)), "parts string, c long"), "words")
            now = []
    return out


def bpe_split(word: str, rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    parts = [bytes([b]) for b in word.encode()]
    while len(parts) > 1:
        k = min(range(len(parts) - 1), key=lambda i: (rank.get((parts[i], parts[i + 1]), len(rank)), i))
        if (parts[k], parts[k + 1]) not in rank:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def bpe_encode(df: DataFrame, merges: list[tuple[bytes, bytes]]) -> DataFrame:
    """(doc_id, pieces): each white-space word's pieces as hexadecimal strings."""
    rank = {p: k for k, p in enumerate(merges)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for b in batches:
            rows = []
            for t in b["text"]:
                out: list[str] = []
                for w in (t or "").split():
                    if w not in known:
                        if len(known) > 500_000:
                            known.clear()
                        known[w] = [p.hex() for p in bpe_split(w, rank)]
                    out += known[w]
                rows.append(out)
            yield pd.DataFrame({"doc_id": b["doc_id"], "pieces": rows})

    return df.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(df.dtypes)['doc_id']}, pieces array<string>")


def bpe_decode(pieces: Column) -> Column:
    """The text of pieces: the words of bpe_encode() one after the other, without what was between them."""
    return F.decode(F.unhex(F.array_join(pieces, "")), "UTF-8")


def bpe_merges_by_first(df: DataFrame, merges: int) -> list[tuple[str, str]]:
    """The older merges, over characters of words: of equally frequent pairs the first to occur in documents by id."""
    first = df.select("doc_id", F.posexplode(X.words(X.text())).alias("at", "w")).groupBy("w").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "at")).alias("f"))
    words = [(list(r["w"]), r["c"]) for r in first.orderBy("f").collect()]
    out = []
    for _ in range(merges):
        pairs: dict[tuple[str, str], int] = {}
        for parts, c in words:
            for p in zip(parts, parts[1:]):
                pairs[p] = pairs.get(p, 0) + c
        if not pairs:
            break
        best = max(pairs, key=pairs.get)  # of equals the first that was met
        out.append(best)
        for parts, _c in words:
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == best:
                    parts[k : k + 2] = [best[0] + best[1]]
                k += 1
    return out


def characters(df: DataFrame) -> list[str]:
    """The characters of the corpus in order: a vocabulary no larger than Unicode."""
    chars = df.select(F.explode(F.array_distinct(F.split(X.text(), ""))).alias("c")).distinct()
    return sorted(r["c"] for r in chars.collect() if r["c"])


def character_ids(x: Column, vocabulary: list[str]) -> Column:
    """Places in the vocabulary of a text's characters; unknown ones are left out."""
    places = F.map_from_arrays(F.array(*[F.lit(c) for c in vocabulary]), F.array(*[F.lit(k) for k in range(len(vocabulary))]))
    return F.filter(F.transform(F.split(x, ""), lambda c: F.try_element_at(places, c)), lambda k: k.isNotNull())
