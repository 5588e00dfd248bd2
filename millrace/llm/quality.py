"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 not toxic but of low quality, 2 good. One weight vector over hashed features of the text gives a
score s, and ordered thresholds cut it: P(grade > k) = sigmoid(s - t_k). That gives an expected grade, and tail
probabilities by which documents are selected. Features are present or not: words, their beginnings and the marks around
them, and binned shares (different words, capitals, repetition) of the whole text.

The model is fitted on a bounded sample of the labelled documents, those whose hashed ids are least; all that is collected
of them is their features. An L1 penalty leaves few weights other than 0, so the many words of a long text add no noise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shown_id, whole_id

#: Labelled documents to fit on, at most.
SAMPLE = 6000
DIM = 2**20
GRADES = 3
ROUNDS = 500
#: Higher rates don't settle: at 0.5 the loss swings, and where it ends hangs on the order of sums.
RATE = 0.2
PENALTY = 1e-3
#: Fewest sample documents with a feature.
LEAST = 12
#: A document is kept if it is good with at least this probability.
KEEP = 0.5

#: Tokens whose features a task remembers: some 20 MB.
CACHE = 1 << 17

_MARKS = frozenset("#$%&*+=<>@^_|~\\/!")
_WORD = re.compile(r"[^\W_]+")


class Model(NamedTuple):
    weights: dict[int, float]
    thresholds: np.ndarray


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIM


def _of_token(token: str) -> tuple[int, ...]:
    """Features of a token between white space: its word parts, their beginnings, and what is left without them."""
    folded = token.casefold()
    parts = _WORD.findall(folded)
    marks = _WORD.sub("w", folded)
    out = ["m" + marks[:8]]
    for p in parts:
        out += ["w" + p, "4" + p[:4], "5" + p[:5]]
    return tuple(_slot(x) for x in out)


def features(text: str, known: dict[str, tuple[int, ...]], wanted: dict[int, float] | None = None) -> set[int]:
    """Slots of the features of a whole text, those in wanted only where that is given.

    known is a cache over texts, for one wanted. An empty text has one feature.
    """
    tokens = text.split()
    out: set[int] = set()
    if not tokens:
        out.add(_slot("empty"))
        return out if wanted is None else out & wanted.keys()
    different = set(tokens)
    find = known.get
    for t in different:
        slots = find(t)
        if slots is None:
            slots = _of_token(t)
            if wanted is not None:
                slots = tuple(x for x in slots if x in wanted)
            if len(known) < CACHE and len(t) < 64:
                known[t] = slots
        if slots:
            out.update(slots)
    n, d = len(tokens), len(different)
    size = min(9, n.bit_length())
    again = sum(map(eq, tokens, tokens[1:]))
    shout = sum(map(str.isupper, different))
    marked = sum(t[-1] in _MARKS for t in different)
    for name, share in (("different", 10 * d // n), ("again", 10 * again // n), ("shout", 10 * shout // d), ("marked", 10 * marked // d)):
        out.add(_slot(f"share {name} {share}"))
        out.add(_slot(f"share {name} {share} {size}"))
    return out if wanted is None else out & wanted.keys()


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """The model of the rows of slots, by proximal gradients with a step of its own for each weight.

    Without rows every document is of the middle grade or better with probability one half.
    """
    t = np.array([-2.0, -1.0])
    if not rows:
        return Model({}, np.zeros(2))
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    slots, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count >= LEAST
    place = np.cumsum(often) - 1
    use = often[column]
    doc = np.repeat(np.arange(len(rows)), lengths)[use]
    column = place[column[use]]
    slots = slots[often]
    # entries by document and by column: sums of runs take a third of the time of sums by number
    by_column = np.argsort(column, kind="stable")
    of_document, of_column = column.astype(np.int32), doc[by_column].astype(np.int32)
    has, first = np.unique(doc, return_index=True)
    starts = np.searchsorted(column[by_column], np.arange(len(slots)))
    sums = lambda values, at: np.add.reduceat(values, at) if len(at) else np.zeros(0)
    n, w, sq, sq_t = len(rows), np.zeros(len(slots)), np.full(len(slots), 1e-8), np.full(2, 1e-8)
    for _ in range(rounds):
        s = np.zeros(n)
        s[has] = sums(w[of_document], first)
        low, high = (1 / (1 + np.exp(-np.clip(x - s, -30, 30))) for x in t)
        mid = np.maximum(high - low, 1e-9)
        by_s = np.choose(grades, [-(1 - low), low + high - 1, high])
        by_low = np.choose(grades, [1 - low, -low * (1 - low) / mid, 0 * s])
        by_high = np.choose(grades, [0 * s, high * (1 - high) / mid, -high])
        g = -sums(by_s[of_column], starts) / n
        g_t = -np.array([by_low.sum(), by_high.sum()]) / n
        sq += g * g
        sq_t += g_t * g_t
        step = rate / np.sqrt(sq)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        t = t - rate / np.sqrt(sq_t) * g_t
        t[1] = max(t[1], t[0] + 1e-3)
    kept = np.flatnonzero(w)
    return Model(dict(zip(slots[kept].tolist(), w[kept].tolist())), t)


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """Slots and grades of at most limit labelled documents of docs: those with the least hashed ids.

    Rows of labels with a null are left out; of several labels of a document the worst grade counts. Of several texts of an
    id one is used, that of the least hash, so no more than limit rows leave the executors. An empty table of either kind
    gives no rows.
    """
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    graded = labels.where("doc_id is not null and toxic is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    graded = graded.join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # limit rows
    texts = texts.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "grade", "t.text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            slots = [np.array(sorted(features(t, known)), dtype="<i4").tobytes() for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "grade": b["grade"], "slots": slots})

    got = texts.mapInPandas(run, "doc_id long, grade int, slots binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["slots"])))  # the fit must not depend on partitions
    return [np.frombuffer(r["slots"], dtype="<i4") for r in got], np.array([r["grade"] for r in got], dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, **how) -> Model:
    return fit(*sample(docs, labels, **how))


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k), a column for each threshold."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -60, 60)))


def _scores(texts: pd.Series, model: Model, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    # sorted: the sum must not depend on the order in a set
    return np.array([sum(model.weights[k] for k in sorted(features(t or "", known, model.weights))) for t in texts], dtype=float)


def rate_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """docs' (id, text) rows as (id, expected_grade, p_acceptable, p_good, kept).

    A null text is empty and rated like one; a null id stays null. Repeated rows are rated each; an empty table gives no
    rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            p = tails(_scores(b["text"], model, known), model.thresholds)
            yield pd.DataFrame({"id": b["id"], "expected_grade": p.sum(axis=1), "p_acceptable": p[:, 0], "p_good": p[:, 1], "kept": p[:, 1] >= keep})

    src = docs.select(whole_id(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInPandas(run, "id long, expected_grade double, p_acceptable double, p_good double, kept boolean")
    return out.select(shown_id(F.col("id")).alias(id_col), *out.columns[1:])


def select_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs that are kept, with their own columns: repeated rows and null ids like others, a null text as empty."""

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            yield pd.Series(tails(_scores(texts, model, known), model.thresholds)[:, 1] >= keep)

    return docs.where(good(F.col(text_col)))


def query(spark, sf_dir):
    """op6: grades of all documents, from a model of the labelled ones."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return rate_documents(docs, train(docs, table(spark, sf_dir, "labels")))
