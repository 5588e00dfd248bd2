"""Offset-mapped token counts.

A document is encoded whole, once: tokens are what a model will see, and encoding parts one by one would give others at
the seams. Each token's span, from the byte lengths of the vocabulary, is joined to the spans of the document's sections.
A token that crosses a boundary goes to the section that holds most of its bytes, of equals to the first; so the counts
of the sections add up to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shown_id, whole_id
from .tokens import byte_lengths, default_path, encode


def lines(text: str) -> list[int]:
    """Code points of each section of a text: its lines, each with its line break. An empty text has one, of none."""
    return [len(x) + 1 for x in text.split("\n")[:-1]] + [len(text) - text.rfind("\n") - 1] if text else [0]


def attribute(token_bytes: np.ndarray, section_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) of each section, from byte lengths in order. Both must add up to the same."""
    ends, bounds = np.cumsum(token_bytes), np.concatenate([[0], np.cumsum(section_bytes)])
    starts = ends - token_bytes
    # empty sections share their bounds with the next one, and get no tokens
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    owner = first.copy()
    for t in np.flatnonzero(first != last):
        k = np.arange(first[t], last[t] + 1)
        overlap = np.minimum(bounds[k + 1], ends[t]) - np.maximum(bounds[k], starts[t])
        owner[t] = k[int(overlap.argmax())]
    n = len(section_bytes)
    return np.bincount(owner, minlength=n), np.bincount(owner[first != last], minlength=n)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """A row for each line of each document: id, section (from 0), start and n_chars (code points), n_tokens, n_crossing.

    n_crossing: those of its tokens that reach into other sections. A null or empty text has one section without tokens;
    an empty line within a text has its line break. Repeated rows and null ids give rows like others; an empty table gives none.
    """
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = byte_lengths(path)
        for batch in batches:
            keys, parts = [], []
            for key, text in zip(batch["id"].array, batch["text"].array):
                chars = np.array(lines(text), dtype=np.int64)
                starts = np.cumsum(chars) - chars
                width = chars if text.isascii() else np.array([len(text[s : s + n].encode()) for s, n in zip(starts.tolist(), chars.tolist())], dtype=np.int64)
                tokens, crossing = attribute(sizes[np.array(encode(text, path), dtype=np.int64)], width)
                keys += [key] * len(chars)
                parts.append((np.arange(len(chars)), starts, chars, tokens, crossing))
            out = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0, dtype=np.int64)] * 5
            yield pd.DataFrame({"id": np.array(keys, dtype=np.int64)} | dict(zip(["section", "start", "n_chars", "n_tokens", "n_crossing"], out)))

    src = df.select(whole_id(F.col(id_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = src.mapInPandas(run, "id long, section int, start long, n_chars long, n_tokens long, n_crossing long")
    return out.select(shown_id(F.col("id")).alias(id_col), *out.columns[1:])


def query(spark, sf_dir):
    """op3: tokens of every line of all documents."""
    from .common import table

    return token_counts(table(spark, sf_dir, "documents"))
