"""Counts of a text's characters and token runs, a batch of texts at a time.

The JVM's own expressions take a regular expression for each class of characters, and an interpreted step for each
character of an entropy; over code points as numbers all of them are table look-ups and histograms of a whole batch.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE, _LETTER, _ASCII_LETTER, _NUMBER, _DIGIT, _LATIN, _CJK, _CONTROL, _MARK, _KNOWN, _PUNCTUATION = (1 << k for k in range(11))
PUNCTUATION = ".,;:!?\"'()[]{}"

#: Fields of characters(): code points, symbols (neither letters, numbers nor space), ASCII marks, letters, ASCII letters,
#: letters and space, decimal digits, letters a-z after lower-casing, ideographs, control characters, punctuation, kinds, entropy.
CHARACTERS = ("n_len", "n_sym", "n_ascii_punct", "n_alpha", "n_ascii_alpha", "n_letspace", "n_digit", "n_latin", "n_cjk", "n_control", "n_punct", "n_char_kinds", "char_entropy_bits")
RUNS = ("token_entropy_bits", "n_bigrams", "n_trigrams")
#: Code points of a batch that are counted at once, and rows of it that are decoded at once: a batch may have 10,000 long texts.
STEP, ROWS = 2**20, 64


@cache
def _table() -> np.ndarray:
    """Flags of each code point, filled in when one is first met."""
    return np.zeros(sys.maxunicode + 1, dtype=np.uint16)


def _flags(point: int) -> int:
    c = chr(point)
    kind = unicodedata.category(c)
    out = _KNOWN
    if kind[0] == "Z" or c in " \t\n\x0b\f\r":
        out |= _SPACE
    if kind[0] == "L":
        out |= _LETTER
    if kind[0] == "N":
        out |= _NUMBER
    if kind == "Nd":
        out |= _DIGIT
    if point < 128:
        if c.isalpha():
            out |= _ASCII_LETTER
        elif 33 <= point < 127 and not c.isdigit():
            out |= _MARK
        elif point < 32 and c not in "\t\n\r":
            out |= _CONTROL
    if any("a" <= x <= "z" for x in c.lower()):
        out |= _LATIN
    if c in PUNCTUATION:
        out |= _PUNCTUATION
    if 0x4E00 <= point <= 0x9FFF:
        out |= _CJK
    return out


#: What each of the CHARACTERS between the first and the kinds counts: points with one of the flags; symbols are what has none of theirs.
_COUNTED = np.array([_LETTER | _NUMBER | _SPACE, _MARK, _LETTER, _ASCII_LETTER, _LETTER | _SPACE, _DIGIT, _LATIN, _CJK, _CONTROL, _PUNCTUATION], dtype=np.uint16)


def count_characters(texts: list[str]) -> dict[str, np.ndarray]:
    """CHARACTERS of each text: by its different code points and how often each stands in it."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _table()
    ends = np.cumsum(sizes)
    found, kinds, entropy = np.zeros((len(texts), len(_COUNTED)), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
        if b > a:
            one = points[a:b]
            if int(one.max()) < max(4096, 16 * (b - a)):
                c = np.bincount(one)
                at = np.flatnonzero(c)
                c = c[at]
            else:
                at, c = np.unique(one, return_counts=True)
            flags = table[at]
            if len(new := at[flags == 0]):
                table[new] = [_flags(int(p)) for p in new]
                flags = table[at]
            found[k] = c @ ((flags[:, None] & _COUNTED) != 0)
            kinds[k], entropy[k] = len(c), _entropy(c, b - a)
    found[:, 0] = sizes - found[:, 0]
    return {"n_len": sizes} | dict(zip(CHARACTERS[1:], found.T)) | {"n_char_kinds": kinds, "char_entropy_bits": entropy}


def _entropy(c: np.ndarray, n: int) -> float:
    c = np.sort(c)  # the sum must not depend on the order in which things were met
    return max(0.0, float(np.log2(n) - (c * np.log2(c)).sum() / n))


def count_runs(tokens: list[str]) -> tuple[float, int, int]:
    """RUNS of a text's tokens."""
    if not tokens:
        return 0.0, 0, 0
    c = np.fromiter(Counter(tokens).values(), dtype=np.float64)
    return _entropy(c, len(tokens)), len(set(zip(tokens, tokens[1:]))), len(set(zip(tokens, tokens[1:], tokens[2:])))


def _schema(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} {'double' if n.endswith('bits') else 'int'}" for n in names)


def _struct(found: dict[str, np.ndarray]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(v, type=pa.float64() if n.endswith("bits") else pa.int32()) for n, v in found.items()], names=list(found))


def _texts(batch: pa.Array) -> Iterator[str]:
    for k in range(0, len(batch), ROWS):
        yield from batch.slice(k, ROWS).to_pylist()


def _parts(batch: pa.Array) -> Iterator[list[str]]:
    """The batch's texts, up to STEP code points at a time."""
    size, part = 0, []
    for t in _texts(batch):
        part.append(t)
        size += len(t)
        if size >= STEP:
            yield part
            size, part = 0, []
    if part:
        yield part


def characters(x: Column) -> Column:
    """A struct of CHARACTERS of a text without nulls."""

    @F.arrow_udf(_schema(CHARACTERS))
    def run(texts: pa.Array) -> pa.Array:
        found = [count_characters(p) for p in _parts(texts)]
        return _struct({c: np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in CHARACTERS})

    return run(x)


def batch_runs(texts: pa.Array) -> np.ndarray:
    """RUNS of each text of a few, as rows; tokens are joined by spaces.

    Tokens become numbers, and a run of three in a text one number, as far as that fits; so runs are counted by sorting.
    """
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten()
    ids = words.dictionary_encode()
    kinds = len(ids.dictionary)
    if len(texts) * (kinds + 1) ** 3 >= 2**63:
        return np.array([count_runs(t.split(" ") if t else []) for t in texts.to_pylist()], dtype=np.float64).reshape(-1, len(RUNS))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(texts)), sizes)
    code = ids.indices.to_numpy().astype(np.int64)
    some = np.repeat(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0, sizes)  # an empty text is split into an empty token
    at, code = at[some], code[some]
    found, times = np.unique(at * kinds + code, return_counts=True)
    ends = np.searchsorted(found, np.arange(len(texts) + 1) * kinds)
    times, n = times.astype(np.float64), np.bincount(at, minlength=len(texts)).tolist()
    out = np.array([(_entropy(times[a:b], m) if m else 0.0, 0, 0) for a, b, m in zip(ends, ends[1:], n)]).reshape(-1, len(RUNS))
    two = (at * kinds + code)[:-1] * kinds + code[1:]
    three = two[:-1] * kinds + code[2:]
    for k, run in ((1, two[at[:-1] == at[1:]]), (2, three[at[:-2] == at[2:]])):
        run.sort()
        first = run[np.diff(run, prepend=-1) != 0]
        out[:, k] = np.bincount(first // kinds ** (k + 1), minlength=len(texts))
    return out


def runs(x: Column) -> Column:
    """A struct of RUNS of tokens that are joined by spaces."""

    @F.arrow_udf(_schema(RUNS))
    def run(texts: pa.Array) -> pa.Array:
        found = np.concatenate([np.zeros((0, len(RUNS))), *(batch_runs(texts.slice(k, ROWS)) for k in range(0, len(texts), ROWS))])
        return _struct(dict(zip(RUNS, found.T)))

    return run(x)
