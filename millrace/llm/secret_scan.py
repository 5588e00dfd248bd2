"""Secret scans: known forms, and password guess costs of values in credential contexts.

The forms (assignments, access keys, long hex strings) are patterns. Beside them a value that stands in a credential
context ("the passphrase is ...", "pwd: ...", "Authorization: Bearer ...") is a secret if it would be hard to guess: a
dynamic program finds its cheapest segmentation into dictionary words, dates, repeats, keyboard walks and brute-force
characters, costs being bits of guesses. An ordinary word after "password is" costs little and is left alone.

Whole texts are read, a row at a time within Arrow batches: no shuffle, and a text is the most that a task holds of one row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shown_id, table, whole_id
from .tokens import _ranks, default_path

#: Kinds in the order that breaks ties of spans with the same start.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, LEAST_ACCESS = re.compile(r"AKIA[A-Z0-9]+"), 20
HEX, LEAST_HEX = re.compile(r"[0-9a-f]{24,}"), 24
LEAST_ASSIGN = 6
#: Words that every match has, in lower case: texts without them are not searched.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_HINTS = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "credential", "key", "authori", "bearer", "login")

#: A credential's name, what joins it to a value, and the value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|(?:api|access|private|auth|secret|encryption)[\x20_-]?key|authorization|bearer|login)"""
    r"""["'`]?(?:\x20*(?:=>|->|:=|[:=])\x20*(?:bearer\x20+|basic\x20+)?|\x20+(?:is|was)\x20*:?\x20*|(?<=bearer)\x20+)["'`]?([^\s"'`<>,;|]{6,})""",
    re.IGNORECASE | re.ASCII,
)
#: What a sentence puts behind a value.
CLOSING = ".!?:)]}"

#: Guesses, in bits, from which a value in a credential context is a secret.
BITS = 40.0
#: Longest word, and longest block of a repeat, that the segmentation tries.
WORD, PERIOD = 24, 16
LEAST_WORD, LEAST_WALK = 3, 4

#: Rows of the keyboard without and with shift, how far each is set in, and look-alikes of letters.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
INSET = (0.0, 1.5, 1.75, 2.25)
LOOKALIKES = {"@": "a", "4": "a", "8": "b", "3": "e", "6": "g", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "2": "z"}

DATE = re.compile(r"(?:\d{4}([-/._]?)(?:0?[1-9]|1[0-2])\1(?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:19|20)\d\d)", re.ASCII)
YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)
DATE_BITS, YEAR_BITS = math.log2(366 * 200 * 4), math.log2(200)
#: What it takes to tell a segment that isn't brute force from others.
SEGMENT_BITS = math.log2(5)


@cache
def _keys() -> dict[str, tuple[int, float]]:
    return {c: (r, INSET[r] + k) for rows in (ROWS, SHIFTED) for r, row in enumerate(rows) for k, c in enumerate(row)}


@cache
def words(path: str) -> dict[str, int]:
    """Words of the vocabulary, with their place: frequent ones come first."""
    out: dict[str, int] = {}
    for token, _ in sorted(_ranks(path).items(), key=lambda kv: kv[1]):
        word = token.strip().lower()
        if LEAST_WORD <= len(word) <= WORD and word.isalpha() and word.isascii():
            out.setdefault(word.decode(), len(out) + 1)
    return out


def char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    return math.log2(26) + c.isupper() if c.isalpha() else math.log2(33)


def word_bits(rank: int, shown: str, lookalikes: int) -> float:
    """Place in the list, how letters are capitalised, and a bit for each look-alike."""
    upper = sum(c.isupper() for c in shown)
    letters = sum(c.isalpha() for c in shown)
    if not upper:
        case = 0.0
    elif upper == letters or upper == 1 and shown[0].isupper():
        case = 1.0
    else:
        case = math.log2(sum(math.comb(letters, k) for k in range(1, min(upper, letters - upper) + 1)) + 1)
    return math.log2(rank + 1) + case + lookalikes


def direction(a: str, b: str) -> tuple[int, int] | None:
    """How b lies to a on the keyboard, or None if it is no neighbour."""
    if a not in _keys() or b not in _keys():
        return None
    (r, x), (s, y) = _keys()[a], _keys()[b]
    if r == s:
        return (0, 1 if y > x else -1) if abs(x - y) == 1 else None
    return (s - r, 1 if y > x else -1) if abs(r - s) == 1 and abs(x - y) < 1 else None


def segments(value: str, path: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of all segments: a character, a word, a date, and from each place the longest repeats and walk."""
    n, low, vocabulary = len(value), value.lower(), words(path)
    low = low if len(low) == n else value
    plain = low.translate(str.maketrans(LOOKALIKES))
    same = [[0] * (n + 1) for _ in range(PERIOD + 1)]
    for p in range(1, min(PERIOD, n // 2) + 1):
        row = same[p]
        for i in range(n - p - 1, -1, -1):
            row[i] = row[i + 1] + 1 if value[i] == value[i + p] else 0
    ways = [direction(a, b) for a, b in zip(value, value[1:])]
    end, turns = [n] * n, [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        end[i] = end[i + 1] if ways[i] else i + 1
        turns[i] = turns[i + 1] + (ways[i] is not None and i + 1 < len(ways) and ways[i + 1] not in (None, ways[i])) if ways[i] else 0
    for i, c in enumerate(value):
        yield i, i + 1, char_bits(c)
        if plain[i].isalpha():
            for j in range(i + LEAST_WORD, min(n, i + WORD) + 1):
                if rank := vocabulary.get(plain[i:j]):
                    changed = sum(a != b for a, b in zip(plain[i:j], low[i:j]))
                    yield i, j, SEGMENT_BITS + word_bits(rank, value[i:j], changed)
        if c.isdigit():
            if m := DATE.match(value, i):
                yield i, m.end(), SEGMENT_BITS + DATE_BITS
            if YEAR.match(value, i):
                yield i, i + 4, SEGMENT_BITS + YEAR_BITS
        if end[i] - i >= LEAST_WALK:
            yield i, end[i], SEGMENT_BITS + math.log2(len(_keys())) + math.log2(end[i] - i) + 3 * turns[i]
        for p in range(1, min(PERIOD, n // 2) + 1):
            times = same[p][i] // p + 1
            if times > 1 and times * p > 2 and not (i and same[p][i - 1]):
                yield i, i + times * p, SEGMENT_BITS + _block_bits(value[i : i + p], path) + math.log2(times)


@lru_cache(4096)
def _block_bits(block: str, path: str) -> float:
    return guess_bits(block, path)


def guess_bits(value: str, path: str) -> float:
    """Bits of the cheapest segmentation of the value."""
    best = [0.0] + [math.inf] * len(value)
    for i, j, bits in segments(value, path):  # by start, so best[i] is settled
        if best[i] + bits < best[j]:
            best[j] = best[i] + bits
    return best[-1]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, sorted."""
    out = []
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, low: str, known: list[tuple[int, int, int]], path: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values in credential contexts that are hard to guess and in no known form."""
    if not any(h in low for h in CONTEXT_HINTS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        start, value = m.start(1), m[1].rstrip(CLOSING)
        end = start + len(value)
        if value and all(e <= start or s >= end for s, _, e in known) and guess_bits(value, path) >= BITS:
            out.append((start, 3, end))
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str, path: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Known forms of a text, and all spans; both by start, then kind, in code points."""
    low = text.lower()
    base = base_spans(text, low)
    return base, sorted(base + guessed_spans(text, low, base, path))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """A row for each row of df: id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    A null text is empty and has no spans. Null ids and repeated rows give rows like others, other columns don't matter, an
    empty table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"].array:
                base, spans = scan(text, path)
                kinds = [k for _, k, _ in spans]
                rows.append((*map(kinds.count, range(4)), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            found = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])
            found.insert(0, "id", batch["id"].to_numpy())
            yield found

    src = df.select(whole_id(F.col(id_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = src.mapInPandas(run, "id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
    return out.select(shown_id(F.col("id")).alias(id_col), *out.columns[1:])


def query(spark, sf_dir):
    """op11: secrets in all documents."""
    return secret_spans(table(spark, sf_dir, "documents"))
