"""Ways to count a text's tokens, by name. More are added by register()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import textexpr as X

COUNTERS: dict[str, Callable[[Column], Column]] = {
    "whitespace": lambda x: F.size(X.words(x)),
    "word": lambda x: F.size(X.tokens(x)),
    "word_mark": X.count_tokens,
    "characters": F.char_length,
    "bytes": F.octet_length,
}


def register(name: str, counter: Callable[[Column], Column]) -> None:
    """counter makes a column of numbers of a column of texts without nulls. A name that is taken is an error."""
    if name in COUNTERS:
        raise ValueError(f"the counter {name} is there already")
    COUNTERS[name] = counter


def count(x: Column, name: str) -> Column:
    """Tokens of a text, 0 of a null one."""
    if name not in COUNTERS:
        raise ValueError(f"unknown counter: {name}")
    return COUNTERS[name](F.coalesce(x, F.lit("")))
