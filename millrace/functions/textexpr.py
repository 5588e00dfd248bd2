"""Text expressions, written once: Unicode word, line and character classes as Python's strings have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counts, formulas

# fixed values: patterns and word lists that scores depend on
WORD = r"[\p{L}\p{N}_]"
STOPWORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "is", "for", "with", "that", "this", "it"]
BOILERPLATE = ["copyright", "subscribe", "cookie", "terms of use", "privacy policy"]
RISK_TERMS = ["violence", "hate", "porn", "kill", "blood", "casino", "viagra"]
PUNCTUATION = counts.PUNCTUATION
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
EDGE = r"[\s\p{Z}]"
URL = r"(?i)https?://\S+|www\.\S+"
HTML = r"<[^>]+>"
URL_HTML = r"https?://\S+|<[^>]+>"
EMAIL = rf"[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+"
PHONE = r"\b(?:\+?\d[\d\-\s]{7,}\d)\b"
ID = r"\bID-\d{2}-\d{4}\b"
RISK_EMAIL = rf"[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}"
RISK_PHONE = r"\b(?:\+?\d[\d -]{7,}\d)\b"


def text(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def fold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Common elements of two arrays of different elements, as a share of all; of two empty ones 0."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)


def normalise(x: Column) -> Column:
    return F.trim(F.regexp_replace(fold(x), r"\s+", " "))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(x), F.lit(f"({WORD}+)"), F.lit(1))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def risk_terms(x: Column, kind: str = "padded") -> Column:
    """Occurrences of the risk terms: as words between spaces, as words without the last two terms, or anywhere in the text."""
    if kind not in ("padded", "short", "anywhere"):
        raise ValueError(f"unknown kind of risk: {kind}")
    low = fold(x) if kind == "anywhere" else F.concat(F.lit(" "), fold(x), F.lit(" "))
    terms = RISK_TERMS if kind == "padded" else RISK_TERMS[:5]
    shown = [t if kind == "anywhere" else f" {t} " for t in terms]
    return sum((((F.char_length(low) - F.char_length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int") for t in shown), F.lit(0))


def lines(x: Column) -> Column:
    # only a line with white space at an edge is stripped: looking for it at its end goes through all of it
    bare = lambda t: F.when(F.left(t, F.lit(1)).rlike(EDGE) | F.right(t, F.lit(1)).rlike(EDGE), strip(t)).otherwise(t)
    return F.filter(F.transform(F.split(x, r"\r\n|[\n\r\x0B\f\x85  ]"), bare), lambda t: t != "")


def without(x: Column, pattern: str) -> Column:
    """How many characters are left without those of the pattern."""
    return F.char_length(F.regexp_replace(x, pattern, ""))


def only(x: Column, cls: str) -> Column:
    """How many characters are of the class; cls is the inside of a bracket."""
    return without(x, f"[^{cls}]")


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def count_tokens(x: Column) -> Column:
    return count(x, rf"{WORD}+|[^\p{{L}}\p{{N}}_\s]")


def guarded(x: Column, pattern: str, needs: Column) -> Column:
    """count(), where the text has what every match needs; most texts don't, and looking for it is far cheaper."""
    return F.when(needs, count(x, pattern)).otherwise(F.lit(0))


def profile(df: DataFrame, entropies: bool = False) -> DataFrame:
    """df with the counts that scores are made of, with_entropies() if asked for. A null text is empty."""
    x = text()
    t = F.col("toks")
    w = F.col("folded_words")
    df = df.withColumns({"toks": tokens(x), "folded_words": words(fold(x)), "line_list": lines(x)})
    # both in one step: a task has one worker for them, and it is run once, not once for each field
    df = df.withColumns({"__c": counts.characters(x)} | ({"__t": counts.runs(F.concat_ws(" ", "toks"))} if entropies else {}))
    has = lambda *what: F.greatest(*[x.contains(w) for w in what], F.lit(False))
    digit, link = x.rlike("[0-9]"), F.greatest(fold(x).contains("http"), fold(x).contains("www."))
    padded = F.concat(F.lit(" "), fold(x), F.lit(" "))
    risk = sum(((F.char_length(padded) - F.char_length(F.replace(padded, F.lit(f" {term} "), F.lit("")))) / (len(term) + 2)).cast("int") for term in RISK_TERMS)
    return df.withColumns(
        {
            **{name: F.col(f"__c.{name}") for name in counts.CHARACTERS},
            **{name: F.col(f"__t.{name}") for name in counts.RUNS if entropies},
            "n_tok": F.size(t),
            "n_uniq": F.size(F.array_distinct(t)),
            "n_stop": F.size(F.filter(t, lambda v: v.isin(STOPWORDS))),
            "n_words": F.size(w),
            "n_uniq_words": F.size(F.array_distinct(w)),
            "n_lines": F.size("line_list"),
            "n_dup_lines": F.size("line_list") - F.size(F.array_distinct("line_list")),
            "n_url": guarded(x, URL, link),
            "n_html": guarded(x, HTML, has("<")),
            "n_email": guarded(x, RISK_EMAIL, has("@")),
            "n_phone": guarded(x, RISK_PHONE, digit),
            "q_email": guarded(x, EMAIL, has("@")),
            "q_phone": guarded(x, PHONE, digit),
            "q_id": guarded(x, ID, has("ID-")),
            "q_url_html": guarded(x, URL_HTML, has("http", "<")),
            "n_risk_terms": risk,
            "n_http": guarded(fold(x), "https?://", link),
        }
    ).drop("line_list", "folded_words", "__c", "__t")


def with_ratios(df: DataFrame) -> DataFrame:
    """A profile with formulas.RATIOS."""
    return df.withColumns({k: F.expr(formulas.spark(v)) for k, v in formulas.RATIOS.items()})


def with_entropies(df: DataFrame) -> DataFrame:
    """A profile with the entropy of its tokens in bits, and counts of different n-grams."""
    df = df.withColumn("__t", counts.runs(F.concat_ws(" ", "toks")))
    return df.withColumns({name: F.col(f"__t.{name}") for name in counts.RUNS}).drop("__t")


def with_formulas(df: DataFrame, named: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.expr(formulas.spark(v)) for k, v in named.items()})
