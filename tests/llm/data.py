"""A small table with everything that goes wrong: nulls, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, name string, kept boolean, part string, h string, h_extra string, copies long, shard int, template string"


def word(rng):
    return "".join(rng.choice("abcdefghilmnoprstuéß") for _ in range(rng.randint(2, 9)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def documents():
    rng = random.Random(7)
    passage = prose(rng, 60)
    base = prose(rng, 300)
    texts = [
        None, "", " \n\t ", "a", "A", "Hello World", "hello world", "HELLO\x00WORLD", "😀" * 40, "x" * 5000, "x" * 5000, base, base.upper(), base + " tail", "start " + base,
        passage, prose(rng, 40) + " " + passage + " " + prose(rng, 40), passage + "\n\n\n" + prose(rng, 30), prose(rng, 9000), "line\r\nline\nline\n", "<|endoftext|> ordinary", base.replace(" ", "  "), "é" * 60, "é" * 60,
    ]
    rows = [(k + 1, t) for k, t in enumerate(texts)]
    rows += [(None, None), (None, base), (None, "only here without an id"), (5, "A"), (12, base), (12, "other text of the same id " + passage), (-3, base), (2**62, passage)]
    rows += [(1000 + k, prose(rng, rng.randint(1, 80))) for k in range(30)]
    out = []
    for k, (i, t) in enumerate(rows):
        out.append((i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "hot" if k % 3 else f"s{k % 2}", None if k % 7 == 0 else len(t or ""), k, "n", k % 2 == 0, "p", "h", None, 5, 1, "t"))
    rng.shuffle(out)
    return out


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
