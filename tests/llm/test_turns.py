"""Conversation repair against brute force: every sequence of edits, by cost and then by its string."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import duckdb
import pytest

from millrace.llm import turn_repair

SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, place int, edit string, sha string, choice string"


def damage(rows):
    """Damaged rows of each conversation, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        h = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        rows_of = out[conv]
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        rows_of += [(turn, role, text)] * (2 if h == 3 else 1)
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repaired(rows):
    """(cost, audit, repaired rows), the least of all."""
    fault = faults(rows)
    good = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserts):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserts < 2:  # two in a row are enough for any gap
            for role in ("user", "assistant"):
                if role[0] in good[last]:
                    c, a, r = best(i, role[0], inserts + 1)
                    found.append((c + 5, "I" + a, ((role, ""),) + r))
        if i < len(rows):
            c, a, r = best(i + 1, last, 0)
            found.append((c + 2, "D" + a, r))
            if fault[i] not in ("blank", "duplicate"):
                own = 5 if fault[i] == "truncated" else 0
                for edit, cost, role in (("K", 0, rows[i][1]), ("R", 1, "user"), ("R", 1, "assistant")):
                    if role[:1] and role[:1] in good[last]:
                        c, a, r = best(i + 1, role[:1], 0)
                        found.append((c + cost + own, edit + a, ((role, rows[i][2]),) + r))
        return min(found, default=(10**9, "", ()))

    for i in range(len(rows), 0, -1):  # from the end, so that nothing recurs deeply
        for last in good:
            best(i, last, 0)
    return best(0, "", 0)


def digest(rows):
    fault = faults(rows)
    cost, audit, kept = repaired(rows)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (gaps, *map(fault.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(seed, convs, most, roles=("user", "assistant", "system", "user", "assistant", None, "tool", "")):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t", None, "  done. \n", "Long " * 50 + ".", "é.", "a b"]
    out = []
    for c in convs:
        for t in range(rng.randint(1, most)):
            row = (c, None if rng.random() < 0.05 else t * (1 + (rng.random() < 0.1)), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}{rng.choice(['.', ''])}")
            out += [row] * (2 if rng.random() < 0.05 else 1)
    return out


def check(spark, rows, parts):
    df = spark.createDataFrame([(*r, 1, "e", "s", "c") for r in rows], SCHEMA).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair_digests(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = {c: digest(v) for c, v in damage(rows).items()}
    assert got == want


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_against_brute_force(spark, parts):
    check(spark, conversations(parts, [None, *range(60)], 12), parts)


def test_a_conversation_that_spans_all_ranges(spark):
    rows = [(5, t, r, x) for _, t, r, x in conversations(1, [0], 400, ("user", "assistant", "system"))]
    rows += [(5, 1000 + k, "user assistant".split()[k % 2], f"t{k}.") for k in range(300)] + [(6, 1, "user", "x."), (4, 2, "assistant", "y.")]
    check(spark, rows, 6)


def test_empty_and_dropped(spark):
    check(spark, [(c, t, "user", "hello.") for c in range(30) for t in range(1)], 3)
    assert turn_repair.repair_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turn_repair.query(spark, sf).collect()}
    assert got == {c: digest(v) for c, v in damage(rows).items()}


def test_the_edits_are_the_conversation(spark):
    """The operator's own result: rows that can be read back as conversations."""
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "What?"), (1, 2, "user", "Hm."), (1, 3, "tool", "x."), (2, 0, "system", "Be brief.")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    got = turn_repair.repair(df).orderBy("conv", "place", "step").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in got if r["conv"] == 1] == [("R", "user", "Hi."), ("R", "assistant", "What?"), ("K", "user", "Hm."), ("R", "assistant", "x.")]
    assert [(r["edit"], r["role"]) for r in got if r["conv"] == 2] == [("D", "system")]
