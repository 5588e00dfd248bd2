"""Hot-key join: pairs against Spark's join, folds against brute force, the plan's balance and size."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import hot_join

CLICKS = "click_id long, client_id long, value double, side string, key string, cell int, copies int"
SALES = "sale_id long, client_id long, total double, side string, hot string, total_n int"


def moved(i, client):
    if i is None:
        return client
    h = zlib.crc32(str(i).encode())
    return h // 10 % 3 if h % 10 < 2 else client


def crc(i, x):
    import math

    cents = "" if x is None else math.floor(100.0 * x + 0.5)
    return zlib.crc32(f"{'' if i is None else i}:{cents}".encode())


def brute(clicks, sales):
    sides = {"click": clicks, "sale": sales}
    of = {s: defaultdict(list) for s in sides}
    for s, rows in sides.items():
        for i, c, x in rows:
            if (k := moved(i, c)) is not None:
                of[s][k].append(crc(i, x))
    out = {}
    for s, rows in sides.items():
        other = of["sale" if s == "click" else "click"]
        for i, c, x in rows:
            k = moved(i, c)
            p = other.get(k, []) if k is not None else []
            o = out.setdefault((s, i), [k, 0, 0, 0, 0, 0])
            o[0] = k if o[0] is None or k is not None and k < o[0] else o[0]
            for at, n in enumerate((1, len(p), max(1, len(p)) if s == "click" else len(p), max(1, len(p)), sum(p)), 1):
                o[at] += n
    return {k: tuple(v) for k, v in out.items()}


def table(seed, n, hot):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        client = None if rng.random() < 0.05 else 7 if rng.random() < hot else rng.randint(0, n)
        row = (i, client, None if rng.random() < 0.1 else rng.choice([-0.005, 0.0, 1.005, 12.34, -3.5, 1e7 / 3]))
        out += [row] * rng.choice([1, 1, 1, 1, 2, 3])
    return out


def digests(spark, clicks, sales):
    left = spark.createDataFrame([(*r, "s", "k", 1, 9) for r in clicks], CLICKS).repartition(3)
    right = spark.createDataFrame([(*r, "s", "h", 1) for r in sales], SALES).repartition(2)
    rows = hot_join.join_digests(left, right).collect()
    got = {(r["side"], r["id"]): (r["client_id"], r["copies"], r["inner_rows"], r["left_rows"], r["full_rows"], r["partner_crc"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("n,m", [(700, 400), (50, 900), (900, 3), (0, 40), (40, 0), (0, 0)])
def test_digests(spark, n, m):
    clicks, sales = table(1, n, 0.4), table(2, m, 0.4)
    assert digests(spark, clicks, sales) == brute(clicks, sales)


def test_ids_without_number_and_rows_that_differ(spark):
    clicks = [(None, 7, 1.0), (None, 7, 1.0), (None, 8, 2.0), (3, 7, 1.0), (3, 9, None), (3, None, 1.0), (4, None, None)] + table(5, 100, 0.3)[50:]
    sales = [(1, 7, 5.0), (2, 8, None), (2, 9, 1.0), (None, None, None)]
    assert digests(spark, clicks, sales) == brute(clicks, sales)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_pairs(spark, how):
    rng = random.Random(3)
    left = [(rng.choice([None, 1, 1, 1, 2, 3, 4, rng.randint(10, 60)]), k, "x" * rng.randint(0, 30)) for k in range(500)]
    right = [(rng.choice([None, 1, 1, 2, 7, rng.randint(10, 60)]), k, "y") for k in range(300)]
    a, b = spark.createDataFrame(left, "k long, id int, role string"), spark.createDataFrame(right, "k long, id int, cell string")
    columns = ["l.k lk", "l.id li", "l.role lr", "r.k rk", "r.id ri", "r.cell rc"]
    want = Counter(map(tuple, a.alias("l").join(b.alias("r"), a["k"] == b["k"], how).selectExpr(*columns).collect()))
    for bins, buffer in ((None, 1 << 20), (16, 64)):  # a buffer that holds nothing: all goes by disk
        assert Counter(map(tuple, hot_join.hot_join(a, b, "k", how, bins, buffer).selectExpr(*columns).collect())) == want


def test_texts_as_keys_and_empty_sides(spark):
    a = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    none = a.where("false")
    assert sorted(r["l"]["v"] for r in hot_join.hot_join(a, none, "k", "full").collect()) == [1, 2, 3, 4]
    assert hot_join.hot_join(none, a, "k", "inner").count() == 0
    assert hot_join.hot_join(a, a, "k").count() == 5


def test_longest_processing_time_first():
    rng = random.Random(1)
    work = {k: rng.expovariate(1) for k in range(400)}
    bins = hot_join.assign(work, 16)
    loads = Counter()
    for k, b in bins.items():
        loads[b] += work[k]
    assert max(loads.values()) <= (4 / 3 - 1 / 48) * max(sum(work.values()) / 16, max(work.values()))


def test_a_hot_key_is_spread_and_the_plan_is_small(spark, monkeypatch):
    plans, dealt = [], []
    made, was = hot_join.Plan.__init__, hot_join.Plan.dealt
    monkeypatch.setattr(hot_join.Plan, "__init__", lambda self, *a: (made(self, *a), plans.append(self))[0])
    monkeypatch.setattr(hot_join.Plan, "dealt", lambda self, rows, *o: (dealt.append(rows), was(self, rows, *o))[1])
    rows = spark.range(20000).selectExpr("cast(id % 2 as int) side", "id", "if(id % 3 = 0, 7L, id % 997) key", "id value", "1L copies")
    got = hot_join.partner_folds(rows)
    sizes = [r["count"] for r in got.groupBy(hot_join.F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20000 and max(sizes) < 1.5 * 20000 / 4
    assert len(plans[0].bins) <= 3 * plans[0].buckets and [h[0] for h in plans[0].hot] == [7]
    # a row goes to one cell; of the hot key only sums are copied
    assert dealt[0].count() <= 20000 + 2 * hot_join.STRIPS * len(plans[0].bins)
