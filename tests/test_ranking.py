"""The k-th row, first fit and rebalancing against plain Python, at sizes that take several rounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranking, select


def rows(seed, n, spread):
    rng = random.Random(seed)
    score = lambda: rng.choice([None, float("nan"), float("inf"), -0.5]) if rng.random() < 0.05 else round(rng.random() * spread) / spread
    return [(k, score(), rng.choice("abc") + str(k) if rng.random() < 0.97 else None) for k in range(n)]


def place(row):
    k, score, name = row
    down = (1, 0.0) if score is None else (0, -math.inf) if math.isnan(score) else (0, 0.5 - math.inf if score == math.inf else -score)
    down = (0, -1e300) if score == math.inf else down
    return down, (name is not None, name or ""), k


ORDER = [("score", True), ("name", False), ("id", False)]


@pytest.mark.parametrize("spread", [1, 7, 10**6])
def test_kth(spark, monkeypatch, spread):
    monkeypatch.setattr(ranking, "SMALL", 300)
    monkeypatch.setattr(ranking, "SAMPLE", 400)
    data = rows(spread, 3000, spread)
    want = sorted(data, key=place)
    df = spark.createDataFrame(data, "id long, score double, name string").repartition(5).cache()
    for k in (1, 700, 1500, 3000):
        got = ranking.kth(df, k, ORDER)
        assert (got["id"], got["name"]) == (want[k - 1][0], want[k - 1][2])
    for k in (0, 1234, 4000):
        assert sorted(r["id"] for r in ranking.first_rows(df, k, ORDER).collect()) == sorted(r[0] for r in want[:k])
    assert ranking.kth(df, 3001, ORDER) is None and ranking.kth(df.where("false"), 1, ORDER) is None


def test_equal_rows_stay_together(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL", 10)
    df = spark.createDataFrame([(1.0, 5)] * 400 + [(0.5, k) for k in range(100)], "score double, id long")
    assert tuple(ranking.kth(df, 200, [("score", True), ("id", False)])) == (1.0, 5)
    assert ranking.first_rows(df, 1, [("score", True), ("id", False)]).count() == 400
    assert ranking.first_rows(df, 410, [("score", True), ("id", False)]).count() == 410


def test_no_plan_sorts_towards_one_task(spark):
    """No limit in the plans of the selections by rate, and none that is run on the way is larger than SMALL."""
    df = spark.range(1000).selectExpr("id doc_id", "cast(hash(id) % 100 as double) score", "if(id % 3 = 0, 'a', 'b') length_bin", "repeat('word ', 5) text")
    plans = [select.topk(df, 0.5), select.random_keep(df, 0.5), select.local_top_fraction(df, 0.5, "largest"), select.length_quota(df, "length_bin", 500), select.select_v3(df, 0.5), select.random_matched(df.withColumn("n", F.lit(1)), "n", 0, 1, "document_count", 500)]
    for got in plans:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Limit" not in plan and "TakeOrdered" not in plan
    assert [p.where("keep").count() for p in plans] == [500, 500, 500, 500, 500, 500]


def greedy(data, budget):
    out, left = [], budget
    for k, n in data:
        if n <= left:
            out.append(k)
            left -= n
    return out


@pytest.mark.parametrize("seed", range(2))
def test_first_fit(spark, seed):
    rng = random.Random(seed)
    most = rng.choice([3, 50, 2000])
    data = [(k, rng.choice([0, 1, rng.randint(0, most), int(most * rng.random() ** 4)])) for k in range(400)]
    df = spark.createDataFrame(data, "doc_id long, n long").repartition(3)
    for budget in (0, 1, most, sum(n for _, n in data) // 3, 10**9):
        for parts in (1, 13):
            assert sorted(r["doc_id"] for r in select.first_fit(df, "n", budget, "doc_id", parts=parts).collect()) == greedy(data, budget)


def test_first_fit_walks_few_ranges(spark, monkeypatch):
    walks = []
    made = select._walk
    monkeypatch.setattr(select, "_walk", lambda left: (walks.append(left), made(left))[1])
    rng = random.Random(3)
    data = [(k, rng.randint(50, 800)) for k in range(20000)]
    df = spark.createDataFrame(data, "doc_id long, n long")
    budget = sum(n for _, n in data) // 2
    assert sorted(r["doc_id"] for r in select.first_fit(df, "n", budget, "doc_id", parts=64).collect()) == greedy(data, budget)
    assert len(walks) <= 4


def rebalanced(data, k, fraction=0.45):
    """The same walk, one row after the other."""
    inside = {i: (s, 0, i) for i, s, _, keep in data if keep}
    bins = {}
    for i, s, b, _ in data:
        bins.setdefault(b, []).append((i, s))
    have = {b: sum(i in inside for i, _ in v) for b, v in bins.items()}
    for b, members in bins.items():
        more = math.floor(len(members) * k / len(data) * fraction) - have[b]
        come = sorted((x for x in members if x[0] not in inside), key=lambda x: (-x[1], x[0]))[: max(0, more)]
        for t, (i, s) in enumerate(come):
            free = len(inside) < k
            if not free:
                del inside[min(inside, key=lambda x: inside[x])]
            inside[i] = (s, 0, i) if free else (s, 1, -t)
        inside = {i: (v[0], 0, i) for i, v in inside.items()}
    return sorted(inside)


@pytest.mark.parametrize("seed", range(3))
def test_weak_rebalance_is_the_walk(spark, seed):
    rng = random.Random(seed)
    n, k = 300, rng.choice([100, 150])
    data = [(i, round(rng.random(), rng.choice([1, 3])), rng.choice("aaabbc")) for i in range(n)]
    out = {b: rng.random() < 0.5 for b in "abc"}
    chosen = [i for i, _, b in data if not out[b]][: k - rng.choice([0, 0, 15])]
    data = [(*r, r[0] in set(chosen)) for r in data]
    df = spark.createDataFrame(data, "doc_id long, score double, length_bin string, keep boolean").repartition(4)
    got = select.weak_rebalance(df, "length_bin", k)
    assert sorted(r["doc_id"] for r in got.where("keep").collect()) == rebalanced(data, k) and got.count() == n
