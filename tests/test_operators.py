"""Dedup, selection and statistics on small cases whose answers are known."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import analysis, dedup, select, storage, urd


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "s") for k, t in texts], "doc_id long, text string, source string")


BASE = [f"w{k}" for k in range(40)]


def test_exact_dedup_normalises(spark):
    df = frame(spark, [(1, "A  b"), (2, "a B"), (3, "Straße"), (4, "STRASSE"), (5, None), (6, "")])
    assert {r["doc_id"]: r["keep"] for r in dedup.exact_dedup(df).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}
    assert dedup.sha1_clusters(df).count() == 1


def chain(spark):
    """1 ~ 2 ~ 3, but not 1 ~ 3."""
    a, b, c = list(BASE), list(BASE), list(BASE)
    b[39] = "x"
    c[39], c[0] = "x", "y"
    return frame(spark, [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, "something else altogether here")])


def test_greedy_and_components_differ_on_a_chain(spark):
    df = chain(spark)
    pairs = {(r["a"], r["b"]): r["similarity"] for r in dedup.jaccard_pairs(df, 0.93).collect()}
    assert set(pairs) == {(1, 2), (2, 3)}
    greedy = [(r["member"], r["representative"]) for r in dedup.near_dedup(df, 0.93).collect()]
    assert greedy == [(2, 1)]
    edges = dedup.jaccard_pairs(df, 0.93)
    assert {r["node"]: r["root"] for r in dedup.components(edges).collect()} == {1: 1, 2: 1, 3: 1}


def test_string_order_of_ids(spark):
    text = " ".join(BASE)
    got = {r["doc_id"]: r["keep"] for r in dedup.minhash_filter(frame(spark, [(2, text), (10, text), (3, "other words entirely")])).collect()}
    assert got == {"10": True, "2": False, "3": True}


def test_minhash_finds_what_jaccard_finds(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(20):
        words = [f"g{g}w{k}" for k in range(60)]
        for j in range(4):
            w = list(words)
            for at in rng.choice(60, j, replace=False):
                w[at] = f"e{rng.integers(10**6)}"
            rows.append((10 * g + j, " ".join(w)))
    df = frame(spark, rows)
    exact = {(str(r["a"]), str(r["b"])) for r in dedup.jaccard_pairs(df, 0.82).collect()}
    found = {(r["a"], r["b"]) for r in dedup.near_pairs(df, 0.82).collect()}
    assert {tuple(sorted(p)) for p in found} == {tuple(sorted(p)) for p in exact} and len(exact) > 20
    one = {(r["a"], r["b"]) for r in dedup.jaccard_pairs(df.repartition(1), 0.82).collect()}
    assert one == {(r["a"], r["b"]) for r in dedup.jaccard_pairs(df.repartition(17), 0.82).collect()}


def test_keep_counts():
    assert select.keep_count(100, 0.07) == 8 and select.keep_count(3, 0.01) == 1 and select.keep_count(5, None) == 5
    with pytest.raises(ValueError):
        select.keep_count(5, 0.0)


def test_topk_ties(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.9), (2, 0.9), (3, 0.9)], "doc_id long, score double")
    assert {r["doc_id"] for r in select.topk(df, 0.5).where("keep").collect()} == {1, 2}


def test_budgets(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 3)], "doc_id long, n long")
    assert [r["doc_id"] for r in select.prefix_budget(df, "n", 8).collect()] == [1]
    assert sorted(r["doc_id"] for r in select.first_fit(df, "n", 8, "doc_id").collect()) == [1, 3]
    full = spark.createDataFrame([(1, 5), (2, 3), (3, 0)], "doc_id long, n long")
    assert sorted(r["doc_id"] for r in select.prefix_budget(full, "n", 8).collect()) == [1, 2]
    big = spark.createDataFrame([(1, 50), (2, 3)], "doc_id long, n long")
    assert [r["doc_id"] for r in select.prefix_budget(big, "n", 8).collect()] == [1]


def test_global_rank(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("v")).repartition(5)
    got = select.global_rank(df, F.desc("v"), F.col("doc_id")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [(r["v"], r["doc_id"]) for r in got] == sorted([(k % 7, k) for k in range(1000)], key=lambda x: (-x[0], x[1]))


def test_pareto(spark):
    rows = [(1, 1.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 0.0), (4, 1.0, 0.0), (5, -1.0, -1.0)]
    df = spark.createDataFrame(rows, "doc_id long, a double, b double")
    assert {r["doc_id"]: r["pareto_rank"] for r in select.pareto_layers(df, ["a", "b"], []).collect()} == {1: 0, 2: 0, 4: 0, 3: 1, 5: 2}
    assert {r["doc_id"] for r in select.pareto_front(df.repartition(3), ["a"], ["b"]).collect()} == {1, 4, 5}


def test_curriculum(spark):
    df = spark.createDataFrame([(k, float(-k)) for k in range(5)], "doc_id long, score double")
    got = [r["doc_id"] for r in select.curriculum_interleave(df).orderBy("position").collect()]
    assert got == [0, 3, 2, 1, 4]


def test_urd(spark):
    df = frame(spark, [(1, "alpha beta gamma"), (2, "alpha beta delta https://x.org <b> 12345"), (3, "omega"), (4, "")])
    rows = urd.scores(df).collect()
    assert len(rows) == 4
    for r in rows:
        for c in ("utility_score", "risk_score", "diversity_score", "shift_penalty", "cost_score"):
            assert 0 <= r[c] <= 1
    sets = {1: {"alpha", "beta", "gamma"}, 2: {"alpha", "beta", "delta", "https", "x", "org", "b", "12345"}, 3: {"omega"}, 4: set()}
    nov = {r["doc_id"]: r["novelty"] for r in urd.novelty(df).collect()}
    for k, s in sets.items():
        want = 1 - sum((len(s & t) / len(s | t)) if s | t else 1.0 for j, t in sets.items() if j != k) / 3
        assert abs(nov[k] - want) < 1e-12
    kept = urd.select_fixed(df, 0.5, budget=5).where("keep").count()
    assert 1 <= kept <= 2
    assert urd.select_pareto(df, 0.5).where("keep").count() == 2
    assert urd.scores(df, disabled=("risk",)).where("risk_score <> 0").count() == 0


def test_farthest_first(spark):
    df = frame(spark, [(1, "a b c"), (2, "a b c d"), (3, "x y z"), (4, "a b x")])
    got = {r["doc_id"]: (r["keep"], r["score"]) for r in select.farthest_first(df, 0.5).collect()}
    assert {k for k, v in got.items() if v[0]} == {1, 3}


def test_statistics(spark):
    df = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 3.0), ("r", 1, 2.0), ("r", 2, 5.0), ("one", 1, 4.0)], "method string, seed int, value double")
    s = {r["method"]: r for r in analysis.summarize(df, "method", "value").collect()}
    assert s["m"]["mean"] == 2.0 and abs(s["m"]["std"] - math.sqrt(2)) < 1e-12 and s["one"]["std"] == 0.0 and s["one"]["ci95_low"] is None
    p = {r["method"]: r for r in analysis.paired_difference(df, "method", "seed", "value", "r").collect()}
    assert p["m"]["mean"] == 1.5 and p["m"]["positive_mean_improvement"] and p["one"]["n"] == 1
    b = {r["method"]: r for r in analysis.bootstrap_mean(df, "method", "value", ["seed"]).collect()}
    assert b["m"]["ci_low"] <= 2.0 <= b["m"]["ci_high"]


def test_divergence(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "token string, c long")
    b = spark.createDataFrame([("z", 2)], "token string, c long")
    same, apart = analysis.divergence(a, a).first(), analysis.divergence(a, b).first()
    assert abs(same["js"]) < 1e-9 and abs(apart["js"] - 1) < 1e-5


def test_median_is_the_upper_one(spark):
    df = frame(spark, [(k, "x" * k) for k in (1, 2, 3, 4)])
    assert analysis.corpus_analysis(df).first()["len_p50"] == 3


def test_containment(spark):
    items = spark.createDataFrame([(1, "the exact passage to protect"), (2, "not there at all")], "item_id long, text string")
    df = frame(spark, [(1, "before the exact passage to protect after"), (2, "the exact passage, to protect"), (3, "xthe exact passage to protecty")])
    assert {(r["item_id"], r["doc_id"]) for r in dedup.containment(df, items).collect()} == {(1, 1), (1, 3)}


def test_minhash_drops_copies_of_a_dropped_document(spark):
    """Copies of a document go with it, where an earlier near copy drops it; their score counts all earlier kept ones."""
    base = [f"w{k}" for k in range(60)]
    near, other = " ".join([*base, "end"]), " ".join(f"v{k}" for k in range(40))
    rows = [(10, " ".join(base))] + [(k, near) for k in range(11, 20)] + [(k, other) for k in (30, 31)] + [(40, "alone here")]
    got = {r["doc_id"]: r for r in dedup.minhash_filter(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r["keep"]} == {"10", "30", "40"}
    assert all(abs(got[str(k)]["score"] - 1 / 59) < 1e-12 for k in range(11, 20)) and got["31"]["score"] == 0


def test_incremental_index(spark, tmp_path):
    from millrace.operators.index import MinHashIndex

    base = [f"w{k}" for k in range(60)]
    near, far = " ".join([*base, "end"]), " ".join(f"v{k}" for k in range(40))
    index = MinHashIndex(spark, str(tmp_path / "index"))
    assert index.clusters().count() == 0
    assert index.add(frame(spark, [(9, near), (20, far), (21, far)])) == 3
    assert {r["doc_id"]: r["representative"] for r in index.clusters().collect()} == {"9": "9", "20": "20", "21": "20"}
    probe = frame(spark, [(5, " ".join(base)), (6, "nothing like it")])
    assert [(r["doc_id"], r["duplicate"]) for r in index.confirmed(probe).collect()] == [("5", "9")]
    assert ("5", "9") in {tuple(r) for r in index.candidates(probe).collect()}
    assert index.add(probe) == 2 and index.add(probe) == 0
    again = MinHashIndex(spark, str(tmp_path / "index"))
    assert {r["doc_id"]: r["representative"] for r in again.clusters().collect()} == {"5": "5", "6": "6", "9": "5", "20": "20", "21": "20"}
    with pytest.raises(ValueError):
        MinHashIndex(spark, str(tmp_path / "index"), bands=8)


def test_copies_cost_a_row_each(spark, tmp_path):
    """300 and 300 copies of a text and of one near to it: a set for each, and one link between them."""
    from millrace.operators.index import MinHashIndex

    base = [f"w{k}" for k in range(60)]
    index = MinHashIndex(spark, str(tmp_path / "index"))
    assert index.add(frame(spark, [(k, " ".join(base)) for k in range(300)])) == 300
    assert index.add(frame(spark, [(1000 + k, " ".join(base if k % 2 else [*base, "end"])) for k in range(300)])) == 300
    assert index.links().count() == 1 and index._table("sets").count() == 2 and index.documents().count() == 600
    assert {r["representative"] for r in index.clusters().collect()} == {"0"}
    assert index.confirmed(frame(spark, [(1, " ".join(base))])).count() == 2


def test_index_on_a_stream_that_is_killed(spark, tmp_path, monkeypatch):
    """A stream that dies in each of its steps and is started again gives the clusters of one that doesn't."""
    import json

    from millrace.operators import index as I

    rng = np.random.default_rng(5)
    texts = []
    for k in range(12):
        words = [f"t{k}w{j}" for j in range(50)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join(words)]
    order = rng.permutation(len(texts))
    source = tmp_path / "in"
    source.mkdir()
    for f in range(3):
        (source / f"{f}.json").write_text("".join(json.dumps({"doc_id": int(k), "text": texts[k]}) + "\n" for k in order[f::3]))
    schema = "doc_id long, text string"
    whole = I.MinHashIndex(spark, str(tmp_path / "whole"))
    whole.add(spark.read.schema(schema).json(str(source)))
    want = {r["doc_id"]: r["representative"] for r in whole.clusters().collect()}
    assert len(set(want.values())) == 12

    index = I.MinHashIndex(spark, str(tmp_path / "index"))
    fail, mark = [0], I.marked

    def dying(spark, path):
        fail[0] += 1
        if fail[0] == 2:  # all tables of the batch are written, its marker is not
            raise OSError("killed")
        mark(spark, path)
        if fail[0] == 3:  # the marker stands, the stream doesn't know
            raise OSError("killed")

    monkeypatch.setattr(I, "marked", dying)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            index.add_files(str(source), schema, str(tmp_path / "checkpoint"))
        assert len(index.batches()) in (1, 2)
    assert index.add_files(str(source), schema, str(tmp_path / "checkpoint")) == 2
    assert {r["doc_id"]: r["representative"] for r in index.clusters().collect()} == want and len(index.batches()) == 3
    assert index.documents().count() == len(texts) and index.links().count() <= index._table("sets").count()


def test_layers_in_five_objectives(spark):
    """Ranges of 90 rows against peeling; a third of the rows are equal, some objectives are null, and no task has all rows."""
    rng = np.random.default_rng(8)
    v = np.round(rng.random((600, 5)) ** 2, 2)
    v[::3] = v[0]
    rows = [(k, *[None if rng.random() < 0.01 else float(x) for x in v[k]]) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, a double, b double, c double, d double, e double").repartition(7)
    worst = np.array([[-np.inf if x is None else (x if j < 2 else -x) for j, x in enumerate(r[1:])] for r in rows])
    want = select.layers(worst)
    got = {r["doc_id"]: r["pareto_rank"] for r in select.pareto_layers(df, ["a", "b"], ["c", "d", "e"], 90).collect()}
    assert got == {k: int(want[k]) for k in range(600)} and max(got.values()) > 3
    assert select.pareto_layers(df.limit(0), ["a"], ["b"]).count() == 0


def test_matrix_modes(spark):
    from millrace.operators import matrix

    df = frame(spark, [(1, "abcd"), (2, "ab")])
    broken = lambda: spark.read.parquet("/no/such/table")
    sets = {"a": matrix.Dataset(lambda: df), "b": matrix.Dataset(broken), "c": matrix.Dataset(lambda: df), "r": matrix.Dataset(broken, lambda: df, True)}
    methods = {"one": lambda x: x.where("doc_id = 1"), "bad": lambda x: x.where("no_such_column")}
    rows = matrix.run(spark, sets, {"one": methods["one"]}, "full").collect()
    assert [(r["dataset"], r["status"], r["documents"], r["retention"]) for r in rows] == [("a", "ok", 1, 4 / 6), ("b", "error", None, None), ("c", "ok", 1, 4 / 6), ("r", "fallback_recorded", None, None)]
    assert [r["status"] for r in matrix.run(spark, sets, methods, "quick").collect()] == ["error", "error"]
    assert [(r["status"], r["used_fallback"]) for r in matrix.run(spark, sets, methods, "full", dry_run=True).collect()] == [("dry_run", False), ("error", False), ("dry_run", False), ("dry_run", True)]
    with pytest.raises(ValueError):
        matrix.run(spark, sets, methods, "other")


def test_split_token_pairs(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(1, words, "a"), (2, words[:99], "b"), (3, words[:97], "b"), (4, words, "b"), (5, words[:39], "a"), (6, words[:39], "b"), (7, words[::-1], "a"), (8, None, None), (9, [*words, "x"], None)]
    df = spark.createDataFrame([(i, " ".join(t) if t else None, s) for i, t, s in rows], "doc_id long, text string, split string")
    got = {(r["a"], r["b"]): (round(r["similarity"], 4), r["a_split"], r["b_split"]) for r in dedup.split_token_pairs(df).collect()}
    assert got == {(1, 2): (0.99, "a", "b"), (1, 4): (1.0, "a", "b"), (1, 9): (0.9901, "a", None), (2, 9): (0.9802, "b", None), (4, 9): (0.9901, "b", None)}


def test_layers_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, *[float(x) for x in rng.integers(0, 6, 3)]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, a double, b double, c double")
    rank, left = {}, {r[0]: np.array([r[1], r[2], -r[3]]) for r in rows}
    while left:
        front = [k for k, v in left.items() if not any((w >= v).all() and (w > v).any() for w in left.values())]
        rank |= {k: len(set(rank.values())) for k in front}
        left = {k: v for k, v in left.items() if k not in front}
    want, k = {}, sorted(set(rank.values()))
    for block in (1000, 37):
        assert {r["doc_id"]: r["pareto_rank"] for r in select.pareto_layers(df.repartition(40), ["a", "b"], ["c"], block).collect()} == {i: k.index(x) for i, x in rank.items()}
    assert {r["doc_id"] for r in select.pareto_front(df.repartition(40), ["a", "b"], ["c"]).collect()} == {i for i, x in rank.items() if x == 0}
    assert not want


def test_farthest_first_writes_sets_once(spark, monkeypatch):
    # one set of 2,000 words a row and a round for each two choices: rounds must not write the sets again, nor leave tables
    texts = [" ".join(f"w{(k * 7919 + j * (k + 1)) % 100003}" for j in range(2000)) for k in range(40)]
    monkeypatch.setattr(select, "SETTLED", 2)
    kinds = []
    monkeypatch.setattr(select, "saved", lambda df, kind, **more: kinds.append((kind, df.columns)) or storage.saved(df, kind, **more))
    gone = []
    monkeypatch.setattr(select, "forget", lambda df: gone.append(df.inputFiles()) or storage.forget(df))
    assert select.farthest_first(frame(spark, list(enumerate(texts))), 0.4).where("keep").count() == 16
    assert [c for c in kinds if "s" in c[1]] == [("sets", ["doc_id", "s"])]
    assert len(gone) == 8 and not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for files in gone for f in files)


def test_farthest_first_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, int(rng.integers(0, 12)))) for _ in range(120)]
    sets = [set(t.split()) for t in texts]
    apart = lambda a, b: 1 - (len(a & b) / len(a | b) if a | b else 1.0)
    d, kept = [2.0] * 120, []
    for _ in range(48):
        k = min((i for i in range(120) if i not in kept), key=lambda i: (-d[i], i))
        kept.append(k)
        d = [d[i] if i in kept else min(d[i], apart(sets[i], sets[k])) for i in range(120)]
    for pool in (1024, 10):
        monkeypatch.setattr(select, "POOL", pool)
        got = {r["doc_id"]: r for r in select.farthest_first(frame(spark, list(enumerate(texts))), 0.4).collect()}
        assert {i for i, r in got.items() if r["keep"]} == set(kept)
        assert all(abs(got[i]["score"] - min(1.0, d[i])) < 1e-12 for i in range(120))


@pytest.mark.parametrize("few", [1 << 19, 3])
def test_jaccard_pairs_write_sets_that_meet_only(spark, monkeypatch, few):
    """All similar pairs are found by parts of the sets, and whole sets are made for documents that meet another one."""
    rng = np.random.default_rng(3)
    texts = []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 9 if k % 4 else 400, int(rng.integers(5, 60)))]
        texts.append(base)
        for j in range(k % 3):
            texts.append([*base[: -1 - 2 * j], f"x{j}", *base[len(base) - 2 * j :]])
    texts += [[f"alone{k}_{j}" for j in range(30)] for k in range(40)]
    sets = [{tuple(x[j : j + 3]) for j in range(max(1, len(x) - 2))} for x in texts]
    jac = lambda a, b: len(a & b) / len(a | b)
    written = {}
    monkeypatch.setattr(dedup, "saved", lambda df, kind="table", **more: written.setdefault(kind, storage.saved(df, kind, **more)))
    monkeypatch.setattr(dedup, "FEW", few)
    for threshold in (0.5, 0.82):
        written.clear()
        first = {}
        for k, s in enumerate(sets):
            first.setdefault(frozenset(s), k)
        want = {(a, b): jac(sets[a], sets[b]) for a in first.values() for b in first.values() if a < b and jac(sets[a], sets[b]) >= threshold}
        want |= {(first[frozenset(s)], k): 1.0 for k, s in enumerate(sets) if first[frozenset(s)] != k}
        got = {(r["a"], r["b"]): r["similarity"] for r in dedup.jaccard_pairs(frame(spark, [(k, " ".join(x)) for k, x in enumerate(texts)]), threshold).collect()}
        assert got == want and len(want) > 20
        assert "shingles" not in written["heads"].columns and written["sets"].where("id >= 120").isEmpty() and written["sets"].count() < len(texts)


def test_banded_sets_stay_where_they_are(spark, monkeypatch, tmp_path):
    """By bands only names and keys are handed on; sets are written for documents in a pair, and once by the index."""
    from millrace.operators import index

    texts = [" ".join(f"w{k}_{j}" for j in range(40)) for k in range(30)]
    texts += [texts[0] + " end", texts[1], texts[1] + " end"]
    df = frame(spark, list(enumerate(texts))).withColumn("split", F.when(F.col("doc_id") < 30, "a").otherwise("b"))
    written = []

    def saved(table, kind="table", **more):
        out = storage.saved(table, kind, **more)
        if "shingles" in out.columns:
            written.append((kind, out.count()))
        return out

    monkeypatch.setattr(dedup, "saved", saved)
    got = {(r["a"], r["b"], r["a_split"], r["b_split"]) for r in dedup.split_near_pairs(df).collect()}
    assert got == {("0", "30", "a", "b"), ("1", "31", "a", "b"), ("1", "32", "a", "b")}
    assert written == [("sets", 4)]
    monkeypatch.setattr(index, "saved", saved)
    written.clear()
    kept = index.MinHashIndex(spark, str(tmp_path / "index"))
    assert kept.add(df, "split") == 33
    assert written == [("prepared", 33)] and kept._table("sets").count() == 32
    found = {r["doc_id"]: r["representative"] for r in kept.clusters().collect()}
    assert {k: v for k, v in found.items() if k != v} == {"30": "0", "31": "1", "32": "1"}


def test_copies_cost_their_number(spark):
    """A group of copies is one set: pairs of its least id with each other, not of all with all."""
    near = " ".join([*BASE, "end"])
    df = frame(spark, [(k, " ".join(BASE)) for k in range(10, 60)] + [(k, near) for k in range(60, 90)] + [(1, "something else")])
    pairs = {(r["a"], r["b"]) for r in dedup.jaccard_pairs(df, 0.9).collect()}
    assert pairs == {(10, k) for k in range(11, 60)} | {(60, k) for k in range(61, 90)} | {(10, 60)}
    got = {r["member"]: (r["representative"], round(r["similarity"], 6)) for r in dedup.near_dedup(df, 0.9).collect()}
    assert got == {k: (10, 1.0) for k in range(11, 60)} | {k: (10, round(38 / 39, 6)) for k in range(60, 90)}


def test_pipeline_steps_against_plain_python(spark):
    """The full pipeline's steps, and near dedup in each place, on texts that each step changes or drops."""
    import hashlib
    import re

    from millrace.operators import pipeline, scoring

    prose = "careful measurement of corpora helps people choose training data with some confidence in what they build from it"
    texts = [prose, prose.upper(), prose + " today", "<p>" + prose + "</p>", "write to a.b@c.org about " + prose, "a a a a a a a a", "$$$ ### !!!", "", prose + " today", "one two three four five six seven eight nine ten"]
    df = frame(spark, list(enumerate(texts)))
    shingle = lambda t: {tuple(t[k : k + 3]) for k in range(max(1, len(t) - 2))}
    toks = lambda t: re.findall(r"\w+", t.casefold())

    def walk(steps):
        rows = list(enumerate(texts))
        for s in steps:
            if s == "clean":
                rows = [(i, " ".join(re.sub(r"https?://\S+", " ", re.sub(r"<[^>]+>", " ", t)).split())) for i, t in rows]
            elif s == "redact":
                rows = [(i, re.sub(r"[\w.+-]+@[\w-]+\.[\w.-]+", "<EMAIL>", t)) for i, t in rows]
            elif s == "hdqs":
                one = spark.createDataFrame(rows, "doc_id long, text string")
                score = {r["doc_id"]: r["score"] for r in scoring.hdqs(one).collect()}
                rows = [(i, t) for i, t in rows if score[i] >= 0.8]
            elif s == "exact":
                seen, rows_ = set(), []
                for i, t in rows:
                    h = hashlib.sha1(" ".join(t.casefold().split()).encode()).hexdigest()
                    if h not in seen:
                        seen.add(h)
                        rows_.append((i, t))
                rows = rows_
            else:
                kept = []
                for i, t in rows:
                    x = shingle(toks(t))
                    if not any(len(x & y) / len(x | y) >= 0.82 for _, _, y in kept):
                        kept.append((i, t, x))
                rows = [(i, t) for i, t, _ in kept]
        return sorted(rows)

    for name in ("full_pipeline", "full_pipeline_without_clean", "near_dedup_only", "exact_dedup_only"):
        got = sorted((r["doc_id"], r["text"]) for r in pipeline.variants(df, (name,))[name].select("doc_id", "text").collect())
        assert got == walk(pipeline.VARIANTS[name]), name
    for name, steps in pipeline.ORDERS.items():
        assert pipeline.order_report(df, (name,)).first()["documents"] == len(walk(steps)), name
    matched = pipeline.variants(df, ("full_pipeline", *pipeline.MATCHED))
    assert len({m.count() for m in matched.values()}) == 1
    with pytest.raises(ValueError):
        pipeline.variants(df, ("none",))


def test_reports(spark):
    from millrace.operators import reports

    a = spark.createDataFrame([("t.csv", "main_table", True, []), ("u.csv", "main_table", True, ["t.csv", "gone"]), ("v", "report", False, None)], "path string, artifact_type string, main_evidence boolean, parent_artifacts array<string>")
    assert [r[0] for r in reports.lineage_warnings(a).collect()] == ["t.csv"]
    assert {(r["child"], r["parent"], r["known"]) for r in reports.lineage(a).collect()} == {("u.csv", "t.csv", True), ("u.csv", "gone", False)}
    m = spark.createDataFrame([("HTTP 403 gated",), ("No space left",), ("read timed out",), ("boom",), (None,)], "m string")
    assert [r[0] for r in m.select(reports.failure_class(F.col("m"))).collect()] == ["failed_due_to_auth", "failed_due_to_disk", "failed_due_to_network", "failed_due_to_environment", "failed_due_to_environment"]
    runs = spark.createDataFrame([("my run", "a\\b", "/home/x/repo/out")], "x string, y string, p string")
    r = reports.normalised_runs(runs, ("x", "y"), "x", "/home/x/repo").first()
    assert r["run_id"] == "my_run:a/b" and r["p"] == "out"


def test_perplexity_of_nothing_is_infinite(spark):
    from millrace.operators import scoring

    got = {r["doc_id"]: r["perplexity_proxy"] for r in scoring.local_scores(frame(spark, [(1, ""), (2, "one two two")])).collect()}
    # one word in three repeated, no marks or digits, and the length's distance from 384 words
    assert got[1] == math.inf and abs(got[2] - (1 / 3 + 0.35 * (math.log(385) - math.log(4)) / math.log(4097))) < 1e-12


def test_scores_by_hand(spark):
    """Formulas worked out by hand, as both engines share their text."""
    from millrace.functions import formulas
    from millrace.functions import textexpr as X
    from millrace.operators import scoring

    r = X.with_formulas(X.with_ratios(X.profile(frame(spark, [(1, "the cat, the dog")]))), {"q": formulas.QUALITY_PROFILE}).first()
    assert (r["n_tok"], r["n_uniq"], r["n_sym"], r["n_len"]) == (4, 3, 1, 16)
    assert abs(r["q"] - (4 / 20 + (1 - 3 / 16) + 1 + 1) / 4) < 1e-12
    h = scoring.hdqs(frame(spark, [(1, "the cat, the dog")])).first()
    parts = {
        "lexical_diversity": 3 / 4, "char_entropy": h["char_entropy_bits"] / 5, "token_entropy": 1.5 / 8, "repetition_penalty": 1.0, "ngram_repetition_penalty": 1.0, "pii_density_penalty": 1.0,
        "url_html_noise_penalty": 1.0, "non_linguistic_symbol_penalty": 1 - 4 / 16, "length_prior": 16 / 40, "language_consistency": 1.0,
    }
    weights = (1.0, 1.0, 0.8, 1.3, 1.0, 1.2, 1.0, 1.0, 0.8, 0.7)
    assert abs(h["score"] - sum(w * v for w, v in zip(weights, parts.values())) / sum(weights)) < 1e-9
    lm = frame(spark, [(1, "the cat, the dog")]).withColumn("loss", F.lit(1.0))
    more = scoring.hdqs(lm, surprisal="loss", more={"optional_lm_surprisal": 2.0}).first()
    assert abs(more["score"] - (h["score"] * sum(weights) + 2 * 0.5) / (sum(weights) + 2)) < 1e-9
    local = scoring.local_scores(frame(spark, [(1, "casino https://x.org kill kill")])).first()
    assert abs(local["local_risk"] - (0.05 * 2 + 0.02)) < 1e-12 and abs(local["local_diversity"] - 3 / 4) < 1e-12 and abs(local["local_utility"] - math.log(5) / math.log(2049)) < 1e-12


def test_ablation_measures_texts_once(spark):
    from millrace.operators import pipeline

    near = " ".join(BASE)
    texts = [(1, near), (2, near + " x"), (3, near + " x"), (4, "<b>" + near + "</b> see https://a.example/b"), (5, "mail a@b.org now please or call"), (6, None), (7, near + " a@b.org"), (8, "one two"), (8, near)]
    df = frame(spark, texts)
    names = ("raw_noisy_baseline", "near_dedup_only", "full_pipeline", "length_matched_baseline")
    rows = lambda x: sorted((r[0], *r[1:5], round(r[5], 9)) for r in x.collect())
    got = pipeline.ablation(df, names, threshold=0.5)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got) == rows(pipeline.compared(pipeline.variants(df, names, threshold=0.5)))


def test_novelty_writes_no_pairs(spark, monkeypatch):
    """Tiles smaller than the table, and common words of all texts: each set is handed on once for each group, no pair is."""
    rng = np.random.default_rng(1)
    texts = [(k, " ".join(["all", "have", *(f"w{x}" for x in rng.zipf(1.5, 20) % 50)]) if k % 7 else "") for k in range(60)]
    monkeypatch.setattr(urd, "TILE", 8)
    got = urd.novelty(frame(spark, texts))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[1]
    sets = {k: set(t.split()) for k, t in texts}
    for k, v in got.collect():
        others = [1.0 if sets[k] == s else len(sets[k] & s) / len(sets[k] | s) for o, s in sets.items() if o != k]
        assert abs(v - (1 - sum(others) / len(others))) < 1e-9


def test_common_counts_by_matrices_and_by_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(urd, "CELLS", 16)
    left, right = ([np.unique(rng.zipf(1.2, 30) % 400) for _ in range(40)] for _ in range(2))
    got = urd._common(np.concatenate(left), np.array([len(x) for x in left]), np.concatenate(right), np.array([len(x) for x in right]))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_containment_of_many_items_with_common_words(spark):
    """Numbers share the run between their first and last word; short items are parts of words. No item meets all texts."""
    texts = [(k, f"call +1 412 555 {1000 + k}. or mail xeditor{k}@example.orgy, see ID-13-{k:04d}; ab cd") for k in range(30)] + [(99, "412 555 é" + "q" * 50), (98, None), (97, "412 555")]
    items = [(f"p{k}", f"+1 412 555 {1000 + k}") for k in range(40)] + [(f"e{k}", f"editor{k}@example.org") for k in range(40)] + [(f"i{k}", f"ID-13-{k:04d}") for k in range(40)]
    items += [("two", "b c"), ("space", " ab"), ("three", "1 412 5"), ("four", "13-0001; ab c"), ("none", "412  555"), ("é", "é")]
    got = dedup.containment(frame(spark, texts), spark.createDataFrame(items, "item_id string, text string"))
    assert "contains" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().lower().split("\n") if "join cross" in x or "join inner, contains" in x)
    assert {tuple(r) for r in got.collect()} == {(i, k) for i, x in items for k, t in texts if x in (t or "")}


def test_frontier_of_empty_texts(spark, tmp_path):
    # symbols of an empty text are nothing of nothing: an error for Spark, the greatest share for the SQL
    import duckdb

    from millrace.plans import registry

    def both(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(r[0] for r in con.execute(registry.oracle_sql()["pareto_frontier"]).fetchall())
        assert sorted(r["doc_id"] for r in registry.queries()["pareto_frontier"](spark, str(tmp_path)).collect()) == want
        return want

    assert both(["", "one two three", "one two two!", None, "", "!!!", "one one one one one"]) == [1, 3, 6]
    assert both(["", ""]) == [0, 1]


def test_layers_of_sums_that_round_alike():
    # 1e9 + 1e-9 is 1e9: the dominated row has the same sum and comes first
    assert select.layers(np.array([[1e9, 0.0], [1e9, 1e-9]])).tolist() == [1, 0]
    assert select.layers(np.array([[1.0, -np.inf], [2.0, -np.inf]])).tolist() == [1, 0]


@pytest.mark.parametrize("own", [True, False])
def test_similarities_index_a_tile_once(monkeypatch, own):
    """Each tile is put in order of its values once, however many others it is compared with; some sets are empty, some are copies."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.zipf(1.3, rng.integers(0, 40)) % 300) << 40 | 7 for _ in range(70)]
    g, w = [0] * 70 if own else [3] * 33 + [5] * 37, rng.integers(1, 4, 70)
    made, index = [], urd._Tile
    monkeypatch.setattr(urd, "_Tile", lambda *a: made.append(1) or index(*a))
    monkeypatch.setattr(urd, "TILE", 8)
    table = pa.table({"own": [own] * 70, "g": pa.array(g, pa.int32()), "h": [str(k) for k in range(70)], "w": w, "v": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
    got = urd._similarities(table)["x"].to_pylist()
    j = np.array([[float(a is b) or len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) for b in sets] for a in sets])
    meet = np.array([[own or a != b for b in g] for a in g])
    assert np.allclose(got, (j * meet) @ w, rtol=0, atol=1e-12)
    assert len(made) == (9 if own else 5 + 5)


def test_containment_leaves_texts_alone_that_can_hold_nothing(spark, monkeypatch):
    """Of 205 texts two have the beginning of an item; only those are written, and no runs of the others' words are sent."""
    written = {}

    def noted(df, kind="table", by=None):
        written[kind] = storage.saved(df, kind, by)
        return written[kind]

    monkeypatch.setattr(dedup, "saved", noted)
    texts = [(k, f"many words {k} of a text without any") for k in range(200)] + [(300, "so +1 412 555 1003 it is"), (301, "xeditor7@example.orgy"), (302, "edit this"), (303, "call +1 412\n555 1003"), (304, None)]
    items = spark.createDataFrame([("p", "+1 412 555 1003"), ("q", "+1 412 555 1004"), ("e", "editor7@example.org")] + [(f"x{k}", f"editor{k}@example.org") for k in range(100, 200)], "item_id string, text string")
    got = dedup.containment(frame(spark, texts), items)
    assert {tuple(r) for r in got.collect()} == {("p", 300), ("e", 301)}
    assert sorted(r["doc_id"] for r in written["holding"].collect()) == [300, 301]  # by the first eight characters
    many = spark.createDataFrame([(chr(0x4E00 + k), chr(0x4E00 + k) + " of a") for k in range(100)] + [("w", "words 7 of a t")], "item_id string, text string")
    written.clear()
    assert [tuple(r) for r in dedup.containment(frame(spark, texts), many).collect()] == [("w", 7)] and "holding" not in written  # they begin in too many ways
    assert dedup.containment(frame(spark, texts), items.limit(0)).collect() == []


def test_redaction_of_texts_that_need_none(spark):
    from millrace.functions import textexpr as X
    from millrace.operators import pipeline

    texts = ["a@b.org, +1 412 555 1003 and ID-13-0001", "ID-13-0001@x.org 12345678901", "none", "@", "1", "ID-", "", None, "5ID-11-1111 x@y.z ID-11-1111"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", X.EMAIL, "<EMAIL>"), X.PHONE, "<PHONE>"), X.ID, "<ID>")
    assert all(r["a"] == r["b"] for r in df.select(pipeline.redact(F.col("text")).alias("a"), plain.alias("b")).collect())
    plan = df.select(pipeline.redact(pipeline.clean(F.col("text"))).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?") == 1  # what it is made of stands there once


def test_shingles_of_a_batch(spark):
    """Equal sets have equal names, similar ones the values in common that their runs of words are; no run is a string any more."""
    from pyspark.sql.types import LongType, StructField, StructType

    texts = [(1, "a b c d e"), (2, "b c d e f"), (3, "a b c d e a b c"), (4, "c d e a b c d"), (5, ""), (6, None), (7, "a"), (8, "a b"), (9, "b a"), (10, "A, b: c!")] + [(20 + k, "w " * k) for k in range(600)]
    df = dedup._sets(frame(spark, texts).coalesce(1), 3)
    assert "ArrowEvalPython" in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and "concat_ws" not in plan
    got = {r["doc_id"]: (r["shingles"], bytes(r["set"])) for r in df.collect()}
    for k, t in texts:
        words = (t or "").lower().replace(",", "").replace(":", "").replace("!", "").split()
        assert got[k][0] == sorted(got[k][0]) and len(got[k][0]) == max(1, len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}))
    assert got[5] == got[6] == got[20] and got[3] == got[4] and len({got[k][1] for k in (1, 2, 3, 5, 7, 8, 9, 10)}) == 8
    assert len(set(got[1][0]) & set(got[2][0])) == 2 and got[10][0][0] in got[1][0] and got[23] == got[619]
    member, close = dedup.jaccard_classes(spark.createDataFrame([], StructType([StructField("doc_id", LongType())])).withColumn("text", F.lit("x")))
    assert member.count() == close.count() == 0


def test_rows_are_compared_with_choices_by_tiles(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.zipf(1.3, rng.integers(0, 30)) % 200) << 33 for _ in range(50)]
    monkeypatch.setattr(urd, "TILE", 8)
    chosen = [(0.5 + k / 100, k, sets[k]) for k in range(20)]
    rows = {"doc_id": list(range(5, 50)), "s": pa.array([s.tolist() for s in sets[5:]], pa.list_(pa.int64())), "d": [2.0] * 40 + [0.01] * 5, "keep": [True] * 3 + [False] * 42}
    got = pa.Table.from_batches(select._nearer(chosen)(iter([pa.RecordBatch.from_pydict(rows)]))).to_pylist()
    far = lambda a, b: 1 - (len(np.intersect1d(a, b)) / len(np.union1d(a, b)) if len(a) or len(b) else 1.0)
    for r, d in zip(got, rows["d"]):
        k = r["doc_id"]
        want = 2.0 if k < 8 else 0.5 + k / 100 if k < 20 else min(d, *(far(sets[k], s) for _, _, s in chosen))
        assert (r["d"], r["keep"]) == (want, k < 20)
