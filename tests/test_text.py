"""Text expressions and scores against plain Python on awkward strings."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import counts, tokenizers
from millrace.functions import textexpr as X
from millrace.operators import filters, pipeline, scoring, select

TEXTS = [
    "", " ", "Straße STRASSE", "été ½ Ⅷ x_1 中文 emoji 😀!", "a\x01b", "The the THE cat. Sat on the mat, and it is the end!", "one\ntwo\n  two \r\n\n one", "mail a.b+c@d-e.org or call +1 412 555 1234 now ID-12-3456",
    "see https://x.example/y?z and <b>bold</b> www.foo.bar", "x" * 1500, "word " * 300, "kill blood violence", None,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "web" if k % 2 else "wiki") for k, t in enumerate(TEXTS)], "doc_id long, text string, source string")


def toks(t):
    return re.findall(r"\w+", t.casefold())


def entropy(items):
    c, n = Counter(items), len(items)
    return -sum(v / n * math.log2(v / n) for v in c.values()) if n else 0.0


def test_profile(docs):
    rows = {r["doc_id"]: r for r in X.with_entropies(X.with_ratios(X.profile(docs))).collect()}
    for k, t in enumerate(TEXTS):
        t, r = t or "", rows[k]
        w = toks(t)
        assert list(r["toks"]) == w
        assert r["n_sym"] == sum(not c.isalnum() and not c.isspace() for c in t)
        assert r["n_alpha"] == sum(c.isalpha() for c in t) and r["n_words"] == len(t.split())
        lines = [x.strip() for x in t.splitlines() if x.strip()]
        assert r["n_lines"] == len(lines) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["is_readable"] == (bool(w) and not any(ord(c) < 32 and c not in "\n\r\t" for c in t))
        assert abs(r["token_entropy_bits"] - entropy(w)) < 1e-9 and abs(r["char_entropy_bits"] - entropy(t)) < 1e-9
        assert r["n_bigrams"] == len(set(zip(w, w[1:]))) and r["n_trigrams"] == len(set(zip(w, w[1:], w[2:])))
        assert r["q_email"] == len(re.findall(r"[\w.+-]+@[\w-]+\.[\w.-]+", t)) and r["q_id"] == len(re.findall(r"\bID-\d{2}-\d{4}\b", t))
        assert r["q_phone"] == len(re.findall(r"\b(?:\+?\d[\d\-\s]{7,}\d)\b", t)) and r["n_html"] == len(re.findall(r"<[^>]+>", t))


def test_hdqs_orders_texts(spark):
    df = spark.createDataFrame([(1, "A clear paragraph explains how careful measurement of corpora helps people choose training data with confidence."), (2, "$$$ !!! template <div> template <div> $$$ template")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in scoring.hdqs(df).collect()}
    assert s[1] > s[2] and all(0 <= v <= 1 for v in s.values())


def test_every_filter_decides_every_row(docs):
    for name in ["raw", "length_filter", "c4_style_proxy", "gopher_style_proxy", "ccnet_style_protocol", "classifier_quality_proxy", "hdqspp", "perplexity_proxy", "exact_dedup", "random_same_keep_rate", "minhash_near_dedup"]:
        got = filters.decide(docs, name, 0.5)
        assert got.columns == ["doc_id", "keep", "score", "reason"], name
        assert got.count() == len(TEXTS), name
    with pytest.raises(ValueError):
        filters.decide(docs, "no such filter")
    kept = {r["doc_id"]: r["keep"] for r in filters.decide(docs, "c4_style_proxy").collect()}
    assert not kept[4] and kept[5]


def test_registry_has_all_names():
    assert len(filters.REGISTRY) + len(filters.ALIASES) == 27


def test_redaction_and_cleaning(spark):
    df = spark.createDataFrame([(1, "write a.b@c.org, call +1 412 555 1234, see ID-12-3456"), (2, "<p>a</p> https://x.y/z  b")], "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in df.select("doc_id", pipeline.redact(F.col("text")), pipeline.clean(F.col("text"))).collect()}
    assert got[1][0] == "write <EMAIL>, call <PHONE>, see <ID>" or got[1][0] == "write <EMAIL>, call +<PHONE>, see <ID>"
    assert got[2][1] == "a b"


def test_noise_and_canaries(spark):
    df = spark.createDataFrame([(k, f"document {k} says the thing") for k in range(30)], "doc_id long, text string")
    noisy = pipeline.noise(df)
    texts = {(r["doc_id"], r["kind"]): r["text"] for r in noisy.collect()}
    assert "editor7@example.org" in texts[(7, "document")] and "ID-13-0007" in texts[(7, "document")]
    assert texts[(0, "document")].startswith("<article><nav>archive</nav>document 0 says tbe th1ng</article>")
    assert texts[(8, "near_duplicates")].endswith(" updated") and (14, "low_information_pages") in texts
    assert pipeline.noise(df, set()).count() == 30
    values = spark.createDataFrame([("editor7@example.org",), ("ID-13-0014",)], "value string")
    raw = noisy.where("kind = 'document'")
    row = pipeline.canaries(raw, raw.withColumn("text", pipeline.redact(F.col("text"))), values).first()
    assert row["detected_before"] == 2 and row["residual_after"] == 0 and row["recall"] == 1.0
    assert pipeline.noise(df, intensity=0).count() == 30 and pipeline.noise_counts(df, intensity=0).count() == 0
    counts = {r["family"]: r["n"] for r in pipeline.noise_counts(df).collect()}
    assert counts["html_boilerplate"] == 10 and counts["pii_canaries"] == 5 and counts["near_duplicates"] == noisy.where("kind = 'near_duplicates'").count()


def test_canaries_are_found_wherever_they_stand(spark):
    """By hand: of four values three are there; one is left; four placeholders, two of them for no canary."""
    raw = spark.createDataFrame([(1, "mail a@b.org, (+1 412 555 1000)xID-13-0007x other@c.org other@d.org"), (2, None)], "doc_id long, text string")
    done = spark.createDataFrame([(1, "mail <EMAIL>, (<PHONE>)xID-13-0007x <EMAIL> <EMAIL>")], "doc_id long, text string")
    values = spark.createDataFrame([("a@b.org",), ("+1 412 555 1000",), ("ID-13-0007",), ("not there",)], "value string")
    row = pipeline.canaries(raw, done, values).first()
    assert [row[c] for c in ("canaries", "detected_before", "residual_after", "placeholders", "side_effects")] == [4, 3, 1, 4, 2]
    assert (row["recall"], row["precision"], row["false_positive_rate"], row["exposure_bits"]) == (2 / 3, 0.5, 0.5, 1.0) and row["status"].startswith("residual")


def test_sweep(spark):
    df = spark.createDataFrame([(k, " ".join(f"word{j * (k + 1) % (k + 2)}" for j in range(20)) + (" a@b.org" if k % 4 == 0 else "")) for k in range(12)], "doc_id long, text string")
    rows = pipeline.sweep(df).collect()
    assert len(rows) == 4 * (7 + 3) and {r["cut"] for r in rows if r["kind"] == "threshold"} == {0.74, 0.76, 0.78, 0.80, 0.82, 0.84, 0.86}
    assert {r["cut"]: r["documents"] for r in rows if r["kind"] == "ratio"} == {0.25: 3, 0.5: 6, 0.75: 9}
    best = [r for r in rows if r["best"]]
    assert len(best) == 4 and all(b["objective"] == max(r["objective"] for r in rows if r["weights"] == b["weights"] and r["kind"] == "threshold") for b in best)
    assert pipeline.sweep(df.limit(0)).count() == 40


def test_bpe(spark):
    df = spark.createDataFrame([(1, "low low low lower lowest"), (2, None)], "doc_id long, text string")
    merges = tokenizers.bpe_merges(df, 3)
    assert merges[0] == (b"l", b"o") and merges[1] == (b"lo", b"w")
    got = {r["doc_id"]: r["pieces"] for r in tokenizers.bpe_encode(df, merges).collect()}
    assert b"".join(bytes.fromhex(p) for p in got[1]).decode() == "lowlowlowlowerlowest" and got[2] == []
    vocabulary = tokenizers.characters(df)
    ids = df.where("doc_id = 1").select(tokenizers.character_ids(F.col("text"), vocabulary)).first()[0]
    assert "".join(vocabulary[k] for k in ids) == "low low low lower lowest"


def test_one_worker_counts_characters_and_runs(spark):
    plan = scoring.components(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_batches_are_decoded_by_slices():
    import pyarrow as pa

    parts = list(counts._parts(pa.array(["x" * 300_000] * 9 + ["y"])))
    assert [len(p) for p in parts] == [4, 4, 2]


def test_cooccurrence_counts_pairs_once(spark):
    """Against brute force; where keys clash, tokens are keys. Only keys, not tokens, are counted, and a pair with its reverse."""
    texts = ["a b a a c", "c c", "b", "", None, "x a b x a b a", "é ß A B"]
    n = Counter()
    for t in texts:
        k = toks(t or "")
        for d in (1, 2):
            for x, y in zip(k, k[d:]):
                n[x, y] += 1
                n[y, x] += 1
    one = Counter()
    for (x, _), c in n.items():
        one[x] += c
    want = {(x, y): (c, round(max(0.0, math.log2(c * sum(n.values()) / (one[x] * one[y]))), 6)) for (x, y), c in n.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for key in (F.xxhash64, lambda c: F.xxhash64(c) % 2):
        found = pipeline.cooccurrence(df, key=key)
        rows = found.collect()
        assert len(rows) == len(want) and {(r["a"], r["b"]): (r["n"], round(r["ppmi"], 6)) for r in rows} == want
    plan = pipeline.cooccurrence(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and plan.count("Aggregate [") == 1
    assert pipeline.cooccurrence(df.limit(0)).count() == 0


def test_runs_by_sorting_are_those_of_each_text():
    """A slice of texts against one text at a time, also where numbers of runs don't fit; no text becomes tokens in Python."""
    import pyarrow as pa

    texts = ["", "a", "a a", "a b a b a", "", " ".join(f"w{k * k % 97}" for k in range(500)), "b a"]
    want = [counts.count_runs(t.split(" ") if t else []) for t in texts]
    assert counts.batch_runs(pa.array(texts)).tolist() == [list(map(float, w)) for w in want]
    assert counts.batch_runs(pa.array(["", ""])).tolist() == [[0.0] * 3] * 2 and len(counts.batch_runs(pa.array([], pa.string()))) == 0
    long = " ".join(map(str, range(2**21)))
    assert counts.batch_runs(pa.array(["x x", long])).tolist() == [[0.0, 1.0, 0.0], [21.0, 2**21 - 1, 2**21 - 2]]


def test_characters_by_their_kinds():
    """Rare and far apart code points take another way than texts of common ones."""
    for t in ["", "a,b.c! (d) [e]", "\U0001f600", "中文 a1\x01\u2019", "x" * 5000 + "中", "é\n\t;"]:
        c = {k: v[0] for k, v in counts.count_characters([t]).items()}
        assert list(c) == list(counts.CHARACTERS)
        assert c["n_punct"] == sum(x in ".,;:!?\"'()[]{}" for x in t) and c["n_alpha"] == sum(x.isalpha() for x in t) and c["n_cjk"] == sum("一" <= x <= "鿿" for x in t)
        assert c["n_char_kinds"] == len(set(t)) and abs(c["char_entropy_bits"] - entropy(t)) < 1e-9


def test_baseline_suite_reads_texts_once(spark):
    """Scores of all baselines come from one pass; ties of the most frequent tokens are looked up alone, of equal ones the first."""
    df = spark.createDataFrame([(k, f"w{k % 7} the cat w{k} and the {'dog' * (k % 3)} w{k + 1}. Sat, on the mat{k % 5}!") for k in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    profiles, plain = [], X.profile
    try:
        X.profile = lambda *a, **b: profiles.append(1) or plain(*a, **b)
        rows = {r["name"]: r for r in pipeline.baseline_suite(df).collect()}
    finally:
        X.profile = plain
    assert len(profiles) == 1 and set(rows) == set(pipeline.BASELINES)
    assert rows["raw"]["output_documents"] == 62 and rows["dedup_only"]["output_documents"] == 61
    for name, off in (("hdqspp_v2", "hdqspp_v2"), ("hdqspp_v2_no_token_frequency", "v2_without_token_frequency_preservation")):
        assert rows[name]["output_documents"] == select.select_v2_variant(df, off).where("keep").count()
    assert rows["hdqspp_v3"]["output_documents"] == select.select_v3_variant(df, seed=13).where("keep").count()
    seen = Counter(t for k in df.orderBy("doc_id").collect() for t in toks(k["text"] or ""))
    order = [t for t, _ in sorted(seen.items(), key=lambda x: -x[1])]  # stable: first to occur
    some = scoring.FEW
    try:
        for scoring.FEW in (some, 2):
            for top in (1, 3, 9, 40, 1000):
                assert set(scoring.frequent_tokens(df, top)) == set(order[:top])
    finally:
        scoring.FEW = some
    sizes = sorted(len(toks(r["text"] or "")) for r in df.collect())
    assert scoring._order_statistics(scoring._lengths(df), lambda n: list(range(n))) == sizes


def test_lines_are_stripped_where_they_have_to_be(spark):
    texts = ["", None, "a", " a", "a ", " a b　\n\n \t\n c", "a\r\nb \rc\x0bd\x85e  f ", "\n", "x\ty", "é ", "\U0001f600 \n \U0001f600"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    plain = F.filter(F.transform(F.split("text", "\\r\\n|[\\n\\r\\x0B\\f\\x85  ]"), X.strip), lambda t: t != "")
    rows = df.select(X.lines(F.col("text")).alias("a"), plain.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[5]["a"] == ["a b", "c"]
    plan = df.select(X.lines(F.col("text")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan.split("regexp_replace")[0]  # most lines are left as they are
