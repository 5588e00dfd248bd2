"""Numeric methods against numpy: fixed points, residuals, normal equations; the bootstrap against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import analysis, ml


def vectors(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v], float(k % 2)) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label double")


def test_kmeans_is_a_fixed_point(spark):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 5))])
    got = {r["vec_id"]: r["cluster"] for r in ml.kmeans(vectors(spark, rows), "embedding", 3).collect()}
    label = np.array([got[k] for k in range(len(rows))])
    centres = np.stack([rows[label == c].mean(axis=0) for c in range(3)])
    assert (np.linalg.norm(rows[:, None] - centres, axis=2).argmin(axis=1) == label).all()


def test_pca_leaves_the_least_residual(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 5)) + 0.01 * rng.normal(size=(60, 5))
    got = {r["vec_id"]: r["components"] for r in ml.pca(vectors(spark, rows), "embedding", 2).collect()}
    x = np.array([got[k] for k in range(60)])
    _, _, v = np.linalg.svd(rows - rows.mean(axis=0))
    assert np.allclose(np.abs(x), np.abs(rows @ v[:2].T), atol=1e-8)


def test_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 2))
    y = 3 + x @ [2.0, -1.0] + 0.1 * rng.normal(size=50)
    got = ml.linear_model(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, y double"), ["a", "b"], "y")
    want = np.linalg.lstsq(np.c_[np.ones(50), x], y, rcond=None)[0]
    assert np.allclose([r["value"] for r in got.collect()], want)
    line = ml.linear_fit(spark.createDataFrame([(float(k), 2.0 * k**1.5) for k in range(1, 9)], "x double, y double"), "x", "y", logs=True).first()
    assert abs(line["slope"] - 1.5) < 1e-9 and abs(np.exp(line["intercept"]) - 2) < 1e-9


def test_factorisation_finds_a_low_rank(spark):
    rng = np.random.default_rng(6)
    full = rng.random((20, 2)) @ rng.random((2, 12)) + 1
    rows = [(u, i, float(full[u, i])) for u in range(20) for i in range(12) if (u + i) % 5]
    got = ml.factorise(spark.createDataFrame(rows, "u int, i int, r double"), "u", "i", "r", rank=3).collect()
    error, spread = np.sqrt(np.mean([(r["prediction"] - r["r"]) ** 2 for r in got])), np.std([r for *_, r in rows])
    assert len(got) == len(rows) and error < spread / 2  # the penalty of the fit keeps it from being exact


def test_classifiers_separate_what_is_apart(spark):
    rng = np.random.default_rng(7)
    rows = [rng.normal(4 * (k % 2), 0.4, 3) for k in range(200)]
    got = {r["model"]: r["accuracy"] for r in ml.classifier_accuracy(vectors(spark, rows), "embedding", "label").collect()}
    assert len(got) == 3 and all(x > 0.95 for x in got.values())


def test_bootstrap_by_hand(spark):
    rows = [(k, "abc"[k % 2], float(k * k % 17)) for k in range(40)] + [(99, "c", 4.0), (98, "d", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(3)
    keys = {r["id"]: r["k"] % 2**64 for r in df.select("id", F.xxhash64(F.lit(13), "id").alias("k")).collect()}
    cdf = np.cumsum([np.exp(-1) / np.prod(range(1, n + 1)) for n in range(6)])

    def weight(key, sample):
        x = (key + (sample + 1) * 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return int(np.searchsorted(cdf, (x >> 11) / 2.0**53, side="right"))

    for kind, (samples, places, _) in analysis.BOOTSTRAPS.items():
        got = {r["g"]: r for r in analysis.bootstrap_mean(df, "g", "v", ["id"], kind).collect()}
        for g in "ab":
            values = [(v, keys[i]) for i, name, v in rows if name == g]
            means = []
            for s in range(samples):
                w = [weight(k, s) for _, k in values]
                means.append(sum(x * v for x, (v, _) in zip(w, values)) / max(1, sum(w)))
            low, high = (sorted(means)[p] for p in places(samples))
            assert abs(got[g]["ci_low"] - low) < 1e-9 and abs(got[g]["ci_high"] - high) < 1e-9
        alone = got["c"]["ci_low"], got["d"]["ci_low"]
        assert alone == {"interval": (4.0, None), "methods": (4.0, None), "runs": (4.0, 0.0), "inclusive": (None, None), "registry": (None, None)}[kind]
