"""Numeric methods around a corpus, on Spark's own estimators where there is one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved


def _vectors(df: DataFrame, col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.col(col).cast("array<double>")))


def kmeans(df: DataFrame, col: str, k: int, seed: int = 42) -> DataFrame:
    """df with cluster."""
    from pyspark.ml.clustering import KMeans

    rows = _vectors(df, col)
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).withColumnRenamed("prediction", "cluster").drop("features")


def pca(df: DataFrame, col: str, k: int) -> DataFrame:
    """df with components: an array of the first k."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = _vectors(df, col)
    return PCA(k=k, inputCol="features", outputCol="pc").fit(rows).transform(rows).withColumn("components", vector_to_array("pc")).drop("features", "pc")


def factorise(df: DataFrame, user: str, item: str, rating: str, rank: int = 8, seed: int = 42) -> DataFrame:
    """(user, item, rating, prediction) by alternating least squares."""
    from pyspark.ml.recommendation import ALS

    model = ALS(userCol=user, itemCol=item, ratingCol=rating, rank=rank, seed=seed, coldStartStrategy="drop").fit(df)
    return model.transform(df)


def linear_fit(df: DataFrame, x: str, y: str, logs: bool = False) -> DataFrame:
    """One row (slope, intercept, r2) by least squares; with logs of both, as scaling laws are fitted."""
    a, b = (F.ln(F.col(x)), F.ln(F.col(y))) if logs else (F.col(x), F.col(y))
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def anomaly(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with log_density under independent normal distributions fitted to the columns."""
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("v", F.var_pop))]).head()
    terms = [-(F.col(c) - F.lit(s[f"m_{c}"])) ** 2 / F.lit(2 * max(s[f"v_{c}"], 1e-12)) - 0.5 * float(np.log(2 * np.pi * max(s[f"v_{c}"], 1e-12))) for c in cols if s[f"v_{c}"] is not None]
    return df.withColumn("log_density", sum(terms, F.lit(0.0)))


def _tiles(df: DataFrame, id_col: str, col: str, size: int) -> DataFrame:
    """(tile, ids, vectors): rows of a table in tiles of at most so many, as bytes of longs and doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, held = TaskContext.get().partitionId() << 32, 0, []

        def tile(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal n
            n += 1
            return pd.DataFrame({"tile": [part + n], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "vectors": [np.stack(rows["v"].to_numpy()).astype(float).tobytes()]})

        for b in batches:
            held = pd.concat([held, b], ignore_index=True) if len(held) else b
            while len(held) >= size:
                yield tile(held[:size])
                held = held[size:].reset_index(drop=True)
        if len(held):
            yield tile(held)

    rows = df.where(F.col(id_col).isNotNull() & F.col(col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v"))
    return saved(rows.mapInPandas(run, "tile long, ids binary, vectors binary"), "tiles")


def _closest(k: int):
    """Running k nearest of each tile of queries, over the tiles that a task has of the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, q, best_d, best_n = None, None, None, None, None

        def done() -> pd.DataFrame:
            real = np.isfinite(best_d)
            return pd.DataFrame({"query": np.repeat(ids, best_d.shape[1])[real.ravel()], "neighbour": best_n[real], "distance": best_d[real]})

        for b in batches:
            for tile, qi, qv, ni, nv in zip(b["q_tile"], b["q_ids"], b["q_vectors"], b["ids"], b["vectors"]):
                if tile != now:
                    if now is not None:
                        yield done()
                    now, ids = tile, np.frombuffer(qi, dtype=np.int64)
                    q = np.frombuffer(qv).reshape(len(ids), -1)
                    best_d, best_n = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), dtype=np.int64)
                other = np.frombuffer(ni, dtype=np.int64)
                v = np.frombuffer(nv).reshape(len(other), -1)
                d = np.empty((len(ids), len(other)))
                for i, x in enumerate(q):  # differences, not products: equal distances must be equal numbers
                    d[i] = np.sqrt(((x - v) ** 2).sum(axis=1))
                d[ids[:, None] == other] = np.inf
                d, n = np.concatenate([best_d, d], axis=1), np.concatenate([best_n, np.broadcast_to(other, d.shape)], axis=1)
                order = np.lexsort((n, d), axis=1)[:, :k]
                best_d, best_n = np.take_along_axis(d, order, axis=1), np.take_along_axis(n, order, axis=1)
        if now is not None:
            yield done()

    return run


#: Vectors of a tile; tiles of queries that a tile of the table is sent to at once.
TILE, TOGETHER = 1024, 4


def nearest(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(query, neighbour, rank, distance): the k nearest rows of df to each query, by Euclidean distance; equal ones by id.

    Both tables are cut into written tiles; a tile of the table is sent to each group of tiles of queries, and a task keeps
    the k nearest of a tile of queries while tiles pass by. Nothing goes through the driver, so queries may be as many as
    rows. A query isn't its own neighbour. Vectors must be of one length; rows with a null id or vector don't count.
    """
    spark = df.sparkSession
    q, t = _tiles(queries, id_col, col, tile), _tiles(df, id_col, col, tile)
    groups, parts = max(1, -(-q.count() // TOGETHER)), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = q.select(F.pmod(F.xxhash64("tile"), F.lit(groups)).alias("g"), F.col("tile").alias("q_tile"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    t = t.withColumn("h", F.pmod(F.xxhash64("tile"), F.lit(parts))).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = t.join(q, "g").repartition(F.col("q_tile"), F.col("h")).sortWithinPartitions("q_tile", "tile")
    out = met.select("q_tile", "q_ids", "q_vectors", "ids", "vectors").mapInPandas(_closest(k), "query long, neighbour long, distance double")
    # at most k rows of each part of the table
    best = out.groupBy("query").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "neighbour"))), 1, k).alias("b"))
    return best.select("query", F.posexplode("b").alias("p", "x")).select("query", "x.neighbour", (F.col("p") + 1).alias("rank"), "x.distance")


def classifier_accuracy(df: DataFrame, col: str, label: str, seed: int = 42) -> DataFrame:
    """(model, accuracy) of a logistic regression, a decision tree and a small network, on a fifth of rows held out by hash."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier

    rows = _vectors(df, col).withColumn("__held", F.pmod(F.xxhash64(F.lit(seed), F.col(col).cast("string")), F.lit(5)) == 0)
    size = len(rows.select("features").head()[0])
    models = {
        "logistic_regression": LogisticRegression(labelCol=label, maxIter=50),
        "decision_tree": DecisionTreeClassifier(labelCol=label, maxDepth=5, seed=seed),
        "perceptron": MultilayerPerceptronClassifier(labelCol=label, layers=[size, 8, 2], maxIter=50, seed=seed),
    }
    out = None
    for name, model in models.items():
        done = model.fit(rows.where(~F.col("__held"))).transform(rows.where("__held"))
        one = done.agg(F.lit(name).alias("model"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


def linear_model(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """(term, value): intercept and weights of least squares over several columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(df.select(*cols, y))
    fit = LinearRegression(labelCol=y, solver="normal").fit(rows)
    return df.sparkSession.createDataFrame([("intercept", float(fit.intercept)), *zip(cols, map(float, fit.coefficients))], "term string, value double")
