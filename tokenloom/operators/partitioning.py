"""Centroid clustering: k-means, mini-batch k-means, bisecting, cluster features."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.vectors import as_vector, l2_normalize, stack_rows, vector_sum
from tokenloom.operators.assign import nearest_centroid
from tokenloom.operators.bisecting import MOST_COST, fit_split_tree
from tokenloom.operators.evaluate import cluster_moments
from tokenloom.session import materialize

MAX_ITER = 100
CENTROIDS = "cluster bigint, n double, centroid array<double>"


def prepared(vectors: DataFrame, *, embedding: str = "embedding", normalize: bool = True) -> DataFrame:
    vector = l2_normalize(embedding) if normalize else F.col(embedding).cast("array<double>")
    return vectors.withColumn(embedding, vector)


def _featured(vectors: DataFrame, embedding: str) -> DataFrame:
    return vectors.withColumn("features", as_vector(embedding))


def _centers(spark, centers: list[np.ndarray]) -> DataFrame:
    """Model centers (k x d, already on the driver as the fitted model) as a centroid table."""
    rows = [(index, 0.0, [float(x) for x in center]) for index, center in enumerate(centers)]
    return spark.createDataFrame(rows, CENTROIDS)


def _check_size(vectors: DataFrame, k: int) -> int:
    if k < 1:
        raise ValueError("n_clusters must be positive")
    rows = vectors.count()
    if rows < k:
        raise ValueError(f"n_clusters={k} exceeds feature rows={rows}")
    return rows


def _mean_centroid(vectors: DataFrame, embedding: str, weight: str | None = None) -> DataFrame:
    """The centroid table of one cluster."""
    share = F.col(weight) if weight else F.lit(1.0)
    scaled = vectors.select(F.transform(embedding, lambda x: x * share).alias("scaled"), share.alias("share"))
    total = scaled.agg(vector_sum("scaled").alias("total"), F.sum("share").alias("n")).where("n > 0")
    return total.select(
        F.lit(0).cast("bigint").alias("cluster"),
        F.col("n").cast("double").alias("n"),
        F.transform("total", lambda x: x / F.col("n")).alias("centroid"),
    )


def fit_kmeans(
    vectors: DataFrame,
    k: int,
    *,
    embedding: str = "embedding",
    seed: int = 42,
    n_init: int = 1,
    max_iter: int = MAX_ITER,
    tolerance: float = 1e-4,
    weight: str | None = None,
) -> DataFrame:
    """Centroid table of the best of ``n_init`` k-means fits; one centroid is the (weighted) mean of all rows."""
    if k == 1:
        return _mean_centroid(vectors, embedding, weight)
    featured = _featured(vectors, embedding)
    best = None
    for attempt in range(max(1, n_init)):
        estimator = KMeans(k=k, seed=seed + attempt, maxIter=max_iter, tol=tolerance)
        if weight:
            estimator = estimator.setWeightCol(weight)
        model = estimator.fit(featured)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return _centers(vectors.sparkSession, best.clusterCenters())


def fit_bisecting(
    vectors: DataFrame,
    k: int,
    *,
    embedding: str = "embedding",
    seed: int = 42,
    strategy: str = MOST_COST,
    n_init: int = 1,
    max_iter: int = MAX_ITER,
) -> DataFrame:
    """Centroid table of bisecting k-means by cost or by rows (:func:`fit_split_tree`)."""
    tree = fit_split_tree(vectors, k, embedding=embedding, seed=seed, strategy=strategy, n_init=n_init, max_iter=max_iter)
    return tree.centroids(vectors.sparkSession)


def minibatch_step(centroids: DataFrame, batch: DataFrame, *, embedding: str = "embedding") -> DataFrame:
    """Move the centroids to the running mean after one batch: one assignment pass and one small aggregate."""
    assigned = nearest_centroid(batch.select(embedding), centroids, embedding=embedding)
    moments = cluster_moments(assigned, embedding=embedding).select("cluster", F.col("n").alias("added"), "vector_sum")
    total = F.col("n") + F.col("added")
    moved = F.zip_with("centroid", "vector_sum", lambda old, extra: (old * F.col("n") + extra) / total)
    return centroids.join(moments, "cluster", "left").select(
        "cluster",
        F.coalesce(total, F.col("n")).alias("n"),
        F.when(F.col("added").isNull(), F.col("centroid")).otherwise(moved).alias("centroid"),
    )


def fit_minibatch_kmeans(
    vectors: DataFrame,
    k: int,
    *,
    key: list[str],
    batch_size: int = 4096,
    n_init: int = 1,
    embedding: str = "embedding",
    seed: int = 42,
) -> DataFrame:
    """Mini-batch k-means: every row takes part in exactly one batch of about ``batch_size`` rows.

    Rows are stored once, partitioned by batch, so a step reads its own files only. The first batch seeds the
    centroids; of ``n_init`` seeds the model of the least cost over all rows is kept.
    """
    rows = _check_size(vectors, k)
    if k == 1:
        return _mean_centroid(vectors, embedding)
    batches = max(1, -(-rows // max(batch_size, k)))
    number = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(batches)).cast("int")
    if batches == 1:
        stored = vectors.select(embedding, F.lit(0).alias("batch"))
    else:
        stored = materialize(
            vectors.select(embedding, number.alias("batch")), "batches", partition_by=["batch"]
        )
    first = stored.filter(F.col("batch") == 0)
    if batches > 1 and first.count() < k:
        first = stored
    best, least = None, None
    for attempt in range(max(1, n_init)):
        found = _minibatch_run(stored, first, k, batches, embedding=embedding, seed=seed + attempt)
        if n_init <= 1:
            return found
        cost = _cost(stored.select(embedding), found, embedding)
        if least is None or cost < least:
            best, least = found, cost
    return best


def _minibatch_run(
    stored: DataFrame, first: DataFrame, k: int, batches: int, *, embedding: str, seed: int
) -> DataFrame:
    centroids = fit_kmeans(first, k, embedding=embedding, seed=seed, max_iter=1)
    for batch in range(batches):
        moved = minibatch_step(centroids, stored.filter(F.col("batch") == batch), embedding=embedding)
        # The model (k x d) is what a fitted estimator keeps on the driver; bringing it back cuts the lineage.
        centroids = stored.sparkSession.createDataFrame(moved.toPandas(), CENTROIDS)
    return centroids


def _cost(rows: DataFrame, centroids: DataFrame, embedding: str) -> float:
    """Sum of squared distances of all rows to their nearest centroid."""
    assigned = nearest_centroid(rows, centroids, embedding=embedding)
    near = assigned.join(F.broadcast(centroids.select("cluster", "centroid")), "cluster")
    gaps = F.aggregate(
        F.zip_with(embedding, "centroid", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda total, one: total + one
    )
    return near.agg(F.sum(gaps)).first()[0]


def cluster_features(
    vectors: DataFrame,
    *,
    threshold: float = 0.75,
    branching_factor: int = 100,
    embedding: str = "embedding",
) -> DataFrame:
    """Cluster features ``n, centroid, radius`` formed inside each task.

    A row joins its nearest feature when the merged radius stays within the threshold, else it opens one. A
    task that holds ``branching_factor ** 2`` features hands them on and begins anew with the same threshold, so
    memory is bounded, every row stays counted and the threshold holds everywhere.
    """
    limit = max(4, branching_factor**2)

    def absorb(state: dict[str, np.ndarray], n: np.ndarray, s: np.ndarray, q: np.ndarray, bound: float) -> None:
        for count, total, squares in zip(n, s, q, strict=True):
            size = len(state["n"])
            if size:
                means = state["s"] / state["n"][:, None]
                at = int((((means - total / count) ** 2).sum(1)).argmin())
                merged_n, merged_s = state["n"][at] + count, state["s"][at] + total
                radius = (state["q"][at] + squares) / merged_n - ((merged_s / merged_n) ** 2).sum()
                if radius <= bound * bound:
                    state["n"][at], state["s"][at] = merged_n, merged_s
                    state["q"][at] += squares
                    continue
            state["n"] = np.append(state["n"], count)
            state["s"] = np.vstack([state["s"], total]) if size else total[None, :].copy()
            state["q"] = np.append(state["q"], squares)

    def table(state: dict[str, np.ndarray]) -> pd.DataFrame:
        means = state["s"] / state["n"][:, None]
        spread = np.maximum(state["q"] / state["n"] - (means**2).sum(1), 0.0)
        return pd.DataFrame({"n": state["n"], "centroid": list(means), "radius": np.sqrt(spread)})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {"n": np.zeros(0), "s": np.zeros((0, 0)), "q": np.zeros(0)}
        for batch in batches:
            matrix = stack_rows(batch[embedding])
            for start in range(0, len(matrix), 1024):
                part = matrix[start : start + 1024]
                absorb(state, np.ones(len(part)), part, (part**2).sum(1), threshold)
                if len(state["n"]) > limit:
                    yield table(state)
                    state = {"n": np.zeros(0), "s": np.zeros((0, 0)), "q": np.zeros(0)}
        if len(state["n"]):
            yield table(state)

    return vectors.select(embedding).mapInPandas(build, "n double, centroid array<double>, radius double")


def fit_cluster_features(
    vectors: DataFrame,
    k: int,
    *,
    threshold: float = 0.75,
    branching_factor: int = 100,
    embedding: str = "embedding",
    seed: int = 42,
) -> DataFrame:
    """Two-phase clustering: cluster features per task, then weighted k-means over the features."""
    features = materialize(
        cluster_features(vectors, threshold=threshold, branching_factor=branching_factor, embedding=embedding),
        "features",
    )
    found = features.count()
    if found < k:
        warnings.warn(f"{found} cluster features are fewer than the {k} clusters asked for; lower the threshold", stacklevel=2)
    return fit_kmeans(
        features.withColumn("weight", F.col("n")), min(k, found), embedding="centroid", seed=seed, weight="weight"
    )


__all__ = [
    "cluster_features",
    "fit_bisecting",
    "fit_cluster_features",
    "fit_kmeans",
    "fit_minibatch_kmeans",
    "minibatch_step",
    "prepared",
]
