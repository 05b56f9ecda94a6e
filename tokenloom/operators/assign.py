"""Nearest-centroid assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.vectors import l2_normalize, stack_rows
from tokenloom.operators.evaluate import NOISE, centroids_of, vector_blocks


def _nearest(vector: Column, labels: np.ndarray, matrix: np.ndarray) -> Column:
    """Label and squared distance of the nearest row of ``matrix``; the lowest label wins ties."""
    order = np.argsort(labels, kind="stable")
    labels, matrix = labels[order], matrix[order]
    norms = (matrix**2).sum(1)

    @F.pandas_udf("distance double, cluster bigint")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        here = stack_rows(vectors)
        if not len(here):
            return pd.DataFrame({"distance": [], "cluster": []})
        squares = (here**2).sum(1)[:, None] - 2 * here @ matrix.T + norms[None, :]
        at = squares.argmin(1)
        return pd.DataFrame({"distance": squares[np.arange(len(here)), at], "cluster": labels[at]})

    return nearest(vector)


def nearest_centroid(
    rows: DataFrame,
    centroids: DataFrame,
    *,
    metric: str = "euclidean",
    embedding: str = "embedding",
    cluster: str = "cluster",
    centroid: str = "centroid",
    output: str = "cluster",
) -> DataFrame:
    """Rows with the label of their nearest centroid; -1 when there is no centroid but noise.

    The centroid table is measured and sent to the tasks in blocks of bounded size; with several blocks the
    best of each is compared row by row, so any number of centroids is handled exactly. No shuffle.
    """
    usable = centroids.filter(F.col(cluster) != NOISE).select(
        F.col(cluster).cast("bigint").alias("_label"),
        (l2_normalize(centroid) if metric == "cosine" else F.col(centroid)).alias("_center"),
    )
    vector = l2_normalize(embedding) if metric == "cosine" else F.col(embedding)
    found: list[Column] = []
    working = rows.withColumn("_vector", vector)
    for block, (labels, matrix, _) in enumerate(vector_blocks(usable, "_label", "_center")):
        working = working.withColumn(f"_near_{block}", _nearest(F.col("_vector"), labels, matrix))
        found.append(F.col(f"_near_{block}"))
    if not found:
        return rows.withColumn(output, F.lit(NOISE).cast("bigint"))
    best = found[0] if len(found) == 1 else F.least(*found)
    return working.withColumn("_best", best).select(
        *[name for name in rows.columns if name != output], F.col("_best.cluster").alias(output)
    )


def assign_to_training_clusters(
    training: DataFrame,
    evaluation: DataFrame,
    *,
    metric: str = "euclidean",
    cluster: str = "cluster",
    embedding: str = "embedding",
) -> DataFrame:
    """Label evaluation rows by the nearest mean of the labelled training rows, noise left out."""
    means = centroids_of(training.filter(F.col(cluster) != NOISE), cluster=cluster, embedding=embedding)
    return nearest_centroid(evaluation, means, metric=metric, embedding=embedding, cluster=cluster)
