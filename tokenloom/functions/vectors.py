"""Vector expressions on ``array<float|double>`` columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.labels import _col


def squared_norm(vector: Column | str) -> Column:
    return F.aggregate(
        _col(vector).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x
    )


def dot(left: Column | str, right: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_col(left), _col(right), lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_normalize(vector: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    values = _col(vector).cast("array<double>")
    norm = F.sqrt(squared_norm(vector))
    return F.when(norm > 0, F.transform(values, lambda x: x / norm)).otherwise(values)


def as_vector(vector: Column | str) -> Column:
    return array_to_vector(_col(vector).cast("array<double>"))


def vector_sum(vector: Column | str) -> Column:
    """Positional sum as an aggregate: one buffer per group with map-side combine."""
    return vector_to_array(Summarizer.sum(as_vector(vector)))


def vector_mean(vector: Column | str) -> Column:
    return vector_to_array(Summarizer.mean(as_vector(vector)))


def edge_weight(distance: Column | str, *, metric: str) -> Column:
    """Similarity weight of a neighbour distance."""
    d = _col(distance)
    if metric == "cosine":
        return F.greatest(F.lit(0.0), F.lit(1.0) - d)
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0.0), d))


def stack_rows(series: pd.Series) -> np.ndarray:
    """Arrow batch of vectors as one float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(row, dtype=np.float64) for row in series])
