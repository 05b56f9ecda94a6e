"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Texts are lower-cased and every run of white space becomes one space. Features are the distinct character n-grams
of each length in ``LENGTHS``, hashed to ``2**bits`` places and counted as present or absent. Each place carries
r = log of its smoothed share in texts of label 1 over that in texts of label 0; a logistic regression is then fitted
on the scaled features. A stored weight is already r times the fitted coefficient, so scoring is one sparse sum.

Nulls and empty texts have no n-grams and score by the bias alone. Extra columns are kept and never enter a score.
Without labelled rows the score is 0.5; with one class only, it is that class's smoothed share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import (
    first_of_each,
    fit_in_one_task,
    ftrl,
    labelled_sample,
    one_class_bias,
    remainder,
    sigmoid,
    with_score,
)

BITS = 18
LENGTHS = (3, 4, 5)
MAX_TRAINING_ROWS = 4000
THRESHOLD = 0.3
#: Added to both counts of a place; fewest texts for a place to take part; step and sparsity of the fit.
SMOOTHING, LEAST_TEXTS, RATE, L1 = 1.0, 4, 0.1, 8.0
MODULUS, HELD_OUT = 4, 2

_scratch: dict[int, np.ndarray] = {}


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Places of the distinct n-grams of a text; place 0 is left for the bias."""
    text = f" {' '.join(text.lower().split())} "
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(codes) < 3:
        return np.zeros(0, np.int32)
    found = []
    for length in LENGTHS:
        if len(codes) < length:
            break
        value = np.full(len(codes) - length + 1, length, np.uint32)
        for at in range(length):
            value = value * np.uint32(0x01000193) ^ codes[at : len(codes) - length + 1 + at]
        found.append((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))
    places = np.maximum(np.concatenate(found).astype(np.int32), 1)
    if bits not in _scratch:
        _scratch[bits] = np.zeros(1 << bits, np.int32)
    return first_of_each(places, _scratch[bits])


def fit(rows: list[np.ndarray], y: np.ndarray, *, bits: int = BITS, epochs: int = 6) -> np.ndarray:
    """Log-count ratios, then a sparse logistic regression on the scaled features; entry 0 is the bias."""
    size = 1 << bits
    if (bias := one_class_bias(y)) is not None:
        weights = np.zeros(size)
        weights[0] = bias
        return weights
    counts = np.zeros((2, size))
    for places, label in zip(rows, y, strict=True):
        counts[int(label)][places] += 1
    share = (counts + SMOOTHING) / (np.array([[len(y) - y.sum()], [y.sum()]]) + 2 * SMOOTHING)
    ratio = np.log(share[1] / share[0])
    ratio[counts.sum(axis=0) < LEAST_TEXTS] = 0.0
    ratio[0] = 1.0
    examples = []
    for places in rows:
        index = np.append(np.sort(places[ratio[places] != 0]), 0)
        examples.append((index, ratio[index]))
    return ftrl(examples, y, size, alpha=RATE, l1=L1, l2=0.01, epochs=epochs) * ratio


def score(text: str, weights: np.ndarray) -> float:
    if not len(weights):
        return 0.5
    return sigmoid(weights[0] + weights[features(text, len(weights).bit_length() - 1)].sum())


def train_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    *,
    modulus: int = MODULUS,
    held_out: int = HELD_OUT,
    max_rows: int = MAX_TRAINING_ROWS,
) -> np.ndarray:
    """Weights fitted on at most ``max_rows`` labelled rows outside the held-out fold (see ``labelled_sample``)."""
    sample = labelled_sample(documents, labels, "toxic", modulus=modulus, held_out=held_out, max_rows=max_rows)
    return fit_in_one_task(sample, features, fit)


def score_toxicity(documents: DataFrame, weights: np.ndarray, *, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with held_out, score and predicted; every text is scored whole."""
    return (
        with_score(documents, weights, score)
        .withColumn("held_out", remainder("doc_id", MODULUS) == HELD_OUT)
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
