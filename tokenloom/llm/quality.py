"""Quality classifier: hashed word n-grams, logistic regression trained by follow-the-regularised-leader updates.

A text is cut into words (letters, digits, anything beyond ASCII) and runs of symbols. Features are the single tokens
and pairs of neighbours, hashed to ``2**bits`` places; a word next to itself is one feature of its own, whatever the
word. A feature counts by its share of the text, so a score is the sparse dot product of shares and weights.

Nulls and empty texts have no features and score by the bias alone. Extra columns are left out of the score and kept.
Without labelled rows the score is 0.5; with one class only, it is that class's smoothed share.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import (
    fit_in_one_task,
    ftrl,
    labelled_sample,
    one_class_bias,
    remainder,
    sigmoid,
    with_score,
)

BITS = 18
MAX_TRAINING_ROWS = 6000
THRESHOLD = 0.5
MODULUS, HELD_OUT = 3, 1

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_MIX = 0x9E3779B1
_REPEAT = 1


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Feature places of a text, one entry per occurrence; place 0 is left for the bias."""
    tokens = _TOKEN.findall(text.encode("utf-8", "replace"))
    if not tokens:
        return np.zeros(0, np.int32)
    words = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    pairs = (words[:-1] * np.uint64(_MIX) + words[1:] * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)
    every = np.concatenate([words, pairs])
    places = ((every * np.uint64(_MIX)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)
    places = np.maximum(places.astype(np.int32), 2)
    places[len(words) :][words[:-1] == words[1:]] = _REPEAT
    return places


def fit(rows: list[np.ndarray], y: np.ndarray, *, bits: int = BITS, epochs: int = 4) -> np.ndarray:
    """Per-coordinate FTRL-proximal logistic regression; returns dense weights, entry 0 the bias."""
    if (bias := one_class_bias(y)) is not None:
        weights = np.zeros(1 << bits)
        weights[0] = bias
        return weights
    examples = []
    for places in rows:
        index, counts = np.unique(np.append(places, 0), return_counts=True)
        shares = counts * _scale(len(places))
        shares[0] = 1.0
        examples.append((index, shares))
    return ftrl(examples, y, 1 << bits, alpha=0.5, l1=0.02, l2=0.05, epochs=epochs)


def _scale(length: int) -> float:
    return 20.0 / max(length, 20)


def score(text: str, weights: np.ndarray) -> float:
    if not len(weights):
        return 0.5
    places = features(text, len(weights).bit_length() - 1)
    return sigmoid(weights[0] + weights[places].sum() * _scale(len(places)))


def train_quality(
    documents: DataFrame,
    labels: DataFrame,
    *,
    modulus: int = MODULUS,
    held_out: int = HELD_OUT,
    max_rows: int = MAX_TRAINING_ROWS,
) -> np.ndarray:
    """Weights fitted on at most ``max_rows`` labelled rows outside the held-out fold (see ``labelled_sample``)."""
    sample = labelled_sample(documents, labels, "quality", modulus=modulus, held_out=held_out, max_rows=max_rows)
    return fit_in_one_task(sample, features, fit)


def score_quality(documents: DataFrame, weights: np.ndarray, *, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with held_out, score and predicted; every text is scored whole."""
    return (
        with_score(documents, weights, score)
        .withColumn("held_out", remainder("doc_id", MODULUS) == HELD_OUT)
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
