"""Helpers that several of the text-preparation operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import materialize, short_lived_shuffles  # noqa: F401

#: ASCII white space, as a regular expression class.
SPACES = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and keeps costly columns from being computed twice."""
    return materialize(df, name)


def release_memory() -> None:
    """Give the pages of freed arrays back to the system, which the C library otherwise keeps for the life of a worker."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the quicker built-in, which then does the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def mixed(value: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers; no two numbers share one."""
    with np.errstate(over="ignore"):
        value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return value ^ (value >> np.uint64(31))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(or_empty(F.col(doc_id).cast("string"))), F.lit(modulus))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, *, modulus: int, held_out: int, max_rows: int
) -> DataFrame:
    """At most ``max_rows`` labelled documents (doc_id, text, y) outside the held-out fold, by hash order of the id.

    The ids are chosen from the label table alone, so no text passes through the limit. Null labels and null ids are
    left out; repeated label rows of an id count once (the largest), repeated documents of an id once (least text).
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return (
        documents.select("doc_id", or_empty("text").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
    )


def fit_in_one_task(sample: DataFrame, features: Callable[[str], np.ndarray], fit: Callable) -> np.ndarray:
    """Turn a bounded sample into features in parallel, fit in one task, and bring back the weight vector.

    ``fit(list of feature arrays, labels)`` returns a dense vector, whose length is a parameter of the model.
    """

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id, "y": frame.y, "x": [features(text) for text in frame.text]})

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        weights = fit([np.asarray(x) for x in frame.x], frame.y.to_numpy(np.float64))
        return pd.DataFrame({"weights": [weights]})

    rows = (
        sample.mapInPandas(extract, "doc_id bigint, y int, x array<int>")
        .groupBy(F.lit(0).alias("model"))
        .applyInPandas(train, "weights array<double>")
        .collect()
    )
    return np.array(rows[0].weights, dtype=np.float64) if rows else np.zeros(0)


def with_score(documents: DataFrame, weights: np.ndarray, score: Callable[[str, np.ndarray], float]) -> DataFrame:
    """Add ``score`` in 0..1 per row; ``weights`` are broadcast (their size is a parameter)."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([score(text or "", model) for text in texts], dtype="float64")

    return documents.withColumn("score", scored(or_empty("text")))


def sigmoid(value: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(value, -40.0, 40.0))))


def first_of_each(index: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Distinct entries of ``index`` without sorting; ``scratch`` is any int32 array that covers all entries."""
    order = np.arange(len(index), dtype=np.int32)
    scratch[index] = order
    return index[scratch[index] == order]


def ftrl(
    examples: list[tuple[np.ndarray, np.ndarray]],
    y: np.ndarray,
    size: int,
    *,
    alpha: float,
    beta: float = 1.0,
    l1: float,
    l2: float,
    epochs: int,
    seed: int = 7,
) -> np.ndarray:
    """Logistic regression by per-coordinate follow-the-regularised-leader updates over sparse examples.

    Each example is (distinct places, values); places with an accumulated gradient within ``l1`` keep weight 0.
    """
    z, n = np.zeros(size), np.zeros(size)

    def solved(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        kept = np.abs(zi) > l1
        return np.where(kept, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    generator = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in generator.permutation(len(examples)):
            index, x = examples[at]
            zi, ni = z[index], n[index]
            w = solved(zi, ni)
            gradient = (sigmoid(float(w @ x)) - y[at]) * x
            grown = ni + gradient * gradient
            z[index] = zi + gradient - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[index] = grown
    return solved(z, n)


def one_class_bias(y: np.ndarray) -> float | None:
    """Log odds of the smoothed share if the labels have one class only (or none), else None."""
    positives = float(y.sum())
    if positives in (0.0, float(len(y))):
        return float(np.log((positives + 1) / (len(y) - positives + 1)))
    return None
