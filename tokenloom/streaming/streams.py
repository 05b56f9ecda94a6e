"""Structured Streaming: raw text to contexts, online mini-batch k-means, cluster assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tokenloom.operators.assign import nearest_centroid
from tokenloom.operators.contexts import MAX_CONTEXT_TOKENS, MAX_CONTEXT_WORDS, chunk_raw_text
from tokenloom.operators.partitioning import CENTROIDS, fit_kmeans, minibatch_step, prepared

STATE_SCHEMA = f"batch_id bigint, {CENTROIDS}"


def stream_table(spark: SparkSession, path: str, schema: StructType | str, *, file_format: str = "parquet", **options: str) -> DataFrame:
    """Streaming scan of a folder or glob of files."""
    return spark.readStream.format(file_format).schema(schema).options(**options).load(path)


def stream_named_table(spark: SparkSession, folder: str, name: str, schema: StructType | str) -> DataFrame:
    """Streaming scan of the table ``name`` of a folder, whether it is one file or a folder of parts.

    The path is a pattern that only this name fits: a plain path to one file is refused as a stream.
    """
    return stream_table(spark, f"{folder.rstrip('/')}/{name}.parque[t]", schema)


def stream_contexts(
    records: DataFrame,
    *,
    document_index: str,
    text: str = "text",
    max_context_tokens: int = MAX_CONTEXT_TOKENS,
    max_context_word_tokens: int = MAX_CONTEXT_WORDS,
) -> DataFrame:
    """Bounded contexts of arriving text records; stateless, so it runs in append mode without a watermark."""
    return chunk_raw_text(
        records,
        document_index=document_index,
        text=text,
        max_context_tokens=max_context_tokens,
        max_context_word_tokens=max_context_word_tokens,
    )


def write_stream(rows: DataFrame, path: str, checkpoint: str, *, file_format: str = "parquet") -> StreamingQuery:
    """Append a stream to files, processing what is available and stopping."""
    return (
        rows.writeStream.format(file_format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_centroids(spark: SparkSession, state: str, *, before: int | None = None) -> DataFrame | None:
    """Latest centroid table of the state folder, or the latest one before a batch."""
    try:
        versions = spark.read.schema(STATE_SCHEMA).parquet(state)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if before is not None:
        versions = versions.filter(F.col("batch_id") < before)
    latest = versions.agg(F.max("batch_id")).first()[0]
    if latest is None:
        return None
    return versions.filter(F.col("batch_id") == latest).drop("batch_id")


def stream_minibatch_kmeans(
    vectors: DataFrame,
    k: int,
    state: str,
    checkpoint: str,
    *,
    embedding: str = "embedding",
    normalize: bool = True,
    seed: int = 42,
) -> StreamingQuery:
    """Update centroids with every arriving micro-batch.

    Each batch writes its centroids under its own ``batch_id`` and starts from the latest earlier one, so a
    replayed batch overwrites its own version and nothing is counted twice. Batches that arrive before ``k``
    rows were seen wait in the state folder's ``pending`` table.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = prepared(batch.select(embedding), embedding=embedding, normalize=normalize)
        centroids = read_centroids(spark, f"{state}/versions", before=batch_id)
        if centroids is None:
            pending = f"{state}/pending"
            rows.write.mode("overwrite").parquet(f"{pending}/arrived={batch_id}")
            rows = spark.read.parquet(pending).filter(F.col("arrived") <= batch_id).select(embedding)
            if rows.count() < k:
                return
            centroids = fit_kmeans(rows, k, embedding=embedding, seed=seed, max_iter=1)
        moved = minibatch_step(centroids, rows, embedding=embedding)
        moved.coalesce(1).write.mode("overwrite").parquet(f"{state}/versions/batch_id={batch_id}")

    return (
        vectors.writeStream.foreachBatch(update)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_assignments(
    vectors: DataFrame, centroids: DataFrame, *, metric: str = "euclidean", embedding: str = "embedding"
) -> DataFrame:
    """Arriving rows with the cluster of their nearest centroid in a fixed centroid table."""
    return nearest_centroid(vectors, centroids, metric=metric, embedding=embedding)
