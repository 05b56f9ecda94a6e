"""Corpus pipeline: quality, toxicity, near copies, benchmark passages, then pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import decontaminate, pieces, quality, simhash, toxicity
from tokenloom.llm.common import stored, table


def _packed(docs: DataFrame) -> DataFrame:
    """Ids and texts beside the whole row, so that no column of the input meets a column of an operator."""
    return docs.select("doc_id", "text", F.struct(*[docs[name] for name in docs.columns]).alias("row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    weights = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(_packed(docs), weights).where("predicted = 1").select("row.*")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity classifier rejects."""
    weights = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(_packed(docs), weights).where("predicted = 0").select("row.*")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies: SimHash links first, then exact likeness."""
    return simhash.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    found = decontaminate.contamination(_packed(docs), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select("row.*")


def into_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document into pieces, with sampled segmentations."""
    return pieces.encode_and_sample(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("near_copies", keep_one_copy),
    ("decontamination", keep_uncontaminated),
    ("pieces", into_pieces),
]

#: Trained classifiers and sampled segmentations have no SQL counterpart; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
