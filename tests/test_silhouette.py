import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators.evaluate import silhouette

SCHEMA = "id bigint, cluster bigint, embedding array<double>"


def table(spark, count=300, width=5, seed=4):
    """Half of all rows in one cluster, noise, a cluster of one row, and repeated vectors."""
    rng = np.random.default_rng(seed)
    owners = np.where(rng.random(count) < 0.5, 0, rng.integers(-1, 4, count))
    owners[7] = 9
    vectors = rng.normal(size=(count, width)) + owners[:, None]
    vectors[20:40] = vectors[20]
    owners[20:40] = 2
    rows = [(at, int(owners[at]), vectors[at].tolist()) for at in range(count)]
    return spark.createDataFrame(rows, SCHEMA).cache(), owners, vectors


def brute_force(owners, vectors):
    kept = owners != -1
    owners, vectors = owners[kept], vectors[kept]
    gaps = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
    widths = []
    for at, own in enumerate(owners):
        if (owners == own).sum() == 1:
            widths.append(0.0)
            continue
        within = gaps[at][owners == own].sum() / ((owners == own).sum() - 1)
        nearest = min(gaps[at][owners == other].mean() for other in set(owners) - {own})
        widths.append((nearest - within) / max(within, nearest))
    return np.mean(widths)


def test_all_rows_in_one_or_many_blocks(spark):
    rows, owners, vectors = table(spark)
    expected = brute_force(owners, vectors)
    for block_bytes in (2 << 20, 40 * 64):
        assert silhouette(rows, key=["id"], block_bytes=block_bytes).first()[0] == pytest.approx(expected, abs=1e-8)


def test_a_sample_is_taken_only_if_asked_for(spark):
    rows, owners, vectors = table(spark)
    hashes = {r["id"]: r["h"] for r in rows.filter("cluster <> -1").select("id", F.xxhash64(F.lit(42), "id").alias("h")).collect()}
    chosen = sorted(hashes, key=hashes.get)[:90]
    found = silhouette(rows, key=["id"], max_samples=90).first()[0]
    assert found == pytest.approx(brute_force(owners[chosen], vectors[chosen]), abs=1e-8)
    whole = silhouette(rows, key=["id"], max_samples=1000).first()[0]
    assert whole == pytest.approx(brute_force(owners, vectors), abs=1e-8)


def test_one_cluster_lone_rows_and_no_rows_have_none(spark):
    rows, _, _ = table(spark, 60)
    assert math.isnan(silhouette(rows.withColumn("cluster", F.lit(1)), key=["id"]).first()[0])
    assert math.isnan(silhouette(rows.withColumn("cluster", F.col("id")), key=["id"]).first()[0])
    assert math.isnan(silhouette(rows.limit(0), key=["id"]).first()[0])
