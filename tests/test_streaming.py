from pyspark.sql import functions as F

from tokenloom.operators.contexts import chunk_raw_text
from tokenloom.streaming import streams


def test_stream_matches_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    records = spark.createDataFrame([(i, "слово, " * (i % 7)) for i in range(30)], "id bigint, text string")
    records.repartition(3).write.parquet(source)
    stream = streams.stream_table(spark, source, records.schema, maxFilesPerTrigger="1")
    out = str(tmp_path / "out")
    chunks = streams.stream_contexts(stream, document_index="id", max_context_tokens=5)
    streams.write_stream(chunks, out, str(tmp_path / "log")).awaitTermination()
    expected = chunk_raw_text(records, document_index="id", max_context_tokens=5)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, expected.collect()))


def test_online_kmeans_counts_every_row_once(spark, tmp_path):
    source = str(tmp_path / "in")
    points = spark.range(60).select(F.array((F.col("id") % 2 * 10).cast("double"), F.lit(1.0)).alias("embedding"))
    points.repartition(4).write.parquet(source)
    stream = streams.stream_table(spark, source, points.schema, maxFilesPerTrigger="1")
    state = str(tmp_path / "state")
    streams.stream_minibatch_kmeans(stream, 2, state, str(tmp_path / "log"), normalize=False).awaitTermination()
    centers = streams.read_centroids(spark, f"{state}/versions").collect()
    assert sum(r["n"] for r in centers) == 60
    assert sorted(round(r["centroid"][0], 6) for r in centers) == [0.0, 10.0]
    assigned = streams.stream_assignments(points, streams.read_centroids(spark, f"{state}/versions"))
    assert assigned.groupBy("cluster").count().count() == 2


def test_table_of_one_file_and_of_parts_stream_alike(spark, tmp_path):
    rows = spark.range(40).select("id", F.lit("a b").alias("text"))
    parts = tmp_path / "parts"
    rows.repartition(3).write.parquet(str(parts / "documents.parquet"))
    rows.write.parquet(str(parts / "other.parquet"))
    one = tmp_path / "one"
    one.mkdir()
    rows.coalesce(1).write.parquet(str(tmp_path / "single"))
    next((tmp_path / "single").glob("part-*.parquet")).rename(one / "documents.parquet")
    for folder in (parts, one):
        stream = streams.stream_named_table(spark, str(folder), "documents", rows.schema)
        out = str(tmp_path / f"out-{folder.name}")
        streams.write_stream(stream, out, f"{out}-log").awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(40))
