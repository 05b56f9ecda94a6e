"""Hierarchy, raw text, vector tables, run artifacts and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.labels import require_columns
from tokenloom.functions.naming import metric_note, score_text

ARTIFACT_TABLES = ["runs", "annotated_tokens", "summary", "scores", "hierarchy_alignment", "label_map"]
MISSING_FIELD = "\u0001"


def read_hierarchy(spark: SparkSession, path: str, *, file_name: str = "*hierarchy.csv") -> DataFrame:
    """Label hierarchy from a headerless CSV file, or from that file anywhere below a folder.

    The first four columns count; an empty or ``NULL`` parent is null.
    """
    columns = ["class_id", "parent_id", "depth", "class_name"]
    reader = (
        spark.read.schema(", ".join(f"{name} string" for name in columns))
        .option("emptyValue", "")
        .option("nullValue", MISSING_FIELD)
        .option("escape", '"')
    )
    if not path.endswith(".csv"):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", file_name)
    rows = reader.csv(path)
    name = F.when(
        F.col("class_name").isNull(), F.raise_error(F.lit(f"{path}: expected at least 4 CSV columns"))
    ).otherwise(F.col("class_name"))
    return rows.select(
        F.regexp_replace("class_id", "^﻿", "").alias("class_id"),
        F.when(~F.col("parent_id").isin("", "NULL"), F.col("parent_id")).alias("parent_id"),
        F.col("depth").cast("int").alias("depth"),
        name.alias("class_name"),
    )


def read_raw_text(
    spark: SparkSession,
    path: str,
    *,
    file_format: str = "parquet",
    text: str = "text",
    seed: int | None = 42,
    shuffle: bool = True,
    key: list[str] | None = None,
) -> DataFrame:
    """Raw text records, in a seeded pseudo-random order unless ``shuffle`` is off.

    The order follows a hash of the seed and the record key, so it is the same on every run and cluster. The
    key ``shuffle_key`` stays in the table: order by it wherever order matters.
    """
    records = spark.read.format(file_format).load(path)
    if file_format == "text" and text != "value":
        records = records.withColumnRenamed("value", text)
    require_columns(records, [text], "raw text")
    return seeded_order(records, key or [text], seed=seed) if shuffle else records


def seeded_order(records: DataFrame, key: list[str], *, seed: int | None = 42) -> DataFrame:
    return records.withColumn("shuffle_key", F.xxhash64(F.lit(seed or 0), *key)).orderBy("shuffle_key", *key)


def write_vectors(vectors: DataFrame, path: str, *, embedding: str = "embedding") -> str:
    require_columns(vectors, [embedding], "vectors")
    vectors.write.mode("overwrite").parquet(path)
    return path


def read_vectors(spark: SparkSession, path: str, *, embedding: str = "embedding", key: list[str] | None = None) -> DataFrame:
    return require_columns(spark.read.parquet(path), [embedding, *(key or [])], "vectors")


def write_artifact(tables: dict[str, DataFrame], path: str) -> str:
    """Write the long result tables of a suite, partitioned by run."""
    if "runs" not in tables:
        raise ValueError("an artifact needs a runs table")
    unknown = sorted(set(tables) - set(ARTIFACT_TABLES))
    if unknown:
        raise ValueError(f"unknown artifact tables: {unknown}")
    for name, table in tables.items():
        require_columns(table, ["run_id"], name).write.mode("overwrite").partitionBy("run_id").parquet(
            f"{path.rstrip('/')}/{name}"
        )
    return path


def read_artifact(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Result tables of a suite; anything without runs is refused."""
    tables: dict[str, DataFrame] = {}
    for name in ARTIFACT_TABLES:
        try:
            tables[name] = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    if "runs" not in tables:
        raise ValueError(f"{path} is not a clustering artifact: it has no runs table")
    return tables


def write_result_table(table: DataFrame, path: str, *, run_label: str = "run_label", file_format: str = "parquet") -> str:
    """One folder per run label, the counterpart of one sheet per run."""
    writer = table.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", "true")
    writer.partitionBy(run_label).save(path)
    return path


def unique_labels(runs: DataFrame, *, base: str = "", label: str = "run_label") -> DataFrame:
    """Run labels cut to 31 characters and made unique with ``_2``, ``_3``, … in run order.

    ``runs`` is the parameter grid of a suite (one row per configured run), so the window is over that list.
    """
    from pyspark.sql import Window as W

    short = F.substring(F.concat(F.lit(base), F.col(label)), 1, 31)
    rank = F.row_number().over(W.partitionBy("_short").orderBy("run_index"))
    suffix = F.concat(F.lit("_"), F.col("_rank").cast("string"))
    named = F.when(F.col("_rank") == 1, F.col("_short")).otherwise(
        F.concat(F.substring(F.col("_short"), F.lit(1), F.lit(31) - F.length(suffix)), suffix)
    )
    return (
        runs.withColumn("_short", short)
        .withColumn("_rank", rank)
        .withColumn("sheet_label", named)
        .drop("_short", "_rank")
    )


def score_lines(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Printable lines ``metric - value - note`` per run, after a title and a heading line."""
    values = scores.select(
        "run_id",
        F.lit(2).alias("part"),
        F.col("metric_index").cast("int").alias("place"),
        F.concat_ws(" - ", "metric", score_text("metric", "value"), metric_note("metric")).alias("line"),
    )
    titles = runs.select(
        "run_id",
        F.posexplode(F.array(F.col("title"), F.lit("metric - result - reference note"))).alias("part", "line"),
    ).select("run_id", "part", F.lit(0).alias("place"), "line")
    return titles.unionByName(values)


def write_scores(comparison: DataFrame, lines: DataFrame, path: str) -> None:
    """Metric comparison as CSV and the printable lines as one text folder per run."""
    base = path.rstrip("/")
    comparison.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{base}/scores_csv")
    (
        lines.repartition("run_id")
        .sortWithinPartitions("run_id", "part", "place")
        .select("run_id", F.col("line").alias("value"))
        .write.mode("overwrite")
        .partitionBy("run_id")
        .text(f"{base}/scores_text")
    )


def clustered_tokens(tokens: DataFrame, assignments: DataFrame, key: list[str]) -> DataFrame:
    """Tokens with their cluster as the first column."""
    return tokens.join(assignments.select(*key, "cluster"), key).select("cluster", *tokens.columns)


def write_csv(table: DataFrame, path: str) -> str:
    flat = [
        F.col(field.name) if field.dataType.simpleString()[:5] not in ("array", "map<s", "struc") else
        F.to_json(field.name).alias(field.name)
        for field in table.schema
    ]
    table.select(*flat).write.mode("overwrite").option("header", "true").csv(path)
    return path


def run_table(spark: SparkSession, configs: list[dict[str, object]]) -> DataFrame:
    """One row per configured run: the named parameters the naming rules use, and the full config as a map."""
    rows = [
        (
            f"run_{index + 1}",
            index,
            config.get("algorithm", "run"),
            config.get("n_clusters"),
            config.get("min_cluster_size"),
            config.get("graph_n_neighbors"),
            {key: str(value) for key, value in config.items()},
        )
        for index, config in enumerate(configs)
    ]
    schema = (
        "run_id string, run_index int, algorithm string, n_clusters int, min_cluster_size int, "
        "graph_n_neighbors int, config map<string,string>"
    )
    return spark.createDataFrame(rows, schema)
