"""Label statistics: frequencies, cumulative thresholds, and "value: count" texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions.labels import has_valid_label, has_valid_text, require_columns
from tokenloom.functions.order import first_seen


def label_counts(tokens: DataFrame, *, label: str = "SEMCLASS", order: list[str] | None = None) -> DataFrame:
    """Label frequencies in descending order; ties by first appearance when ``order`` is given."""
    require_columns(tokens, [label], "tokens")
    first = first_seen(tokens, order) if order else F.min(F.col(label).cast("string"))
    counts = (
        tokens.filter(has_valid_label(label))
        .groupBy(F.col(label).cast("string").alias("semclass"))
        .agg(F.count("*").alias("token_count"), first.alias("_first"))
    )
    return counts.orderBy(F.desc("token_count"), "_first").drop("_first")


def threshold_table(
    counts: DataFrame, *, max_occurrences: int = 15, existing_semclass_count: int | None = None
) -> DataFrame:
    """For n = 1…``max_occurrences``: labels seen at least n times and the tokens they cover.

    Each label meets at most ``max_occurrences`` thresholds, so it is expanded to those instead of joined to
    all of them.
    """
    if max_occurrences < 1:
        raise ValueError(f"thresholds start at 1, not {max_occurrences}")
    met = counts.withColumn(
        "minimum_occurrences",
        F.explode(F.sequence(F.lit(1), F.least(F.col("token_count"), F.lit(max_occurrences)).cast("int"))),
    )
    covered = met.groupBy("minimum_occurrences").agg(
        F.count("*").alias("semclass_count"), F.sum("token_count").alias("labeled_token_count")
    )
    steps = counts.sparkSession.range(1, max_occurrences + 1).select(
        F.col("id").cast("int").alias("minimum_occurrences")
    )
    minimum = F.col("minimum_occurrences")
    table = steps.join(covered, "minimum_occurrences", "left").select(
        minimum,
        F.when(minimum == 1, "semantic classes observed at least 1 time")
        .otherwise(F.format_string("semantic classes present at least %d times", minimum))
        .alias("description"),
        *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in ("semclass_count", "labeled_token_count")],
    )
    if existing_semclass_count is not None:
        table = table.withColumn("existing_semclass_count", F.lit(existing_semclass_count))
    return table.orderBy("minimum_occurrences")


def hierarchy_class_count(hierarchy: DataFrame) -> DataFrame:
    require_columns(hierarchy, ["class_id"], "hierarchy")
    return hierarchy.agg(F.countDistinct("class_id").alias("semclass_count"))


def infer_cluster_count(tokens: DataFrame, *, label: str = "SEMCLASS") -> int:
    """Number of distinct usable labels; an error if there is none."""
    require_columns(tokens, [label], "tokens")
    distinct = tokens.filter(has_valid_text(label)).agg(F.countDistinct(label)).first()[0]
    if distinct < 1:
        raise ValueError("cannot infer clusters: no usable labels found")
    return int(distinct)


def value_counts(
    df: DataFrame, by: list[str], value: str, *, order: list[str], keep: Column | None = None
) -> DataFrame:
    """Counts per group and value with the first appearance: ``by…, value, count, first``."""
    rows = df.filter(keep) if keep is not None else df
    return rows.groupBy(*by, F.col(value).cast("string").alias("value")).agg(
        F.count("*").alias("count"), first_seen(rows, order).alias("first")
    )


def counts_text(
    counts: DataFrame,
    by: list[str],
    *,
    name: str,
    top_n: int | None = None,
    value: str = "value",
    separator: str = "\n",
    with_count: bool = True,
) -> DataFrame:
    """One text per group, largest count first, ties by first appearance.

    Works on pre-aggregated ``counts``. With ``top_n`` the ranking window keeps only the first values of every
    group (the limit is applied before the shuffle); without it the text holds every distinct value, as the
    format demands.
    """
    ranked = counts
    if top_n is not None:
        order = W.partitionBy(*by).orderBy(F.desc("count"), "first")
        ranked = counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top_n)
    line = F.concat_ws(": ", value, F.col("count").cast("string")) if with_count else F.col(value)
    packed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("rank"), "first", line.alias("line"))))
    return ranked.groupBy(*by).agg(
        F.array_join(F.transform(packed, lambda item: item["line"]), separator).alias(name)
    )


def value_counts_text(
    df: DataFrame, by: list[str], value: str, *, order: list[str], name: str, top_n: int | None = None
) -> DataFrame:
    counts = value_counts(df, by, value, order=order, keep=has_valid_text(value))
    return counts_text(counts, by, name=name, top_n=top_n)


def corpus_threshold_table(
    spark: SparkSession,
    data_dir: str,
    *,
    splits: tuple[str, ...] = ("train", "dev"),
    max_occurrences: int = 15,
    hierarchy: DataFrame | None = None,
) -> DataFrame:
    """Threshold table of the embedding targets of a corpus folder."""
    from tokenloom.operators.tokens import explode_sentences
    from tokenloom.sources.annotated import read_corpus

    tokens = explode_sentences(
        read_corpus(spark, data_dir, splits=splits), include_punctuation=False, include_empty=False
    )
    existing = hierarchy_class_count(hierarchy).first()[0] if hierarchy is not None else None
    return threshold_table(
        label_counts(tokens), max_occurrences=max_occurrences, existing_semclass_count=existing
    )
