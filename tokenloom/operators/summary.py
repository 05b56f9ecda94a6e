"""Cluster summaries, token annotation and label-to-cluster maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions.labels import has_valid_text, require_columns
from tokenloom.functions.order import first_seen
from tokenloom.functions.text import clean_name
from tokenloom.operators.evaluate import NOISE, centroids_of, own_centroid_distance
from tokenloom.operators.labels import counts_text, value_counts
from tokenloom.operators.skew import lookup_join

EXAMPLES = 5
TOP_FORMS = 8
LEMMA_EXAMPLES = 50


def _text(column: str, rows: DataFrame, default: str = "") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(default)) if column in rows.columns else F.lit(default)


def representatives(rows: DataFrame, *, order: list[str], embedding: str = "embedding") -> DataFrame:
    """Per cluster the row nearest to the cluster mean (first row wins ties) and the cluster name from it."""
    measured = own_centroid_distance(rows, centroids_of(rows, embedding=embedding), embedding=embedding)
    nearest = measured.groupBy("cluster").agg(
        F.min(
            F.struct(
                F.round("distance", 12).alias("distance"),
                F.struct(*order).alias("at"),
                _text("LEMMA", rows).alias("lemma"),
                _text("FORM", rows).alias("form"),
            )
        ).alias("best")
    )
    name = F.when(F.col("best.lemma") != "_", F.col("best.lemma")).otherwise(F.col("best.form"))
    return nearest.select(
        "cluster",
        F.when(F.col("cluster") == NOISE, F.concat(F.lit("NOISE:"), name)).otherwise(name).alias("cluster_name"),
        F.round("best.distance", 6).alias("representative_distance"),
    )


def label_lemma_examples(
    rows: DataFrame, *, order: list[str], max_lemmas: int = LEMMA_EXAMPLES, seed: int = 42
) -> DataFrame:
    """Per cluster, lines ``label: lemma, lemma`` with labels by count.

    Up to ``max_lemmas`` lemmas are listed as first seen; of more, a seeded hash picks the sample.
    """
    labelled = rows.filter(has_valid_text("SEMCLASS"))
    labels = value_counts(labelled, ["cluster"], "SEMCLASS", order=order).withColumnRenamed("value", "label")
    lemmas = (
        labelled.filter(has_valid_text("LEMMA"))
        .groupBy("cluster", F.col("SEMCLASS").cast("string").alias("label"), F.col("LEMMA").cast("string").alias("lemma"))
        .agg(first_seen(labelled, order).alias("seen"))
        .withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), "lemma")))
    )
    sizes = lemmas.groupBy("cluster", "label").agg(F.count("*").alias("distinct"))
    drawn = lemmas.withColumn(
        "_rank", F.row_number().over(W.partitionBy("cluster", "label").orderBy("draw", "lemma"))
    ).filter(F.col("_rank") <= max_lemmas)
    few = F.array_sort(F.collect_list(F.struct("seen", "lemma")))
    many = F.array_sort(F.collect_list(F.struct("draw", "lemma")))
    lists = drawn.groupBy("cluster", "label").agg(
        F.transform(few, lambda item: item["lemma"]).alias("few"),
        F.transform(many, lambda item: item["lemma"]).alias("many"),
    )
    lines = (
        labels.join(sizes, ["cluster", "label"])
        .join(lists, ["cluster", "label"])
        .select(
            "cluster",
            "count",
            "first",
            F.concat(
                "label",
                F.lit(": "),
                F.array_join(F.when(F.col("distinct") <= max_lemmas, F.col("few")).otherwise(F.col("many")), ", "),
            ).alias("value"),
        )
    )
    return counts_text(lines, ["cluster"], name="semclass_lemma_examples", with_count=False)


def cluster_value_counts(rows: DataFrame, value: str, *, order: list[str]) -> DataFrame:
    """Long form of the count texts: ``cluster, value, count, first``, for values too many for one text."""
    return value_counts(rows, ["cluster"], value, order=order, keep=has_valid_text(value))


def summarize_clusters(
    rows: DataFrame,
    *,
    order: list[str],
    embedding: str = "embedding",
    examples_per_cluster: int = EXAMPLES,
    top_n: int = TOP_FORMS,
    max_lemmas_per_label: int = LEMMA_EXAMPLES,
    seed: int = 42,
) -> DataFrame:
    """Readable summary, one row per cluster, noise last.

    ``rows`` are clustered tokens with their vectors; ``order`` gives the row order for ties and examples. The
    texts are built from pre-aggregated counts and joined on the cluster.
    """
    require_columns(rows, ["cluster", "FORM", "LEMMA", "SEMCLASS", embedding, *order], "clustered tokens")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("token_count"))
    lemmas = cluster_value_counts(rows, "LEMMA", order=order)
    example = F.concat(
        F.col("FORM").cast("string"),
        F.lit(" ["),
        _text("SEMCLASS", rows, "_"),
        F.lit("] :: "),
        _text("context_text", rows),
    )
    first_rows = rows.select(
        "cluster",
        F.row_number().over(W.partitionBy("cluster").orderBy(*order)).alias("_rank"),
        F.struct(*order).alias("_at"),
        example.alias("line"),
    ).filter(F.col("_rank") <= examples_per_cluster)
    examples = first_rows.groupBy("cluster").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_at", "line"))), lambda item: item["line"]), "\n"
        ).alias("examples")
    )
    parts = [
        representatives(rows, order=order, embedding=embedding).drop("representative_distance"),
        lemmas.groupBy("cluster").agg(F.count("*").alias("lemma_count")),
        counts_text(lemmas, ["cluster"], name="lemmas"),
        counts_text(cluster_value_counts(rows, "FORM", order=order), ["cluster"], name="top_forms", top_n=top_n),
        counts_text(cluster_value_counts(rows, "SEMCLASS", order=order), ["cluster"], name="semclasses"),
        label_lemma_examples(rows, order=order, max_lemmas=max_lemmas_per_label, seed=seed),
        examples,
    ]
    table = sizes
    for part in parts:
        table = table.join(part, "cluster", "left")
    texts = ["lemmas", "top_forms", "semclasses", "semclass_lemma_examples", "examples"]
    return table.select(
        "cluster",
        "cluster_name",
        "token_count",
        F.coalesce("lemma_count", F.lit(0)).alias("lemma_count"),
        *[F.coalesce(name, F.lit("")).alias(name) for name in texts],
    ).orderBy(F.col("cluster") == NOISE, "cluster")


def annotate_tokens(
    tokens: DataFrame, assignments: DataFrame, summary: DataFrame | None, *, key: list[str], by: list[str] = []  # noqa: B006
) -> DataFrame:
    """Tokens with ``cluster`` first and ``AUTO_SEMCLASS`` = ``cluster_<id>:<name>`` last."""
    joined = tokens.join(assignments.select(*by, *key, "cluster"), key)
    plain = F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))
    columns = [*by, "cluster", *[name for name in tokens.columns if name not in by]]
    if summary is None:
        return joined.select(*columns, plain.alias("AUTO_SEMCLASS"))
    names = summary.select(
        *by, "cluster", clean_name("cluster_name").alias("_name"), F.col("token_count").alias("_size")
    )
    named = lookup_join(joined, names, {name: name for name in [*by, "cluster"]}, weight="_size")
    label = F.when(F.coalesce("_name", F.lit("")) != "", F.concat_ws(":", plain, "_name")).otherwise(plain)
    return named.select(*columns, label.alias("AUTO_SEMCLASS"))


def label_cluster_map(annotated: DataFrame, summary: DataFrame | None, *, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Per gold label the clusters that hold it, as ``id:name`` lines in cluster order, and their number."""
    require_columns(annotated, ["SEMCLASS", "cluster"], "annotated_tokens")
    pairs = (
        annotated.filter(has_valid_text("SEMCLASS") & F.col("cluster").isNotNull())
        .select(*by, F.col("SEMCLASS").cast("string").alias("semclass"), F.col("cluster").cast("bigint").alias("cluster"))
        .distinct()
    )
    number = F.col("cluster").cast("string")
    if summary is None:
        shown = pairs.withColumn("shown", number)
    else:
        names = summary.select(
            *by, F.col("cluster").cast("bigint").alias("cluster"), clean_name("cluster_name").alias("_name")
        )
        name = F.coalesce("_name", F.lit(""))
        shown = pairs.join(names, [*by, "cluster"], "left").withColumn(
            "shown", F.when(name != "", F.concat_ws(":", number, "_name")).otherwise(number)
        )
    packed = F.array_sort(F.collect_list(F.struct("cluster", "shown")))
    return (
        shown.groupBy(*by, "semclass")
        .agg(
            F.array_join(F.transform(packed, lambda item: item["shown"]), "\n").alias("automatic_clusters"),
            F.count("*").cast("int").alias("cluster_count"),
        )
        .orderBy(*by, "semclass")
    )
