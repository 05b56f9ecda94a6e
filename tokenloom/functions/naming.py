"""Metric notes, score formatting and run names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.labels import _col

# Notes shown beside each metric.
METRIC_NOTES = {
    "silhouette": "-1 to 1; higher is better",
    "calinski_harabasz": "0 to +inf; higher is better",
    "davies_bouldin": "0 to +inf; lower is better",
    "n_clusters_found": "count; compare with requested or discovered cluster count",
    "n_noise": "count; HDBSCAN noise points, lower is usually better",
}
SUFFIX_NOTES = {
    "_adjusted_rand": "-1 to 1; higher is better, 0 is near random",
    "_normalized_mutual_info": "0 to 1; higher is better",
    "_homogeneity": "0 to 1; higher is better",
    "_completeness": "0 to 1; higher is better",
    "_v_measure": "0 to 1; higher is better",
    "_purity": "0 to 1; higher is better",
    "_n_labeled": "count of tokens with usable SEMCLASS labels",
}
OTHER_NOTE = "inspect manually"
DENSITY_ALGORITHMS = ["hdbscan"]
GRAPH_ALGORITHMS = ["knn_leiden", "knn_louvain"]
HIERARCHICAL_ALGORITHMS = ["bisecting_kmeans", "birch", "knn_leiden"]
FLAT_ALGORITHMS = ["kmeans", "minibatch_kmeans"]


def metric_note(metric: Column | str) -> Column:
    name = _col(metric)
    note = F.lit(OTHER_NOTE)
    for suffix, text in SUFFIX_NOTES.items():
        note = F.when(name.endswith(suffix), F.lit(text)).otherwise(note)
    for full_name, text in METRIC_NOTES.items():
        note = F.when(name == full_name, F.lit(text)).otherwise(note)
    return note


def score_text(metric: Column | str, value: Column | str) -> Column:
    """``nan``, an integer for counts, else four decimals."""
    name, number = _col(metric), _col(value).cast("double")
    is_count = name.isin("n_clusters_found", "n_noise") | name.endswith("_n_labeled")
    return (
        F.when(number.isNull() | F.isnan(number), F.lit("nan"))
        .when(is_count, number.cast("bigint").cast("string"))
        .otherwise(F.format_string("%.4f", number))
    )


def run_part(runs: DataFrame) -> Column:
    """Short parameter tag of a run: ``k…``, ``nn…`` or ``min…``."""
    return (
        F.when(runs["algorithm"].isin(DENSITY_ALGORITHMS), F.concat(F.lit("min"), runs["min_cluster_size"]))
        .when(runs["algorithm"].isin(GRAPH_ALGORITHMS), F.concat(F.lit("nn"), runs["graph_n_neighbors"]))
        .otherwise(F.concat(F.lit("k"), runs["n_clusters"]))
    )


def with_run_names(runs: DataFrame) -> DataFrame:
    """Add ``run_part``, the comparison column name and the sheet label of every run.

    ``runs`` has one row per run: ``run_index`` (from 0), ``algorithm``, ``n_clusters``, ``min_cluster_size``,
    ``graph_n_neighbors``.
    """
    part = run_part(runs)
    label = F.when(runs["n_clusters"].isNotNull(), F.concat(F.lit("k"), runs["n_clusters"])).otherwise(
        F.when(runs["algorithm"].isin(GRAPH_ALGORITHMS + DENSITY_ALGORITHMS), part).otherwise(
            F.concat(F.lit("run"), runs["run_index"])
        )
    )
    return runs.withColumns(
        {
            "run_part": part,
            "run_column": F.concat_ws(
                "_", F.lit("run"), (runs["run_index"] + 1).cast("string"), runs["algorithm"], part
            ),
            "run_label": label,
        }
    )


def safe_component(value: Column, *, default: str = "run") -> Column:
    cleaned = F.regexp_replace(F.trim(value), r"[^A-Za-z0-9_,.-]+", "_")
    stripped = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.when(stripped == "", F.lit(default)).otherwise(stripped)


def output_prefix(runs: DataFrame, *, label: str, family: str | None = None) -> DataFrame:
    """One row with the file prefix of a result suite, such as ``100,200cl_label_Hierarchical``."""
    counted = ~F.col("algorithm").isin(DENSITY_ALGORITHMS + GRAPH_ALGORITHMS) & F.col("n_clusters").isNotNull()
    first_seen = runs.filter(counted).groupBy("n_clusters").agg(F.min("run_index").alias("at"))
    counts = first_seen.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("at", "n_clusters"))),
                lambda item: item["n_clusters"].cast("string"),
            ),
            ",",
        ).alias("counts")
    )
    algorithms = runs.agg(F.collect_set("algorithm").alias("algorithms"))
    only = lambda names: F.size(F.array_except("algorithms", F.array(*map(F.lit, names)))) == 0
    inferred = (
        F.when(F.size("algorithms") == 0, "Mixed")
        .when(only(HIERARCHICAL_ALGORITHMS), "Hierarchical")
        .when(only(["minibatch_kmeans"]), "Minibatch_Kmeans")
        .when(only(FLAT_ALGORITHMS), "Flat")
        .otherwise("Mixed")
    )
    chosen = F.lit(family) if family else inferred
    counts_text = F.when(F.col("counts") == "", F.lit("auto")).otherwise(F.col("counts"))
    return counts.join(F.broadcast(algorithms)).select(
        safe_component(F.concat(counts_text, F.lit("cl_"), F.lit(label), F.lit("_"), chosen)).alias("prefix")
    )
