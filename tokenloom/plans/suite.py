"""Clustering suites: configuration grid, fit and apply, evaluation, result tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.naming import with_run_names
from tokenloom.operators.assign import assign_to_training_clusters, nearest_centroid
from tokenloom.operators.evaluate import contingency, evaluate_clusters, hierarchy_alignment
from tokenloom.operators.labels import infer_cluster_count
from tokenloom.operators.density_tree import density_tree_clusters
from tokenloom.operators.linkage import agglomerate
from tokenloom.operators.neighbours import (
    QUADRATIC_ROWS,
    communities,
    density_clusters,
    guard_quadratic,
    neighbour_graph,
)
from tokenloom.operators.partitioning import (
    fit_bisecting,
    fit_cluster_features,
    fit_kmeans,
    fit_minibatch_kmeans,
    prepared,
)
from tokenloom.operators.skew import running_total
from tokenloom.operators.summary import annotate_tokens, label_cluster_map, summarize_clusters
from tokenloom.session import materialize
from tokenloom.sources.tables import run_table, write_artifact

CENTROID_ALGORITHMS = ["kmeans", "minibatch_kmeans", "bisecting_kmeans", "birch"]
DENSITY = ["hdbscan"]
GRAPH = ["knn_leiden", "knn_louvain"]
DATA_LABELS = "data_semclass"


@dataclass(frozen=True)
class RunConfig:
    """Parameters of one clustering run."""

    algorithm: str = "minibatch_kmeans"
    n_clusters: int = 100
    random_state: int = 42
    normalize: bool = True
    batch_size: int = 4096
    n_init: int = 10
    bisecting_strategy: str = "biggest_inertia"
    min_samples: int = 10
    min_cluster_size: int = 10
    cluster_selection_epsilon: float = 0.0
    cluster_selection_method: str = "eom"
    allow_single_cluster: bool = False
    linkage: str = "ward"
    metric: str = "euclidean"
    birch_threshold: float = 0.75
    birch_branching_factor: int = 100
    graph_n_neighbors: int = 15
    graph_resolution: float = 1.0
    exact_neighbours: bool = False  # of density clusters at one level: quadratic time, at any number of rows


def resolve_cluster_counts(n_clusters: int | str | list[int | str], tokens: DataFrame | None) -> list[int]:
    """Cluster counts as integers; ``data_semclass`` stands for the number of labels in the data."""
    wanted = n_clusters if isinstance(n_clusters, (list, tuple)) else [n_clusters]
    if not wanted:
        raise ValueError("a grid needs at least one cluster count")
    counts = []
    for value in wanted:
        if value == DATA_LABELS:
            if tokens is None:
                raise ValueError("data_semclass needs a token table")
            counts.append(infer_cluster_count(tokens))
        else:
            counts.append(int(value))
    return counts


def config_grid(
    algorithms: list[str] = ["bisecting_kmeans", "birch", "knn_leiden"],  # noqa: B006
    n_clusters: int | str | list[int | str] = 565,
    *,
    tokens: DataFrame | None = None,
    graph_metric: str = "cosine",
    n_init: int = 1,
    **settings: object,
) -> list[RunConfig]:
    """Algorithms x cluster counts; density and graph algorithms find their own number and appear once."""
    known = [*CENTROID_ALGORITHMS, "agglomerative", *DENSITY, *GRAPH]
    unknown = [name for name in algorithms if name not in known]
    if unknown:
        raise ValueError(f"unknown algorithms: {unknown}")
    counts = resolve_cluster_counts(n_clusters, tokens)
    base = RunConfig(n_init=n_init, **settings)
    grid = []
    for name in algorithms:
        if name in DENSITY:
            grid.append(replace(base, algorithm=name))
        elif name in GRAPH:
            grid.append(replace(base, algorithm=name, metric=graph_metric))
        else:
            grid.extend(replace(base, algorithm=name, n_clusters=count) for count in counts)
    return grid


def default_configs(n_clusters: list[int] = [565], *, seed: int = 42) -> list[RunConfig]:  # noqa: B006
    """The scalable defaults: bisecting and cluster-feature runs per count, and one community run."""
    runs = [
        RunConfig(algorithm=name, n_clusters=count, random_state=seed, n_init=1)
        for count in n_clusters
        for name in ("bisecting_kmeans", "birch")
    ]
    return [*runs, RunConfig(algorithm="knn_leiden", random_state=seed, metric="cosine")]


def check_quadratic(configs: list[RunConfig], rows: int, *, max_rows: int = QUADRATIC_ROWS, allow: bool = False) -> None:
    if any(config.algorithm == "agglomerative" for config in configs):
        guard_quadratic(rows, "agglomerative clustering", max_rows=max_rows, allow=allow)


def _fit_centroids(vectors: DataFrame, config: RunConfig, key: list[str], embedding: str) -> DataFrame:
    common = {"embedding": embedding, "seed": config.random_state}
    if config.algorithm == "kmeans":
        return fit_kmeans(vectors, config.n_clusters, n_init=config.n_init, **common)
    if config.algorithm == "minibatch_kmeans":
        return fit_minibatch_kmeans(
            vectors, config.n_clusters, key=key, batch_size=config.batch_size, n_init=config.n_init, **common
        )
    if config.algorithm == "bisecting_kmeans":
        return fit_bisecting(
            vectors, config.n_clusters, strategy=config.bisecting_strategy, n_init=config.n_init, **common
        )
    return fit_cluster_features(
        vectors,
        config.n_clusters,
        threshold=config.birch_threshold,
        branching_factor=config.birch_branching_factor,
        **common,
    )


def _with_node(vectors: DataFrame, key: list[str]) -> DataFrame:
    """Graph node numbers: a single integer key serves as it is, others are numbered in key order."""
    if len(key) == 1 and vectors.schema[key[0]].dataType.simpleString() in ("int", "bigint"):
        return vectors.withColumn("node", F.col(key[0]).cast("bigint"))
    return running_total(vectors, F.lit(1).cast("bigint"), key, total="node")


def fit_predict(vectors: DataFrame, config: RunConfig, *, key: list[str], embedding: str = "embedding") -> DataFrame:
    """``key…, cluster`` for every row of ``vectors``."""
    rows = prepared(vectors.select(*key, embedding), embedding=embedding, normalize=config.normalize)
    if config.algorithm in CENTROID_ALGORITHMS:
        centroids = _fit_centroids(rows, config, key, embedding)
        return nearest_centroid(rows, centroids, embedding=embedding).drop(embedding)
    if config.algorithm == "agglomerative":
        noded = materialize(_with_node(rows, key), "nodes")
        found = agglomerate(
            noded, config.n_clusters, key="node", linkage=config.linkage, metric=config.metric, embedding=embedding
        )
        return noded.select(*key, "node").join(found, "node").drop("node")
    noded = materialize(_with_node(rows, key), "nodes")
    if config.algorithm in DENSITY and not config.cluster_selection_epsilon:
        found = density_tree_clusters(
            noded,
            key="node",
            min_cluster_size=config.min_cluster_size,
            min_samples=config.min_samples,
            selection=config.cluster_selection_method,
            allow_single_cluster=config.allow_single_cluster,
            metric=config.metric,
            embedding=embedding,
            seed=config.random_state,
        )
    elif config.algorithm in DENSITY:
        found = density_clusters(
            noded,
            key="node",
            min_cluster_size=config.min_cluster_size,
            min_samples=config.min_samples,
            epsilon=config.cluster_selection_epsilon,
            allow_single_cluster=config.allow_single_cluster,
            metric=config.metric,
            embedding=embedding,
            exact=config.exact_neighbours,
            seed=config.random_state,
            max_rows=None if config.exact_neighbours else QUADRATIC_ROWS,
        )
    elif config.algorithm in GRAPH:
        edges = materialize(
            neighbour_graph(
                noded,
                config.graph_n_neighbors,
                key="node",
                metric=config.metric,
                embedding=embedding,
                seed=config.random_state,
            ),
            "knn",
        )
        # The multilevel variant has no resolution parameter.
        resolution = config.graph_resolution if config.algorithm == "knn_leiden" else 1.0
        found = communities(noded.select("node"), edges, resolution=resolution, seed=config.random_state)
    else:
        raise ValueError(f"unknown algorithm: {config.algorithm}")
    return noded.select(*key, "node").join(found, "node").drop("node")


def fit_apply(
    training: DataFrame, evaluation: DataFrame, config: RunConfig, *, key: list[str], embedding: str = "embedding"
) -> tuple[DataFrame, str]:
    """Clusters learnt on training rows and given to evaluation rows, with the name of the method.

    Centroid algorithms predict with their model; the others give the nearest mean of their training clusters.
    """
    train = prepared(training.select(*key, embedding), embedding=embedding, normalize=config.normalize)
    apply_to = prepared(evaluation.select(*key, embedding), embedding=embedding, normalize=config.normalize)
    if config.algorithm in CENTROID_ALGORITHMS:
        centroids = _fit_centroids(train, config, key, embedding)
        return nearest_centroid(apply_to, centroids, embedding=embedding).drop(embedding), "model_predict"
    labels = fit_predict(training, config, key=key, embedding=embedding)
    labelled = train.join(labels, key)
    assigned = assign_to_training_clusters(labelled, apply_to, metric=config.metric, embedding=embedding)
    return assigned.drop(embedding), "nearest_training_centroid"


def evaluate_run(
    tokens: DataFrame,
    assignments: DataFrame,
    config: RunConfig,
    *,
    key: list[str],
    order: list[str],
    hierarchy: DataFrame | None = None,
    hierarchy_depths: tuple[int, ...] = (1, 2, 3),
    embedding: str = "embedding",
) -> dict[str, DataFrame]:
    """Result tables of one run: assignments, annotated tokens, scores, summary, alignment, label map."""
    joined = prepared(tokens, embedding=embedding, normalize=config.normalize).join(
        assignments.select(*key, "cluster"), key
    )
    rows = materialize(joined, "clustered")
    summary = materialize(
        summarize_clusters(rows, order=order, embedding=embedding, seed=config.random_state), "summary"
    )
    annotated = annotate_tokens(tokens, assignments, summary, key=key)
    tables = {
        "assignments": assignments,
        "annotated_tokens": annotated,
        "scores": evaluate_clusters(
            rows,
            key=key,
            order=order,
            hierarchy=hierarchy,
            hierarchy_depths=hierarchy_depths,
            embedding=embedding,
            seed=config.random_state,
        ),
        "summary": summary,
        "label_map": label_cluster_map(annotated, summary),
    }
    if hierarchy is not None and "SEMCLASS" in tokens.columns:
        cells = contingency(rows, by=[], order=order)
        tables["hierarchy_alignment"] = hierarchy_alignment(
            cells, hierarchy, by=[], hierarchy_depths=hierarchy_depths
        )
    return tables


def run_suite(
    tokens: DataFrame,
    configs: list[RunConfig],
    *,
    key: list[str],
    order: list[str],
    training: DataFrame | None = None,
    hierarchy: DataFrame | None = None,
    hierarchy_depths: tuple[int, ...] = (1, 2, 3),
    embedding: str = "embedding",
    agglomerative_max_rows: int = QUADRATIC_ROWS,
    allow_quadratic_algorithms: bool = False,
) -> dict[str, DataFrame]:
    """All runs of a grid as long tables keyed by ``run_id``; ``runs`` has the configurations and names.

    With ``training`` the clusters are learnt there and applied to ``tokens``. The vector table is stored once
    and every run reads it.
    """
    vectors = materialize(tokens.select(*key, embedding), "vectors")
    learn = vectors if training is None else materialize(training.select(*key, embedding), "training")
    rows, train_rows = vectors.count(), learn.count()
    check_quadratic(configs, train_rows, max_rows=agglomerative_max_rows, allow=allow_quadratic_algorithms)
    collected: dict[str, list[DataFrame]] = {}
    facts = []
    for index, config in enumerate(configs):
        if training is None:
            labels, method = fit_predict(vectors, config, key=key, embedding=embedding), "fit_predict"
        else:
            labels, method = fit_apply(learn, vectors, config, key=key, embedding=embedding)
        run_id = f"run_{index + 1}"
        result = evaluate_run(
            tokens,
            materialize(labels, "assignments"),
            config,
            key=key,
            order=order,
            hierarchy=hierarchy,
            hierarchy_depths=hierarchy_depths,
            embedding=embedding,
        )
        for name, table in result.items():
            collected.setdefault(name, []).append(table.withColumn("run_id", F.lit(run_id)))
        facts.append(
            {**asdict(config), "training_rows": train_rows, "prediction_rows": rows, "prediction_method": method}
        )
    tables = {name: reduce(DataFrame.unionByName, parts) for name, parts in collected.items()}
    tables["runs"] = with_run_names(run_table(tokens.sparkSession, facts))
    return tables


def write_suite(tables: dict[str, DataFrame], path: str) -> str:
    return write_artifact({name: table for name, table in tables.items() if name != "assignments"}, path)
