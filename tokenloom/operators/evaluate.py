"""Cluster evaluation: contingency metrics, hierarchy alignment, internal metrics, comparison tables.

Everything against gold labels starts from one pre-aggregated contingency table (label x cluster), so tokens
are shuffled once whatever the number of metrics and hierarchy depths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.labels import MISSING_LABELS, has_valid_label, require_columns
from tokenloom.functions.naming import metric_note
from tokenloom.functions.order import first_seen
from tokenloom.functions.vectors import squared_norm, stack_rows, vector_mean, vector_sum
from tokenloom.operators.pairwise import PAIR_BLOCK_BYTES, Block, distances, over_block_pairs
from tokenloom.operators.skew import lookup_join
from tokenloom.session import materialize

EXACT = -1
NOISE = -1
BLOCK_BYTES = 64 * 1024 * 1024
EXTERNAL_METRICS = [
    "adjusted_rand",
    "normalized_mutual_info",
    "homogeneity",
    "completeness",
    "v_measure",
    "purity",
]
NAN = float("nan")


def contingency(
    labelled: DataFrame, *, by: list[str], order: list[str], gold: str = "SEMCLASS", cluster: str = "cluster"
) -> DataFrame:
    """Rows per run, gold label and cluster, with first appearance. Noise counts as a cluster."""
    require_columns(labelled, [*by, gold, cluster, *order], "labelled tokens")
    return labelled.groupBy(
        *by,
        F.coalesce(F.col(gold).cast("string"), F.lit("None")).alias("gold"),
        F.col(cluster).cast("bigint").alias("cluster"),
    ).agg(F.count("*").alias("n"), first_seen(labelled, order).alias("first"))


def ancestor_labels(hierarchy: DataFrame, depths: list[int]) -> DataFrame:
    """``class_name, depth, ancestor``: for each class, its ancestor at each requested depth.

    Climbs from a class while its depth exceeds the requested one, stopping at a null parent; a missing parent
    row gives the class itself. Of duplicate ids or names the last row wins. The climb is a loop of joins on
    the hierarchy alone, as deep as the hierarchy.
    """
    require_columns(hierarchy, ["class_id", "parent_id", "depth", "class_name"], "hierarchy")
    rows = hierarchy.withColumn("_at", F.monotonically_increasing_id())
    nodes = rows.groupBy("class_id").agg(
        F.max_by(F.struct("parent_id", F.col("depth").cast("int").alias("depth"), "class_name"), "_at").alias("node")
    )
    steps = F.explode(F.array(*[F.lit(int(depth)) for depth in depths]))
    climb = (
        rows.groupBy("class_name")
        .agg(F.max_by("class_id", "_at").alias("current"))
        .withColumn("want", steps)
    )
    deepest = hierarchy.agg(F.max(F.col("depth").cast("int"))).first()[0] or 0
    for _ in range(max(0, deepest - min([*depths, deepest])) + 1):
        here = nodes.select(F.col("class_id").alias("current"), "node")
        up = (F.col("node.depth") > F.col("want")) & F.col("node.parent_id").isNotNull()
        climb = climb.join(here, "current", "left").select(
            "class_name",
            "want",
            F.when(up, F.col("node.parent_id")).otherwise(F.col("current")).alias("current"),
        )
    here = nodes.select(F.col("class_id").alias("current"), F.col("node.class_name").alias("found"))
    return climb.join(here, "current", "left").select(
        "class_name", F.col("want").alias("depth"), F.coalesce("found", "class_name").alias("ancestor")
    )


def with_depths(cells: DataFrame, hierarchy: DataFrame | None, depths: list[int], *, by: list[str], exact: bool) -> DataFrame:
    """Contingency per level: the gold label itself (level ``EXACT``) and its ancestor at each depth."""
    levels = ([EXACT] if exact else []) + ([int(depth) for depth in depths] if hierarchy is not None else [])
    spread = cells.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    if hierarchy is None:
        return spread
    names = ancestor_labels(hierarchy, list(depths)).select(
        F.col("class_name").alias("gold"), F.col("depth").alias("level"), "ancestor"
    )
    label = F.when(F.col("gold").isin(MISSING_LABELS), F.lit("_")).otherwise(F.coalesce("ancestor", "gold"))
    return (
        spread.join(names, ["gold", "level"], "left")
        .withColumn("label", label)
        .groupBy(*by, "level", F.col("label").alias("gold"), "cluster")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )


def external_scores(cells: DataFrame, *, by: list[str]) -> DataFrame:
    """Purity, adjusted Rand and the mutual-information family per group, in wide form.

    Only sums over cells, rows and columns of the contingency table are needed: pair counts come from sums of
    squares and mutual information from sums of ``n ln n``, so no table is joined.
    """
    valid = cells.filter(has_valid_label("gold"))
    sides = valid.groupingSets(
        [[*by, "gold", "cluster"], [*by, "gold"], [*by, "cluster"]], *by, "gold", "cluster"
    ).agg(
        F.sum("n").alias("n"),
        F.max("n").alias("largest"),
        F.grouping("gold").alias("no_gold"),
        F.grouping("cluster").alias("no_cluster"),
    )
    cell = (F.col("no_gold") == 0) & (F.col("no_cluster") == 0)
    row, column = F.col("no_cluster") == 1, F.col("no_gold") == 1
    wide = F.col("n").cast("decimal(19,0)")
    square = (wide * wide).cast("decimal(38,0)")
    log = F.col("n") * F.ln("n")

    def total(which: Column, value: Column) -> Column:
        return F.sum(F.when(which, value))

    sums = sides.groupBy(*by).agg(
        total(cell, F.col("n")).alias("n"),
        *[
            total(which, value).alias(f"{kind}_{side}")
            for side, which in (("cell", cell), ("row", row), ("col", column))
            for kind, value in (("sq", square), ("log", log))
        ],
        F.count_if(row).alias("golds"),
        F.count_if(column).alias("clusters"),
        total(column, F.col("largest")).alias("hits"),
    ).filter(F.col("n").isNotNull())
    n = F.col("n").cast("double")
    entropy = {
        side: F.when(F.col(size) == 1, F.lit(0.0)).otherwise(F.greatest(F.ln(n) - F.col(f"log_{side}") / n, F.lit(0.0)))
        for side, size in (("row", "golds"), ("col", "clusters"))
    }
    joint = F.ln(n) - F.col("log_cell") / n
    sq = {side: F.col(f"sq_{side}") for side in ("cell", "row", "col")}
    derived = sums.withColumns(
        {
            "h_gold": entropy["row"],
            "h_cluster": entropy["col"],
            "fp": (sq["col"] - sq["cell"]).cast("double"),
            "fn": (sq["row"] - sq["cell"]).cast("double"),
            "tp": (sq["cell"] - F.col("n").cast("decimal(38,0)")).cast("double"),
            "nn": n * n - (sq["col"] + sq["row"] - sq["cell"]).cast("double"),
        }
    ).withColumn(
        "mi",
        F.when((F.col("golds") == 1) | (F.col("clusters") == 1), F.lit(0.0)).otherwise(
            F.greatest(F.col("h_gold") + F.col("h_cluster") - joint, F.lit(0.0))
        ),
    )
    mi, tp, fp, fn, tn = F.col("mi"), F.col("tp"), F.col("fp"), F.col("fn"), F.col("nn")
    rand = F.when((fp == 0) & (fn == 0), F.lit(1.0)).otherwise(
        2.0 * (tp * tn - fp * fn) / ((tp + fp) * (fp + tn) + (tp + fn) * (fn + tn))
    )
    homogeneity = F.when(F.col("h_gold") == 0, F.lit(1.0)).otherwise(mi / F.col("h_gold"))
    completeness = F.when(F.col("h_cluster") == 0, F.lit(1.0)).otherwise(mi / F.col("h_cluster"))
    scored = derived.select(
        *by,
        rand.alias("adjusted_rand"),
        F.when((F.col("golds") == 1) & (F.col("clusters") == 1), F.lit(1.0))
        .when(mi <= 2.220446049250313e-16, F.lit(0.0))
        .otherwise(2.0 * mi / (F.col("h_gold") + F.col("h_cluster")))
        .alias("normalized_mutual_info"),
        homogeneity.alias("homogeneity"),
        completeness.alias("completeness"),
        (F.col("hits") / n).alias("purity"),
        n.alias("n_labeled"),
    ).withColumn(
        "v_measure",
        F.when(F.col("homogeneity") + F.col("completeness") == 0, F.lit(0.0)).otherwise(
            2.0
            * F.col("homogeneity")
            * F.col("completeness")
            / (F.col("homogeneity") + F.col("completeness"))
        ),
    )
    groups = cells.select(*by).distinct()
    joined = groups.join(scored, by, "left") if by else groups.limit(1).join(scored, how="left")
    return joined.select(
        *by,
        *[F.coalesce(F.col(name), F.lit(NAN)).alias(name) for name in EXTERNAL_METRICS],
        F.coalesce("n_labeled", F.lit(0.0)).alias("n_labeled"),
    )


def _long(wide: DataFrame, by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Wide metric columns as rows ``by…, metric_index, metric, value``."""
    items = F.array(
        *[F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in metrics.items()]
    )
    return wide.select(*by, F.posexplode(items).alias("metric_index", "item")).select(
        *by, "metric_index", F.col("item.metric").alias("metric"), F.col("item.value").alias("value")
    )


def external_score_rows(levels: DataFrame, *, by: list[str]) -> DataFrame:
    """Long score rows; the metric name carries the level (``semclass_exact_…``, ``semclass_depth_2_…``)."""
    wide = external_scores(levels, by=[*by, "level"])
    names = [*EXTERNAL_METRICS, "n_labeled"]
    rows = _long(wide, [*by, "level"], {name: F.col(name) for name in names})
    prefix = F.when(F.col("level") == EXACT, F.lit("semclass_exact_")).otherwise(
        F.concat(F.lit("semclass_depth_"), F.col("level").cast("string"), F.lit("_"))
    )
    return rows.select(
        *by,
        (F.lit(100) + (F.col("level") + 1) * 10 + F.col("metric_index")).alias("metric_index"),
        F.concat(prefix, F.col("metric")).alias("metric"),
        "value",
    )


def cluster_moments(rows: DataFrame, *, by: list[str] = [], cluster: str = "cluster", embedding: str = "embedding") -> DataFrame:  # noqa: B006
    """Count, vector sum and sum of squared norms per cluster; partial sums form before the shuffle."""
    return rows.groupBy(*by, cluster).agg(
        F.count("*").alias("n"),
        vector_sum(embedding).alias("vector_sum"),
        F.sum(squared_norm(embedding)).alias("square_sum"),
    )


def centroids_of(rows: DataFrame, *, by: list[str] = [], cluster: str = "cluster", embedding: str = "embedding") -> DataFrame:  # noqa: B006
    """Mean vector per cluster: ``by…, cluster, n, centroid``."""
    moments = cluster_moments(rows, by=by, cluster=cluster, embedding=embedding)
    return moments.select(
        *by, cluster, "n", F.transform("vector_sum", lambda x: x / F.col("n")).alias("centroid")
    )


def own_centroid_distance(
    rows: DataFrame, centroids: DataFrame, *, by: list[str] = [], cluster: str = "cluster", embedding: str = "embedding"  # noqa: B006
) -> DataFrame:
    """Rows with the euclidean distance to the centroid of their own cluster."""
    keyed = lookup_join(rows, centroids, {name: name for name in [*by, cluster]}, weight="n")
    gap = F.zip_with(embedding, "centroid", lambda x, c: (x.cast("double") - c) * (x.cast("double") - c))
    return keyed.withColumn("distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x))).drop(
        "centroid", "n"
    )


def vector_blocks(vectors: DataFrame, key: str, vector: str, *extra: str, limit_bytes: int = BLOCK_BYTES):
    """Yield ``(keys, matrix, extras)`` blocks of a small vector table, each within ``limit_bytes``.

    The table is measured first; when it is larger than one block it is split by key hash and every block is
    fetched on its own, so what a task or the driver holds is bounded whatever the table size.
    """
    size = vectors.agg(F.count("*"), F.max(F.size(vector))).first()
    bytes_needed = (size[0] or 0) * (size[1] or 0) * 8
    blocks = max(1, -(-bytes_needed // limit_bytes))
    for block in range(blocks):
        part = vectors.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == block) if blocks > 1 else vectors
        frame = part.select(key, vector, *extra).toPandas().sort_values(key, kind="stable")
        if len(frame):
            yield frame[key].to_numpy(), stack_rows(frame[vector]), frame[list(extra)]


def _spread_ratios(matrix: np.ndarray, spreads: np.ndarray):
    """Column function: largest ``(s_i + s_j) / d_ij`` against one block of centroids, and largest distance."""

    @F.pandas_udf("worst double, apart double")
    def against(vectors: pd.Series, own: pd.Series) -> pd.DataFrame:
        here = stack_rows(vectors)
        squares = (here**2).sum(1)[:, None] - 2 * here @ matrix.T + (matrix**2).sum(1)[None, :]
        scale = (here**2).sum(1)[:, None] + (matrix**2).sum(1)[None, :]
        distance = np.sqrt(np.where(squares > 1e-14 * scale, squares, 0.0))
        both = own.to_numpy()[:, None] + spreads[None, :]
        ratio = np.divide(both, distance, out=np.zeros_like(both), where=distance > 0)
        return pd.DataFrame({"worst": ratio.max(1), "apart": distance.max(1)})

    return against


def davies_bouldin(rows: DataFrame, *, cluster: str = "cluster", embedding: str = "embedding") -> DataFrame:
    """One row with the Davies-Bouldin index of the non-noise rows."""
    kept = rows.filter(F.col(cluster) != NOISE)
    centroids = centroids_of(kept, cluster=cluster, embedding=embedding)
    spread = (
        own_centroid_distance(kept, centroids, cluster=cluster, embedding=embedding)
        .groupBy(cluster)
        .agg(F.avg("distance").alias("spread"))
    )
    table = centroids.join(spread, cluster).select(cluster, "centroid", "spread")
    worst = F.lit(0.0)
    apart = F.lit(0.0)
    for _, matrix, extra in vector_blocks(table, cluster, "centroid", "spread"):
        spreads = extra["spread"].to_numpy(dtype=float)
        found = _spread_ratios(matrix, spreads)(F.col("centroid"), F.col("spread"))
        worst, apart = F.greatest(worst, found["worst"]), F.greatest(apart, found["apart"])
    scored = table.select("spread", worst.alias("worst"), apart.alias("apart"))
    flat = (F.max("spread") <= 1e-8) | (F.max("apart") <= 1e-8)
    return scored.agg(F.when(flat, F.lit(0.0)).otherwise(F.avg("worst")).alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame, *, cluster: str = "cluster", embedding: str = "embedding") -> DataFrame:
    """One row with the Calinski-Harabasz index, from per-cluster sums of the gaps to the overall mean.

    Taking the mean out first keeps the sums of squares from cancelling where all vectors lie far from the origin.
    """
    kept = rows.filter(F.col(cluster) != NOISE).select(cluster, F.col(embedding).cast("array<double>").alias(embedding))
    middle = kept.agg(vector_mean(embedding).alias("_middle"))  # one row
    gaps = kept.join(F.broadcast(middle)).withColumn(
        embedding, F.zip_with(embedding, "_middle", lambda x, m: x - m)
    )
    moments = cluster_moments(gaps, cluster=cluster, embedding=embedding)
    total = moments.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum("square_sum").alias("squares"),
        F.sum(squared_norm("vector_sum") / F.col("n")).alias("between"),
        vector_sum("vector_sum").alias("all"),
    )
    within = F.col("squares") - F.col("between")
    extra = F.col("between") - squared_norm("all") / F.col("n")
    return total.select(
        F.when((F.col("k") < 2) | (F.col("n") <= F.col("k")), F.lit(NAN))
        .when(within <= 1e-12 * F.col("squares"), F.lit(1.0))
        .otherwise(extra * (F.col("n") - F.col("k")) / (within * (F.col("k") - 1)))
        .alias("calinski_harabasz")
    )


def silhouette(
    rows: DataFrame,
    *,
    key: list[str],
    cluster: str = "cluster",
    embedding: str = "embedding",
    max_samples: int | None = None,
    seed: int = 42,
    block_bytes: int = PAIR_BLOCK_BYTES,
) -> DataFrame:
    """One row with the euclidean silhouette over all non-noise rows, or over a seeded sample if the caller sets ``max_samples``.

    Rows are laid out by cluster, packed into blocks, and each pair of blocks gives distance sums per (row, cluster of
    the other block), so neither pairs of rows nor vectors leave a task. The time is quadratic in the rows; memory is two
    blocks a task. Fewer than two clusters, or as many as rows, give NaN; a row alone in its cluster counts as 0. A
    sample holds the rows of the smallest hashes of ``key``; rows of equal key stay together.
    """
    spark = rows.sparkSession
    place = F.struct(F.xxhash64(F.lit(seed), *key).alias("hash"), *key)
    kept = rows.filter(F.col(cluster) != NOISE).select(
        place.alias("_place"), F.col(cluster).cast("bigint").alias("own"), F.col(embedding).cast("array<double>").alias("vector")
    )
    if max_samples is not None:
        edge = kept.select("_place").orderBy("_place").limit(max_samples).agg(F.max("_place").alias("_edge"))  # one row
        kept = kept.join(F.broadcast(edge), F.col("_place") <= F.col("_edge"))
    laid = kept.repartitionByRange("own", "_place").sortWithinPartitions("own").select("own", "vector")
    points = materialize(laid.withColumn("id", F.monotonically_increasing_id()), "silhouette-rows")
    sizes = points.groupBy(F.col("own").alias("size_of")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.count("*"), F.sum("n")).first()
    if total[0] < 2 or total[0] >= total[1]:
        return spark.range(1).select(F.lit(NAN).alias("silhouette"))
    sums = over_block_pairs(
        points, _distance_sums, "id bigint, own bigint, other bigint, total double", extra={"own": "int64"}, block_bytes=block_bytes
    )
    sums = sums.groupBy("id", "own", "other").agg(F.sum("total").alias("total"))
    sized = lookup_join(sums, sizes, {"other": "size_of"}, weight="n", spread_by=["id"], lookup_rows=total[0])
    mine = F.col("own") == F.col("other")
    per_row = sized.groupBy("id").agg(
        F.max(F.when(mine, F.col("n"))).alias("n"),
        F.max(F.when(mine, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("within"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("nearest"),
    )
    top = F.greatest("within", "nearest")
    width = F.when((F.col("n") > 1) & (top > 0), (F.col("nearest") - F.col("within")) / top).otherwise(0.0)
    return per_row.agg(F.avg(width).alias("silhouette"))


def _distance_sums(one: Block, other: Block, same: bool) -> pd.DataFrame:
    """Sums of distances from each row of either block to the rows of each cluster in the other block."""
    found = []
    for (ids, here, mine), (_, there, theirs) in [(one, other)] if same else [(one, other), (other, one)]:
        names, codes = np.unique(theirs["own"], return_inverse=True)
        member = (codes[:, None] == np.arange(len(names))).astype(float)
        step = max(1, PAIR_BLOCK_BYTES // len(there))
        for start in range(0, len(here), step):
            gaps = distances(here[start : start + step], there, "euclidean")
            if same:
                at = np.arange(len(gaps))
                gaps[at, start + at] = 0.0
            columns = {"id": ids[start : start + step], "own": mine["own"][start : start + step]}
            table = pd.DataFrame({name: np.repeat(values, len(names)) for name, values in columns.items()})
            found.append(table.assign(other=np.tile(names, len(gaps)), total=(gaps @ member).ravel()))
    return pd.concat(found, ignore_index=True)


def silhouette_squared(rows: DataFrame, *, cluster: str = "cluster", embedding: str = "embedding") -> float:
    """Squared-euclidean silhouette over all non-noise rows, as MLlib computes it (linear in the rows)."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    from tokenloom.functions.vectors import as_vector

    kept = rows.filter(F.col(cluster) != NOISE).select(
        as_vector(embedding).alias("features"), F.col(cluster).cast("double").alias("prediction")
    )
    return ClusteringEvaluator().evaluate(kept)


def cluster_counts(rows: DataFrame, *, cluster: str = "cluster") -> DataFrame:
    """Clusters found (noise apart) and noise rows."""
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n"))
    noise = F.col(cluster) == NOISE
    return sizes.agg(
        F.count_if(~noise).alias("n_clusters_found"),
        F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)).alias("n_noise"),
        F.coalesce(F.sum(F.when(~noise, F.col("n"))), F.lit(0)).alias("n_clustered"),
    )


def internal_scores(
    rows: DataFrame,
    *,
    key: list[str],
    cluster: str = "cluster",
    embedding: str = "embedding",
    max_silhouette_samples: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Long score rows of one run: silhouette, Calinski-Harabasz, Davies-Bouldin, cluster and noise counts."""
    counts = cluster_counts(rows, cluster=cluster)
    found = counts.first()
    spark = rows.sparkSession
    if found["n_clusters_found"] < 2 or found["n_clustered"] <= found["n_clusters_found"]:
        wide = counts.withColumns(
            {name: F.lit(NAN) for name in ("silhouette", "calinski_harabasz", "davies_bouldin")}
        )
    else:
        wide = (
            spark.createDataFrame(
                [(float(found["n_clusters_found"]), float(found["n_noise"]))],
                "n_clusters_found double, n_noise double",
            )
            .join(F.broadcast(silhouette(rows, key=key, cluster=cluster, embedding=embedding, max_samples=max_silhouette_samples, seed=seed)))
            .join(F.broadcast(calinski_harabasz(rows, cluster=cluster, embedding=embedding)))
            .join(F.broadcast(davies_bouldin(rows, cluster=cluster, embedding=embedding)))
        )
    names = ["silhouette", "calinski_harabasz", "davies_bouldin", "n_clusters_found", "n_noise"]
    return _long(wide, [], {name: F.col(name) for name in names})


def evaluate_clusters(
    rows: DataFrame,
    *,
    key: list[str],
    order: list[str],
    hierarchy: DataFrame | None = None,
    hierarchy_depths: tuple[int, ...] = (1, 2, 3),
    gold: str = "SEMCLASS",
    cluster: str = "cluster",
    embedding: str = "embedding",
    max_silhouette_samples: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """All scores of one run as rows ``metric_index, metric, value``."""
    scores = internal_scores(
        rows, key=key, cluster=cluster, embedding=embedding, max_silhouette_samples=max_silhouette_samples, seed=seed
    )
    if gold not in rows.columns:
        return scores
    cells = contingency(rows, by=[], order=order, gold=gold, cluster=cluster)
    levels = with_depths(cells, hierarchy, list(hierarchy_depths), by=[], exact=True)
    return scores.unionByName(external_score_rows(levels, by=[]))


def hierarchy_alignment(
    cells: DataFrame,
    hierarchy: DataFrame,
    *,
    by: list[str],
    hierarchy_depths: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7),
) -> DataFrame:
    """Per depth and cluster: sizes, the best label with its count, purity and coverage.

    Starts from :func:`contingency`. Ties go to the label seen first in the cluster.
    """
    levels = with_depths(cells, hierarchy, list(hierarchy_depths), by=by, exact=False)
    valid = levels.filter(has_valid_label("gold"))
    golds = valid.groupBy(*by, "level", "gold").agg(F.sum("n").alias("gold_count"))
    best = (
        levels.groupBy(*by, "level", "cluster")
        .agg(
            F.sum("n").alias("cluster_token_count"),
            F.coalesce(F.sum(F.when(has_valid_label("gold"), F.col("n"))), F.lit(0)).alias("cluster_labeled_count"),
            F.min(
                F.when(has_valid_label("gold"), F.struct((-F.col("n")).alias("rank"), "first", "gold"))
            ).alias("best"),
        )
        .withColumn("gold", F.col("best.gold"))
        .withColumn("best_label_count", F.coalesce(-F.col("best.rank"), F.lit(0)))
    )
    hits = F.col("best_label_count").cast("double")
    return (
        best.join(golds, [*by, "level", "gold"], "left")
        .select(
            *by,
            F.col("level").alias("depth"),
            "cluster",
            "cluster_token_count",
            "cluster_labeled_count",
            F.coalesce("gold", F.lit("")).alias("best_label"),
            "best_label_count",
            F.when(F.col("cluster_labeled_count") > 0, hits / F.col("cluster_labeled_count"))
            .otherwise(F.lit(NAN))
            .alias("cluster_purity"),
            F.when(F.col("gold_count") > 0, hits / F.col("gold_count"))
            .otherwise(F.lit(NAN))
            .alias("gold_label_coverage"),
        )
        .orderBy(*by, "depth", F.col("cluster") == NOISE, "cluster")
    )


def scores_wide(runs: DataFrame, scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run: its configuration and its metrics as columns."""
    values = scores.groupBy("run_id").pivot("metric", metrics).agg(F.first("value"))
    return runs.join(values, "run_id", "left")


def score_comparison(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Metric x run table with the metric note; a metric a run lacks is NaN.

    ``runs`` is the configured grid; its column names become the table's columns, in run order.
    """
    names = [row["run_column"] for row in runs.orderBy("run_index").select("run_column").collect()]
    named = scores.join(runs.select("run_id", "run_index", "run_column"), "run_id")
    place = named.groupBy("metric").agg(F.min(F.struct("run_index", "metric_index")).alias("_at"))
    table = named.groupBy("metric").pivot("run_column", names).agg(F.first("value"))
    quoted = [F.coalesce(F.col(f"`{name}`"), F.lit(NAN)).alias(name) for name in names]
    return (
        table.join(place, "metric")
        .orderBy("_at", "metric")
        .select("metric", metric_note("metric").alias("reference_note"), *quoted)
    )
