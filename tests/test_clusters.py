import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenloom.functions.naming import metric_note, output_prefix, score_text, with_run_names
from tokenloom.operators import evaluate, labels, neighbours, partitioning, summary
from tokenloom.operators.assign import assign_to_training_clusters, nearest_centroid
from tokenloom.plans import suite
from tokenloom.sources.tables import run_table

FIXTURE = [
    (0, "кошка", "кошка", "ANIMAL", "кошка спит", [0.0, 0.0], 0),
    (1, "кот", "кот", "ANIMAL", "кот спит", [0.1, 0.0], 0),
    (2, "банк", "банк", "MONEY", "банк открыт", [5.0, 5.0], 1),
    (3, "деньги", "деньги", "MONEY", "деньги лежат", [5.2, 5.0], 1),
]
SCHEMA = "id bigint, FORM string, LEMMA string, SEMCLASS string, context_text string, embedding array<float>, cluster bigint"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(FIXTURE, SCHEMA).cache()


@pytest.fixture(scope="module")
def hierarchy(spark):
    return spark.createDataFrame(
        [("1", None, 0, "ROOT"), ("2", "1", 1, "ENTITY"), ("3", "2", 2, "ANIMAL"), ("4", "2", 2, "MONEY"), ("9", "77", 3, "LOST")],
        "class_id string, parent_id string, depth int, class_name string",
    )


def blobs(spark, per=40, seed=3):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 0], [0, 0, 8]], dtype=float)
    data = [
        (int(i * per + j), [float(x) for x in centers[i] + rng.normal(scale=0.4, size=3)], i)
        for i in range(4)
        for j in range(per)
    ]
    return spark.createDataFrame(data, "id bigint, embedding array<double>, truth int").cache()


def agrees(table):
    """Every found cluster is one true group and the other way round."""
    pairs = {(r["cluster"], r["truth"]) for r in table.select("cluster", "truth").distinct().collect()}
    return len(pairs) == 4 and len({c for c, _ in pairs}) == 4


def test_label_counts_and_thresholds(spark):
    rows = spark.createDataFrame([("ANIMAL",), ("ANIMAL",), ("MONEY",), ("_",), ("",), (None,), ("None",)], "SEMCLASS string")
    counts = labels.label_counts(rows)
    assert [tuple(r) for r in counts.collect()] == [("ANIMAL", 2), ("MONEY", 1)]
    given = spark.createDataFrame([("ANIMAL", 3), ("MONEY", 2), ("PLACE", 1)], "semclass string, token_count bigint")
    table = labels.threshold_table(given, max_occurrences=4).collect()
    assert [(r["semclass_count"], r["labeled_token_count"]) for r in table] == [(3, 6), (2, 5), (1, 3), (0, 0)]
    assert table[0]["description"] == "semantic classes observed at least 1 time"
    with pytest.raises(ValueError):
        labels.threshold_table(given, max_occurrences=0)
    assert labels.infer_cluster_count(rows) == 3
    with pytest.raises(ValueError, match="no usable"):
        labels.infer_cluster_count(rows.filter("SEMCLASS = '_'"))


def test_external_scores_on_a_hand_worked_table(spark):
    pairs = [("a", 0)] * 3 + [("a", 1)] + [("b", 1)] * 2 + [("b", -1)] + [("_", 0)] * 5
    frame = spark.createDataFrame([(i, g, c) for i, (g, c) in enumerate(pairs)], "id bigint, SEMCLASS string, cluster bigint")
    scores = evaluate.external_scores(evaluate.contingency(frame, by=[], order=["id"]), by=[]).first()
    n = 7
    table = {("a", 0): 3, ("a", 1): 1, ("b", 1): 2, ("b", -1): 1}
    a, b = {"a": 4, "b": 3}, {0: 3, 1: 3, -1: 1}
    mi = sum(v / n * math.log(v * n / (a[g] * b[c])) for (g, c), v in table.items())
    entropy = lambda counts: -sum(v / n * math.log(v / n) for v in counts.values())
    choose = lambda v: v * (v - 1) / 2
    expected = sum(map(choose, a.values())) * sum(map(choose, b.values())) / choose(n)
    rand = (sum(map(choose, table.values())) - expected) / (
        (sum(map(choose, a.values())) + sum(map(choose, b.values()))) / 2 - expected
    )
    assert scores["purity"] == pytest.approx(6 / 7)
    assert scores["adjusted_rand"] == pytest.approx(rand)
    assert scores["homogeneity"] == pytest.approx(mi / entropy(a))
    assert scores["completeness"] == pytest.approx(mi / entropy(b))
    assert scores["normalized_mutual_info"] == pytest.approx(2 * mi / (entropy(a) + entropy(b)))
    assert scores["n_labeled"] == 7.0


def test_external_scores_at_the_edges(spark):
    one = spark.createDataFrame([(0, "a", 0), (1, "a", 0)], "id bigint, SEMCLASS string, cluster bigint")
    scores = evaluate.external_scores(evaluate.contingency(one, by=[], order=["id"]), by=[]).first()
    assert [scores[name] for name in evaluate.EXTERNAL_METRICS] == [1.0] * 6
    none = one.withColumn("SEMCLASS", F.lit("_"))
    empty = evaluate.external_scores(evaluate.contingency(none, by=[], order=["id"]), by=[]).first()
    assert empty["n_labeled"] == 0.0 and all(math.isnan(empty[name]) for name in evaluate.EXTERNAL_METRICS)


def test_hierarchy(spark, rows, hierarchy):
    found = {
        (r["class_name"], r["depth"]): r["ancestor"] for r in evaluate.ancestor_labels(hierarchy, [0, 1, 2]).collect()
    }
    assert found[("ANIMAL", 1)] == found[("MONEY", 1)] == "ENTITY"
    assert found[("ANIMAL", 0)] == "ROOT" and found[("ANIMAL", 2)] == "ANIMAL" and found[("ROOT", 2)] == "ROOT"
    assert found[("LOST", 1)] == "LOST"
    cells = evaluate.contingency(rows, by=[], order=["id"])
    table = evaluate.hierarchy_alignment(cells, hierarchy, by=[], hierarchy_depths=(2,)).first()
    assert (table["cluster"], table["best_label"], table["best_label_count"]) == (0, "ANIMAL", 2)
    assert (table["cluster_purity"], table["gold_label_coverage"]) == (1.0, 1.0)
    blank = evaluate.contingency(rows.withColumn("SEMCLASS", F.lit("_")), by=[], order=["id"])
    empty = evaluate.hierarchy_alignment(blank, hierarchy, by=[], hierarchy_depths=(1,)).first()
    assert empty["best_label"] == "" and empty["best_label_count"] == 0 and math.isnan(empty["cluster_purity"])


def test_summary_texts(rows):
    table = {r["cluster"]: r for r in summary.summarize_clusters(rows, order=["id"]).collect()}
    assert table[0]["token_count"] == 2 and table[0]["lemma_count"] == 2
    assert table[0]["semclasses"] == "ANIMAL: 2" and table[1]["semclasses"] == "MONEY: 2"
    assert table[0]["semclass_lemma_examples"] == "ANIMAL: кошка, кот"
    assert table[1]["semclass_lemma_examples"] == "MONEY: банк, деньги"
    assert table[0]["examples"].split("\n")[0] == "кошка [ANIMAL] :: кошка спит"
    assert table[0]["cluster_name"] == "кошка"


def test_ties_follow_first_appearance_and_lemmas_are_capped(spark):
    data = [(i, f"форма{i + 1}", f"лемма{i + 1}", "CLASS_A" if i < 2 else "CLASS_B", "", [float(i)], 0) for i in range(3)]
    row = summary.summarize_clusters(spark.createDataFrame(data, SCHEMA), order=["id"], top_n=1).first()
    assert row["lemmas"] == "лемма1: 1\nлемма2: 1\nлемма3: 1"
    assert row["top_forms"] == "форма1: 1" and row["semclasses"] == "CLASS_A: 2\nCLASS_B: 1"
    many = [(i, "f", f"a{i}", "A", "", [0.0], 0) for i in range(52)] + [(60 + i, "f", f"b{i}", "B", "", [0.0], 0) for i in range(2)]
    text = summary.summarize_clusters(spark.createDataFrame(many, SCHEMA), order=["id"]).first()["semclass_lemma_examples"]
    first, second = text.split("\n")
    assert len(set(first.removeprefix("A: ").split(", "))) == 50 and second == "B: b0, b1"


def test_annotation_and_label_map(spark, rows):
    names = spark.createDataFrame([(0, "кошка", 1), (1, "банк", 2), (2, "деньги", 1)], "cluster bigint, cluster_name string, token_count bigint")
    moved = rows.withColumn("cluster", F.element_at(F.array(*map(F.lit, [0, 1, 1, 2])), (F.col("id") + 1).cast("int")).cast("bigint"))
    annotated = summary.annotate_tokens(rows.drop("cluster"), moved.select("id", "cluster"), names, key=["id"])
    assert annotated.columns[0] == "cluster"
    assert {r["id"]: r["AUTO_SEMCLASS"] for r in annotated.collect()} == {
        0: "cluster_0:кошка", 1: "cluster_1:банк", 2: "cluster_1:банк", 3: "cluster_2:деньги"
    }
    table = [tuple(r) for r in summary.label_cluster_map(annotated, names).collect()]
    assert table == [("ANIMAL", "0:кошка\n1:банк", 2), ("MONEY", "1:банк\n2:деньги", 2)]


def test_names_notes_and_prefix(spark):
    configs = [
        {"algorithm": "bisecting_kmeans", "n_clusters": 100},
        {"algorithm": "birch", "n_clusters": 200},
        {"algorithm": "knn_leiden", "n_clusters": 100, "graph_n_neighbors": 15},
        {"algorithm": "hdbscan", "min_cluster_size": 10},
    ]
    runs = run_table(spark, configs)
    assert output_prefix(runs.filter("run_index < 3"), label="rubric tiny2").first()[0] == "100,200cl_rubric_tiny2_Hierarchical"
    assert output_prefix(runs.filter("run_index = 3"), label="x").first()[0] == "autocl_x_Mixed"
    named = [r["run_column"] for r in with_run_names(runs).orderBy("run_index").collect()]
    assert named[0] == "run_1_bisecting_kmeans_k100" and named[2:] == ["run_3_knn_leiden_nn15", "run_4_hdbscan_min10"]
    values = spark.createDataFrame([("silhouette", 0.12345), ("n_noise", 3.0), ("x_purity", float("nan"))], "m string, v double")
    assert [r[0] for r in values.select(score_text("m", "v")).collect()] == ["0.1235", "3", "nan"]
    assert values.select(metric_note("m")).collect()[2][0] == "0 to 1; higher is better"


def test_score_comparison(spark):
    runs = with_run_names(run_table(spark, [{"algorithm": "kmeans", "n_clusters": 2}, {"algorithm": "hdbscan", "min_cluster_size": 10}]))
    scores = spark.createDataFrame(
        [("run_1", 0, "silhouette", 0.5), ("run_1", 1, "n_noise", 0.0), ("run_2", 1, "n_noise", 3.0)],
        "run_id string, metric_index int, metric string, value double",
    )
    table = evaluate.score_comparison(runs, scores)
    assert table.columns == ["metric", "reference_note", "run_1_kmeans_k2", "run_2_hdbscan_min10"]
    found = table.collect()
    assert [r["metric"] for r in found] == ["silhouette", "n_noise"] and math.isnan(found[0]["run_2_hdbscan_min10"])


def test_internal_scores_match_direct_formulas(spark):
    data = blobs(spark, per=15)
    rows = data.withColumn("cluster", F.col("truth").cast("bigint"))
    scores = {r["metric"]: r["value"] for r in evaluate.internal_scores(rows, key=["id"]).collect()}
    frame = rows.toPandas()
    x, y = np.vstack(frame["embedding"]), frame["cluster"].to_numpy()
    distance = np.linalg.norm(x[:, None] - x[None], axis=2)
    widths = []
    for i in range(len(x)):
        own = distance[i][y == y[i]].sum() / ((y == y[i]).sum() - 1)
        other = min(distance[i][y == c].mean() for c in set(y) - {y[i]})
        widths.append((other - own) / max(own, other))
    means = np.array([x[y == c].mean(0) for c in range(4)])
    within = sum(((x[y == c] - means[c]) ** 2).sum() for c in range(4))
    between = sum((y == c).sum() * ((means[c] - x.mean(0)) ** 2).sum() for c in range(4))
    spread = [np.linalg.norm(x[y == c] - means[c], axis=1).mean() for c in range(4)]
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in range(4) if j != i) for i in range(4)]
    assert scores["silhouette"] == pytest.approx(np.mean(widths))
    assert scores["calinski_harabasz"] == pytest.approx((between / 3) / (within / (len(x) - 4)))
    assert scores["davies_bouldin"] == pytest.approx(np.mean(worst))
    lone = rows.withColumn("cluster", F.lit(-1).cast("bigint"))
    empty = {r["metric"]: r["value"] for r in evaluate.internal_scores(lone, key=["id"]).collect()}
    assert math.isnan(empty["silhouette"]) and empty["n_noise"] == 60.0 and empty["n_clusters_found"] == 0.0


def test_nearest_centroids_in_several_blocks(spark, monkeypatch):
    data = blobs(spark, per=10)
    centers = data.select(F.col("id").alias("cluster"), F.col("embedding").alias("centroid"))
    whole = {r["id"]: r["cluster"] for r in nearest_centroid(data, centers).collect()}
    monkeypatch.setattr("tokenloom.operators.evaluate.vector_blocks.__kwdefaults__", {"limit_bytes": 200}, raising=False)
    split = {r["id"]: r["cluster"] for r in nearest_centroid(data, centers).collect()}
    assert whole == split == {i: i for i in range(40)}
    noise = data.withColumn("cluster", F.lit(-1).cast("bigint"))
    assert {r["cluster"] for r in assign_to_training_clusters(noise, data).collect()} == {-1}


@pytest.mark.parametrize("algorithm", ["kmeans", "minibatch_kmeans", "bisecting_kmeans", "birch", "agglomerative", "hdbscan", "knn_leiden"])
def test_algorithms_find_separate_groups(spark, algorithm):
    data = blobs(spark)
    config = suite.RunConfig(
        algorithm=algorithm, n_clusters=4, normalize=False, n_init=2, batch_size=64, min_cluster_size=5, min_samples=5,
        graph_n_neighbors=8, cluster_selection_epsilon=1.5, graph_resolution=0.3,
    )
    found = suite.fit_predict(data, config, key=["id"]).join(data, "id")
    assert found.count() == 160
    assert agrees(found.filter("cluster >= 0"))


def test_training_clusters_are_applied(spark):
    data = blobs(spark)
    config = suite.RunConfig(algorithm="kmeans", n_clusters=4, n_init=2, normalize=False)
    labels_, method = suite.fit_apply(data.filter("id % 2 = 0"), data, config, key=["id"])
    assert method == "model_predict" and agrees(labels_.join(data, "id"))
    config = suite.RunConfig(algorithm="agglomerative", n_clusters=4, normalize=False)
    labels_, method = suite.fit_apply(data.filter("id % 2 = 0"), data, config, key=["id"])
    assert method == "nearest_training_centroid" and agrees(labels_.join(data, "id"))


def test_approximate_neighbours_with_a_hot_copy(spark):
    data = blobs(spark)
    copies = spark.range(200, 300).select(F.col("id"), F.array(*[F.lit(1.0)] * 3).alias("embedding"), F.lit(9).alias("truth"))
    rows = data.unionByName(copies)
    exact = neighbours.exact_neighbours(rows, 4, key="id")
    near = neighbours.approximate_neighbours(rows, 4, key="id", block_rows=32, orderings=12)
    assert near.count() == exact.count() == 260 * 4
    goal = exact.groupBy("src").agg(F.sum("distance").alias("best"))
    got = near.groupBy("src").agg(F.sum("distance").alias("got"))
    ratio = goal.join(got, "src").agg(F.sum("best") / F.sum("got")).first()[0]
    assert ratio > 0.8
    with pytest.raises(ValueError, match="allow_quadratic_algorithms"):
        neighbours.exact_neighbours(rows, 4, key="id", max_rows=10)


def test_components_on_a_long_path(spark):
    edges = spark.range(0, 40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).filter("src <> 20")
    nodes = spark.range(0, 43).withColumnRenamed("id", "node")
    found = {r["node"]: r["component"] for r in neighbours.connected_components(nodes, edges).collect()}
    assert found == {**{n: 0 for n in range(21)}, **{n: 21 for n in range(21, 41)}, 41: 41, 42: 42}


def test_cluster_features_keep_every_row(spark):
    data = blobs(spark)
    found = partitioning.cluster_features(data.coalesce(1), threshold=0.5, branching_factor=2)
    total = found.agg(F.sum("n"), F.count("*"), F.max("radius")).first()
    assert total[0] == 160 and total[1] < 160 and total[2] <= 0.5


def test_grid_and_guard(spark, rows):
    grid = suite.config_grid(["kmeans", "birch", "hdbscan", "knn_louvain"], ["data_semclass", 7], tokens=rows)
    assert [(c.algorithm, c.n_clusters) for c in grid[:4]] == [("kmeans", 2), ("kmeans", 7), ("birch", 2), ("birch", 7)]
    assert [c.algorithm for c in grid[4:]] == ["hdbscan", "knn_louvain"] and grid[5].metric == "cosine"
    with pytest.raises(ValueError, match="allow_quadratic"):
        suite.check_quadratic([suite.RunConfig(algorithm="agglomerative")], 60_000)
    suite.check_quadratic([suite.RunConfig(algorithm="agglomerative")], 60_000, allow=True)
    assert len(suite.default_configs([5])) == 3


def test_suite_tables(spark, rows, hierarchy, tmp_path):
    tokens = rows.drop("cluster")
    configs = [suite.RunConfig(algorithm="kmeans", n_clusters=2, n_init=2, normalize=False)]
    found = suite.run_suite(tokens, configs, key=["id"], order=["id"], hierarchy=hierarchy, hierarchy_depths=(1, 2))
    scores = {r["metric"]: r["value"] for r in found["scores"].collect()}
    assert scores["semclass_exact_purity"] == 1.0 and scores["semclass_depth_2_n_labeled"] == 4.0
    assert scores["semclass_depth_1_purity"] == 1.0
    suite.write_suite(found, str(tmp_path / "artifact"))


def test_one_cluster_is_the_mean(spark):
    data = blobs(spark)
    rows = data.collect()
    mean = np.mean([row["embedding"] for row in rows], axis=0)
    fits = [
        partitioning.fit_kmeans(data, 1),
        partitioning.fit_bisecting(data, 1),
        partitioning.fit_minibatch_kmeans(data, 1, key=data.columns[:1], batch_size=16),
        partitioning.fit_cluster_features(data, 1, threshold=0.5),
    ]
    for fitted in fits:
        (row,) = fitted.collect()
        assert row["cluster"] == 0 and np.allclose(row["centroid"], mean)


def test_minibatch_keeps_the_best_of_several_seeds(spark):
    data = blobs(spark)
    key = data.columns[:1]
    single = partitioning.fit_minibatch_kmeans(data, 4, key=key, batch_size=40)
    best = partitioning.fit_minibatch_kmeans(data, 4, key=key, batch_size=40, n_init=3)
    costs = [partitioning._cost(data, found, "embedding") for found in (best, single)]
    assert costs[0] <= costs[1]


def test_components_of_a_long_path(spark):
    edges = spark.range(2100).selectExpr("(id * 7919) % 2100 AS src").selectExpr("src", "src + 1 AS dst")
    nodes = spark.range(2102).withColumnRenamed("id", "node")
    found = neighbours.connected_components(nodes, edges)
    assert {(row[0], row[1]) for row in found.groupBy("component").count().collect()} == {(0, 2101), (2101, 1)}
    with pytest.raises(RuntimeError, match="still change"):
        neighbours.connected_components(nodes, edges, max_rounds=1)


def test_density_needs_a_level(spark):
    with pytest.raises(ValueError, match="distance level"):
        neighbours.density_clusters(blobs(spark), key="id", epsilon=0.0)


def test_index_does_not_depend_on_the_origin(spark):
    data = blobs(spark)
    rows = data.withColumn("cluster", F.pmod(F.xxhash64(*data.columns[:1]), F.lit(3)))
    moved = rows.withColumn("embedding", F.transform("embedding", lambda x: x + 1e6))
    near = evaluate.calinski_harabasz(rows).first()[0]
    assert evaluate.calinski_harabasz(moved).first()[0] == pytest.approx(near, rel=1e-3)


def test_density_query_asks_for_exact_neighbours(spark, tmp_path, monkeypatch):
    from tokenloom.plans import vector_queries

    def refused(*_, **__):
        raise AssertionError("approximate neighbours differ from the SQL counterpart on large tables")

    monkeypatch.setattr(neighbours, "approximate_neighbours", refused)
    monkeypatch.setattr(neighbours, "QUADRATIC_ROWS", 10)
    monkeypatch.setattr(suite, "QUADRATIC_ROWS", 10)
    points = np.random.default_rng(5).normal(size=(60, 4))
    points[:30, 0] += 30
    points[30:, 1] += 30
    rows = [(i, 0, [float(x) for x in point]) for i, point in enumerate(points)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").write.parquet(
        str(tmp_path / "embeddings.parquet")
    )
    found = {r["vec_id"]: r["cluster"] for r in vector_queries.density_clusters(spark, str(tmp_path)).collect()}
    assert len({found[i] for i in range(30)}) == 1 and len({found[i] for i in range(30, 60)}) == 1
    assert found[0] != found[59]


def test_blocks_run_on_from_batch_to_batch():
    """Sorted rows that arrive in several batches are not cut where a batch ends."""
    for rows in (1, 10, 14, 15, 19, 20, 47):
        batches = [pd.DataFrame({"src": range(a, min(a + 7, rows)), "vector": [[float(a)]] * (min(a + 7, rows) - a)}) for a in range(0, rows, 7)]
        names = [own.tolist() for _, own in neighbours._blocks(iter(batches), 10)]
        assert sum(names, []) == list(range(rows))
        assert all(5 <= len(own) < 15 for own in names) or rows < 5


def test_neighbour_search_has_few_partitions(spark, monkeypatch):
    """Partition bounds come from keys sent to the driver, so their number may not follow the blocks."""
    from pyspark.sql.classic.dataframe import DataFrame

    found, ranged = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, n, *keys: found.append(n) or ranged(self, n, *keys))
    rows = spark.range(2_000).select("id", F.array(F.rand(1), F.rand(2)).alias("embedding"))
    neighbours.approximate_neighbours(rows, 3, key="id", block_rows=8, orderings=1)
    assert found and max(found) <= spark.sparkContext.defaultParallelism
