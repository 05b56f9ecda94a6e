"""Same word form, different labels: cosine and cluster statistics from sums, without emitting token pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions.labels import has_valid_label, require_columns
from tokenloom.functions.order import first_seen
from tokenloom.functions.text import casefold
from tokenloom.functions.vectors import dot, l2_normalize, squared_norm, vector_sum
from tokenloom.operators.labels import counts_text
from tokenloom.operators.skew import lookup_join

IDENTITY_COLUMNS = ["FORM", "LEMMA", "SEMCLASS", "split", "sentence_index", "token_index"]
TOP = 12
PAIRS = "decimal(38,0)"
NAN = float("nan")


def alignment_mismatches(vectors: DataFrame, annotated: DataFrame, *, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row: rows on each side, unmatched keys, and per identity column the number of differing rows."""
    compared = [
        name
        for name in (columns or IDENTITY_COLUMNS)
        if name in vectors.columns and name in annotated.columns and name not in key
    ]
    left = vectors.select(*key, *[F.col(name).alias(f"l_{name}") for name in compared], F.lit(1).alias("_l"))
    right = annotated.select(*key, *[F.col(name).alias(f"r_{name}") for name in compared], F.lit(1).alias("_r"))
    both = left.join(right, key, "full_outer")
    pair = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(
        F.count("_l").alias("vector_rows"),
        F.count("_r").alias("annotated_rows"),
        F.count_if(~pair).alias("unmatched_keys"),
        *[
            F.count_if(pair & ~F.col(f"l_{name}").eqNullSafe(F.col(f"r_{name}"))).alias(name)
            for name in compared
        ],
    )


def validate_alignment(vectors: DataFrame, annotated: DataFrame, *, key: list[str], columns: list[str] | None = None) -> None:
    """Error naming the first difference between the vector table and the annotated tokens."""
    found = alignment_mismatches(vectors, annotated, key=key, columns=columns).first().asDict()
    if found["vector_rows"] != found["annotated_rows"]:
        raise ValueError(
            f"annotated token rows ({found['annotated_rows']}) do not match vector rows ({found['vector_rows']})"
        )
    for name, count in found.items():
        if name in ("vector_rows", "annotated_rows"):
            continue
        if count:
            raise ValueError(f"annotated_tokens mismatch vectors in column {name!r}: {count} rows differ")


def ambiguous_rows(annotated: DataFrame, *, by: list[str]) -> DataFrame:
    """Validly labelled rows whose casefolded form carries more than one label; adds ``form_lower``."""
    require_columns(annotated, [*by, "FORM", "SEMCLASS"], "annotated_tokens")
    valid = annotated.filter(has_valid_label("SEMCLASS")).withColumn("form_lower", casefold(F.col("FORM").cast("string")))
    forms = valid.groupBy(*by, "form_lower").agg(
        F.count("*").alias("_rows"),
        (F.min("SEMCLASS") != F.max("SEMCLASS")).alias("_many"),
    )
    kept = lookup_join(valid, forms, {name: name for name in [*by, "form_lower"]}, weight="_rows")
    return kept.filter("_many").drop("_rows", "_many")


def _pair_count(n: Column) -> Column:
    wide = n.cast(PAIRS)
    return F.floor((wide * (wide - 1)).cast(PAIRS) / 2).cast(PAIRS)


def _product(a: Column, b: Column) -> Column:
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(PAIRS)


def _rate(count: Column, total: Column) -> Column:
    return F.when(total > 0, count.cast("double") / total.cast("double"))


def label_parts(rows: DataFrame, *, by: list[str], embedding: str = "embedding") -> DataFrame:
    """State per form and label: token count, sum of unit vectors, same-cluster pairs, cluster counts.

    Counts per (form, label, cluster) form first, so a very frequent form is combined inside the tasks. The
    cluster list is bounded by the number of clusters.
    """
    key = [*by, "form_lower", "SEMCLASS"]
    sums = rows.select(*key, l2_normalize(embedding).alias("_unit")).groupBy(*key).agg(
        F.count("*").alias("n"), vector_sum("_unit").alias("vector_sum")
    )
    cells = rows.groupBy(*key, F.col("cluster").cast("bigint").alias("cluster")).agg(F.count("*").alias("m"))
    clusters = cells.groupBy(*key).agg(
        F.sum(_pair_count(F.col("m"))).cast(PAIRS).alias("same_cluster_pairs"),
        F.array_sort(F.collect_list(F.struct("cluster", "m"))).alias("cells"),
    )
    return sums.join(clusters, key)


def _cells_text(cells: Column, top: int = TOP) -> Column:
    """``cluster: count`` lines, largest first, at most ``top``."""
    ranked = F.array_sort(
        F.transform(cells, lambda item: F.struct((-item["m"]).alias("rank"), item["cluster"].alias("cluster")))
    )
    return F.array_join(
        F.transform(
            F.slice(ranked, 1, top),
            lambda item: F.concat_ws(": ", item["cluster"].cast("string"), (-item["rank"]).cast("string")),
        ),
        "\n",
    )


def within_labels(parts: DataFrame, *, by: list[str]) -> DataFrame:
    """Per form and label: pairs, mean cosine from the norm of the sum, same and different cluster pairs."""
    pairs = _pair_count(F.col("n"))
    cosine = (squared_norm("vector_sum") - F.col("n")) / 2.0
    different = (pairs - F.col("same_cluster_pairs")).cast(PAIRS)
    return parts.select(
        *by,
        "form_lower",
        F.col("SEMCLASS").alias("semclass"),
        F.col("n").alias("token_count"),
        pairs.alias("pair_count"),
        _rate(cosine, pairs).alias("mean_cosine"),
        F.col("same_cluster_pairs").alias("same_cluster_pair_count"),
        different.alias("different_cluster_pair_count"),
        _rate(different, pairs).alias("different_cluster_rate"),
        F.size("cells").alias("cluster_count"),
        _cells_text(F.col("cells")).alias("clusters"),
    )


def label_pairs(parts: DataFrame, *, by: list[str]) -> DataFrame:
    """Per form and label pair (a < b): pairs, mean cross cosine, same-cluster pairs, shared clusters.

    The pairs are label pairs of one form, the rows of the report itself; tokens are never paired.
    """
    key = [*by, "form_lower"]
    side = lambda s: parts.select(
        *key,
        F.col("SEMCLASS").alias(f"semclass_{s}"),
        F.col("n").alias(f"token_count_{s}"),
        F.col("vector_sum").alias(f"sum_{s}"),
        F.col("cells").alias(f"cells_{s}"),
    )
    joined = side("a").join(side("b"), key).filter(F.col("semclass_a") < F.col("semclass_b"))
    pairs = _product(F.col("token_count_a"), F.col("token_count_b"))
    as_map = lambda name: F.map_from_entries(F.col(name))
    shared = F.array_sort(F.array_intersect(F.map_keys(as_map("cells_a")), F.map_keys(as_map("cells_b"))))
    counted = joined.withColumns({"_a": as_map("cells_a"), "_b": as_map("cells_b"), "_shared": shared})
    same = F.aggregate(
        "_shared",
        F.lit(0).cast(PAIRS),
        lambda acc, c: (acc + _product(F.col("_a")[c], F.col("_b")[c])).cast(PAIRS),
    )
    return counted.select(
        *key,
        "semclass_a",
        "semclass_b",
        "token_count_a",
        "token_count_b",
        pairs.alias("pair_count"),
        _rate(dot("sum_a", "sum_b"), pairs).alias("mean_cosine"),
        same.alias("same_cluster_pair_count"),
        _rate(same, pairs).alias("same_cluster_rate"),
        _cells_text(F.col("cells_a")).alias("clusters_a"),
        _cells_text(F.col("cells_b")).alias("clusters_b"),
        F.array_join(F.transform("_shared", lambda c: c.cast("string")), "\n").alias("shared_clusters"),
    )


def form_summary(rows: DataFrame, parts: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """Per form: totals, mean cosines and rates within and across labels, and their gap.

    Cross-label totals come from the form total minus the label totals (of counts, vector sums and cluster
    counts), so not even label pairs are formed. NaN means become null here.
    """
    key = [*by, "form_lower"]
    totals = parts.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("semclass_count"),
        F.sum(_pair_count(F.col("n"))).cast(PAIRS).alias("same_pairs"),
        F.sum("same_cluster_pairs").cast(PAIRS).alias("same_same"),
        F.sum(F.when(F.col("n") >= 2, (squared_norm("vector_sum") - F.col("n")) / 2.0)).alias("same_cosine"),
        F.sum(squared_norm("vector_sum")).alias("label_squares"),
        vector_sum("vector_sum").alias("form_sum"),
    )
    cells = rows.groupBy(*key, F.col("cluster").cast("bigint").alias("cluster")).agg(
        F.count("*").alias("m"), first_seen(rows, order).alias("first")
    )
    clusters = cells.groupBy(*key).agg(
        F.count("*").alias("cluster_count"), F.sum(_pair_count(F.col("m"))).cast(PAIRS).alias("all_same")
    )
    text = lambda value, name: counts_text(
        rows.groupBy(*key, F.col(value).cast("string").alias("value")).agg(
            F.count("*").alias("count"), first_seen(rows, order).alias("first")
        ),
        key,
        name=name,
        top_n=TOP,
    )
    joined = totals.join(clusters, key)
    for value, name in (("FORM", "forms"), ("SEMCLASS", "semclasses"), ("cluster", "clusters")):
        joined = joined.join(text(value, name), key)
    diff_pairs = (_pair_count(F.col("n")) - F.col("same_pairs")).cast(PAIRS)
    diff_cosine = (squared_norm("form_sum") - F.col("label_squares")) / 2.0
    diff_same = (F.col("all_same") - F.col("same_same")).cast(PAIRS)
    same_different = (F.col("same_pairs") - F.col("same_same")).cast(PAIRS)
    same_mean, diff_mean = _rate(F.col("same_cosine"), F.col("same_pairs")), _rate(diff_cosine, diff_pairs)
    return joined.select(
        *key,
        F.col("n").alias("token_count"),
        "semclass_count",
        "cluster_count",
        "forms",
        "semclasses",
        "clusters",
        diff_pairs.alias("diff_semclass_pair_count"),
        diff_mean.alias("diff_semclass_mean_cosine"),
        diff_same.alias("diff_semclass_same_cluster_pair_count"),
        _rate(diff_same, diff_pairs).alias("diff_semclass_same_cluster_rate"),
        F.col("same_pairs").alias("same_semclass_pair_count"),
        same_mean.alias("same_semclass_mean_cosine"),
        same_different.alias("same_semclass_different_cluster_pair_count"),
        _rate(same_different, F.col("same_pairs")).alias("same_semclass_different_cluster_rate"),
        (same_mean - diff_mean).alias("same_minus_diff_cosine"),
    )


def form_order() -> list[Column]:
    return [
        F.desc_nulls_last("same_minus_diff_cosine"),
        F.desc_nulls_last("diff_semclass_same_cluster_rate"),
        F.desc_nulls_last("same_semclass_different_cluster_rate"),
        F.desc("diff_semclass_pair_count"),
        F.asc("form_lower"),
    ]


def pair_order() -> list[Column]:
    return [
        F.asc_nulls_last("mean_cosine"),
        F.desc_nulls_last("same_cluster_rate"),
        F.desc("pair_count"),
        F.asc("form_lower"),
        F.asc("semclass_a"),
        F.asc("semclass_b"),
    ]


def within_order() -> list[Column]:
    return [F.desc_nulls_last("different_cluster_rate"), F.desc("pair_count"), F.asc("form_lower"), F.asc("semclass")]


def run_overview(forms: DataFrame, *, by: list[str]) -> DataFrame:
    """Per run: pair-weighted means and rates over all ambiguous forms."""

    def weighted(mean: str, pairs: str) -> Column:
        return F.sum(F.col(mean) * F.col(pairs).cast("double"))

    diff, same = F.sum("diff_semclass_pair_count"), F.sum("same_semclass_pair_count")
    diff_mean = _rate(F.coalesce(weighted("diff_semclass_mean_cosine", "diff_semclass_pair_count"), F.lit(0.0)), diff)
    same_mean = _rate(F.coalesce(weighted("same_semclass_mean_cosine", "same_semclass_pair_count"), F.lit(0.0)), same)
    zero = lambda value: F.coalesce(value, F.lit(0)).cast(PAIRS)
    return forms.groupBy(*by).agg(
        F.count("*").alias("ambiguous_form_count"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("ambiguous_token_count"),
        zero(diff).alias("diff_semclass_pair_count"),
        diff_mean.alias("diff_semclass_mean_cosine"),
        zero(same).alias("same_semclass_pair_count"),
        same_mean.alias("same_semclass_mean_cosine"),
        (same_mean - diff_mean).alias("same_minus_diff_cosine"),
        _rate(F.sum("diff_semclass_same_cluster_pair_count"), diff).alias("diff_semclass_same_cluster_rate"),
        _rate(F.sum("same_semclass_different_cluster_pair_count"), same).alias(
            "same_semclass_different_cluster_rate"
        ),
    )


def form_examples(
    rows: DataFrame, forms: DataFrame, *, order: list[str], max_examples: int = 200, examples_per_form: int = 4
) -> DataFrame:
    """Example tokens of one run: the first forms in report order, a few rows per label, at most ``max_examples``.

    A capped report by definition; the chosen forms are at most ``max_examples`` rows and are broadcast.
    """
    if max_examples <= 0 or examples_per_form <= 0:
        return rows.limit(0)
    wanted = max(1, -(-max_examples // examples_per_form))
    top = forms.orderBy(*form_order()).limit(wanted).select("form_lower")
    ranked = top.sparkSession.createDataFrame(
        [(row["form_lower"], place) for place, row in enumerate(top.collect())], "form_lower string, form_rank int"
    )
    per_label = F.row_number().over(W.partitionBy("form_lower", "SEMCLASS").orderBy("cluster", *order))
    return (
        rows.join(F.broadcast(ranked), "form_lower")
        .withColumn("_rank", per_label)
        .filter(F.col("_rank") <= examples_per_form)
        .orderBy("form_rank", "SEMCLASS", "cluster", *order)
        .limit(max_examples)
        .drop("_rank")
    )
