"""End-to-end corpus analyses: collocations, collocations against clusters, same-form similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import ambiguity, collocate, occurrences
from tokenloom.operators.tokens import SENTENCE_KEY, TOKEN_KEY, sentence_terms, sentence_text
from tokenloom.session import materialize


def collocation_experiment(
    sentences: DataFrame,
    *,
    token_bases: tuple[str, ...] = ("lemma", "form"),
    ngram_sizes: tuple[int, ...] = (2, 3),
    min_freq: int = collocate.MIN_FREQ,
    sort_by: str = "pmi",
    max_rows: int | None = None,
    lowercase: bool = True,
) -> dict[str, DataFrame]:
    """Collocation tables of a sentence table and their metadata."""
    documents = sentence_terms(sentences, bases=list(token_bases), lowercase=lowercase, drop_empty=False)
    tables = materialize(
        collocate.collocation_tables(
            documents,
            token_bases=token_bases,
            ngram_sizes=ngram_sizes,
            min_freq=min_freq,
            sort_by=sort_by,
            max_rows=max_rows,
        ),
        "collocations",
    )
    settings = {
        "token_bases": ",".join(token_bases),
        "ngram_sizes": ",".join(map(str, ngram_sizes)),
        "min_freq": min_freq,
        "sort_by": sort_by,
        "max_rows": max_rows,
        "lowercase": lowercase,
        "token_filter": "surface non-punctuation tokens",
    }
    return {
        "collocations": tables,
        "metadata": collocate.collocation_metadata(sentences, documents, tables, settings),
    }


def collocation_cluster_experiment(
    sentences: DataFrame,
    annotated: DataFrame,
    runs: DataFrame,
    *,
    by: list[str] = ["run_id"],  # noqa: B006
    sentence_key: list[str] = SENTENCE_KEY,
    ngram_sizes: tuple[int, ...] = (2, 3),
    min_freq: int = collocate.CLUSTER_MIN_FREQ,
    sort_by: str = "pmi",
    max_rows: int | None = None,
    lowercase: bool = True,
) -> dict[str, DataFrame]:
    """Lemma collocations against the clusters of every run. The frequency floor is at least five."""
    documents = sentence_terms(
        sentences.withColumn("context_text", sentence_text(sentences)),
        bases=["lemma"],
        lowercase=lowercase,
        drop_empty=False,
    )
    tables = materialize(
        collocate.collocation_tables(
            documents,
            token_bases=("lemma",),
            ngram_sizes=ngram_sizes,
            min_freq=max(min_freq, collocate.CLUSTER_MIN_FREQ),
            sort_by=sort_by,
            max_rows=max_rows,
        ),
        "collocations",
    )
    chosen = collocate.select_for_clusters(tables, sort_by=sort_by)
    selected = {"sentence_key": sentence_key, "ngram_sizes": ngram_sizes, "selected_rows": tables.count()}
    # The table needs the places of the tokens only; context texts and token structs would travel with every occurrence.
    table = occurrences.collocation_cluster_table(
        chosen,
        occurrences.occurrences(occurrences.token_places(documents, sentence_key), tables, **selected),
        annotated,
        sentence_key=sentence_key,
        by=by,
        order=[*sentence_key, "token_index"],
        lowercase=lowercase,
        runs=runs,
    )
    return {
        "collocations": table,
        "occurrences": occurrences.occurrences(documents, tables, **selected),
        "overview": occurrences.collocation_overview(table, runs),
    }


def similarity_experiment(
    vectors: DataFrame,
    annotated: DataFrame,
    *,
    by: list[str] = ["run_id"],  # noqa: B006
    key: list[str] = TOKEN_KEY,
    order: list[str] | None = None,
    embedding: str = "embedding",
) -> dict[str, DataFrame]:
    """Same-form tables of every run: forms, label pairs, within-label rows, overview.

    Every run must hold exactly the tokens of the vector table.
    """
    runs = annotated.select(*by).distinct()
    for run in runs.collect():
        matching = annotated
        for name in by:
            matching = matching.filter(F.col(name).eqNullSafe(F.lit(run[name])))
        ambiguity.validate_alignment(vectors, matching, key=key)
    rows = materialize(
        ambiguity.ambiguous_rows(annotated.join(vectors.select(*key, embedding), key), by=by), "ambiguous"
    )
    parts = materialize(ambiguity.label_parts(rows, by=by, embedding=embedding), "label_parts")
    forms = materialize(ambiguity.form_summary(rows, parts, by=by, order=order or key), "forms")
    overview = runs.join(ambiguity.run_overview(forms, by=by), by, "left").fillna(
        0, ["ambiguous_form_count", "ambiguous_token_count"]
    )
    return {
        "rows": rows,
        "forms": forms.orderBy(*by, *ambiguity.form_order()),
        "classpairs": ambiguity.label_pairs(parts, by=by).orderBy(*by, *ambiguity.pair_order()),
        "within": ambiguity.within_labels(parts, by=by).orderBy(*by, *ambiguity.within_order()),
        "overview": overview,
    }
