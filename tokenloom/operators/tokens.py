"""Token tables: target filters, sentence text, sentence assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.labels import (
    MISSING_TERMS,
    is_empty_node,
    is_multiword,
    is_punctuation,
    require_columns,
)
from tokenloom.functions.text import is_word, lower_all, tokenize

# Column names of the annotated format, in file order.
ANNOTATED_COLUMNS = [
    "ID",
    "FORM",
    "LEMMA",
    "UPOS",
    "XPOS",
    "FEATS",
    "HEAD",
    "DEPREL",
    "DEPS",
    "MISC",
    "DEEPSLOT",
    "SEMCLASS",
]
SENTENCE_KEY = ["split", "source_file", "sentence_index"]
TOKEN_KEY = [*SENTENCE_KEY, "token_index"]


def keep_tokens(
    tokens: DataFrame, *, include_punctuation: bool = False, include_empty: bool = False
) -> DataFrame:
    """Target filter. The default keeps surface words; ``include_empty`` also lets range rows back in."""
    require_columns(tokens, ["ID", "FORM", "UPOS"], "tokens")
    condition = F.lit(True)
    if not include_empty:
        condition = condition & ~is_empty_node() & ~is_multiword()
    if not include_punctuation:
        condition = condition & ~is_punctuation()
    return tokens.filter(condition)


def _surface(tokens: Column, *, include_punctuation: bool) -> Column:
    def kept(token: Column) -> Column:
        surface = ~is_empty_node(token["ID"], token["FORM"]) & ~is_multiword(token["ID"])
        return surface if include_punctuation else surface & ~is_punctuation(token["UPOS"])

    return F.filter(tokens, kept)


def surface_text(tokens: Column, *, include_punctuation: bool = True) -> Column:
    kept = _surface(tokens, include_punctuation=include_punctuation)
    return F.array_join(F.transform(kept, lambda token: token["FORM"]), " ")


def sentence_text(sentences: DataFrame) -> Column:
    """Text from the metadata, else the surface forms joined by spaces."""
    return F.coalesce(sentences["metadata"]["text"], surface_text(sentences["tokens"]))


def context_text(sentences: DataFrame, *, include_punctuation: bool = True) -> Column:
    """The metadata text only stands in for the forms when punctuation is kept."""
    joined = surface_text(sentences["tokens"], include_punctuation=include_punctuation)
    return F.coalesce(sentences["metadata"]["text"], joined) if include_punctuation else joined


def explode_sentences(
    sentences: DataFrame, *, include_punctuation: bool = True, include_empty: bool = True
) -> DataFrame:
    """Token table of a sentence table: one row per token with flags and ``context_text``."""
    rows = sentences.select(
        *[name for name in sentences.columns if name not in ("tokens", "metadata", "comments")],
        sentence_text(sentences).alias("context_text"),
        F.inline("tokens"),
    ).withColumns({"is_punctuation": is_punctuation(), "is_empty_node": is_empty_node()})
    return keep_tokens(rows, include_punctuation=include_punctuation, include_empty=include_empty)


def assemble_sentences(tokens: DataFrame, key: list[str], *, order: str = "token_index") -> DataFrame:
    """Sentence table of a token table: one row per sentence, as in the source file.

    A sentence is one record of the source, so its token array is bounded by what a source record may hold.
    """
    columns = [name for name in tokens.columns if name not in key and name != order]
    packed = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return tokens.groupBy(*key).agg(packed.alias("tokens"))


def corpus_counts(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Sentences, token rows and embedding targets of a token table."""
    target = ~is_empty_node() & ~is_multiword() & ~is_punctuation()
    per_sentence = tokens.groupBy(*key).agg(F.count("*").alias("rows"), F.count_if(target).alias("targets"))
    return per_sentence.agg(
        F.count("*").alias("sentence_count"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("token_row_count"),
        F.coalesce(F.sum("targets"), F.lit(0)).alias("target_count"),
    )


def sentence_terms(
    sentences: DataFrame,
    *,
    bases: list[str] = ["lemma"],  # noqa: B006
    lowercase: bool = True,
    drop_empty: bool = True,
) -> DataFrame:
    """Term documents: per sentence and basis, the ordered target terms; neighbours close up over blanks.

    Works inside each sentence row, so it needs no shuffle. Adds ``token_basis``, ``terms`` and ``term_tokens``
    (the token structs behind the terms). Sentences without terms are dropped; counting pipelines switch that off,
    since an empty document counts for nothing and the filter would build every array twice.
    """
    column = {"lemma": "LEMMA", "form": "FORM"}
    unknown = sorted(set(bases) - set(column))
    if unknown:
        raise ValueError(f"grams are built on 'lemma' or 'form', not on {unknown}")
    passed = [name for name in sentences.columns if name not in ("tokens", "comments")]
    # Each step is a column of its own, so that no array is built twice.
    stages = sentences.withColumn("_targets", _surface(F.col("tokens"), include_punctuation=False))
    for basis in bases:
        name = column[basis]
        stages = stages.withColumn(
            f"_kept_{basis}", F.filter("_targets", lambda token: ~token[name].isin(MISSING_TERMS))  # noqa: B023
        )
        forms = F.transform(f"_kept_{basis}", lambda token: token[name])  # noqa: B023
        stages = stages.withColumn(f"_terms_{basis}", lower_all(forms) if lowercase else forms)
    if len(bases) == 1:
        stacked = stages.withColumn("token_basis", F.lit(bases[0]))
    else:
        stacked = stages.withColumn("token_basis", F.explode(F.array(*map(F.lit, bases))))

    def of_basis(kind: str) -> Column:
        chosen = F.col(f"_{kind}_{bases[-1]}")
        for basis in bases[:-1]:
            chosen = F.when(F.col("token_basis") == basis, F.col(f"_{kind}_{basis}")).otherwise(chosen)
        return chosen

    documents = stacked.select(
        *passed, "token_basis", of_basis("terms").alias("terms"), of_basis("kept").alias("term_tokens")
    )
    return documents.filter(F.size("terms") > 0) if drop_empty else documents


def tokens_from_text(lines: DataFrame, *, text: str = "text", label: str | None = None) -> DataFrame:
    """Token table of raw text lines; lemma is the lower-cased form and symbols are punctuation.

    ``lines`` keeps its other columns as the sentence key. ``label`` names a column to stand in for SEMCLASS.
    """
    passed = [name for name in lines.columns if name != text]
    words = lines.select(*passed, F.posexplode(tokenize(text)).alias("token_index", "FORM"))
    return words.select(
        *passed,
        "token_index",
        (F.col("token_index") + 1).cast("string").alias("ID"),
        "FORM",
        F.lower("FORM").alias("LEMMA"),
        F.when(is_word("FORM"), F.lit("X")).otherwise(F.lit("PUNCT")).alias("UPOS"),
        (F.col(label) if label else F.lit("_")).cast("string").alias("SEMCLASS"),
    )
