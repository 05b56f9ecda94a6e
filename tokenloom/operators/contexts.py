"""Bounded text contexts: chunking folds, the global target budget, and piece-safe splitting."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.labels import is_punctuation, require_columns
from tokenloom.functions.text import is_word, tokenize
from tokenloom.operators.skew import running_total, running_totals

MAX_CONTEXT_TOKENS = 192
MAX_CONTEXT_WORDS = 128


def _chunk_starts(flags: Column, *, max_tokens: int, max_targets: int) -> Column:
    """Start offsets of the greedy chunks over an array of target flags, as one in-row fold."""
    if max_tokens < 1 or max_targets < 1:
        raise ValueError("a context needs room for at least one token")
    empty = F.struct(
        F.lit(0).alias("position"),
        F.lit(0).alias("size"),
        F.lit(0).alias("targets"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(state: Column, target: Column) -> Column:
        full = (state["size"] >= max_tokens) | (target & (state["targets"] >= max_targets))
        opens = (state["size"] == 0) | full
        return F.struct(
            (state["position"] + 1).alias("position"),
            F.when(opens, 1).otherwise(state["size"] + 1).alias("size"),
            (F.when(opens, 0).otherwise(state["targets"]) + target.cast("int")).alias("targets"),
            F.when(opens, F.array_append(state["starts"], state["position"]))
            .otherwise(state["starts"])
            .alias("starts"),
        )

    return F.aggregate(flags, empty, step, lambda state: state["starts"])


def _cut(values: str, starts: str = "_starts") -> Column:
    """Chunks of ``values`` between consecutive start offsets."""
    ends = F.array_append(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.size(values))
    return F.zip_with(starts, ends, lambda start, end: F.slice(F.col(values), start + 1, end - start))


def _target_indices(flags: Column) -> Column:
    return F.array_compact(F.transform(flags, lambda flag, index: F.when(flag, index)))


def chunk_raw_text(
    documents: DataFrame,
    *,
    document_index: str,
    text: str = "text",
    max_context_tokens: int = MAX_CONTEXT_TOKENS,
    max_context_word_tokens: int = MAX_CONTEXT_WORDS,
) -> DataFrame:
    """Contexts of raw text, one row per chunk; per-document and shuffle-free.

    A chunk closes before a token that would exceed the token limit, or before a word that would exceed the
    word limit. Chunks without words are dropped but still use up a ``chunk_index``.
    """
    tokenized = documents.select(
        F.col(document_index).cast("bigint").alias("document_index"),
        tokenize(F.coalesce(F.col(text), F.lit(""))).alias("_tokens"),
    ).withColumn("_flags", F.transform("_tokens", is_word))
    starts = _chunk_starts(
        F.col("_flags"), max_tokens=max_context_tokens, max_targets=max_context_word_tokens
    )
    chunks = tokenized.withColumn("_starts", starts).select(
        "document_index",
        F.posexplode(F.arrays_zip(_cut("_tokens").alias("tokens"), _cut("_flags").alias("flags"))).alias(
            "chunk_index", "chunk"
        ),
    )
    return chunks.select(
        "document_index",
        "chunk_index",
        F.col("chunk.tokens").alias("tokens"),
        _target_indices(F.col("chunk.flags")).alias("target_indices"),
    ).filter(F.size("target_indices") > 0)


def chunk_sentences(
    sentences: DataFrame,
    *,
    order: list[str],
    max_context_tokens: int = MAX_CONTEXT_TOKENS,
    max_context_word_tokens: int = MAX_CONTEXT_WORDS,
    max_sentences: int | None = None,
) -> DataFrame:
    """Contexts of annotated sentences with aligned lemmas.

    ``order`` holds the columns that order sentences over all files. Range and empty-node rows and blank forms
    vanish; targets are word-like and not punctuation. ``document_index`` and ``chunk_index`` run over all
    files; chunks without targets leave no gap.
    """
    kept = F.filter(
        "tokens",
        lambda token: ~token["ID"].contains("-")
        & ~token["ID"].contains(".")
        & ~F.coalesce(token["FORM"], F.lit("")).isin("", "_"),
    )
    target = lambda token: ~is_punctuation(token["UPOS"]) & is_word(token["FORM"])
    # A block of comments alone is no sentence here, so it takes no number.
    flagged = sentences.filter(F.size("tokens") > 0).select(*order, kept.alias("_kept")).select(
        *order,
        F.transform("_kept", lambda token: token["FORM"]).alias("_tokens"),
        F.transform("_kept", lambda token: token["LEMMA"]).alias("_lemmas"),
        F.transform("_kept", target).alias("_flags"),
    )
    starts = _chunk_starts(F.col("_flags"), max_tokens=max_context_tokens, max_targets=max_context_word_tokens)
    chunks = F.filter(
        F.transform(
            F.arrays_zip(
                _cut("_tokens").alias("tokens"), _cut("_lemmas").alias("lemmas"), _cut("_flags").alias("flags")
            ),
            lambda chunk: F.struct(
                chunk["tokens"].alias("tokens"),
                _target_indices(chunk["flags"]).alias("target_indices"),
                chunk["lemmas"].alias("lemmas"),
            ),
        ),
        lambda chunk: F.size(chunk["target_indices"]) > 0,
    )
    # Sentences and chunks are numbered by one pass over the sentences, which carry their chunks and nothing else.
    cut = lambda rows: rows.withColumn("_starts", starts).select(*order, chunks.alias("_chunks"))
    both = F.struct(F.lit(1).cast("bigint").alias("sentences"), F.size("_chunks").cast("bigint").alias("chunks"))
    numbered = running_totals(
        flagged, both, order, totals=["document_index", "_before"], stop_at=max_sentences, prepare=cut
    )
    if max_sentences is not None:
        numbered = numbered.filter(F.col("document_index") < max_sentences)
    placed = numbered.select("document_index", "_before", F.posexplode("_chunks").alias("_place", "chunk"))
    return placed.select(
        "document_index",
        "chunk.tokens",
        "chunk.target_indices",
        "chunk.lemmas",
        (F.col("_before") + F.col("_place")).alias("chunk_index"),
    )


def first_documents(documents: DataFrame, order: list[str], max_documents: int) -> DataFrame:
    """The first ``max_documents`` documents in order; blank ones count too."""
    ranked = running_total(
        documents, F.lit(1).cast("bigint"), order, total="_rank", stop_at=max_documents
    )
    return ranked.filter(F.col("_rank") < max_documents).drop("_rank")


def take_target_budget(
    contexts: DataFrame,
    max_targets: int,
    *,
    order: tuple[str, ...] = ("document_index", "chunk_index"),
    check: bool = True,
) -> DataFrame:
    """Contexts in order up to exactly ``max_targets`` targets; the last one is cut after its last target."""
    if max_targets < 1:
        raise ValueError("max_train_tokens must be positive")
    require_columns(contexts, ["tokens", "target_indices", *order], "contexts")
    counted = running_total(
        contexts,
        F.size("target_indices").cast("bigint"),
        list(order),
        total="_before",
        stop_at=max_targets,
    ).filter(F.col("_before") < max_targets)
    if check and counted.isEmpty():
        raise ValueError("no word-like targets were collected from the corpus")
    room = (F.lit(max_targets) - F.col("_before")).cast("int")
    trimmed = counted.withColumn(
        "_keep",
        F.when(F.size("target_indices") > room, F.element_at("target_indices", room) + 1).otherwise(
            F.size("tokens")
        ),
    )
    columns = {
        "target_indices": F.slice("target_indices", 1, F.least(room, F.size("target_indices"))),
        "tokens": F.slice("tokens", 1, F.col("_keep")),
    }
    if "lemmas" in contexts.columns:
        columns["lemmas"] = F.slice("lemmas", 1, F.col("_keep"))
    return trimmed.withColumns(columns).select(*contexts.columns)


def split_by_pieces(
    contexts: DataFrame,
    piece_lengths: Callable[[list[str]], list[int]],
    *,
    max_length: int,
    special_tokens: int = 0,
) -> DataFrame:
    """Cut contexts into parts whose subword pieces fit ``max_length``; parts without a target are left out.

    ``piece_lengths`` maps the tokens of one context to their piece counts and is all that runs outside Spark's own
    expressions. Parts are filled from the left. In a context that does not fit as a whole, a token longer than the
    room ends its part and belongs to none; if it is a target, or a target has no pieces, that is an error, as no
    target may be lost. Adds ``part_index``.
    """
    room = max_length - special_tokens
    if max_length < 1 or room < 1:
        raise ValueError(f"max_length={max_length} with {special_tokens} special tokens has no room for text")

    @F.pandas_udf("array<int>")
    def counted(batch: pd.Series) -> pd.Series:
        return pd.Series([list(piece_lengths(list(tokens))) for tokens in batch])

    # The fold numbers the part of every token: ``filled`` is the room used in the open part, -1 marks a token of no part.
    opening = F.struct(
        F.lit(0).alias("part"), F.lit(0).alias("filled"), F.array().cast("array<int>").alias("parts")
    )

    def place(held: Column, pieces: Column) -> Column:
        next_part = (held.filled + pieces > room).cast("int")  # behind a token that is too long, a new part is open
        part = held.part + next_part
        too_long = pieces > room
        return F.struct(
            part.alias("part"),
            F.when(too_long, F.lit(0)).when(next_part == 1, pieces).otherwise(held.filled + pieces).alias("filled"),
            F.concat(held.parts, F.array(F.when(too_long, F.lit(-1)).otherwise(part))).alias("parts"),
        )

    measured = contexts.withColumn("_pieces", counted("tokens"))
    total = F.aggregate("_pieces", F.lit(0), lambda held, one: held + one)
    misfit = F.filter(
        "target_indices", lambda at: ~F.get("_pieces", at).between(1, room)
    )
    message = F.concat(
        F.lit("document "),
        F.col("document_index").cast("string"),
        F.lit(", chunk "),
        F.col("chunk_index").cast("string"),
        F.lit(": no part can hold target "),
        F.get("tokens", F.get(misfit, F.lit(0))),
        F.lit(f"; there is a budget of {room} pieces"),
    )
    numbered = measured.withColumn(
        "_parts",
        F.when(total <= room, F.transform("tokens", lambda _: F.lit(0)))
        .when(F.size(misfit) > 0, F.raise_error(message).cast("array<int>"))
        .otherwise(F.aggregate("_pieces", opening, place, lambda held: held.parts)),
    )
    wanted = F.array_sort(F.array_distinct(F.transform("target_indices", lambda at: F.get("_parts", at))))
    parts = numbered.select("*", F.posexplode(wanted).alias("part_index", "_part"))

    def of_part(column: str) -> Column:
        return F.filter(column, lambda _, at: F.get("_parts", at) == F.col("_part"))

    before = F.array_position("_parts", F.col("_part")).cast("int") - 1
    inside = F.filter("target_indices", lambda at: F.get("_parts", at) == F.col("_part"))
    return parts.select(
        F.col("document_index").cast("bigint").alias("document_index"),
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        "part_index",
        of_part("tokens").alias("tokens"),
        F.transform(inside, lambda at: (at - before).cast("int")).alias("target_indices"),
        *([of_part("lemmas").alias("lemmas")] if "lemmas" in contexts.columns else []),
    )


def check_target_count(before: DataFrame, after: DataFrame) -> None:
    """Error unless both context tables hold the same number of targets."""
    total = F.coalesce(F.sum(F.size("target_indices")), F.lit(0))
    expected, kept = before.agg(total).first()[0], after.agg(total).first()[0]
    if expected != kept:
        raise ValueError(f"expected piece-safe contexts to keep {expected} targets, kept {kept}")
