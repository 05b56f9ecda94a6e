"""Benchmark decontamination over a positional inverted index, with DataFrame operations only.

Words are runs of ASCII letters and digits (A-Z lower-cased) and anything beyond ASCII. The index stores one posting
(term, document, position) per corpus word that occurs in a test item; other words cannot take part in a match. Term
frequencies over the whole corpus rank the words of each window of 13 test words. The postings of the rarest word are
shifted by its offset and intersected with those of the second rarest; what survives is intersected with the postings
of all words of the item, which leaves the exact runs. The same index answers proximity queries.

Documents are keyed by a hash of id and text, so repeated ids with other texts stay apart, and repeated rows share
their postings without counting twice. A null text has no words. Small sides are broadcast only when their counted
rows are below ``BROADCAST_ROWS`` and are shuffled otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import ascii_lower, or_empty, stored

WINDOW = 13
BROADCAST_ROWS = 500_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str = "text") -> Column:
    """Array of the words of a text column; null and empty texts have none."""
    return F.filter(F.split(ascii_lower(or_empty(text)), _BREAK), lambda word: word != "")


def document_key() -> Column:
    return F.xxhash64("doc_id", "text")


def small_side(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Store ``df``; hint a broadcast if its row count is within ``limit``."""
    kept = stored(df, name)
    return F.broadcast(kept) if kept.limit(limit + 1).count() <= limit else kept


@dataclass(frozen=True)
class PositionalIndex:
    """``terms`` (term, term_id, frequency) and ``postings`` (term_id, key, position) of a corpus."""

    terms: DataFrame
    postings: DataFrame


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, n, place, term) per word of each test item, places from 0.

    ``item`` hashes id and words: rows that repeat an item are one, rows that repeat an id with another text are two.
    """
    found = items.select("item_id", words_of().alias("words")).where(F.size("words") > 0).distinct()
    return found.select(
        F.xxhash64("item_id", "words").alias("item"),
        "item_id",
        F.size("words").alias("n"),
        F.posexplode("words").alias("place", "term"),
    )


def build_index(documents: DataFrame, wanted: DataFrame) -> PositionalIndex:
    """Index the whole corpus on the distinct words (term) of ``wanted``."""
    listed = stored(wanted.select("term").distinct(), "index-terms")
    terms = small_side(listed.select("term", F.xxhash64("term").alias("term_id")), "index-term-ids")
    tokens = documents.select(document_key().alias("key"), F.posexplode(words_of()).alias("position", "term"))
    postings = stored(tokens.join(terms, "term").select("term_id", "key", "position"), "index-postings")
    counted = postings.groupBy("term_id").agg(F.count("*").alias("frequency"))
    named = listed.select("term", F.xxhash64("term").alias("term_id")).join(counted, "term_id", "left")
    return PositionalIndex(stored(named.fillna(0, ["frequency"]), "index-frequencies"), postings)


def _anchors(words: DataFrame, window: int) -> DataFrame:
    """The two rarest places of every window: (item, first, first_term, second, second_term), each pair once."""
    of_item = words.groupBy("item", "n").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "frequency", "term_id"))),
            lambda w: F.struct(w.frequency.alias("frequency"), w.place.alias("place"), w.term_id.alias("term_id")),
        ).alias("w")
    )
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)))
    ranked = of_item.select("item", F.explode(starts).alias("start"), "w").select(
        "item", F.sort_array(F.slice("w", F.col("start"), F.lit(window))).alias("w")
    )
    first, second = F.col("w")[0], F.element_at("w", F.least(F.lit(2), F.size("w")))
    return ranked.select(
        "item",
        first.place.alias("first"),
        first.term_id.alias("first_term"),
        second.place.alias("second"),
        second.term_id.alias("second_term"),
    ).distinct()


def phrase_matches(index: PositionalIndex, words: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(key, item_id, positions): the corpus positions that exact runs of a window of each item cover.

    ``words`` is ``item_words``; an item shorter than the window is one window. Each pair of item and document is one
    row per alignment.
    """
    known = stored(words.join(index.terms, "term").drop("term"), "item-terms")
    pairs = small_side(_anchors(known, window), "item-anchors")
    shifted = index.postings.join(pairs, F.col("term_id") == F.col("first_term")).select(
        "item", "key", (F.col("position") - F.col("first")).alias("delta"), "second", "second_term"
    )
    shifted = stored(shifted, "shifted-postings")
    seconds = small_side(pairs.select(F.col("second_term").alias("term_id")).distinct(), "second-terms")
    keys = small_side(shifted.select("key").distinct(), "candidate-keys")
    others = index.postings.join(seconds, "term_id", "left_semi").join(keys, "key", "left_semi")
    lines = shifted.withColumn("position", F.col("delta") + F.col("second")).join(
        others.withColumnRenamed("term_id", "second_term"), ["key", "position", "second_term"], "left_semi"
    )
    lines = stored(lines.select("item", "key", "delta").distinct(), "alignments")
    near = index.postings.join(small_side(lines.select("key").distinct(), "matched-keys"), "key", "left_semi")
    needed = lines.join(small_side(known, "needed-terms"), "item").select(
        "item", "item_id", "n", "key", "delta", "place", "term_id", (F.col("delta") + F.col("place")).alias("position")
    )
    met = needed.join(near, ["key", "position", "term_id"])
    whole = F.least(F.col("n"), F.lit(window))
    runs = met.groupBy("key", "item", "item_id", "n", "delta").agg(F.sort_array(F.collect_set("position")).alias("met"))
    starts = F.filter(
        "met", lambda p, at: F.coalesce(F.get("met", at + whole - 1) == p + whole - 1, F.lit(False))
    )
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + whole - 1))))
    return runs.select("key", "item_id", covered.alias("positions")).where(F.size("positions") > 0)


def proximity_matches(index: PositionalIndex, words: DataFrame, *, width: int) -> DataFrame:
    """(key, item_id, first): stretches of ``width`` corpus positions that hold every distinct word of an item.

    A stretch is reported once, at its first matching word. Candidates grow from the postings of the item's rarest
    word, so the work follows that word's frequency.
    """
    known = stored(words.join(index.terms, "term").select("item", "item_id", "term_id", "frequency").distinct(), "near-terms")
    rarest = known.groupBy("item", "item_id").agg(
        F.min(F.struct("frequency", "term_id")).alias("r"), F.count("*").alias("wanted")
    )
    seeds = index.postings.join(
        small_side(rarest.select("item", "item_id", "wanted", F.col("r.term_id").alias("term_id")), "near-rarest"), "term_id"
    ).select("item", "item_id", "wanted", "key", F.col("position").alias("seed"))
    others = index.postings.join(small_side(known.select("item", "term_id"), "near-wanted"), "term_id")
    found = seeds.join(others, ["item", "key"]).where(F.abs(F.col("position") - F.col("seed")) < width)
    stretches = found.groupBy("item", "item_id", "wanted", "key", "seed").agg(
        F.sort_array(F.collect_set(F.struct("position", "term_id"))).alias("met")
    )
    held = F.filter(
        "met",
        lambda a: (a.position <= F.col("seed"))
        & (
            F.size(
                F.array_distinct(
                    F.transform(
                        F.filter("met", lambda b: (b.position >= a.position) & (b.position < a.position + width)),
                        lambda b: b.term_id,
                    )
                )
            )
            == F.col("wanted")
        ),
    )
    return (
        stretches.select("key", "item_id", F.explode(held).alias("a")).select("key", "item_id", F.col("a.position").alias("first")).distinct()
    )


def contamination(documents: DataFrame, items: DataFrame, *, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``documents`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    A document is contaminated if it has hit words and they are at least one in ``share``. Null item ids count as the
    empty id. Rows with a null id or text are kept; columns that have one of the new names are replaced.
    """
    fresh = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "key", "found"]
    documents = documents.drop(*fresh)
    words = stored(item_words(items), "benchmark-words")
    index = build_index(documents.select("doc_id", "text"), words)
    matches = phrase_matches(index, words, window=window)
    hits = matches.groupBy("key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).cast("bigint").alias("n_hit"),
        F.sort_array(F.collect_set(or_empty(F.col("item_id").cast("string")))).alias("found"),
    )
    hits = small_side(hits.select("key", "n_hit", F.size("found").cast("bigint").alias("n_items"), F.array_join("found", ",").alias("found")), "hits")
    counted = documents.withColumn("key", document_key()).withColumn("n_words", F.size(words_of()).cast("bigint"))
    return (
        counted.join(hits, "key", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("bigint"))
        .withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("bigint"))
        .withColumn("items_sha256", F.sha2(or_empty("found"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
        .drop("key", "found")
    )
