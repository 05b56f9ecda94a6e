"""Collocation mining: n-gram counts, association measures, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.labels import require_columns
from tokenloom.operators.skew import key_bits, lookup_join, running_total, with_likely
from tokenloom.session import materialize

MEASURES = ["raw_freq", "pmi", "likelihood_ratio", "student_t", "chi_sq"]
SORT_COLUMNS = ["frequency", *MEASURES]
MIN_FREQ = 3
CLUSTER_MIN_FREQ = 5
SMALL = 1e-20
UNIGRAM, BIGRAM, TRIGRAM, SKIP = "1", "2", "3", "s"
WORDS = ["w1", "w2", "w3"]


def check_settings(ngram_sizes: tuple[int, ...], min_freq: int, sort_by: str, max_rows: int | None) -> None:
    if min_freq < 1:
        raise ValueError(f"a frequency floor starts at 1, not {min_freq}")
    if max_rows is not None and max_rows < 1:
        raise ValueError(f"a report of {max_rows} rows is empty; leave max_rows out for all rows")
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"no ranking by {sort_by!r}; known are {', '.join(sorted(SORT_COLUMNS))}")
    unsupported = sorted(set(ngram_sizes) - {2, 3})
    if unsupported:
        raise ValueError(f"grams of two or three words can be counted, not of {unsupported}")


def _shifted(terms: str, step: int) -> Column:
    return F.slice(terms, step + 1, F.greatest(F.size(terms) - step, F.lit(0)))


def positions(documents: DataFrame, *, terms: str = "terms", passed: tuple[str, ...] = ()) -> DataFrame:
    """One row per term with the next two terms of its document (null past the end). No shuffle."""
    zipped = F.arrays_zip(
        F.col(terms).alias("w1"), _shifted(terms, 1).alias("w2"), _shifted(terms, 2).alias("w3")
    )
    return documents.select(*passed, F.inline(zipped))


def gram_counts(
    documents: DataFrame, *, by: tuple[str, ...] = (), terms: str = "terms", ngram_sizes: tuple[int, ...] = (2, 3)
) -> DataFrame:
    """All counts the measures need in one pass: ``by…, kind, w1, w2, w3, n``.

    Kinds are unigrams, adjacent pairs, trigrams and the outer pair of trigrams. Grouping sets expand each
    position once and combine before the shuffle, so frequent terms cost one row per task.
    """
    rows = positions(documents, terms=terms, passed=by)
    sets = [[*by, "w1"], [*by, "w1", "w2"]]
    if 3 in ngram_sizes:
        sets += [[*by, "w1", "w3"], [*by, "w1", "w2", "w3"]]
    kind = (
        F.when((F.grouping("w2") == 1) & (F.grouping("w3") == 1), UNIGRAM)
        .when(F.grouping("w3") == 1, BIGRAM)
        .when(F.grouping("w2") == 1, SKIP)
        .otherwise(TRIGRAM)
    )
    counted = rows.groupingSets(sets, *by, *WORDS).agg(F.count("*").alias("n"), kind.alias("kind"))
    whole = (
        (F.col("kind") == UNIGRAM)
        | ((F.col("kind") == BIGRAM) & F.col("w2").isNotNull())
        | F.col("w3").isNotNull()
    )
    return counted.filter(whole).select(*by, "kind", *WORDS, "n")


def frequent_counts(
    documents: DataFrame,
    *,
    by: tuple[str, ...] = (),
    terms: str = "terms",
    ngram_sizes: tuple[int, ...] = (2, 3),
    min_freq: int = MIN_FREQ,
) -> DataFrame:
    """The rows of :func:`gram_counts` that a floor leaves: all unigrams, and what occurs ``min_freq`` times or more.

    Most grams of a corpus occur once or twice. A first pass counts hashes of 40 bits of the pairs instead of words; only
    pairs whose hash is frequent enough, and trigrams all of whose pairs are, are counted as words, so rare ones cost a few
    bytes of shuffle each or none. Grams that share a hash can only be counted needlessly, and the floor is applied to the
    exact counts.
    """
    if min_freq <= 1:
        return gram_counts(documents, by=by, terms=terms, ngram_sizes=ngram_sizes)
    rows = positions(documents, terms=terms, passed=by)
    hashed = lambda kind, one, other: F.when(
        F.col(other).isNotNull(), F.xxhash64(*by, F.lit(kind), one, other).bitwiseAND(F.lit(2**40 - 1))
    )
    pairs = {BIGRAM: hashed(BIGRAM, "w1", "w2")}
    if 3 in ngram_sizes:
        pairs[SKIP] = hashed(SKIP, "w1", "w3")
    asked = rows.select(F.explode(F.array(*pairs.values())).alias("_hash")).filter(F.col("_hash").isNotNull())
    frequent = asked.groupBy("_hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_freq)
    gram = lambda kind, *words: F.struct(
        F.lit(kind).alias("kind"),
        *[(F.col(word) if word in words else F.lit(None).cast("string")).alias(word) for word in WORDS],
    )
    tested = {"_likely_12": pairs[BIGRAM]}
    if 3 in ngram_sizes:
        tested |= {"_likely_13": pairs[SKIP], "_likely_23": hashed(BIGRAM, "w2", "w3")}
    likely = with_likely(rows, key_bits(frequent), tested)
    found = [gram(UNIGRAM, "w1"), F.when(F.col("_likely_12"), gram(BIGRAM, "w1", "w2"))]
    if 3 in ngram_sizes:
        found += [
            F.when(F.col("_likely_13"), gram(SKIP, "w1", "w3")),
            # A trigram is at most as frequent as the pairs inside it; a word that is null makes no pair.
            F.when(
                F.col("_likely_13") & (F.col("w2").isNull() | (F.col("_likely_12") & F.col("_likely_23"))),
                gram(TRIGRAM, *WORDS),
            ),
        ]
    exploded = likely.select(*by, F.explode(F.array(*found)).alias("_gram")).filter(F.col("_gram").isNotNull())
    counted = exploded.select(*by, "_gram.*").groupBy(*by, "kind", *WORDS).agg(F.count("*").alias("n"))
    return counted.filter((F.col("kind") == UNIGRAM) | (F.col("n") >= min_freq))


def stored_counts(
    documents: DataFrame,
    *,
    by: tuple[str, ...] = (),
    terms: str = "terms",
    ngram_sizes: tuple[int, ...] = (2, 3),
    min_freq: int = 1,
) -> DataFrame:
    """:func:`frequent_counts` written once: scoring reads the counts several times with different filters."""
    counts = frequent_counts(documents, by=by, terms=terms, ngram_sizes=ngram_sizes, min_freq=min_freq)
    return materialize(counts, "counts")


def _bigram_cells(n: Column, f: Column, c1: Column, c2: Column) -> list[tuple[Column, Column]]:
    """Observed cells of the 2 x 2 table with the product of their row and column totals."""
    observed = [f, c1 - f, c2 - f, n - c1 - c2 + f]
    sides = [(c1, c2), (c1, n - c2), (n - c1, c2), (n - c1, n - c2)]
    return [(seen, left * right / n) for seen, (left, right) in zip(observed, sides, strict=True)]


def _trigram_cells(
    n: Column, f: Column, singles: list[Column], pairs: dict[str, Column]
) -> list[tuple[Column, Column]]:
    """Observed and expected cells of the 2 x 2 x 2 table."""
    c1, c2, c3 = singles
    only12, only13, only23 = pairs["12"] - f, pairs["13"] - f, pairs["23"] - f
    only1 = c1 - f - only12 - only13
    only2 = c2 - f - only12 - only23
    only3 = c3 - f - only13 - only23
    none = n - f - only12 - only13 - only23 - only1 - only2 - only3
    observed = {
        (1, 1, 1): f,
        (1, 1, 0): only12,
        (1, 0, 1): only13,
        (0, 1, 1): only23,
        (1, 0, 0): only1,
        (0, 1, 0): only2,
        (0, 0, 1): only3,
        (0, 0, 0): none,
    }
    cells = []
    for match, seen in observed.items():
        share = [single if hit else n - single for hit, single in zip(match, singles, strict=True)]
        cells.append((seen, share[0] * share[1] * share[2] / (n * n)))
    return cells


def _with_measures(rows: DataFrame, size: int) -> DataFrame:
    """Add the measures. The contingency cells are columns of their own first, so no formula repeats them."""
    n, f = F.col("_n"), F.col("_f")
    singles = [F.col(f"_c{place}") for place in range(1, size + 1)]
    pairs = {name: F.col(f"_c{name}") for name in ("12", "13", "23")}
    names = {"_n": "total", "_f": "frequency", **{f"_c{place}": f"c{place}" for place in range(1, size + 1)}}
    if size == 3:
        names |= {f"_c{name}": f"c{name}" for name in pairs}
    based = rows.withColumns({name: F.col(source).cast("double") for name, source in names.items()})
    cells = _bigram_cells(n, f, *singles) if size == 2 else _trigram_cells(n, f, singles, pairs)
    staged = based.withColumns(
        {f"_seen{at}": seen for at, (seen, _) in enumerate(cells)}
        | {f"_due{at}": due for at, (_, due) in enumerate(cells)}
        | {"_product": reduce(lambda a, b: a * b, singles), "_scale": n if size == 2 else n * n}
    )
    seen_due = [(F.col(f"_seen{at}"), F.col(f"_due{at}")) for at in range(len(cells))]
    if size == 2:
        ii, io, oi, oo = (seen for seen, _ in seen_due)
        cross, below = ii * oo - io * oi, (ii + io) * (ii + oi) * (io + oo) * (oi + oo)
        chi = F.when(below != 0, n * cross * cross / below)
    else:
        chi = sum(((seen - due) * (seen - due) / (due + SMALL) for seen, due in seen_due), F.lit(0.0))
    likelihood = sum((seen * F.ln(seen / (due + SMALL) + SMALL) for seen, due in seen_due), F.lit(0.0))
    measures = {
        "raw_freq": f / n,
        "pmi": F.log2(f * F.col("_scale")) - F.log2("_product"),
        "likelihood_ratio": 2.0 * likelihood,
        "student_t": (f - F.col("_product") / F.col("_scale")) / F.sqrt(f + SMALL),
        "chi_sq": chi,
    }
    return staged.select(*rows.columns, *[value.alias(name) for name, value in measures.items()])


def score_grams(
    counts: DataFrame, *, by: tuple[str, ...] = (), ngram_sizes: tuple[int, ...] = (2, 3), min_freq: int = MIN_FREQ
) -> DataFrame:
    """Scored n-grams seen at least ``min_freq`` times: ``by…, ngram_size, ngram, parts, frequency`` and measures.

    The frequency filter touches n-grams only; totals and marginals stay whole. Each n-gram asks for all its
    marginals in one join against the counts and is put together again by one aggregate. Every marginal of an
    n-gram is at least as frequent as the n-gram, so rarer counts never enter the join.
    """
    grams = counts.filter(
        F.col("kind").isin([str(size) for size in ngram_sizes]) & (F.col("n") >= min_freq)
    )
    ask = lambda slot, kind, k1, k2=None: F.struct(
        F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), F.col(k1).alias("k1"),
        (F.col(k2) if k2 else F.lit("")).alias("k2"),
    )
    two = [ask("c1", UNIGRAM, "w1"), ask("c2", UNIGRAM, "w2")]
    three = [
        *two,
        ask("c3", UNIGRAM, "w3"),
        ask("c12", BIGRAM, "w1", "w2"),
        ask("c23", BIGRAM, "w2", "w3"),
        ask("c13", SKIP, "w1", "w3"),
    ]
    asked = grams.select(
        *by,
        F.col("kind").cast("int").alias("ngram_size"),
        *WORDS,
        F.col("n").alias("frequency"),
        F.inline(F.when(F.col("kind") == BIGRAM, F.array(*two)).otherwise(F.array(*three))),
    )
    kinds = [UNIGRAM, BIGRAM, SKIP] if 3 in ngram_sizes else [UNIGRAM]
    marginals = counts.filter(F.col("kind").isin(kinds) & (F.col("n") >= min_freq)).select(
        *by, "kind", F.col("w1").alias("k1"), F.coalesce("w2", "w3", F.lit("")).alias("k2"), "n"
    )
    keys = [*by, "kind", "k1", "k2"]
    answered = lookup_join(asked, marginals, {key: key for key in keys}, weight="n")
    slots = ["c1", "c2", "c3", "c12", "c23", "c13"] if 3 in ngram_sizes else ["c1", "c2"]
    gathered = answered.groupBy(*by, "ngram_size", *WORDS, "frequency").agg(
        *[F.max(F.when(F.col("slot") == slot, F.col("n"))).alias(slot) for slot in slots]
    )
    totals = counts.filter(F.col("kind") == UNIGRAM).groupBy(*by).agg(F.sum("n").alias("total"))
    if by:
        gathered = lookup_join(gathered, totals, {name: name for name in by}, weight="total")
    else:
        gathered = gathered.join(F.broadcast(totals))
    tables = []
    for size in ngram_sizes:
        parts = F.array(*WORDS[:size])
        scored = _with_measures(gathered.filter(F.col("ngram_size") == size), size)
        tables.append(
            scored.select(
                *by, "ngram_size", F.array_join(parts, " ").alias("ngram"), parts.alias("parts"), "frequency", *MEASURES
            )
        )
    return reduce(DataFrame.unionByName, tables)


def ranking(sort_by: str = "pmi") -> list[Column]:
    """Report order. Scores are compared to ten digits, so that equal scores tie whatever their last bits."""
    return [F.round(sort_by, 10).desc_nulls_last(), F.desc("frequency"), F.asc("ngram")]


def collocation_table(
    documents: DataFrame,
    *,
    ngram_size: int,
    min_freq: int = MIN_FREQ,
    sort_by: str = "pmi",
    max_rows: int | None = None,
    terms: str = "terms",
) -> DataFrame:
    """Scored, ranked collocations of one n-gram size from term documents."""
    check_settings((ngram_size,), min_freq, sort_by, max_rows)
    require_columns(documents, [terms], "documents")
    counts = stored_counts(documents, terms=terms, ngram_sizes=(ngram_size,), min_freq=min_freq)
    scored = score_grams(counts, ngram_sizes=(ngram_size,), min_freq=min_freq)
    ranked = scored.orderBy(*ranking(sort_by))
    return ranked.limit(max_rows) if max_rows is not None else ranked


def collocation_tables(
    documents: DataFrame,
    *,
    token_bases: tuple[str, ...] = ("lemma", "form"),
    ngram_sizes: tuple[int, ...] = (2, 3),
    min_freq: int = MIN_FREQ,
    sort_by: str = "pmi",
    max_rows: int | None = None,
    terms: str = "terms",
) -> DataFrame:
    """All bases and sizes in one table; ``table_name`` tells them apart (``lemma_bigrams`` …).

    All tables come from one counting pass. ``max_rows`` caps each table, as a top-k per table.
    """
    check_settings(ngram_sizes, min_freq, sort_by, max_rows)
    by = ("token_basis",)
    counts = stored_counts(
        documents.filter(F.col("token_basis").isin(list(token_bases))),
        by=by,
        terms=terms,
        ngram_sizes=ngram_sizes,
        min_freq=min_freq,
    )
    scored = score_grams(counts, by=by, ngram_sizes=ngram_sizes, min_freq=min_freq)
    named = scored.withColumn(
        "table_name",
        F.concat("token_basis", F.when(F.col("ngram_size") == 2, F.lit("_bigrams")).otherwise(F.lit("_trigrams"))),
    )
    if max_rows is None:
        return named
    tops = [
        named.filter((F.col("token_basis") == basis) & (F.col("ngram_size") == size))
        .orderBy(*ranking(sort_by))
        .limit(max_rows)
        for basis in token_bases
        for size in ngram_sizes
    ]
    return reduce(DataFrame.unionByName, tops)


def collocation_metadata(
    sentences: DataFrame, documents: DataFrame, tables: DataFrame, settings: dict[str, object]
) -> DataFrame:
    """Key/value table of settings, sentence count, token counts per basis and rows per table."""
    spark = sentences.sparkSession
    given = spark.createDataFrame(
        [(key, "" if value is None else str(value)) for key, value in settings.items()], "key string, value string"
    )
    as_rows = lambda df: df.select("key", F.col("value").cast("string").alias("value"))
    counts = [
        sentences.agg(F.count("*").alias("value")).withColumn("key", F.lit("sentence_count")),
        documents.groupBy(F.concat("token_basis", F.lit("_token_count")).alias("key")).agg(
            F.sum(F.size("terms")).alias("value")
        ),
        tables.groupBy(F.concat("table_name", F.lit("_rows")).alias("key")).agg(F.count("*").alias("value")),
    ]
    return reduce(DataFrame.unionByName, [given, *map(as_rows, counts)])


def select_for_clusters(tables: DataFrame, *, sort_by: str = "pmi") -> DataFrame:
    """Lemma collocations for cluster study: bigrams inside a selected trigram are dropped.

    Adds ``source_sheet`` and ``source_rank`` (place in the ranked source table) and sorts by frequency, size,
    PMI and text.
    """
    lemma = tables.filter(F.col("token_basis") == "lemma").withColumn(
        "source_sheet", F.when(F.col("ngram_size") == 2, "lemma_bigrams").otherwise("lemma_trigrams")
    )
    order = {"source_sheet": F.col("source_sheet"), "_score": -F.coalesce(F.round(sort_by, 10), F.lit(float("-inf")))}
    keyed = lemma.withColumns({**order, "_frequency": -F.col("frequency")})
    ranked = running_total(
        keyed, F.lit(1).cast("bigint"), ["source_sheet", "_score", "_frequency", "ngram"], total="_place"
    )
    first = ranked.groupBy("source_sheet").agg(F.min("_place").alias("_start"))
    ranked = ranked.join(F.broadcast(first), "source_sheet").withColumn(
        "source_rank", F.col("_place") - F.col("_start") + 1
    )
    inside = (
        ranked.filter(F.col("ngram_size") == 3)
        .select(F.explode(F.array(F.slice("parts", 1, 2), F.slice("parts", 2, 2))).alias("parts"))
        .distinct()
    )
    trigrams = ranked.filter(F.col("ngram_size") == 3)
    bigrams = ranked.filter(F.col("ngram_size") == 2).join(inside, "parts", "left_anti")
    kept = trigrams.unionByName(bigrams.select(*trigrams.columns))
    return kept.drop("_score", "_frequency", "_place", "_start").orderBy(
        F.desc("frequency"), F.desc("ngram_size"), F.round("pmi", 10).desc_nulls_last(), "ngram"
    )
