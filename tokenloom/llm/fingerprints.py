"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every shingle of five words is hashed once. The high bits of a hash choose one of ``BINS`` bins, and a bin keeps its
smallest hash. An empty bin takes the value of a filled one: bins are drawn at random for it until one is filled
(optimal densification; after ``DRAWS`` misses, as in very short texts, the filled bins are ranked by a hash instead),
so two texts borrow alike as far as they share bins. Of every bin
``BITS`` low bits are stored, packed into longs. Two unrelated bins agree by chance once in ``2**BITS``; likeness
takes that share out.

Words are lower-cased and split at ASCII white space. A text of fewer than five words is one shingle. A null or empty
text has an empty fingerprint, which is like itself (1) and unlike any other (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import SPACES, or_empty

BINS = 256
BITS = 4
SHINGLE = 5
DRAWS = 12
_REST = 63 - BINS.bit_length() + 1
_FULL = (1 << _REST) - 1
_PER_LONG = 64 // BITS
_LONGS = BINS // _PER_LONG


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(words: Column) -> Column:
    """Hashes of the shingles of at least one word."""

    def of_many(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - (SHINGLE - 1), F.lit(1)))
        return F.transform(starts, lambda at: F.xxhash64(F.slice(hashes, at, F.lit(SHINGLE))))

    return bound(F.transform(words, lambda word: F.xxhash64(word)), of_many)


def _bin(value: Column) -> Column:
    return F.shiftright(value, _REST)


def _empty(value: Column) -> Column:
    return value.bitwiseAND(_FULL) == _FULL


def _packed(shingles: Column) -> Column:
    """Packed low bits of the densified bins of at least one shingle."""
    # one mark per bin sorts behind all its hashes, so that the first entry of a bin is its least hash or the mark
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda at: F.shiftleft(at.cast("bigint"), _REST).bitwiseOR(F.lit(_FULL)))
    hashes = F.transform(shingles, lambda value: F.shiftrightunsigned(value, 1))

    def firsts(ordered: Column) -> Column:
        return F.filter(
            ordered, lambda value, at: F.coalesce(_bin(value) != _bin(F.get(ordered, at - 1)), F.lit(True))
        )

    def densified(bins: Column, held: Column) -> Column:
        def borrowed(value: Column) -> Column:
            draws = [F.get(held, F.pmod(F.xxhash64(value, F.lit(at)), F.lit(BINS)).cast("int")) for at in range(DRAWS)]
            order = F.transform(
                F.filter(held, lambda other: other.isNotNull()),
                lambda other: F.struct(F.xxhash64(value, _bin(other)).alias("turn"), other.alias("value")),
            )
            return F.coalesce(*draws, F.array_min(order)["value"])

        def stored_bits(value: Column, at: Column) -> Column:
            # which of a hash's bits are stored goes by the bin, so texts of few shingles do not agree by one chance in all bins
            chosen = F.when(_empty(value), borrowed(value)).otherwise(value)
            return F.call_function("shiftright", chosen, F.pmod(at, F.lit(_REST // BITS)) * BITS)

        return F.transform(bins, stored_bits)

    def pack(bins: Column) -> Column:
        def one(group: Column) -> Column:
            return F.aggregate(
                F.slice(bins, group * _PER_LONG + 1, F.lit(_PER_LONG)),
                F.lit(0).cast("bigint"),
                lambda held, value: F.shiftleft(held, BITS).bitwiseOR(value.bitwiseAND(F.lit((1 << BITS) - 1))),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(_LONGS - 1)), one)

    def filled(bins: Column) -> Column:
        held = F.transform(bins, lambda value: F.when(~_empty(value), value))
        return bound(held, lambda held: bound(densified(bins, held), pack))

    return bound(bound(F.sort_array(F.concat(hashes, marks)), firsts), filled)


def fingerprint(text: str | Column) -> Column:
    """Fingerprint of a text as an array of longs; empty for a text without words."""
    trimmed = F.trim(F.lower(or_empty(text)), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(
        bound(_shingles(F.split(trimmed, SPACES)), _packed)
    )


def as_hex(packed: str | Column) -> Column:
    column = F.col(packed) if isinstance(packed, str) else packed
    return F.array_join(F.transform(column, lambda value: F.lower(F.lpad(F.hex(value), 16, "0"))), "")


def likeness(left: Column, right: Column) -> Column:
    """Estimated share of common shingles, 0 to 1, free of chance agreement of the stored bits."""
    lowest = F.lit(0x1111111111111111)

    def unequal(a: Column, b: Column) -> Column:
        return bound(
            a.bitwiseXOR(b),
            lambda z: F.bit_count(
                z.bitwiseOR(F.shiftrightunsigned(z, 1))
                .bitwiseOR(F.shiftrightunsigned(z, 2))
                .bitwiseOR(F.shiftrightunsigned(z, 3))
                .bitwiseAND(lowest)
            ),
        )

    missed = F.aggregate(F.zip_with(left, right, unequal), F.lit(0), lambda total, one: total + one)
    chance = 1.0 / (1 << BITS)
    share = ((BINS - missed) / F.lit(float(BINS)) - chance) / (1.0 - chance)
    both = (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(both, F.greatest(share, F.lit(0.0))).otherwise((F.size(left) == F.size(right)).cast("double"))


# --- each document beside the next one, in the order of their ids


def with_next(
    documents: DataFrame, columns: list[str], derived: dict[str, Column] | None = None, *, buckets: int | None = None
) -> DataFrame:
    """Add ``next_<column>`` of the next document by doc_id; the first follows the last. ``derived`` columns are added first.

    Ranges of ids (from approximate percentiles, so of about equal size) are ordered each by itself, with a copy of the
    following range's first row behind its last. Null ids come first; rows of one id are ordered by a hash of their text.
    Needs the columns doc_id and text.
    """
    spark = documents.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [at / buckets for at in range(1, buckets)]
    found = documents.agg(F.percentile_approx("doc_id", wanted, 10 * buckets)).first()[0] or []
    bounds = sorted(set(found))
    step = max(1, math.isqrt(len(bounds)))
    ordered = documents.withColumn("_hash", F.xxhash64("text"))
    if bounds:
        fine = F.array([F.lit(x).cast("bigint") for x in bounds])
        coarse = F.array([F.lit(x).cast("bigint") for x in bounds[step - 1 :: step]])
        id_ = F.col("doc_id")
        passed = F.size(F.filter(coarse, lambda x: x <= id_)) * step
        ordered = ordered.withColumn("_passed", passed).withColumn(
            "_bucket",
            F.col("_passed") + F.size(F.filter(F.slice(fine, F.col("_passed") + 1, F.lit(step)), lambda x: x <= id_)),
        ).drop("_passed")
    else:
        ordered = ordered.withColumn("_bucket", F.lit(0))
    # one row per range of ids, their number is a parameter
    firsts = ordered.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_hash")).alias("f")).orderBy("_bucket").collect()
    if not firsts:
        return documents.withColumns(derived or {}).select("*", *[F.col(name).alias(f"next_{name}") for name in columns])
    followers = [
        F.struct(
            F.lit(row._bucket).alias("_behind"),
            F.lit(after.f.doc_id).cast("bigint").alias("_id"),
            F.lit(after.f._hash).alias("_first"),
        )
        for row, after in zip(firsts, [*firsts[1:], firsts[0]], strict=True)
    ]
    listed = spark.range(1).select(F.explode(F.array(followers)).alias("f")).select("f.*")
    copies = ordered.join(
        F.broadcast(listed), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_hash").eqNullSafe(F.col("_first"))
    ).select(*[F.col("_behind").alias("_bucket") if name == "_bucket" else F.col(name) for name in ordered.columns])
    every = ordered.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))
    every = every.withColumns(derived or {})
    order = Window.partitionBy("_bucket").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "_hash")
    beside = every.select("*", *[F.lead(name).over(order).alias(f"next_{name}") for name in columns])
    return beside.where(~F.col("_copy")).drop("_copy", "_bucket", "_hash")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the start of the next document."""
    texts = documents.select("doc_id", or_empty("text").alias("text"))
    beside = with_next(texts, ["text", "packed"], {"packed": fingerprint("text")})
    count = F.length("text")
    moved = F.floor(count / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), count - moved), F.substring("next_text", F.lit(1), moved))
    made = beside.withColumn("edited", edited).withColumn("edited_packed", fingerprint("edited"))
    return made.select(
        "doc_id",
        count.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex("packed").alias("fingerprint"),
        as_hex("edited_packed").alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
