"""Joins and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.session import materialize

HOT_KEYS = 1_000
SMALL_ROWS = 100_000
SPREAD = 1_024
BITS = 2**27


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: dict[str, str],
    *,
    weight: str,
    spread_by: list[str] | None = None,
    how: str = "left",
    lookup_rows: int | None = None,
) -> DataFrame:
    """Attach the columns of ``lookup`` (unique per key) to ``facts`` without a hot shuffle key.

    The lookup rows that hold at least ``1 / HOT_KEYS`` of the total ``weight`` are broadcast; by arithmetic there
    are at most ``HOT_KEYS`` of them. What is left goes through an ordinary shuffle join; rows already served are
    spread over ``SPREAD`` salts that no lookup row has, so the keys travel once. The lookup is stored once, as it is read twice. ``on`` maps fact columns to
    lookup columns; ``how`` is ``left`` or ``inner``. A caller that has counted the lookup passes ``lookup_rows``:
    up to ``SMALL_ROWS`` (narrow) rows are broadcast whole.
    """
    keys = list(on.values())
    values = [name for name in lookup.columns if name not in keys]
    if lookup_rows is not None and lookup_rows <= SMALL_ROWS:
        small = lookup.select(
            *[F.col(key).alias(f"_small_{key}") for key in keys],
            *[F.col(name).alias(f"_value_{name}") for name in values],
        )
        joined = facts.join(
            F.broadcast(small), on=[F.col(fact) == F.col(f"_small_{key}") for fact, key in on.items()], how=how
        )
        return joined.select(*facts.columns, *[F.col(f"_value_{name}").alias(name) for name in values])
    lookup = materialize(lookup, "lookup")
    # The weights of one lookup are all counts or all shares, never negative; the total is a single value.
    total = lookup.agg(F.sum(F.col(weight).cast("double"))).first()[0] or 0.0
    hot = lookup.where(F.col(weight).cast("double") * HOT_KEYS >= F.greatest(F.lit(total), F.lit(1e-300))).select(
        *[F.col(key).alias(f"_hot_{key}") for key in keys],
        F.struct(*values).alias("_hot"),
    )
    rest = lookup.select(
        *[F.col(key).alias(f"_rest_{key}") for key in keys],
        F.lit(0).alias("_rest_salt"),
        F.struct(*values).alias("_rest"),
    )
    served = facts.join(
        F.broadcast(hot),
        on=[F.col(fact) == F.col(f"_hot_{key}") for fact, key in on.items()],
        how="left",
    )
    found = F.col("_hot").isNotNull()
    salt_source = spread_by or facts.columns
    salt = F.pmod(F.xxhash64(*salt_source), F.lit(SPREAD)).cast("int") + 1
    joined = served.withColumn("_salt", F.when(found, salt).otherwise(0)).join(
        rest,
        on=[F.col(fact) == F.col(f"_rest_{key}") for fact, key in on.items()] + [F.col("_salt") == F.col("_rest_salt")],
        how="left",
    ).withColumn("_found", F.coalesce(F.col("_hot"), F.col("_rest")))
    if how == "inner":
        joined = joined.filter(F.col("_found").isNotNull())
    return joined.select(*facts.columns, *[F.col(f"_found.{name}").alias(name) for name in values])


def key_bits(hashes: DataFrame, column: str = "_hash") -> DataFrame:
    """The hashes of ``column`` as a map of ``BITS`` bits: ``_chunk`` with 64 words each, 16 MB if all are in use.

    Written once, since it is broadcast: the job behind it may take longer than a broadcast waits.
    """
    bit = F.col(column).bitwiseAND(F.lit(BITS - 1))
    masks = (
        hashes.select(bit.alias("_bit"))
        .groupBy(F.expr("CAST(_bit >> 12 AS INT)").alias("_chunk"), F.expr("CAST((_bit >> 6) & 63 AS INT)").alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(_bit & 63 AS INT)))").alias("_mask"))
    )
    packed = masks.groupBy("_chunk").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_mask"))).alias("_masks"))
    words = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda word: F.coalesce(F.try_element_at("_masks", word), F.lit(0).cast("bigint")),
    )
    return materialize(packed.select("_chunk", words.alias("_words")), "bits")


def likely_in(rows: DataFrame, bits: DataFrame, column: str = "_hash", *, always: Column | None = None) -> DataFrame:
    """The rows whose hash is set in ``bits``, or for which ``always`` holds; drops most others before a shuffle.

    No row of a set hash is lost. Rows that share a bit with one stay too, so an exact step has to follow.
    """
    bit = F.col(column).bitwiseAND(F.lit(BITS - 1))
    tested = rows.withColumn("_bit", bit).join(
        F.broadcast(bits), F.expr("CAST(_bit >> 12 AS INT)") == F.col("_chunk"), "left"
    )
    is_set = F.expr("coalesce(getbit(get(_words, CAST((_bit >> 6) & 63 AS INT)), CAST(_bit & 63 AS INT)) = 1, false)")
    return tested.filter(is_set if always is None else is_set | always).drop("_bit", "_chunk", "_words")


def with_likely(rows: DataFrame, bits: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add, per name, whether the hash in that column is set in ``bits``; a null hash is not. Keeps all rows.

    Like :func:`likely_in` for several hashes of a row, which need not be made rows of their own first.
    """
    for name, column in columns.items():
        bit = column.bitwiseAND(F.lit(BITS - 1))
        words = bits.select(F.col("_chunk").alias("_at"), F.col("_words").alias("_map"))
        rows = rows.withColumn("_bit", bit).join(F.broadcast(words), F.expr("CAST(_bit >> 12 AS INT)") == F.col("_at"), "left")
        is_set = F.expr("coalesce(getbit(get(_map, CAST((_bit >> 6) & 63 AS INT)), CAST(_bit & 63 AS INT)) = 1, false)")
        rows = rows.withColumn(name, is_set).drop("_bit", "_at", "_map")
    return rows


def running_total(
    df: DataFrame,
    value: Column,
    order: list[str],
    *,
    total: str = "running_total",
    stop_at: int | None = None,
) -> DataFrame:
    """Exclusive running sum of ``value`` in the order of ``order``: :func:`running_totals` of one value."""
    return running_totals(df, F.struct(value.alias("value")), order, totals=[total], stop_at=stop_at)


def running_totals(
    df: DataFrame,
    values: Column,
    order: list[str],
    *,
    totals: list[str],
    stop_at: int | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Exclusive running sums of the fields of ``values``, named ``totals``, in the order of ``order``, in two levels.

    Rows are range-partitioned on the order keys and stored with their partition number; per-partition totals
    (one row per partition) give the offsets, and a window inside each partition does the rest. No window runs
    over the whole table. With ``stop_at`` the partitions in which the first sum begins at or beyond it are dropped
    before the window. Work per row that ``values`` needs belongs into ``prepare``, which sees the placed rows: what
    comes before is run twice, as Spark samples the keys first.
    """
    ranged = prepare(df.repartitionByRange(*order)).withColumn("_values", values)
    fields = ranged.schema["_values"].dataType.names
    placed = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ordered")
    value = {total: F.col(f"_values.{field}") for total, field in zip(totals, fields, strict=True)}
    parts = placed.groupBy("_part").agg(*[F.sum(one).alias(f"_sum_{total}") for total, one in value.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "_part", *[F.coalesce(F.sum(f"_sum_{total}").over(before), F.lit(0)).alias(f"_offset_{total}") for total in totals]
    )
    if stop_at is not None:
        offsets = offsets.filter(F.col(f"_offset_{totals[0]}") < stop_at)
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.join(F.broadcast(offsets), "_part").withColumns(
        {total: F.col(f"_offset_{total}") + F.coalesce(F.sum(one).over(inside), F.lit(0)) for total, one in value.items()}
    )
    return summed.drop("_part", "_values", *[f"_offset_{total}" for total in totals])
