"""Trie of conversation prefixes in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns (role, text). Its digest chains the digests of its turns, so equal
prefixes of any conversations meet in one aggregate that counts members. The trie is then cut: nodes whose subtrees
hold more than ``shard_rows`` rows of all members (the crown) stay above, every subtree below the cut is small enough
to be worked on whole, and the subtrees are dealt to shards of about that many nodes. In a shard a minimal perfect
hash gives each digest a slot; the digest stored in the slot is compared at every look-up. Counts are scattered into
flat arrays and carried to the parents' slots, deepest nodes first.

Of the crown, nodes of one smallest member form a chain. There are at most (rows / shard_rows) chains, each ending in
a subtree of its own, and ``shard_rows`` is at least the square root of all rows; so the chains fit in one table of
the same kind, and running sums along each chain give the rest. A first turn that a third of all conversations share,
or thousands of copies of one conversation, are nodes of the crown and are never gathered.

Cases: a null role or text is empty; a null turn comes first; equal turns are ordered by role and text; repeated rows
are turns of their own; rows with a null conv_id belong to no conversation and are left out; a table without rows
gives no nodes; columns beyond the four are not carried along. Turns are numbered and digests chained in streams sorted
by conversation, which hold one value, whatever the length of a conversation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.llm.common import or_empty, stored

SHARD_ROWS = 1 << 16
_ROOT = hashlib.blake2b(b"root", digest_size=16).digest()
_STEP = 0x9E3779B97F4A7C15


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """One 64-bit hash per row of two 64-bit words."""
    x = keys[:, 0] ^ (keys[:, 1] + np.uint64((level + 1) * _STEP % (1 << 64)))
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class NodeTable:
    """Slots 0 .. n-1 for n distinct 16-byte digests.

    Keys that are alone in their cell of a level get their slot from the cells before it; the others go on to the next
    level. ``find`` compares the digest that a slot holds, so keys that were not put in get -1.
    """

    def __init__(self, keys: np.ndarray) -> None:
        if len(np.unique(keys, axis=0)) != len(keys):
            raise ValueError("digests repeat")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        placed, left = 0, keys
        while len(left):
            size = len(left) + len(left) // 2 + 1
            cell = (_mixed(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            self.levels.append((alone, placed - 1 + np.cumsum(alone)))
            placed += int(alone.sum())
            left = left[~alone[cell]]
        self.held = np.zeros_like(keys)
        self.held[self._slots(keys)] = keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            cell = (_mixed(keys[left], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[cell]
            slots[left[hit]] = rank[cell[hit]]
            left = left[~hit]
        return slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        met = slots >= 0
        met[met] = (self.held[slots[met]] == keys[met]).all(axis=1)
        return np.where(met, slots, -1)


def _words(digests: pd.Series) -> np.ndarray:
    """Digests as rows of two words; a null digest is the zero row."""
    joined = b"".join(bytes(digest) if digest is not None else bytes(16) for digest in digests)
    return np.frombuffer(joined, dtype=np.uint64).reshape(-1, 2)


def _accumulated(frame: pd.DataFrame, sums: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Slots, parents' slots (-1 outside) and the sums of each slot's subtree, deepest first."""
    keys = _words(frame.digest)
    table = NodeTable(keys)
    slots, above = table.find(keys), table.find(_words(frame.parent))
    parents = np.empty(len(keys), dtype=np.int64)
    parents[slots] = above
    depths = np.empty(len(keys), dtype=np.int64)
    depths[slots] = frame.depth.to_numpy(np.int64)
    totals = {}
    for name in sums:
        totals[name] = np.empty(len(keys), dtype=np.int64)
        totals[name][slots] = frame[name].to_numpy(np.int64)
    inside = np.flatnonzero(parents >= 0)
    inside = inside[np.argsort(-depths[inside], kind="stable")]
    for level in np.split(inside, np.flatnonzero(np.diff(depths[inside])) + 1) if len(inside) else []:
        for total in totals.values():
            np.add.at(total, parents[level], total[level])
    return slots, parents, totals


def _shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of the nodes of a shard; ``outside`` marks those whose parent is in the crown."""
    frame = frame.assign(n_leaves=0)
    keys = _words(frame.digest)
    table = NodeTable(keys)
    slots, parents = table.find(keys), table.find(_words(frame.parent))
    children = np.bincount(parents[parents >= 0], minlength=len(keys))
    frame["n_leaves"] = (children[slots] == 0).astype(np.int64)
    slots, above, totals = _accumulated(frame, ["n_leaves", "saved_tokens"])
    convs = np.empty(len(keys), dtype=np.int64)
    convs[slots] = frame.conv_id.to_numpy(np.int64)
    outside = above[slots] < 0
    return pd.DataFrame(
        {
            "digest": frame.digest,
            "parent": frame.parent,
            "conv_id": frame.conv_id,
            "depth": frame.depth,
            "parent_conv_id": pd.Series(convs[above[slots]], index=frame.index).astype("Int64").mask(outside),
            "n_convs": frame.n_convs,
            "n_children": children[slots],
            "n_leaves": totals["n_leaves"][slots],
            "saved_tokens": totals["saved_tokens"][slots],
            "outside": outside,
        }
    )


def _chain_sums(frame: pd.DataFrame) -> pd.DataFrame:
    slots, _, totals = _accumulated(frame, ["leaves", "saved"])
    return pd.DataFrame(
        {"digest": frame.digest, "attached": frame.attached, "leaves": totals["leaves"][slots], "saved": totals["saved"][slots]}
    )


def _chained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Depth, digest and parent's digest per turn; rows arrive by conversation, in order, the turnless root first."""
    conv, depth, digest = None, 0, _ROOT
    for frame in frames:
        depths, digests, parents = [], [], []
        for mine, turn in zip(frame.conv_id.tolist(), frame.turn_digest, strict=True):
            if mine != conv:
                conv, depth, digest, parent = mine, 0, _ROOT, None
            else:
                parent, depth = digest, depth + 1
                digest = hashlib.blake2b(parent + bytes(turn), digest_size=16).digest()
            depths.append(depth)
            digests.append(digest)
            parents.append(parent)
        yield pd.DataFrame(
            {
                "conv_id": frame.conv_id,
                "depth": depths,
                "digest": digests,
                "parent": parents,
                "bytes": frame.bytes,
                "length": frame.length,
            }
        )


def _joined_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of the comma-joined ids per digest; rows arrive by digest, ids ascending."""
    names = ["digest", "ends_sha256"]
    digest, hashed = None, hashlib.sha256()
    for frame in frames:
        done = []
        for mine, conv in zip(frame.digest, frame.conv_id.tolist(), strict=True):
            mine = bytes(mine)
            if mine == digest:
                hashed.update(b",%d" % conv)
                continue
            if digest is not None:
                done.append((digest, hashed.hexdigest()))
            digest, hashed = mine, hashlib.sha256(b"%d" % conv)
        yield pd.DataFrame(done, columns=names)
    if digest is not None:
        yield pd.DataFrame([(digest, hashed.hexdigest())], columns=names)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_digest, bytes): the turns of each conversation, numbered from 1."""
    role, text = or_empty(F.col("role").cast("string")), or_empty(F.col("text").cast("string"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    # The length of the role keeps (role, text) apart from any other split of the same characters.
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        F.unhex(F.sha2(said, 256)).alias("turn_digest"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """``numbered_turns`` with the first h turns of conversation c taken from c - c % 5, h = crc32(c) % 9.

    Adds a row of place 0 per conversation, so that turnless ones are kept.
    """
    taken = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    convs = turns.select("conv_id").distinct().withColumn("first", taken)
    donors = turns.where((F.col("conv_id") % 5 == 0) & (F.col("place") <= 8)).withColumnRenamed("conv_id", "donor")
    borrowed = convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % 5).join(donors, "donor")
    begins = convs.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("bigint").alias("bytes"))
    columns = begins.columns
    return (
        turns.where(F.col("place") > taken)
        .select(columns)
        .unionByName(borrowed.where("place <= first").select(columns))
        .unionByName(begins)
    )


def _one(name: str, what: str) -> Column:
    """The value of ``name`` that all rows of a digest share; two values would be two prefixes of one digest."""
    return F.when(F.min(name) != F.max(name), F.raise_error(F.lit(f"two prefixes share a digest ({what})"))).otherwise(F.max(name)).alias(name)


def prefix_trie(turns: DataFrame, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Nodes of the trie over turns (conv_id, place, turn_digest, bytes), with a row of place 0 per conversation.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = stored(turns, "trie-turns")
    lengths = turns.groupBy("conv_id").agg((F.count("*") - 1).alias("length"))
    paths = (
        turns.join(lengths, "conv_id")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "place")
        .select("conv_id", "turn_digest", "bytes", "length")
        .mapInPandas(_chained, "conv_id bigint, depth int, digest binary, parent binary, bytes bigint, length bigint")
    )
    paths = stored(paths, "trie-paths")
    nodes = stored(
        paths.groupBy("digest").agg(
            _one("depth", "depth"),
            _one("parent", "parent"),
            _one("bytes", "text"),
            F.count("*").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("mass"),
        ),
        "trie-nodes",
    )
    nodes = nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    total = nodes.agg(F.max("mass"), F.count("*")).first()
    limit = max(shard_rows, math.isqrt(total[0] or 0))
    heavy = stored(nodes.where(F.col("mass") > limit), "trie-crown")
    light = nodes.where(F.col("mass") <= limit)

    marked = paths.join(heavy.select("digest"), "digest", "left_anti")
    cuts = marked.groupBy("conv_id").agg(F.min(F.struct("depth", "digest")).alias("cut"))
    shards = max(1, -(-total[1] // limit))
    dealt = light.join(cuts, "conv_id").withColumn("shard", F.pmod(F.xxhash64("cut.digest"), F.lit(shards)))
    kept = ["digest", "parent", "conv_id", "depth", "n_convs", "saved_tokens"]
    below = stored(
        dealt.select(*kept, "shard")
        .groupBy("shard")
        .applyInPandas(
            lambda frame: _shard(frame),
            "digest binary, parent binary, conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, "
            "n_children bigint, n_leaves bigint, saved_tokens bigint, outside boolean",
        ),
        "trie-shards",
    )
    crown = _crown(heavy, below.where("outside"))
    ends = (
        paths.where("depth = length")
        .select("digest", "conv_id")
        .repartition("digest")
        .sortWithinPartitions("digest", "conv_id")
        .mapInPandas(_joined_ids, "digest binary, ends_sha256 string")
    )
    above = heavy.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    whole = below.drop("outside").unionByName(crown).join(above, "parent", "left").join(ends, "digest", "left")
    return whole.select(
        "conv_id",
        F.col("depth").cast("bigint").alias("depth"),
        F.coalesce("parent_conv_id", "above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _crown(heavy: DataFrame, cut: DataFrame) -> DataFrame:
    """Subtree sums of the crown's nodes; ``cut`` are the tops of the subtrees below it."""
    light = cut.groupBy("parent").agg(
        F.count("*").alias("n_light"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    inner = heavy.groupBy("parent").agg(F.count("*").alias("n_heavy"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    own = (
        heavy.join(light.withColumnRenamed("parent", "digest"), "digest", "left")
        .join(inner.withColumnRenamed("parent", "digest"), "digest", "left")
        .withColumn("n_children", zero("n_light") + zero("n_heavy"))
        .withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(zero("leaves")))
        .withColumn("saved", F.col("saved_tokens") + zero("saved"))
    )
    own = stored(own.select("digest", "parent", "conv_id", "depth", "n_convs", "n_children", "leaves", "saved"), "crown-own")
    chains = own.groupBy("conv_id").agg(
        F.min(F.struct("depth", "digest", "parent")).alias("head"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    heads = chains.select(
        "conv_id", "head.depth", "head.digest", F.col("head.parent").alias("attached"), "leaves", "saved"
    )
    owners = own.select(F.col("digest").alias("attached"), F.col("conv_id").alias("owner"))
    tops = heads.select(F.col("conv_id").alias("owner"), F.col("digest").alias("parent"))
    linked = heads.join(owners, "attached", "left").join(tops, "owner", "left")
    sums = (
        linked.select("digest", "parent", "attached", "depth", "leaves", "saved")
        .groupBy(F.lit(0).alias("table"))
        .applyInPandas(lambda frame: _chain_sums(frame), "digest binary, attached binary, leaves bigint, saved bigint")
    )
    joined = sums.groupBy("attached").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    along = W.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    return own.join(joined.withColumnRenamed("attached", "digest"), "digest", "left").select(
        "digest",
        "parent",
        "conv_id",
        "depth",
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.sum(F.col("leaves") + zero("more_leaves")).over(along).alias("n_leaves"),
        F.sum(F.col("saved") + zero("more_saved")).over(along).alias("saved_tokens"),
    )
