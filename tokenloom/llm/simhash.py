"""SimHash near copies by a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits and mapped to the bit count of each segment (0 to 2).
The Manhattan distance of two count vectors never exceeds the number of differing bits, so vectors within the radius
are a superset of all links. The counts are stored in unary, two places each, which makes their Manhattan distance a
bit count of an exclusive or.

The range join runs on a grid. The segments form ``radius + 4`` blocks, at most ``radius`` of which can differ, so
any link agrees in the counts of at least four blocks. A cell is a choice of four blocks and their counts; every
fingerprint enters one cell per choice, and a pair is taken in the first choice on which it agrees only. Pairs of a
cell pass the Manhattan bound first and are then verified bit by bit.

Equal fingerprints are one node throughout. Before the range join, fingerprints that agree outside one group of
``radius`` neighbouring bits are chained (they are links whatever those bits hold); the join then looks only into
cells that hold more than one component and only at pairs of different components, so a dense group of near copies
neither emits nor compares all its pairs once it is connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import or_empty, short_lived_shuffles, stored

RADIUS = 4
SHINGLE = 4
SEED = 42
_CHUNK = 1 << 16
_AGREE = 4


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text: ASCII lower case, ASCII white space, word shingles with repeats.

    Fewer words than ``shingle`` are one shingle; no words give zero.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - shingle, 0)
    begins, stops = starts[: last + 1], ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, last + 1, _CHUNK):
        pieces = zip(begins[at : at + _CHUNK].tolist(), stops[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pieces], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last + 1, bitorder="little").view(np.int64)[0])


def with_fingerprint(documents: DataFrame, *, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """Add ``simhash`` (bigint) over the whole text; a null text counts as empty and gives zero."""

    @F.pandas_udf("bigint")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(text, shingle) for text in texts], dtype="int64")

    return documents.withColumn("simhash", hashed(or_empty(text)))


def segment_counts(value: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary (0: 00, 1: 01, 2: 11)."""
    low, shifted = F.lit(0x5555555555555555), F.shiftrightunsigned(value, 1)
    return value.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(value.bitwiseAND(shifted).bitwiseAND(low), 1))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _blocks(radius: int) -> list[int]:
    """Bit masks of the grid's blocks, whole segments each."""
    edges = np.linspace(0, 32, radius + _AGREE + 1).round().astype(int)
    return [sum(3 << (2 * at) for at in range(a, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _choices(radius: int) -> Column:
    """Every choice of four blocks: its mask, and the masks of earlier blocks, which must differ for a pair to count."""
    blocks = _blocks(radius)
    rows = []
    for chosen in combinations(range(len(blocks)), _AGREE):
        mask = _signed(sum(blocks[at] for at in chosen))
        earlier = [_signed(blocks[at]) for at in range(chosen[-1]) if at not in chosen]
        rows.append(F.struct(F.lit(mask).alias("mask"), F.array([F.lit(x) for x in earlier]).cast("array<bigint>").alias("earlier")))
    return F.array(rows)


def _near_chains(nodes: DataFrame, radius: int) -> DataFrame:
    """Links between fingerprints that agree outside one run of ``radius`` bits: a star per agreeing set."""
    runs = [_signed((1 << 64) - 1 ^ (((1 << radius) - 1) << at & ((1 << 64) - 1))) for at in range(0, 64, radius)]
    kept = nodes.select("simhash", F.explode(F.array([F.lit(x) for x in runs])).alias("mask"))
    group = [F.col("mask"), F.col("simhash").bitwiseAND(F.col("mask")).alias("rest")]
    stars = kept.groupBy(*group).agg(F.collect_set("simhash").alias("members")).where(F.size("members") > 1)
    # at most 2**radius fingerprints agree outside a run, so a set is bounded
    return stars.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b").distinct()


def _range_join(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between nodes of different components: grid, Manhattan bound, exact bits."""
    cells = nodes.select(
        "simhash", "component", segment_counts(F.col("simhash")).alias("counts"), F.explode(_choices(radius)).alias("choice")
    ).select(
        "simhash",
        "component",
        "counts",
        "choice.earlier",
        F.xxhash64("choice.mask", F.col("counts").bitwiseAND(F.col("choice.mask"))).alias("cell"),
    )
    mixed = cells.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.where("low <> high").select("cell")
    open_cells = stored(cells.join(mixed, "cell", "left_semi"), "simhash-cells")
    a, b = open_cells.alias("a"), open_cells.alias("b")
    between = F.col("a.counts").bitwiseXOR(F.col("b.counts"))
    return a.join(
        b,
        (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.simhash") < F.col("b.simhash"))
        & (F.col("a.component") != F.col("b.component"))
        & (F.bit_count(between) <= radius)
        & (F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash"))) <= radius)
        & F.forall(F.col("a.earlier"), lambda mask: between.bitwiseAND(mask) != 0),
    ).select(F.col("a.simhash").alias("a"), F.col("b.simhash").alias("b"))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; a component's name is its smallest node.

    Alternates large-star and small-star steps until the edges no longer change; each step is a stored table.
    """
    edges, state = stored(links.select("a", "b").where("a <> b").distinct(), "simhash-edges"), None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(lowest.select("a", "m")).where("a <> b").distinct()
        edges = stored(small, "simhash-edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if now == state:
            break
        state = now
    named = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named.union(edges.select(F.col("b"), F.col("b"))).distinct()


def fingerprint_components(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(simhash, component) of distinct fingerprints; a component is joined by links of at most ``radius`` differing bits."""
    chains = stored(_near_chains(nodes, radius), "simhash-chains")
    first = connected(chains).withColumnRenamed("node", "simhash")
    marked = nodes.join(first, "simhash", "left").select(
        "simhash", F.coalesce("component", "simhash").alias("component")
    )
    links = _range_join(stored(marked, "simhash-marked"), radius)
    roots = connected(chains.union(links)).withColumnRenamed("node", "simhash")
    return nodes.join(roots, "simhash", "left").select("simhash", F.coalesce("component", "simhash").alias("component"))


def near_copies(documents: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, simhash, component_id) per document; components are linked by at most ``radius`` differing bits.

    ``component_id`` is the smallest doc_id reachable. Repeated rows stay; a null text has fingerprint zero; a row with
    a null doc_id links others and gets their component, or null if it reaches no id. An empty table gives no rows.
    """
    prints = stored(with_fingerprint(documents.select("doc_id", "text"), shingle=shingle).drop("text"), "simhash")
    nodes = stored(prints.groupBy("simhash").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    rooted = nodes.join(fingerprint_components(nodes, radius), "simhash")
    ids = rooted.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(ids, "component").select("simhash", "component_id")
    return prints.join(classes, "simhash", "left")


def fingerprint_text(column: str = "simhash") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# --- looser copies: an exact join of shingle sets

#: Least likeness of near copies (numerator, denominator) and the words of a shingle.
LIKENESS = (4, 5)
COPY_SHINGLE = 5
_BATCH_SHINGLES = 1_000_000
_SETS = "shard int, nodes binary, sizes binary, counts binary, hashes binary, seen binary"


def _mixed(value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingle_hashes(words: list[bytes], shingle: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words than ``shingle`` are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    known = _WordHashes() if known is None else known
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    count = max(len(words) - shingle, 0) + 1
    found = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(min(shingle, len(words))):
            found = _mixed(found + hashes[at : at + count] + np.uint64(at + 1))
    return np.unique(found)


def _copy_words(text: str) -> tuple[list[bytes], int]:
    words = text.encode("utf-8", "replace").lower().split()
    return words, int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))


def _dealt(shards: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
    """A row per shard of elements that are ordered by shard and node: its nodes, their sizes and hash counts, its hashes."""
    cuts, rows = np.flatnonzero(np.diff(shards, prepend=-1, append=-1)), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first = np.concatenate([[0], np.flatnonzero(np.diff(nodes[a:b])) + 1])
        counts = np.diff(first, append=b - a)
        arrays = (nodes[a:b][first].astype("i8"), sizes[a:b][first].astype("u4"), counts.astype("u4"), hashes[a:b], seen[a:b].astype("u4"))
        rows.append((int(shards[a]), *(array.tobytes() for array in arrays)))
    return pd.DataFrame(rows, columns=["shard", "nodes", "sizes", "counts", "hashes", "seen"])


def _elements(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Node, its size, hash and sightings (empty if not yet counted) of every element of a shard's rows."""

    def joined(name: str, kind: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(blob, kind) for blob in frame[name]])

    counts = joined("counts", "u4")
    return np.repeat(joined("nodes", "i8"), counts), np.repeat(joined("sizes", "u4"), counts), joined("hashes", "u8"), joined("seen", "u4")


def _copy_sets(texts: DataFrame, likeness: tuple[int, int], shingle: int) -> DataFrame:
    """(node, size, shared, central, shingles, prefix) of each text that may have a near copy.

    ``size`` counts its distinct shingles and ``shingles`` lists the ``shared`` ones that other nodes hold too, rarest
    first. Copies share at least ``likeness`` of either's shingles, so a text that shares fewer has none; and in one
    order for all, two copies meet in their first ``size - ceil(likeness * size) + 1`` shingles, of which ``prefix``
    are shared ones.
    """
    above, below = likeness
    bits = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length()
    shift = np.uint64(64 - bits)

    def shards(values: np.ndarray) -> np.ndarray:
        return (values.astype(np.uint64) >> shift).astype(np.int64)

    def packed(sets: dict[int, np.ndarray]) -> pd.DataFrame:
        lengths = np.fromiter(map(len, sets.values()), np.int64, len(sets))
        nodes, hashes = np.fromiter(sets, np.int64, len(sets)), np.concatenate(list(sets.values()))
        order = np.argsort(shards(hashes), kind="stable")
        hashes = hashes[order]
        return _dealt(shards(hashes), np.repeat(nodes, lengths)[order], np.repeat(lengths, lengths)[order], hashes, np.zeros(0))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sets, total = _WordHashes(), {}, 0
        for frame in frames:
            for text in frame["text"]:
                words, node = _copy_words(text)
                if not words or node in sets:
                    continue
                sets[node] = shingle_hashes(words, shingle, known)
                total += len(sets[node])
                if total >= _BATCH_SHINGLES:
                    yield packed(sets)
                    known, sets, total = _WordHashes(), {}, 0
        if sets:
            yield packed(sets)

    def share(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, sizes, hashes, _ = _elements(frame)
        order = np.lexsort((nodes, hashes))
        nodes, sizes, hashes = nodes[order], sizes[order], hashes[order]
        other = np.ones(len(nodes), bool)  # equal texts of several batches count once
        other[1:] = (nodes[1:] != nodes[:-1]) | (hashes[1:] != hashes[:-1])
        nodes, sizes, hashes = nodes[other], sizes[other], hashes[other]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        runs = np.diff(starts, append=len(hashes))
        seen = np.repeat(runs, runs)
        kept = seen > 1
        nodes, sizes, hashes, seen = nodes[kept], sizes[kept], hashes[kept], seen[kept]
        order = np.lexsort((nodes, shards(nodes)))
        return _dealt(shards(nodes[order]), nodes[order], sizes[order], hashes[order], seen[order])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, sizes, hashes, seen = _elements(frame)
        order = np.lexsort((hashes, seen, nodes))
        nodes, sizes, hashes, seen = nodes[order], sizes[order].astype(np.int64), hashes[order].view(np.int64), seen[order]
        starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        rows = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(nodes)], strict=True):
            size, shared = int(sizes[a]), b - a
            least = -(-above * size // below)
            if shared >= least:
                rows.append((nodes[a], size, shared, float(seen[a:b].sum() / size), hashes[a:b], shared - least + 1))
        return pd.DataFrame(rows, columns=["node", "size", "shared", "central", "shingles", "prefix"])

    shared = texts.mapInPandas(count, _SETS).groupBy("shard").applyInPandas(share, _SETS)
    return shared.groupBy("shard").applyInPandas(
        choose, "node bigint, size int, shared int, central double, shingles array<bigint>, prefix int"
    )


def loose_copies(documents: DataFrame, *, likeness: tuple[int, int] = LIKENESS, shingle: int = COPY_SHINGLE) -> DataFrame:
    """Each row as ``row`` with ``copy_group``, equal for texts that links of at least ``likeness`` join."""
    return _copy_groups(documents, None, likeness, shingle)


def _fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) from the least node of each component of fingerprints to its other nodes."""
    nodes = stored(prints.select("simhash", "node").distinct(), "copies-simhash")
    components = stored(fingerprint_components(nodes.select("simhash").distinct(), radius), "copies-components")
    placed = nodes.join(components, "simhash").select("component", "node").distinct()
    least = placed.groupBy("component").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    return placed.join(least, "component").select("a", F.col("node").alias("b")).where("a <> b")


def simhash_copies(
    documents: DataFrame, *, radius: int = RADIUS, likeness: tuple[int, int] = LIKENESS, shingle: int = COPY_SHINGLE
) -> DataFrame:
    """Each row as ``row`` with ``copy_group``: the components of :func:`near_copies`, joined further by likeness.

    The fingerprints link first, at ``radius`` bits as in :func:`near_copies`. The exact join of :func:`loose_copies`
    follows, for copies whose fingerprints lie further apart, and compares no texts that the fingerprints have joined.
    """
    return _copy_groups(documents, radius, likeness, shingle)


def _copy_groups(documents: DataFrame, radius: int | None, likeness: tuple[int, int], shingle: int) -> DataFrame:
    """Groups of rows by likeness and, with ``radius``, by fingerprint too.

    A link is a Jaccard likeness of the distinct ``shingle``-word shingles of at least ``likeness`` (numerator,
    denominator), computed from all of them. Candidates are the pairs that share a shingle of their prefixes and pass
    the bounds by size and place; neither loses a link. Equal texts are one node.

    Within a cell (a shingle) each node is first compared with the most central one; pairs are formed only between
    nodes that no chain of such links joins. Null and empty texts are one group; repeated rows stay and are of one group.
    """
    above, below = likeness

    @F.pandas_udf("bigint")
    def node_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_copy_words(text)[1] for text in texts], dtype="int64")

    packed = documents.select(F.struct(*[documents[name] for name in documents.columns]).alias("row"))
    packed = packed.withColumn("node", node_of(or_empty("row.text")))
    prints = stored(packed if radius is None else with_fingerprint(packed, text="row.text"), "copies-prints")
    joined = None if radius is None else stored(_fingerprint_links(prints, radius), "copies-fingerprints")
    sets = stored(_copy_sets(prints.select(or_empty("row.text").alias("text")), likeness, shingle), "copies-sets")
    placed = sets.select("node", "size", "central", "shared", F.posexplode(F.slice("shingles", F.lit(1), F.col("prefix"))).alias("at", "cell"))
    # unshared shingles come first in the order
    cells = placed.select("node", "size", "central", "cell", (F.col("at") + F.col("size") - F.col("shared")).alias("place"))
    centre = F.max(F.struct("central", "node", "size", "place")).alias("centre")
    shared = cells.groupBy("cell").agg(centre, F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    met = stored(cells.drop("central").join(shared.select("cell", "centre"), "cell"), "copies-cells")

    def enough(common: Column, left: Column, right: Column) -> Column:
        """Whether sets of these sizes with so many common members are copies, in whole numbers."""
        return common * (above + below) >= (left + right) * above

    def maybe(left: str, right: str) -> Column:
        """Bounds of a pair whose first common shingle this is, by sizes and by what follows it."""
        sizes = [F.col(f"{side}.size").cast("bigint") for side in (left, right)]
        follow = [size - F.col(f"{side}.place") for size, side in zip(sizes, (left, right), strict=True)]
        return enough(F.least(*sizes), *sizes) & enough(F.least(*follow), *sizes)

    def closer(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes that are copies by all their shingles."""
        left = sets.select(F.col("node").alias("a"), F.col("size").cast("bigint").alias("size_a"), F.col("shingles").alias("left"))
        right = sets.select(F.col("node").alias("b"), F.col("size").cast("bigint").alias("size_b"), F.col("shingles").alias("right"))
        common = F.size(F.array_intersect("left", "right")).cast("bigint")
        return pairs.join(left, "a").join(right, "b").where(enough(common, F.col("size_a"), F.col("size_b"))).select("a", "b")

    own = F.struct("node", "size", "place").alias("own")
    stars = met.select("centre", own).where((F.col("own.node") != F.col("centre.node")) & maybe("own", "centre"))
    stars = stars.select(F.least("own.node", "centre.node").alias("a"), F.greatest("own.node", "centre.node").alias("b")).distinct()
    first = stored(closer(stars) if joined is None else closer(stars).union(joined), "copies-stars")
    marked = met.drop("centre").join(connected(first), "node", "left")
    marked = stored(marked.select("cell", "node", "size", "place", F.coalesce("component", "node").alias("component")), "copies-marked")
    mixed = marked.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rest = stored(marked.join(mixed.select("cell"), "cell", "left_semi"), "copies-rest")
    apart = (
        (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.node") < F.col("b.node"))
        & (F.col("a.component") != F.col("b.component"))
        & maybe("a", "b")
    )
    pairs = rest.alias("a").join(rest.alias("b"), apart)
    pairs = pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    groups = connected(first.union(closer(pairs)))
    grouped = prints.select("row", "node").join(groups, "node", "left")
    return grouped.select("row", F.coalesce("component", "node").alias("copy_group"))


def keep_one(documents: DataFrame, **settings) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (null only where a group has no ids)."""
    with short_lived_shuffles(documents.sparkSession):
        grouped = stored(simhash_copies(documents, **settings), "copies-grouped")
    least = grouped.groupBy("copy_group").agg(F.min("row.doc_id").alias("least"))
    kept = grouped.join(least, "copy_group").where(F.col("row.doc_id").eqNullSafe(F.col("least")))
    return kept.dropDuplicates(["copy_group"]).select("row.*")
