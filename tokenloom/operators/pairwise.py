"""Work on all pairs of a vector table in blocks of bounded size, inside tasks.

Tasks pack their rows into blocks within ``block_bytes``; the blocks (one small row of metadata each) are numbered, small
ones together, and each travels to the tasks of its block pairs. A task holds two numbers' blocks at a time whatever the size of the table,
and nothing passes through the driver. Each unordered pair of blocks is worked on once, for both directions. The work is
quadratic in the rows, as exact search over any metric is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.vectors import stack_rows
from tokenloom.operators.skew import running_total
from tokenloom.session import materialize

PAIR_BLOCK_BYTES = 2 << 20

#: (ids, matrix, extra columns) of one block.
Block = tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]


def distances(here: np.ndarray, there: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the rows of two matrices; for ``cosine`` the rows must be unit vectors."""
    if metric == "cosine":
        return np.maximum(1.0 - here @ there.T, 0.0)
    squares = (here**2).sum(1)[:, None] - 2 * here @ there.T + (there**2).sum(1)[None, :]
    return np.sqrt(np.maximum(squares, 0.0))


def least_tree(apart: np.ndarray, one: np.ndarray, other: np.ndarray, same: bool) -> pd.DataFrame:
    """Edges ``a < b, d`` of the least spanning tree, by (d, a, b), of all pairs of two blocks with distances ``apart``.

    A pair left out is the longest of a circle inside the blocks, so the least spanning tree of a table lies in the trees of
    its block pairs. Blocks with distances that are no numbers give all their pairs.
    """
    if not np.isfinite(apart).all():
        a, b = np.repeat(one, len(other)), np.tile(other, len(one))
        kept = a < b if same else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[kept], "b": np.maximum(a, b)[kept], "d": apart.ravel()[kept]})
    ids = [one] if same else [one, other]
    tables = [apart] if same else [apart, np.ascontiguousarray(apart.T)]
    best = [np.full(len(own), np.inf) for own in ids]
    source = [np.full(len(own), np.iinfo(np.int64).max) for own in ids]
    waiting = [np.ones(len(own), dtype=bool) for own in ids]
    side, at, edges = 0, 0, []
    for _ in range(sum(map(len, ids)) - 1):
        waiting[side][at], best[side][at] = False, np.inf
        to, name, row = len(ids) - 1 - side, ids[side][at], tables[side][at]
        # of two equal distances to one row the smaller source is the smaller pair
        nearer = np.flatnonzero(waiting[to] & ((row < best[to]) | ((row == best[to]) & (name < source[to]))))
        best[to][nearer], source[to][nearer] = row[nearer], name
        low = min(values.min() for values in best)
        tied = []
        for part, values in enumerate(best):
            places = np.flatnonzero(values == low)
            if len(places) > 1:
                ends, own = source[part][places], ids[part][places]
                places = places[np.lexsort((np.maximum(ends, own), np.minimum(ends, own)))[:1]]
            tied += [(*sorted((int(source[part][place]), int(ids[part][place]))), part, int(place)) for place in places]
        a, b, side, at = min(tied)
        edges.append((a, b, float(low)))
    return pd.DataFrame(edges, columns=["a", "b", "d"]).astype({"a": "int64", "b": "int64", "d": "float64"})


def least_trees(
    points: DataFrame, *, metric: str, floor: str | None = None, block_bytes: int = PAIR_BLOCK_BYTES
) -> DataFrame:
    """Few pairs ``a < b, d`` of ``points(id, vector)`` that hold the least spanning tree of all pairs.

    ``floor`` names a column of least distances: a pair is as far apart as the largest of its distance and both floors.
    Distances of one pair of blocks are held inside its task; at most one pair per row of a block pair leaves it.
    """

    def tree(one, other, same):
        apart = np.empty((len(one[0]), len(other[0])))
        for start in range(0, len(apart), 256):
            apart[start : start + 256] = distances(one[1][start : start + 256], other[1], metric)
        if floor:
            np.maximum(apart, one[2][floor][:, None], out=apart)
            np.maximum(apart, other[2][floor][None, :], out=apart)
        return least_tree(apart, one[0], other[0], same)

    extra = {floor: "float64"} if floor else None
    return over_block_pairs(points, tree, "a bigint, b bigint, d double", extra=extra, block_bytes=block_bytes)


def _packed(points: DataFrame, extra: dict[str, str], block_bytes: int) -> DataFrame:
    """Blocks (block, number, ids, vectors, width, one binary column per extra), each row in one of them.

    Blocks of one number, counted from 0, hold less than twice ``block_bytes`` together, however many tasks packed them.
    """
    names = list(extra)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        waiting = 0
        for frame in frames:
            if not len(frame):
                continue
            rows = max(1, block_bytes // max(1, 8 * len(frame.vector.iloc[0])))
            held.append(frame)
            waiting += len(frame)
            while waiting >= rows:
                whole = pd.concat(held, ignore_index=True)
                yield block(whole.iloc[:rows])
                held, waiting = [whole.iloc[rows:]], waiting - rows
        if waiting:
            yield block(pd.concat(held, ignore_index=True))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        matrix = stack_rows(frame.vector)
        row = {"ids": frame.id.to_numpy(np.int64).tobytes(), "vectors": matrix.tobytes(), "width": matrix.shape[1]}
        return pd.DataFrame([row | {name: frame[name].to_numpy(extra[name]).tobytes() for name in names}])

    schema = "ids binary, vectors binary, width int" + "".join(f", {name} binary" for name in names)
    blocks = points.select("id", "vector", *names).mapInPandas(pack, schema)
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    # tasks of few rows leave small blocks; neighbours share a number as long as they begin within one block's size
    sizes = blocks.select("block", F.length("vectors").cast("bigint").alias("size"))
    step = max(block_bytes, sizes.agg(F.max("size")).first()[0] or 0)  # one row may be wider than a block; no number is left out
    begins = running_total(sizes, F.col("size"), ["block"], total="begin")
    numbers = begins.select("block", F.floor(F.col("begin") / step).alias("number"))
    return materialize(blocks.join(numbers, "block"), "numbered-blocks")


def over_block_pairs(
    points: DataFrame,
    work: Callable[[Block, Block, bool], pd.DataFrame],
    schema: str,
    *,
    extra: dict[str, str] | None = None,
    block_bytes: int = PAIR_BLOCK_BYTES,
) -> DataFrame:
    """Rows of ``work(one, other, same)`` over all unordered pairs of blocks of ``points`` (id, vector, extras).

    ``extra`` maps column names to numpy types. ``same`` says that both blocks are one.
    """
    extra = extra or {}
    blocks = _packed(points, extra, block_bytes)
    last = blocks.agg(F.max("number")).first()[0]
    if last is None:
        return points.sparkSession.createDataFrame([], schema)
    number = F.col("number")
    left = blocks.withColumns({"a": number, "b": F.explode(F.sequence(number, F.lit(last)))})
    renamed = blocks.toDF(*[f"other_{name}" for name in blocks.columns])
    number = F.col("other_number")
    right = renamed.withColumns({"b": number, "a": F.explode(F.sequence(F.lit(0).cast("bigint"), number))})

    def unpack(frame: pd.DataFrame, side: str = "") -> Block:
        frame = frame.sort_values(f"{side}block")

        def joined(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(frame[side + name]), dtype=kind)

        matrix = joined("vectors", "float64").reshape(-1, int(frame[f"{side}width"].iloc[0]))
        return joined("ids", "int64"), matrix, {name: joined(name, kind) for name, kind in extra.items()}

    def pair(key: tuple, one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        return work(unpack(one), unpack(other, "other_"), key[0] == key[1])

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(pair, schema)
