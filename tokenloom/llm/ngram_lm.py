"""Interpolated modified Kneser-Ney model of any order, counted in Spark and scored from memory-mapped sorted arrays.

Words are hashed to 64 bits; the sorted hashes of a shard (a range of the hash space) are one array, and a word's id is
its place in all of them. N-grams of the highest order are counted as they occur, those of each lower order by how many
distinct words precede them, so each order is counted from the distinct n-grams of the one above. Per order the model
stores sorted hashes of its n-grams with their log probabilities, and sorted hashes of their contexts with the log
weights of the lower order. Shards are files below the cluster's shared folder, written by the tasks that counted them
under a name of the attempt, and named to the readers by the rows those tasks return. Workers map the files into memory
and look up the distinct, sorted n-grams of a batch.

Tasks aggregate before anything is shuffled, and shuffle sorted, compressed arrays rather than rows. The number of shards
follows from the bytes of the training texts, so that a shard's size does not grow with them. N-grams lie in the shard
of their context. A context that may hold more than a shard's share consists of words that do; n-grams of such contexts
are spread by all their words, and the statistics of the contexts are summed in a shuffle of their own.

Counts are exact. Hashes of up to two words differ for different n-grams; longer ones may meet in one of 2**64 hashes.

Words are runs of anything but ASCII white space, A-Z lower-cased; every text ends in an end token, which is counted,
and begins with start marks, which occur in contexts only. A null text is empty: its end token is all it has. An unseen
word gets the unknown share of the lowest order. An empty training set gives every token the uniform probability 1.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import mixed, or_empty, release_memory, remainder, short_lived_shuffles, stored
from tokenloom.session import shared_folder

MODULUS, HELD_OUT = 5, 1
ORDER = 3
_START, _END = b" start", b" end"
_BATCH_TOKENS = 1_000_000
_SHARD_BYTES = 16_000_000  # of training text per shard
_LEAST_BITS = 5  # 32 shards, so that little text still keeps the cores of a machine busy
_WAVES = 4  # in which the highest order is finished, so that what a wave has read can be removed before the next
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def save(folder: str, array: np.ndarray) -> str:
    """Write an array's bytes to a file of its own; returns the path."""
    return _write(folder, np.ascontiguousarray(array).tobytes())


def _write(folder: str, data: bytes) -> str:
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = f"{base}/{uuid.uuid4().hex}"
    with store.open_output_stream(name) as out:
        out.write(data)
    return f"{folder}/{name.rsplit('/', 1)[1]}"


def load(path: str, kind: str) -> np.ndarray:
    """Map a file of the shared folder into memory; stores that are no file system are read instead."""
    store, name = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, dtype=kind, mode="r") if store.get_file_info(name).size else np.zeros(0, kind)
    with store.open_input_file(name) as file:
        return np.frombuffer(file.read(), dtype=kind)


def _packed(array: np.ndarray) -> bytes:
    """An array's bytes, compressed, behind their number.

    Equal places of all numbers lie together, as the high bytes are nearly all zero or, in sorted columns, repeat.
    """
    data = np.ascontiguousarray(array).reshape(-1)
    planes = data.view("u1").reshape(-1, data.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size, asbytes=True), "u1")
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


@dataclass
class Shards:
    """Arrays of one kind, one file per shard; ``starts`` are the first ids of the shards and the end."""

    kind: str
    paths: list[str | None] = field(default_factory=list)
    starts: np.ndarray | None = None

    def take(self, ids: np.ndarray) -> np.ndarray:
        """Entries by id; ids need no order."""
        distinct, back = np.unique(ids, return_inverse=True)
        found = np.zeros(len(distinct), self.kind)
        cuts = np.searchsorted(distinct, self.starts)
        for at, path in enumerate(self.paths):
            where = slice(cuts[at], cuts[at + 1])
            if path is not None and cuts[at] < cuts[at + 1]:
                found[where] = load(path, self.kind)[distinct[where] - self.starts[at]]
        return found[back]


def _search(keys: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of ``ordered`` in ``keys`` and whether it is there."""
    place = np.minimum(np.searchsorted(keys, ordered), max(len(keys) - 1, 0))
    return place, (keys[place] == ordered) if len(keys) else np.zeros(len(ordered), bool)


@dataclass
class Table:
    """Values (f4) of sorted hashes, shard by shard."""

    keys: dict[int, str] = field(default_factory=dict)
    values: dict[int, str] = field(default_factory=dict)

    def find(self, shards: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Value of each key, NaN where it is not stored."""
        order = np.lexsort((keys, shards))
        shards, found = shards[order], np.full(len(keys), np.nan)
        cuts = np.flatnonzero(np.diff(shards, prepend=-1, append=-1)) if len(shards) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = int(shards[a])
            if at in self.keys:
                place, known = _search(load(self.keys[at], "u8"), keys[order[a:b]])
                found[order[a:b][known]] = load(self.values[at], "f4")[place[known]]
        return found


@dataclass
class Model:
    order: int
    bits: int
    words: Shards  # sorted hashes
    firsts: np.ndarray  # first id of each shard, and their number at the end
    counts: Shards
    tokens: int
    hot: np.ndarray  # sorted ids of the words of which contexts may be too large for a shard
    grams: dict[int, Table] = field(default_factory=dict)  # by order
    contexts: dict[int, Table] = field(default_factory=dict)  # by order of the n-grams they begin
    once: dict[int, float] = field(default_factory=dict)  # log weight of contexts of one occurrence, which are not stored
    unknown: float = 0.0

    @property
    def size(self) -> int:
        return int(self.firsts[-1])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of sorted hashes; ``size + 1`` for unknown words (``size`` is the start mark)."""
        found = np.full(len(hashes), self.size + 1, np.int64)
        shards = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        cuts = np.searchsorted(shards, np.arange((1 << self.bits) + 1))
        for at, path in enumerate(self.words.paths):
            if path is not None and cuts[at] < cuts[at + 1]:
                where = slice(cuts[at], cuts[at + 1])
                place, known = _search(load(path, "u8"), hashes[where])
                found[where] = np.where(known, self.firsts[at] + place, self.size + 1)
        return found

    def places(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Shard of each n-gram, given by its columns of ids, and shard of its context.

        The upper half of the shard numbers is for contexts that are spread.
        """
        before = _hashed(columns[:-1])
        spread = np.ones(len(columns[-1]), bool)
        for column in columns[:-1]:
            place = np.minimum(np.searchsorted(self.hot, column), len(self.hot) - 1)
            spread &= self.hot[place] == column
        shift, half = np.uint64(64 - self.bits), spread.astype(np.int64) << self.bits
        of_context = half + (before >> shift).astype(np.int64)
        return np.where(spread, half + (_hashed(columns) >> shift).astype(np.int64), of_context), of_context


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the words of each n-gram; of up to two words (32 bits each) no two are equal."""
    if not columns:
        return np.zeros(1, np.uint64)
    first, *rest = (column.astype(np.uint64) for column in columns)
    if not rest:
        return mixed(first)
    value = mixed(first << np.uint64(32) | rest[0])
    for column in rest[1:]:
        with np.errstate(over="ignore"):
            value = mixed(value + (column + np.uint64(1)) * _PRIME)
    return value


def _grams(ids: np.ndarray, start: int, order: int) -> list[np.ndarray]:
    """Columns of ids, oldest first, of the n-gram that ends in each token; ``ids`` holds one start mark per text."""
    at = np.flatnonzero(ids != start)
    columns = [ids[at]]
    for back in range(1, order):
        before = ids[np.maximum(at - back, 0)]
        columns.append(np.where(columns[-1] == start, start, before) if back > 1 else before)
    return [column.astype(np.uint32) for column in columns[::-1]]


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """(sorted hashes of the distinct tokens, tokens as places in them, text of each token, row keys) per batch.

    The start mark of each text is -1 in the token array. A batch ends with the text that fills it; the words of a text
    are turned into numbers at once.
    """

    def empty() -> tuple[dict[bytes, int], list, list[np.ndarray], int]:
        local: dict[bytes, int] = defaultdict()
        local.default_factory = local.__len__
        return local, [], [], 0

    def packed(local: dict[bytes, int], keys: list, parts: list[np.ndarray]):
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.concatenate(parts)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, len(local))
        order = np.argsort(hashes)
        local.default_factory = None  # a dict that refers to itself would wait for the collector, batch after batch
        turn = np.empty(len(order) + 1, np.int32)
        turn[order] = np.arange(len(order))
        turn[-1] = -1
        return hashes[order], turn[flat], np.repeat(np.arange(len(parts), dtype=np.int32), lengths), keys

    local, keys, parts, total = empty()
    for frame in frames:
        for key, text in frame.itertuples(index=False):
            words = _words(text)
            part = np.empty(len(words) + 2, np.int32)
            part[0], part[-1] = -1, local[_END]
            part[1:-1] = np.fromiter(map(local.__getitem__, words), np.int32, len(words))
            keys.append(key)
            parts.append(part)
            total += len(part)
            if total >= _BATCH_TOKENS:
                made = packed(local, keys, parts)
                local, keys, parts, total = empty()  # the words are let go before the batch is worked on
                yield made
                del made
                release_memory()
    if parts:
        made = packed(local, keys, parts)
        local, keys, parts, total = empty()
        yield made
        del made
    release_memory()


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == at).sum()) for at in (1, 2, 3, 4)]


def discounts(n: list[int]) -> np.ndarray:
    """Discounts for counts of 1, 2 and 3 or more; 0.75 each where the counts of counts do not define them."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return np.full(3, 0.75)
    y = n1 / (n1 + 2 * n2)
    found = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where((found > 0) & (found < [1, 2, 3]), found, 0.75)


def _discounted(counts: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return cut[np.minimum(counts, 3).astype(np.int64) - 1]

_BLOB = "shard int, keys binary, counts binary"
_BLOB_COLUMNS = ["shard", "keys", "counts"]


def _blobs(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows (shard, keys, counts) of entries whose ``shards`` ascend; entries are along the last axis."""
    cuts = np.flatnonzero(np.diff(shards, prepend=-1, append=-1)) if len(shards) else []
    return [(int(shards[a]), _packed(keys[..., a:b]), _packed(counts[..., a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _distinct(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order, with their summed counts (each counts once if none are given)."""
    pairs = [columns[at].astype(np.uint64) << np.uint64(32) | columns[at + 1] for at in range(0, len(columns) - 1, 2)]
    pairs += [columns[-1]] if len(columns) % 2 else []
    order = np.lexsort(pairs[::-1]) if len(pairs) > 1 else np.argsort(pairs[0], kind="stable")
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for pair in pairs:
        ordered = pair[order]
        fresh[1:] |= ordered[1:] != ordered[:-1]
    first = np.flatnonzero(fresh)
    if counts is None:
        sums = np.diff(first, append=len(order))
    else:
        sums = np.add.reduceat(counts[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    chosen = order[first]
    return [column[chosen] for column in columns], sums


def _gram_blobs(model: Model, columns: list[np.ndarray], counts: np.ndarray) -> pd.DataFrame:
    shards, _ = model.places(columns)
    order = np.argsort(shards, kind="stable")
    keys = np.stack([column[order] for column in columns]).astype("u4")
    return pd.DataFrame(_blobs(shards[order], keys, counts[order].astype("u8")), columns=_BLOB_COLUMNS)


def _kinds(counts: np.ndarray, groups: np.ndarray, size: int) -> list[np.ndarray]:
    """Per group, its total and how many of its counts are 1, 2, and 3 or more."""
    level = np.minimum(counts, 3)
    total = np.bincount(groups, weights=counts, minlength=size).astype(np.int64)
    return [total, *(np.bincount(groups[level == at], minlength=size) for at in (1, 2, 3))]


_WORD_SCHEMA = "shard int, n bigint, total bigint, words string, counts string, hot array<bigint>"
_GRAM_SCHEMA = "shard int, n bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, many bigint, keys string, counts string"


def train(training: DataFrame, *, order: int = ORDER, bits: int | None = None) -> Model | None:
    """Count and smooth the model of ``training`` (text), n-grams of up to ``order`` words. None if it has no rows.

    There are 2**bits shards; by default one for every ``_SHARD_BYTES`` of text, 2**_LEAST_BITS at least.
    """
    if order < 2:
        raise ValueError("the order must be at least 2")
    spark = training.sparkSession
    texts = training.select(F.lit(0).alias("key"), or_empty("text").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0]
    if size is None:
        return None
    if bits is None:
        # each shard sends arrays to all others, so their number must not follow the number of partitions
        bits = max(_LEAST_BITS, (size // _SHARD_BYTES).bit_length())
    shards = 1 << bits
    # a word takes two bytes at least, so no more than ``shards`` words are hot
    hot_from = max(1, size // (2 * shards))
    folder = f"{shared_folder(spark).rstrip('/')}/tokenloom/lm-{uuid.uuid4().hex}"

    def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for hashes, flat, _, _ in _batches(frames):
            counts = np.bincount(flat[flat >= 0], minlength=len(hashes))
            yield pd.DataFrame(_blobs((hashes >> np.uint64(64 - bits)).astype(np.int64), hashes, counts.astype("u8")), columns=_BLOB_COLUMNS)

    def merge_words(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([_unpacked(blob, "u8") for blob in frame["keys"]])
        (keys,), counts = _distinct([keys], np.concatenate([_unpacked(blob, "u8") for blob in frame["counts"]]))
        row = (
            int(frame["shard"].iloc[0]), len(keys), int(counts.sum()), save(folder, keys), save(folder, counts.astype("i8")),
            np.flatnonzero(counts >= hot_from).tolist(),
        )
        del keys, counts
        release_memory()
        return pd.DataFrame([row], columns=["shard", "n", "total", "words", "counts", "hot"])

    counted = texts.mapInPandas(count_words, _BLOB).groupBy("shard").applyInPandas(merge_words, _WORD_SCHEMA)
    found = {row.shard: row for row in stored(counted, "lm-words").collect()}
    sizes = [found[at].n if at in found else 0 for at in range(shards)]
    firsts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if firsts[-1] >= (1 << 32) - 2:
        raise ValueError("a model holds fewer than 2**32 words")
    hot = [int(firsts[row.shard] + place) for row in found.values() for place in row.hot]
    model = Model(
        order,
        bits,
        Shards("u8", [found[at].words if at in found else None for at in range(shards)]),
        firsts,
        Shards("i8", [found[at].counts if at in found else None for at in range(shards)], firsts),
        sum(row.total for row in found.values()),
        np.array(sorted([*hot, firsts[-1]]), np.int64),
    )

    def count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for hashes, flat, _, _ in _batches(frames):
            ids = np.append(model.ids(hashes), model.size)[flat]
            yield _gram_blobs(model, *_distinct(_grams(ids, model.size, order)))

    listed = {order: _merge(texts.mapInPandas(count_grams, _BLOB), folder, order)}
    for at in range(order - 1, 0, -1):
        listed[at] = _merge(_shorter(listed[at + 1], model, at + 1), folder, at)
    for at in range(1, order + 1):
        _smooth(model, listed[at], at, folder)
    return model


def _merge(blobs: DataFrame, folder: str, order: int) -> DataFrame:
    """One row per shard of the distinct n-grams of an order: their number, total, counts of counts, and files."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(blob, "u4").reshape(order, -1) for blob in frame["keys"]]
        columns = [np.concatenate([part[at] for part in parts]) for at in range(order)]
        del parts
        columns, counts = _distinct(columns, np.concatenate([_unpacked(blob, "u8") for blob in frame["counts"]]))
        row = (
            int(frame["shard"].iloc[0]), len(counts), int(counts.sum()), *_counts_of_counts(counts), int((counts > 2).sum()),
            _write(folder, _packed(np.stack(columns).astype("u4"))), _write(folder, _packed(counts.astype("u8"))),
        )
        del columns, counts
        release_memory()
        return pd.DataFrame([row], columns=["shard", "n", "total", "n1", "n2", "n3", "n4", "many", "keys", "counts"])

    return stored(blobs.groupBy("shard").applyInPandas(merge, _GRAM_SCHEMA), f"lm-grams-{order}")


def _read(row, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    keys, counts = (_unpacked(load(path, "u1").tobytes(), kind) for path, kind in ((row.keys, "u4"), (row.counts, "u8")))
    return list(keys.reshape(order, -1)), counts.astype(np.int64)


def _spread_rows(listed: DataFrame) -> DataFrame:
    """The files' names over as many tasks as there are shards."""
    return listed.select("shard", "keys", "counts").repartition(max(listed.count(), 1), "shard")


def _shorter(listed: DataFrame, model: Model, order: int) -> DataFrame:
    """N-grams without their first word, counted once for each distinct n-gram."""

    def shorten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for frame in frames for row in frame.itertuples(index=False)):
            columns, _ = _read(row, order)
            made = _gram_blobs(model, *_distinct(columns[1:]))
            del columns
            release_memory()
            yield made

    return _spread_rows(listed).mapInPandas(shorten, _BLOB)


def _by_context(columns: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the contexts, an n-gram of each, each n-gram's context as a place there, and `_kinds`."""
    keys, first, groups = np.unique(_hashed(columns[:-1]), return_index=True, return_inverse=True)
    return keys, first, groups, np.stack(_kinds(counts, groups, len(keys)))


def _smooth(model: Model, listed: DataFrame, order: int, folder: str) -> None:
    """Add the tables of an order to the model; those of the lower orders are there."""
    spark = listed.sparkSession
    rows = listed.collect()
    cut = discounts([sum(row[f"n{at}"] for row in rows) for at in (1, 2, 3, 4)])
    half = 1 << model.bits
    model.once[order] = math.log10(cut[0])
    statistics: dict[int, tuple[str, str]] = {}
    if order == 1:
        total = sum(row.total for row in rows)
        weight = float(cut @ [sum(row[name] for row in rows) for name in ("n1", "n2", "many")]) / total
        model.unknown = weight / (model.size + 1)
    else:

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in (row for frame in frames for row in frame.itertuples(index=False)):
                columns, counts = _read(row, order)
                keys, first, _, kinds = _by_context(columns, counts)
                _, places = model.places([column[first] for column in columns])
                by_shard = np.argsort(places, kind="stable")
                yield pd.DataFrame(_blobs(places[by_shard], keys[by_shard], kinds[:, by_shard].astype("i8")), columns=_BLOB_COLUMNS)

        def summed(frame: pd.DataFrame) -> pd.DataFrame:
            keys = np.concatenate([_unpacked(blob, "u8") for blob in frame["keys"]])
            kinds = np.concatenate([_unpacked(blob, "i8").reshape(4, -1) for blob in frame["counts"]], axis=1)
            keys, groups = np.unique(keys, return_inverse=True)
            every = np.stack([np.bincount(groups, weights=kind, minlength=len(keys)) for kind in kinds]).astype("i8")
            weights = np.log10(cut @ every[1:] / every[0]).astype("f4")
            row = (int(frame["shard"].iloc[0]), save(folder, keys), save(folder, every[0]), save(folder, weights))
            return pd.DataFrame([row], columns=["shard", "keys", "totals", "weights"])

        # contexts of the lower half lie in one shard each, together with all their n-grams
        spread = listed.where(F.col("shard") >= half)
        spread = _spread_rows(spread).mapInPandas(partial, _BLOB).groupBy("shard")
        spread = stored(spread.applyInPandas(summed, "shard int, keys string, totals string, weights string"), f"lm-spread-{order}").collect()
        statistics = {row.shard: (row.keys, row.totals) for row in spread}
        model.contexts[order] = Table({row.shard: row.keys for row in spread}, {row.shard: row.weights for row in spread})

    def of_spread(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Totals and weights of n-grams whose contexts are spread."""
        if order == 1:
            return np.full(len(columns[0]), total), np.full(len(columns[0]), weight)
        keys, first, groups = np.unique(_hashed(columns[:-1]), return_index=True, return_inverse=True)
        _, places = model.places([column[first] for column in columns])
        totals = np.zeros(len(keys))
        for at in np.unique(places).tolist():
            stored_keys, stored_totals = statistics[at]
            place, _ = _search(load(stored_keys, "u8"), keys[places == at])
            totals[places == at] = load(stored_totals, "i8")[place]
        return totals[groups], np.power(10.0, model.contexts[order].find(places, keys))[groups]

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for frame in frames for row in frame.itertuples(index=False)):
            columns, counts = _read(row, order)
            contexts = weights = ""
            if row.shard >= half:
                totals, share = of_spread(columns)
            else:
                keys, _, groups, kinds = _by_context(columns, counts)
                by_context = cut @ kinds[1:] / kinds[0]
                totals, share = kinds[0][groups], by_context[groups]
                kept = kinds[0] > 1
                contexts, weights = save(folder, keys[kept]), save(folder, np.log10(by_context[kept]).astype("f4"))
            if order == 1:
                below = np.full(len(counts), 1.0 / (model.size + 1))
            else:
                shorter = columns[1:]
                below = np.power(10.0, model.grams[order - 1].find(model.places(shorter)[0], _hashed(shorter)))
            chance = (counts - _discounted(counts, cut)) / totals + share * below
            keys = _hashed(columns)
            by_key = np.argsort(keys)
            made = (row.shard, save(folder, keys[by_key]), save(folder, np.log10(chance[by_key]).astype("f4")), contexts, weights)
            del columns, counts, totals, share, below, chance, keys, by_key
            release_memory()
            yield pd.DataFrame([made], columns=["shard", "keys", "scores", "contexts", "weights"])

    schema = "shard int, keys string, scores string, contexts string, weights string"
    waves, done = _WAVES if order == model.order else 1, []
    for wave in range(waves):
        part = _spread_rows(listed.where(F.col("shard") % waves == wave))
        done += stored(part.mapInPandas(finish, schema), f"lm-scores-{order}").collect()
        _remove([path for row in rows if row.shard % waves == wave for path in (row.keys, row.counts)])
    model.grams[order] = Table({row.shard: row.keys for row in done}, {row.shard: row.scores for row in done})
    if order > 1:
        own = [row for row in done if row.contexts]
        model.contexts[order].keys.update({row.shard: row.contexts for row in own})
        model.contexts[order].values.update({row.shard: row.weights for row in own})


def _remove(paths: list[str]) -> None:
    for path in paths:
        store, name = fs.FileSystem.from_uri(path)
        store.delete_file(name)


def _weights(model: Model, order: int, shards: np.ndarray, context: list[np.ndarray]) -> np.ndarray:
    """Log weight that each context leaves to the next lower order; a context that was not seen leaves all.

    Contexts of one occurrence all have the same weight and are known by their n-gram of the lower order.
    """
    found = model.contexts[order].find(shards, _hashed(context))
    rare = np.flatnonzero(np.isnan(found))
    part = [column[rare] for column in context]
    seen = ~np.isnan(model.grams[order - 1].find(model.places(part)[0], _hashed(part)))
    found[rare] = np.where(seen, model.once[order], 0.0)
    return found


def log_scores(model: Model, columns: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of the last word of each n-gram (columns of ids, as long as the model's order)."""
    found, carried = np.zeros(len(columns[-1])), np.zeros(len(columns[-1]))
    left = np.arange(len(found))
    for order in range(model.order, 0, -1):
        part = [column[left] for column in columns[model.order - order :]]
        shards, of_context = model.places(part)
        value = model.grams[order].find(shards, _hashed(part))
        hit = ~np.isnan(value)
        found[left[hit]] = carried[left[hit]] + value[hit]
        left = left[~hit]
        if order > 1 and len(left):
            carried[left] += _weights(model, order, of_context[~hit], [column[~hit] for column in part[:-1]])
    found[left] = carried[left] + math.log10(model.unknown)
    return found


def score(documents: DataFrame, model: Model | None, *, id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every whole text, end token included."""
    schema = f"{id_column} bigint, n_tokens bigint, n_known bigint, base_score double, score double"

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = model  # paths, sizes and the hot words; the arrays stay in their files
        for hashes, flat, owner, rows in _batches(frames):
            count = len(rows)
            token = flat >= 0
            out = pd.DataFrame({id_column: pd.array([None if key is None else int(key) for key in rows], dtype="Int64")})
            out["n_tokens"] = np.bincount(owner[token], minlength=count)
            if known is None:
                out["n_known"], out["base_score"], out["score"] = 0, 0.0, 0.0
                yield out
                continue
            by_word = known.ids(hashes)
            inside = by_word < known.size
            counts = np.zeros(len(by_word), np.int64)
            counts[inside] = known.counts.take(by_word[inside])
            base = np.log10((counts + 0.5) / (known.tokens + 0.5 * (known.size + 1)))
            out["n_known"] = np.bincount(owner[token], weights=inside[flat[token]], minlength=count).astype(np.int64)
            out["base_score"] = np.bincount(owner[token], weights=base[flat[token]], minlength=count)
            columns = _grams(np.append(by_word, known.size)[flat], known.size, known.order)
            _, first, back = np.unique(_hashed(columns), return_index=True, return_inverse=True)
            scores = log_scores(known, [column[first] for column in columns])
            out["score"] = np.bincount(owner[token], weights=scores[back], minlength=count)
            yield out

    texts = documents.select(F.col(id_column).cast("string").alias(id_column), or_empty("text").alias("text"))
    return texts.mapInPandas(scored, schema)


def held_out_scores(
    documents: DataFrame, *, order: int = ORDER, modulus: int = MODULUS, held_out: int = HELD_OUT
) -> DataFrame:
    """Score all documents with a model of those outside the held-out fold."""
    fold = remainder("doc_id", modulus) == held_out
    with short_lived_shuffles(documents.sparkSession):
        model = train(documents.where(~fold).select("text"), order=order)
    tokens = model.tokens if model else 0
    return score(documents, model).select(
        "doc_id",
        fold.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


def perplexity(scores: DataFrame) -> float:
    """Perplexity over the tokens of scored texts."""
    total, tokens = scores.agg(F.sum("score"), F.sum("n_tokens")).first()
    return math.pow(10.0, -total / tokens) if tokens else math.nan
