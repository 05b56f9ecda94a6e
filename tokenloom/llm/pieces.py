"""SentencePiece encoding, decoding and sampling of distinct segmentations by Gumbel top-k.

Encoding is the model's own. Sampling walks the lattice of all segmentations of a text into vocabulary pieces (a
character that is no piece is an arc of its UTF-8 bytes). A piece's log probability follows Zipf's law in its rank,
as the vocabularies at hand rank their pieces and hold no probabilities. Backward sums give each arc its probability
among the arcs that leave its position.

Segmentations are the leaves of a tree of such choices. The root has a Gumbel variable at the text's total mass, a
child's perturbed value is bounded by its parent's, and A* takes the node of largest value next. The child that
attains the bound is drawn by its probability; the siblings of a choice stay together as one node, whose largest value
is a truncated Gumbel of their joint mass, and are told apart only when that node is taken. So the first ``k`` leaves
are ``k`` distinct segmentations without replacement, in falling order of their perturbed log probabilities, and the
value of the next node is the threshold of their inclusion scores 1 - exp(-exp(log_prob - threshold)).

Texts are processed whole, in batches of bounded size. All randomness is a hash of the row key and the place of the
choice, so results do not depend on batches or partitions. Null texts are empty; an empty text has no pieces and one
segmentation, the empty one. Texts with fewer than ``k`` segmentations give all they have.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import mixed, or_empty

SAMPLES = 2
SPACE = "▁"
_BATCH_CHARS = 300_000
_KEPT_UNITS = 80_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    """Path of the piece vocabulary that the installed package of public tokenizers brings along."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _uniform(key: np.ndarray, turn: int, place=0, step=0) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key, the turn, the unit's place in the text and the step in the unit only."""
    with np.errstate(over="ignore"):
        number = (np.asarray(place, np.uint64) << np.uint64(24)) + np.asarray(step, np.uint64)
        value = mixed(key + (number + np.uint64(turn) * np.uint64(0xD1342543DE82EF95)) * _PRIME)
    return ((value >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Vocabulary:
    """The model, its pieces as a trie of hashed prefixes, and a log probability per piece."""

    def __init__(self, proto: bytes):
        self.processor = model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        count = model.get_piece_size()
        self.bytes = np.zeros(256, np.int64)
        whole: dict[int, int] = {}
        prefixes: dict[int, int] = {}
        rank = np.array([min(-model.get_score(at), count) for at in range(count)])
        weight = 1.0 / (np.maximum(rank, 0) + 2.7)
        self.log_prob = np.log(weight / weight.sum())
        self.byte_log_prob = float(self.log_prob.min())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        joined = set()
        for at in range(count):
            piece = model.id_to_piece(at)
            if model.is_byte(at):
                self.bytes[int(piece[3:5], 16)] = at
            elif not (model.is_control(at) or model.is_unknown(at) or model.is_unused(at)):
                value = 0
                for char in piece:
                    value = (value + ord(char) + 1) * int(_PRIME) & 0xFFFFFFFFFFFFFFFF
                    prefixes.setdefault(value, -1)
                whole[value] = at
                if len(piece) > 1:
                    joined.update(piece)
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("pieces that reach over the start of a word are not supported")
        prefixes.update(whole)
        self.keys = np.array(sorted(prefixes), np.uint64)
        self.ids = np.array([prefixes[int(key)] for key in self.keys], np.int64)
        # where the keys of each value of the leading bits begin
        self.begins = np.searchsorted(self.keys, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        alone = "" if "\n" in joined else "\n"
        # no piece reaches over these borders, so the pieces of a text are those of its units
        self.units = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|\n|[^{SPACE}{alone}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    @staticmethod
    def _extend(value, code):
        with np.errstate(over="ignore"):
            return (value + code + np.uint64(1)) * _PRIME

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place in ``keys`` of each value, or a place of another key if it is not there."""
        last = len(self.keys) - 1
        place = np.minimum(self.begins[(values >> np.uint64(44)).astype(np.int32)], last)
        later = np.flatnonzero(self.keys[place] < values)
        place[later] = np.minimum(np.searchsorted(self.keys, values[later]), last)
        return place

    def split(self, text: str) -> list[str]:
        return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The model's own pieces of each distinct unit, as the bytes of their ids.

        Units are read off behind a line feed, over which no piece reaches. What was found is kept for later batches:
        units met since the young half was last full, and those of the half before it.
        """
        young, old = self.young, self.old
        missing = [unit for unit in units if unit not in young]
        fresh = [unit for unit in missing if unit not in old]
        young.update((unit, old[unit]) for unit in missing if unit in old)
        lead = len(self.processor.encode("\n"))
        made = self.processor.encode(["\n" + unit.replace(SPACE, " ") for unit in fresh], num_threads=1) if fresh else []
        young.update((unit, array("i", ids[lead:]).tobytes()) for unit, ids in zip(fresh, made, strict=True))
        found = [young[unit] for unit in units]
        if len(young) > _KEPT_UNITS // 2:
            self.young, self.old = {}, young
        return found

    def decodes(self, parts: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether the model decodes each text's pieces to that very text."""
        return [found == text for found, text in zip(self.processor.decode([part.tolist() for part in parts]), texts, strict=True)] if parts else []


class Lattice:
    """Arcs of the segmentations of distinct units, ordered by start, with conditional probabilities."""

    def __init__(self, vocabulary: Vocabulary, units: list[str]):
        codes = np.frombuffer("".join(f"{unit}\0" for unit in units).encode("utf-32-le", "replace"), np.uint32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1].astype(np.int64)
        ends = self.starts + lengths
        size = len(codes)
        left = np.repeat(ends, lengths + 1) - np.arange(size)  # characters from here to the unit's end
        inside = np.flatnonzero(left)
        at, value, reach = inside, np.zeros(len(inside), np.uint64), 0
        arcs = []
        while len(at):
            reach += 1
            value = vocabulary._extend(value, codes[at + reach - 1].astype(np.uint64))
            place = vocabulary.find(value)
            known = vocabulary.keys[place] == value
            ids = np.where(known, vocabulary.ids[place], -1)
            if reach == 1:
                fallback = at[ids < 0]
                points = codes[fallback]
                width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
                arcs.append((fallback, np.ones(len(fallback), np.int64), -1 - points.astype(np.int64), width * vocabulary.byte_log_prob))
            good = ids >= 0
            arcs.append((at[good], np.full(int(good.sum()), reach), ids[good], vocabulary.log_prob[ids[good]]))
            on = known & (left[at] > reach)
            at, value = at[on], value[on]
        start, reaches, ids, log_prob = (np.concatenate(column) for column in zip(*arcs, strict=True)) if arcs else [np.zeros(0, np.int64)] * 4
        del arcs, at, value
        start, end, ids = start.astype(np.int32), (start + reaches).astype(np.int32), ids.astype(np.int32)
        order = np.argsort(start, kind="stable").astype(np.int32)
        start, self.end, self.ids, log_prob = start[order], end[order], ids[order], log_prob[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=size))])
        self.mass = np.zeros(size)
        distance = left[start]
        by_left = np.argsort(distance.astype(np.uint16) if left.max(initial=0) < 65536 else distance, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(distance, minlength=1)[1:])])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            arc = by_left[a:b]
            border = np.flatnonzero(np.diff(start[arc], prepend=-1))
            self.mass[start[arc][border]] = np.logaddexp.reduceat(log_prob[arc] + self.mass[self.end[arc]], border)
        self.prob = np.exp(log_prob + self.mass[self.end] - self.mass[start])
        total = np.cumsum(self.prob)
        self.upto = total - np.concatenate([[0.0], total])[self.first[start]]
        self.unit_ends = ends
        rest = 1.0 - self.prob
        with np.errstate(divide="ignore"):
            self.log_rest = np.log(np.where(rest > 1e-12, rest, 0.0))
            self.log_share = np.log(self.prob)

    def choose(self, at: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """One arc from each position by its probability."""
        arc, last = self.first[at].copy(), self.first[at + 1] - 1
        while True:
            later = (chance > self.upto[arc]) & (arc < last)
            if not later.any():
                return arc
            arc[later] += 1

    def walk(self, units: np.ndarray, key: np.ndarray, place: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled arcs of each unit in reading order, and how many each has; randomness by (key, turn, place, step)."""
        at, active, taken, level = self.starts[units].copy(), np.arange(len(units)), [], 0
        ends = self.unit_ends[units]
        counts = np.zeros(len(units), np.int64)
        while len(active):
            arc = self.choose(at[active], _uniform(key[active], turn, place[active], level))
            taken.append((active, arc))
            counts[active] += 1
            at[active] = self.end[arc]
            active = active[at[active] < ends[active]]
            level += 1
        offset = np.concatenate([[0], np.cumsum(counts)])
        arcs = np.empty(offset[-1], np.int64)
        for level, (who, arc) in enumerate(taken):
            arcs[offset[who] + level] = arc
        return arcs, counts


def _truncated(mass: np.ndarray, bound: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Gumbel variables of the given log masses below the given bounds."""
    # -log(e^-bound + e^-mass * E) with E = -log(chance); an empty mass gives minus infinity
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(chance)) - mass)


class _Paths:
    """One path per text: arcs in reading order, the unit (place in the text) and level of each step, log shares."""

    def __init__(self, lattice: Lattice, arcs: np.ndarray, counts: np.ndarray, first: np.ndarray):
        self.arcs = arcs  # of all texts
        self.first = first  # first step of each text, and the end
        self.unit = np.repeat(np.arange(len(counts)), counts)
        begin = np.cumsum(counts) - counts
        self.level = np.arange(len(arcs)) - np.repeat(begin, counts)
        logs = lattice.log_share[arcs]
        # summed text by text, so that a text's sums do not depend on its batch
        sums = [np.cumsum(logs[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.share = (np.concatenate(sums) if sums else logs) - logs  # before the step
        self.whole = np.array([part[-1] if len(part) else 0.0 for part in sums])


def sample(lattice: Lattice, units: np.ndarray, first_unit: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple]]:
    """Per text up to ``k`` samples (arcs, log_prob, value), then the value of the next node.

    ``units`` holds the units of all texts one behind the other, text t those from ``first_unit[t]`` on.
    """
    texts = len(first_unit) - 1
    owner = np.repeat(np.arange(texts), np.diff(first_unit))
    place = np.arange(len(units)) - first_unit[:-1][owner] if len(units) else np.zeros(0, np.int64)
    root = -np.log(-np.log(_uniform(keys, 0)))
    heaps: list[list[tuple]] = [[] for _ in range(texts)]
    found: list[list[tuple]] = [[] for _ in range(texts)]

    def open_steps(text: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], value: np.ndarray, turn: int):
        """Push the best sibling nodes of the new steps of each text (arcs, unit places, levels, share before)."""
        for t, (arcs, unit, level, share), bound in zip(text, steps, value, strict=True):
            if not len(arcs):
                continue
            perturbed = _truncated(share + lattice.log_rest[arcs], bound, _uniform(keys[t], 1000 + turn, unit, level))
            best = np.argpartition(-perturbed, min(k, len(arcs) - 1))[:k] if len(arcs) > k else np.arange(len(arcs))
            for at in best.tolist():
                if np.isfinite(perturbed[at]):
                    heapq.heappush(heaps[t], (-perturbed[at], turn, at, (int(arcs[at]),)))

    arcs, counts = lattice.walk(units, keys[owner], place, 1)
    step_first = np.concatenate([[0], np.cumsum(counts)])[first_unit]
    paths = _Paths(lattice, arcs, counts, step_first)
    unit_place, stored_paths = place[paths.unit] if len(arcs) else np.zeros(0, np.int64), [dict() for _ in range(texts)]
    steps = []
    for t in range(texts):
        part = slice(step_first[t], step_first[t + 1])
        held = (paths.arcs[part], unit_place[part], paths.level[part], paths.share[part])
        stored_paths[t][1] = held
        found[t].append((held[0], float(paths.whole[t]), float(root[t])))
        steps.append(held)
    open_steps(np.arange(texts), steps, root, 1)

    for turn in range(2, k + 1):
        taken, heads, tails = [], [], []
        for t in range(texts):
            if not heaps[t]:
                continue
            value, source, at, used = heapq.heappop(heaps[t])
            arcs_t, unit_t, level_t, share_t = stored_paths[t][source]
            begin = int(lattice.first[int(_arc_start(lattice, used[0]))])
            stop = int(lattice.first[int(_arc_start(lattice, used[0])) + 1])
            options = np.array([arc for arc in range(begin, stop) if arc not in used])
            weights = np.cumsum(lattice.prob[options])
            chance = _uniform(keys[t : t + 1], 2000 + turn, unit_t[at], level_t[at])[0]
            arc = int(options[min(np.searchsorted(weights, chance * weights[-1]), len(options) - 1)])
            left = 1.0 - lattice.prob[[*used, arc]].sum()
            if len(options) > 1 and left > 1e-12:  # the siblings that are still together
                mass = np.array([share_t[at] + np.log(left)])
                again = _truncated(mass, np.array([-value]), _uniform(keys[t : t + 1], 3000 + turn, unit_t[at], level_t[at]))[0]
                heapq.heappush(heaps[t], (-again, source, at, (*used, arc)))
            # the rest of this unit, arc by arc
            unit = units[first_unit[t] + unit_t[at]]
            head, level = [arc], int(level_t[at]) + 1
            while lattice.end[head[-1]] < lattice.unit_ends[unit]:
                where = lattice.end[head[-1] : head[-1] + 1]
                head.append(int(lattice.choose(where, _uniform(keys[t : t + 1], turn, unit_t[at], level))[0]))
                level += 1
            taken.append((t, source, at, -value))
            heads.append(np.array(head))
            tails.append((first_unit[t] + int(unit_t[at]) + 1, first_unit[t + 1]))
        if not taken:
            break
        later = np.concatenate([np.arange(a, b) for a, b in tails])
        arcs, counts = lattice.walk(units[later], keys[owner[later]], place[later], turn)
        ends = np.concatenate([[0], np.cumsum(counts)])
        fresh, at_unit = [], 0
        for (t, source, at, value), head, (a, b) in zip(taken, heads, tails, strict=True):
            old = stored_paths[t][source]
            tail = arcs[ends[at_unit] : ends[at_unit + b - a]]
            tail_counts = counts[at_unit : at_unit + b - a]
            at_unit += b - a
            new_arcs = np.concatenate([head, tail])
            unit = np.concatenate([np.full(len(head), old[1][at]), np.repeat(place[a:b], tail_counts)])
            level = np.concatenate(
                [old[2][at] + np.arange(len(head)), np.arange(len(tail)) - np.repeat(np.cumsum(tail_counts) - tail_counts, tail_counts)]
            )
            logs = lattice.log_share[new_arcs]
            share = old[3][at] + np.cumsum(logs) - logs
            whole = tuple(np.concatenate([x[:at], y]) for x, y in zip(old, (new_arcs, unit, level, share), strict=True))
            stored_paths[t][turn] = whole
            found[t].append((whole[0], float(share[-1] + logs[-1]), float(value)))
            # a node's number is its step in the whole path; the branching step itself stays with its old siblings
            blank = np.zeros(at + 1)
            fresh.append((np.concatenate([whole[0][: at + 1], new_arcs[1:]]), whole[1], whole[2], np.concatenate([blank - np.inf, share[1:]])))
        open_steps(np.array([t for t, *_ in taken]), fresh, np.array([value for *_, value in taken]), turn)
    for t in range(texts):
        found[t].append(-heaps[t][0][0] if heaps[t] else -np.inf)
    return found


def _arc_start(lattice: Lattice, arc: int) -> int:
    return np.searchsorted(lattice.first, arc, side="right") - 1


def _spell(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Piece ids of arcs, fallback arcs as the ids of their UTF-8 bytes."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids
    widths = np.ones(len(ids), np.int64)
    spelt = {int(at): vocabulary.bytes[list(chr(-1 - at).encode("utf-8", "replace"))] for at in np.unique(ids[odd])}
    found = [spelt[at] for at in ids[odd].tolist()]
    widths[odd] = [len(part) for part in found]
    out = np.repeat(ids, widths)
    out[out < 0] = np.concatenate(found)
    return out


_SAMPLE = "struct<ids: array<int>, log_prob: double, value: double, inclusion: double>"
_SCHEMA = f"doc_id bigint, n_chars bigint, ids array<int>, round_trip boolean, samples array<{_SAMPLE}>"


def encode_and_sample(documents: DataFrame, *, k: int = SAMPLES, model_path: str | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, n_chars, ids, round_trip, samples) of every whole text.

    ``ids`` is the model's encoding, ``round_trip`` tells whether it and every sample decode to the text again (a text that
    holds the space mark does not). The vocabulary file
    is read once and travels with the job. Rows with a null doc_id share one row key.
    """
    with open(model_path or default_model(), "rb") as file:
        proto = documents.sparkSession.sparkContext.broadcast(file.read())

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(proto.value)
        for frame in frames:
            ids, texts = frame.column(0), frame.column(1)
            sizes = np.cumsum(pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(texts):
                done = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, done + _BATCH_CHARS, side="right")))
                yield _batch(vocabulary, ids.slice(begin, end - begin), texts.slice(begin, end - begin).to_pylist(), k, seed)
                begin = end

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), or_empty("text").alias("text"))
    return rows.mapInArrow(work, _SCHEMA)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(part) for part in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _batch(vocabulary: Vocabulary, ids: pa.Array, texts: list[str], k: int, seed: int) -> pa.RecordBatch:
    local: dict[str, int] = defaultdict()
    local.default_factory = local.__len__
    split = [vocabulary.split(text) for text in texts]
    units = np.fromiter(map(local.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
    first = np.concatenate([[0], np.cumsum([len(part) for part in split])]).astype(np.int64)
    names = list(local)
    local.default_factory = None  # a dict that refers to itself would wait for the collector, batch after batch
    encoded = vocabulary.encode_units(names)
    pieces = [
        np.frombuffer(b"".join(map(encoded.__getitem__, units[a:b].tolist())), np.int32) for a, b in zip(first[:-1], first[1:], strict=True)
    ]
    exact = vocabulary.decodes(pieces, texts)
    keys = mixed(np.array([xxhash.xxh64_intdigest(str(key).encode(), seed) for key in ids.to_pylist()], np.uint64))
    lattice = Lattice(vocabulary, names)
    arcs, numbers, counts = [], [], []
    for *samples, threshold in sample(lattice, units, first, keys, k):
        counts.append(len(samples))
        for chosen, log_prob, value in samples:
            arcs.append(_spell(vocabulary, lattice.ids[chosen]))
            inclusion = -np.expm1(-np.exp(min(log_prob - threshold, 50.0))) if np.isfinite(threshold) else 1.0
            numbers.append((log_prob, value, inclusion))
    owners = np.repeat(np.arange(len(texts)), counts)
    drawn_exact = np.array(vocabulary.decodes(arcs, [texts[at] for at in owners.tolist()]), bool)
    exact = np.array(exact, bool) & (np.bincount(owners[~drawn_exact], minlength=len(texts)) == 0)
    table = np.array(numbers).reshape(-1, 3)
    drawn = pa.StructArray.from_arrays(
        [_lists(arcs), *(pa.array(table[:, at]) for at in range(3))], ["ids", "log_prob", "value", "inclusion"]
    )
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([len(text) for text in texts], pa.int64()),
            _lists(pieces),
            pa.array(exact, pa.bool_()),
            pa.ListArray.from_arrays(offsets, drawn),
        ],
        ["doc_id", "n_chars", "ids", "round_trip", "samples"],
    )


def decode(rows: DataFrame, *, ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """Add ``decoded``, the text of the piece ids; null ids give a null text."""
    with open(model_path or default_model(), "rb") as file:
        proto = rows.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        for batch in batches:
            yield pd.Series([None if part is None else model.decode(part.tolist()) for part in batch], dtype="object")

    return rows.withColumn("decoded", decoded(ids))
