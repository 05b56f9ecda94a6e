r"""Conversation structure repair by a run-length dynamic program over min-plus transitions.

Rows of a conversation are taken by turn (null first), then role, then text. Each row has at most one fault: ``blank``
(no character beyond ASCII white space), ``duplicate`` (role and text seen earlier in the conversation) or
``truncated`` (its last such character is none of ``.!?``). A repair keeps a row (0), gives it another role (1) or
deletes it (2; the only choice for blank and duplicate rows), inserts an empty turn (5), and pays 5 for each truncated
row that stays; the role initials that result match ``(s?(ua)+)?``. Of the cheapest repairs the one whose edit
initials (``D I K R``) come first in ASCII order is taken.

Equal rows of one turn are one stored row with a count. Rows become one of nine symbols; the sorted rows are cut into
blocks of ``2 ** block_bits``, so that a conversation of any length is spread over many tasks. Within a block equal
neighbouring symbols are one run, and a run is taken in one step for each binary digit of its length, by cached powers
of the symbol's 4 x 4 min-plus matrix. Blocks are chained by one small row each, in a stream sorted by block that holds
one vector; then every block unrolls the choices for each state it may be entered in.

Cases: null roles and texts are taken as empty (``damaged`` makes them one space); a null conv_id is one conversation;
a null turn comes first and leaves gaps alone; other initials than s, u, a never fit and are reroled or deleted;
repeated rows are duplicates; empty tables give empty results; columns beyond the four are not carried along. Only
``digests`` passes the text of one conversation through one task, as a stream, since a hash of the joined text cannot
be split; it holds the text of one batch and the audit, which is a value of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import or_empty, stored

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
BLOCK_BITS = 12
#: Blocks of at most this many rows keep their results in a worker's cache.
_SHORT = 32

_SPACE = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state that an inserted or reroled turn leads to, and its role initial.
_GOES = np.array([_USER, _USER, _ASSISTANT, _USER])
_SAYS = "uuau"
#: Role class (s, u, a, other) and state before -> state after a kept turn.
_FITS = {(0, _START): _SYSTEM, (1, _START): _USER, (1, _SYSTEM): _USER, (1, _ASSISTANT): _USER, (2, _USER): _ASSISTANT}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_NEVER = 1 << 60
_DELETE_ONLY = 0


def _times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a matrix."""
    return np.minimum((left[:, :, None] + right[None, :, :]).min(axis=1), _NEVER)


def _applied(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with each row of ``vectors``."""
    return np.minimum((matrix[None, :, :] + vectors[:, None, :]).min(axis=2), _NEVER)


def _unit() -> np.ndarray:
    unit = np.full((4, 4), _NEVER, dtype=np.int64)
    np.fill_diagonal(unit, 0)
    return unit


def _inserts() -> np.ndarray:
    """Any number of inserted turns, from each state to each."""
    one = _unit()
    one[np.arange(4), _GOES] = INSERT
    return _times(one, _times(one, one))


def _options(symbol: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """The edits that consume a row of this symbol: (initial, cost by state, state after)."""
    states = np.arange(4)
    found = [("D", np.full(4, DELETE), states)]
    if symbol == _DELETE_ONLY:
        return found
    role, truncated = divmod(int(symbol) - 1, 2)
    fits = np.array([_FITS.get((role, state), -1) for state in states])
    extra = TRUNCATED * truncated
    found.append(("K", np.where(fits >= 0, KEEP + extra, _NEVER), np.maximum(fits, 0)))
    found.append(("R", np.full(4, REROLE + extra), _GOES))
    return found


@lru_cache(maxsize=1024)
def _power(symbol: int, exponent: int) -> np.ndarray:
    """The transition of ``2 ** exponent`` rows of one symbol, inserts before each row included."""
    if exponent:
        half = _power(symbol, exponent - 1)
        return _times(half, half)
    edit = np.full((4, 4), _NEVER, dtype=np.int64)
    for _, cost, after in _options(symbol):
        for state in range(4):
            edit[state, after[state]] = min(edit[state, after[state]], cost[state])
    return _times(_inserts(), edit)


def _runs(symbols: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Equal neighbouring symbols as (symbol, length); the copies behind a row can only be deleted."""
    runs: list[tuple[int, int]] = []
    for symbol, count in zip(symbols, counts, strict=True):
        for kind, length in ((symbol, 1), (_DELETE_ONLY, count - 1)):
            if not length:
                continue
            if runs and runs[-1][0] == kind:
                runs[-1] = (kind, runs[-1][1] + length)
            else:
                runs.append((kind, length))
    return runs


def _digits(length: int) -> Iterator[int]:
    at = 0
    while length:
        if length & 1:
            yield at
        length >>= 1
        at += 1


def _transition(runs: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Least costs from each state before the runs to each state after them."""
    whole = _unit()
    for symbol, length in runs:
        for exponent in _digits(length):
            whole = _times(whole, _power(symbol, exponent))
    return whole


def _final() -> np.ndarray:
    """Cost of ending in each state, with inserts behind the last row."""
    ends = np.array([0, _NEVER, _NEVER, 0], dtype=np.int64)
    return _applied(_inserts(), ends[None])[0]


def _costs_left(symbol: int, length: int, behind: np.ndarray) -> np.ndarray:
    """Row j: costs to go by state when j rows of the run are left; each doubling takes one cached power."""
    left = np.empty((length + 1, 4), dtype=np.int64)
    left[0], done, exponent = behind, 1, 0
    while done <= length:
        take = min(done, length + 1 - done)
        left[done : done + take] = _applied(_power(symbol, exponent), left[:take])
        done += take
        exponent += 1
    return left


def _unrolled(symbols: tuple[int, ...], behind: tuple[int, ...]) -> tuple[list[list[str]], list[int]]:
    """For each state before the rows: their edits in order and the state behind them.

    An edit is ``D``, ``K``, ``Ru`` or ``Ra``, with ``Iu`` or ``Ia`` before it for each inserted turn. ``behind`` are the
    costs to go after these rows.
    """
    steps: list[list[tuple[str, int]]] = []
    costs = np.array(behind, dtype=np.int64)
    at = len(symbols)
    while at:
        begin = at
        while begin and symbols[begin - 1] == symbols[at - 1]:
            begin -= 1
        symbol = symbols[begin]
        left = _costs_left(symbol, at - begin, costs)
        here, after = left[1:], left[:-1]
        chosen = np.full(here.shape, "?", dtype="U1")
        target = np.zeros(here.shape, dtype=np.int64)
        inserted = INSERT + here[:, _GOES]
        # In ASCII order, the first edit that is on a cheapest way; numbers of rows left run upwards.
        ordered = _options(symbol) + [("I", None, _GOES)]
        for initial, cost, goes in sorted(ordered, key=lambda option: option[0]):
            price = inserted if initial == "I" else cost[None, :] + after[:, goes]
            fits = (chosen == "?") & (price == here)
            chosen[fits] = initial
            target[fits] = np.broadcast_to(goes, here.shape)[fits]
        for row in range(at - begin):  # from the last row of the run to its first
            step = []
            for state in range(4):
                now, text = state, ""
                while chosen[row, now] == "I":
                    text += "I" + _SAYS[now]
                    now = int(target[row, now])
                initial = str(chosen[row, now])
                text += initial + (_SAYS[now] if initial == "R" else "")
                step.append((text, int(target[row, now])))
            steps.append(step)
        costs = left[-1]
        at = begin
    steps.reverse()
    edits, ends = [], []
    for state in range(4):
        mine = []
        for step in steps:
            text, state = step[state]
            mine.append(text)
        edits.append(mine)
        ends.append(state)
    return edits, ends


@lru_cache(maxsize=4096)
def _short_transition(runs: tuple[tuple[int, int], ...]) -> np.ndarray:
    return _transition(runs)


@lru_cache(maxsize=4096)
def _short_unrolled(symbols: tuple[int, ...], behind: tuple[int, ...]) -> tuple[list[list[str]], list[int]]:
    return _unrolled(symbols, behind)


def _closing(state: int) -> str:
    """Inserts behind the last row."""
    text = ""
    while state not in (_START, _ASSISTANT):
        text += "I" + _SAYS[state]
        state = int(_GOES[state])
    return text


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) damaged by the hash of ``conv_id:turn``; nulls are one space."""
    either = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id",
        "turn",
        either("role").alias("role"),
        either("text").alias("text"),
        (F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn"))) % 20).alias("harm"),
    )
    return rows.where("harm != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "")
        .when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("harm") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _key() -> Column:
    """The conversation as text, so that no id crosses into Python as a number; a null id has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))


def _named(df: DataFrame, kind: str) -> DataFrame:
    """``key`` back as conv_id of its own type."""
    held = F.when(F.col("key") != "null", F.substring("key", 2, 1 << 30)).cast(kind)
    return df.select(held.alias("conv_id"), *[name for name in df.columns if name != "key"])


def _symbols(turns: DataFrame, block_bits: int) -> DataFrame:
    """Distinct rows with copies, faults and symbol, numbered in order (``at``) and cut into blocks."""
    distinct = (
        turns.select(_key().alias("key"), "turn", or_empty("role").alias("role"), or_empty("text").alias("text"), "copies")
        .groupBy("key", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
    )
    place = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
    firsts = (
        distinct.groupBy("key", "role", "text")
        .agg(F.min(place).alias("first"), F.count("*").alias("places"))
        .where("places > 1")
        .drop("places")
    )
    body = F.rtrim("text", F.lit(_SPACE))
    role = F.substring("role", 1, 1)
    known = distinct.join(firsts, ["key", "role", "text"], "left").select(
        "key",
        "turn",
        "role",
        "text",
        "copies",
        (body == "").alias("blank"),
        (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3).alias("initial"),
    )
    symbol = F.when(F.col("blank") | F.col("seen"), _DELETE_ONLY).otherwise(
        1 + 2 * F.col("initial") + F.col("cut").cast("int")
    )
    ordered = (
        known.withColumn("symbol", symbol)
        .repartitionByRange("key", "turn", "role", F.substring("text", 1, 64))
        .sortWithinPartitions("key", "turn", "role", "text")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("block", F.shiftright("at", block_bits))
    )
    return stored(ordered, "repair-rows")


def _matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for symbols, counts, initials in zip(frame.symbols, frame["counts"], frame.initials, strict=True):
            illegal = sum(pair not in _LEGAL for pair in zip(initials[:-1], initials[1:], strict=True))
            runs = tuple(_runs(symbols.tolist(), counts.tolist()))
            matrix = (_short_transition if len(runs) <= _SHORT else _transition)(runs)
            out.append((matrix.ravel(), illegal + int(sum(counts)) - len(counts), int(initials[0]), int(initials[-1])))
        matrix, illegal, first, last = zip(*out, strict=True) if out else ((), (), (), ())
        yield pd.DataFrame(
            {"key": frame.key, "block": frame.block, "matrix": list(matrix), "illegal": illegal, "first": first, "last": last}
        )


def _backwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs to go behind each block; rows arrive by conversation, last block first."""
    key, costs = None, _final()
    for frame in frames:
        behind, ends = [], []
        for mine, matrix in zip(frame.key, frame.matrix, strict=True):
            ends.append(mine != key)
            if mine != key:
                key, costs = mine, _final()
            behind.append(costs)
            costs = _applied(np.asarray(matrix, dtype=np.int64).reshape(4, 4), costs[None])[0]
        yield pd.DataFrame({"key": frame.key, "block": frame.block, "behind": behind, "ends": ends})


def _choices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        edits, exits = [], []
        for symbols, behind, ends in zip(frame.symbols, frame.behind, frame.ends, strict=True):
            unroll = _short_unrolled if len(symbols) <= _SHORT else _unrolled
            ways, states = unroll(tuple(symbols.tolist()), tuple((behind - behind.min()).tolist()))
            if ends:
                ways = [[*way[:-1], way[-1] + " " + _closing(state)] for way, state in zip(ways, states, strict=True)]
            edits.append(ways)
            exits.append(states)
        yield pd.DataFrame({"key": frame.key, "block": frame.block, "edits": edits, "exits": exits})


def _forwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which each block is entered; rows arrive by conversation, first block first."""
    key, state, before = None, _START, 0
    for frame in frames:
        entered, joints = [], []
        for mine, exits, first, last in zip(frame.key, frame.exits, frame["first"], frame["last"], strict=True):
            joints.append(int(mine == key and (before, first) not in _LEGAL))
            if mine != key:
                key, state = mine, _START
            entered.append(state)
            state, before = int(exits[state]), int(last)
        yield pd.DataFrame({"key": frame.key, "block": frame.block, "entered": entered, "joint": joints})


@dataclass(frozen=True)
class Repair:
    """``edits``: (conv_id, turn, role, text, copies, fault, at, edit), one row per distinct row of the input.

    ``edit`` lists the edits of the row: inserted turns before it, its own (the further copies are deleted), and
    behind a space those after the conversation's last row; ``I`` and ``R`` are followed by the initial of the role.
    ``at`` grows in the order of the rows. ``totals``: (conv_id, gaps, blank, duplicate, truncated, illegal).
    """

    edits: DataFrame
    totals: DataFrame


def repair(turns: DataFrame, *, block_bits: int = BLOCK_BITS) -> Repair:
    """Cheapest repair of rows (conv_id, turn, role, text, copies); ``copies`` may be left out."""
    if "copies" not in turns.columns:
        turns = turns.withColumn("copies", F.lit(1).cast("bigint"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = _symbols(turns, block_bits)
    segments = (
        rows.groupBy("key", "block")
        .agg(F.sort_array(F.collect_list(F.struct("at", "symbol", "copies", "initial"))).alias("rows"))
        .select(
            "key",
            "block",
            F.col("rows")[0]["at"].alias("start"),
            F.transform("rows", lambda row: row.symbol).alias("symbols"),
            F.transform("rows", lambda row: row.copies).alias("counts"),
            F.transform("rows", lambda row: row.initial).alias("initials"),
        )
    )
    segments = stored(segments, "repair-segments")
    chain = "key string, block bigint"
    blocks = stored(
        segments.mapInPandas(_matrices, f"{chain}, matrix array<bigint>, illegal bigint, first int, last int"), "repair-blocks"
    )
    behind = (
        blocks.select("key", "block", "matrix")
        .repartition("key")
        .sortWithinPartitions("key", F.col("block").desc())
        .mapInPandas(_backwards, f"{chain}, behind array<bigint>, ends boolean")
    )
    choices = stored(
        segments.join(behind, ["key", "block"])
        .select("key", "block", "symbols", "behind", "ends")
        .mapInPandas(_choices, f"{chain}, edits array<array<string>>, exits array<int>"),
        "repair-choices",
    )
    entered = stored(
        choices.select("key", "block", "exits")
        .join(blocks.select("key", "block", "first", "last"), ["key", "block"])
        .repartition("key")
        .sortWithinPartitions("key", "block")
        .mapInPandas(_forwards, f"{chain}, entered int, joint bigint"),
        "repair-entered",
    )
    taken = (
        choices.join(entered, ["key", "block"])
        .join(segments.select("key", "block", "start"), ["key", "block"])
        .select("key", "block", "start", F.element_at("edits", F.col("entered") + 1).alias("edits"))
    )
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("cut"), "truncated")
    edits = rows.join(taken, ["key", "block"]).select(
        "key", "turn", "role", "text", "copies", fault.alias("fault"), "at", F.get("edits", (F.col("at") - F.col("start")).cast("int")).alias("edit")
    )
    faults = rows.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("seen"), F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.count_if(~F.col("blank") & ~F.col("seen") & F.col("cut")).alias("truncated"),
    )
    pairs = (
        blocks.select("key", "illegal")
        .unionAll(entered.select("key", F.col("joint").alias("illegal")))
        .groupBy("key")
        .agg(F.sum("illegal").alias("illegal"))
    )
    totals = faults.join(pairs, "key").select(
        "key", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal"
    )
    return Repair(_named(edits, kind), _named(totals, kind))


def repaired_turns(found: Repair) -> DataFrame:
    """The turns after repair: (conv_id, at, step, role, text), in the order of (at, step)."""
    return found.edits.select(
        "conv_id", "at", F.posexplode(_lines()).alias("step", "line")
    ).select("conv_id", "at", "step", "line.role", "line.text")


def _lines() -> Column:
    """Array of (role, text) that a row of ``Repair.edits`` leaves."""
    marks = F.regexp_extract_all("edit", F.lit("([DK]|[IR][ua])"), F.lit(1))
    named = F.transform(
        F.filter(marks, lambda mark: mark != "D"),
        lambda mark: F.struct(
            F.when(mark == "K", F.col("role")).when(F.endswith(mark, F.lit("u")), "user").otherwise("assistant").alias("role"),
            F.when(F.startswith(mark, F.lit("I")), "").otherwise(F.col("text")).alias("text"),
        ),
    )
    return named


def _digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit, cost and hash per conversation; rows arrive by conversation, in order."""
    key, audit, cost, hashed, empty = None, [], 0, hashlib.sha256(), True
    names = ["key", "cost", "audit", "repaired_sha256"]
    for frame in frames:
        done = []
        for mine, marks, price, lines in zip(frame.key, frame.audit, frame.cost, frame.lines, strict=True):
            if mine != key:
                if key is not None:
                    done.append((key, cost, "".join(audit), hashed.hexdigest()))
                key, audit, cost, hashed, empty = mine, [], 0, hashlib.sha256(), True
            audit.append(marks)
            cost += int(price)
            for line in lines:
                hashed.update(line.encode() if empty else b"\n" + line.encode())
                empty = False
        yield pd.DataFrame(done, columns=names)
    if key is not None:
        yield pd.DataFrame([(key, cost, "".join(audit), hashed.hexdigest())], columns=names)


def digests(found: Repair) -> DataFrame:
    """(conv_id, cost, audit, repaired_sha256) per conversation that has rows."""
    kind = found.edits.schema["conv_id"].dataType.simpleString()
    own, closing = F.substring_index("edit", " ", 1), F.regexp_extract("edit", "(?s) (.*)", 1)
    marks = F.concat(own, F.repeat(F.lit("D"), (F.col("copies") - 1).cast("int")), closing)
    audit = F.regexp_replace(marks, "[ua]", "")
    of = lambda initial: F.length(audit) - F.length(F.replace(audit, F.lit(initial), F.lit("")))
    stays = (F.col("fault") == "truncated") & ~F.contains(own, F.lit("D"))
    cost = REROLE * of("R") + DELETE * of("D") + INSERT * of("I") + F.when(stays, TRUNCATED).otherwise(0)
    pieces = found.edits.select(
        _key().alias("key"),
        "at",
        audit.alias("audit"),
        cost.cast("bigint").alias("cost"),
        F.transform(_lines(), lambda line: F.concat(line.role, F.lit(":"), line.text)).alias("lines"),
    )
    streamed = (
        pieces.repartition("key")
        .sortWithinPartitions("key", "at")
        .mapInPandas(_digested, "key string, cost bigint, audit string, repaired_sha256 string")
    )
    return _named(streamed, kind)


def repair_report(conversations: DataFrame, *, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Damage, repair and report per original conversation; one without rows after damage has zeros and no audit."""
    found = repair(damaged(conversations), block_bits=block_bits)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    keys = conversations.select(_key().alias("key")).distinct()
    keyed = lambda df: df.withColumn("key", _key()).drop("conv_id")
    whole = keys.join(keyed(found.totals), "key", "left").join(keyed(digests(found)), "key", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return _named(
        whole.select(
            "key",
            *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in counts],
            or_empty("audit").alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        ),
        kind,
    )
