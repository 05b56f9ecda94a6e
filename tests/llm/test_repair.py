import collections
import hashlib
import random
import re
import zlib

import pytest

from tokenloom.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, at int"
LEGAL = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows, faults):
    """(cost, audit, lines) by a table over every row and state, with whole audits compared."""
    best = {}
    for at in range(len(rows), -1, -1):
        here = {}
        for state in LEGAL:
            if at == len(rows):
                here[state] = [(0, "", ())] if state in ("", "a") else []
                continue
            _, role, text = rows[at]
            extra = 5 if faults[at] == "truncated" else 0
            cost, audit, lines = best[at + 1][state]
            here[state] = [(2 + cost, "D" + audit, lines)]
            if faults[at] in ("blank", "duplicate"):
                continue
            ways = [("K", 0, role[:1], role)] + [("R", 1, k, FULL[k]) for k in "ua"]
            for mark, price, initial, said in ways:
                if initial in LEGAL[state]:
                    cost, audit, lines = best[at + 1][LEGAL[state][initial]]
                    here[state].append((price + extra + cost, mark + audit, (f"{said}:{text}", *lines)))
        for _ in range(4):
            grown = {state: list(ways) for state, ways in here.items()}
            for state in here:
                for k in "ua":
                    if k in LEGAL[state]:
                        grown[state] += [(5 + c, "I" + a, (FULL[k] + ":", *lines)) for c, a, lines in here[k]]
            here = {state: [min(ways)] if ways else [] for state, ways in grown.items()}
        best[at] = {state: ways[0] for state, ways in here.items()}
    return best[0][""]


def brute(rows):
    kept = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        mine = kept[conv]
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        row = (turn, "user" if harm == 4 else role, text)
        mine += [row] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = {}
    for conv, mine in kept.items():
        mine.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()))
        seen, faults = set(), []
        for _, role, text in mine:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            cut = "truncated" if body and body[-1] not in ".!?" else ""
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else cut)
            seen.add((role, text))
        turns = [turn for turn, _, _ in mine if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(mine, faults)
        counts = collections.Counter(faults)
        hashed = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashed)
    return out


def some_rows(seed=1):
    chance = random.Random(seed)
    roles = ["user", "assistant"] * 2 + ["system", "tool", None, ""]
    texts = ["a.", "b!", "c?", "cut", "", " \t", "x y", "é…", "q.  ", None]
    rows = []
    for conv in [*range(50), None]:
        for _ in range(chance.randint(1, 30 if conv else 90)):
            turn = None if chance.random() < 0.05 else chance.randint(0, 40)
            rows.append((conv, turn, chance.choice(roles), chance.choice(texts)))
    rows += [(77, 0, None, None), (2**53 + 1, 1, "user", "a."), (2**53 + 2, 1, "user", "a."), (-5, 3, "assistant", "a.")]
    rows += [(99, turn, "user", f"m{turn}.") for turn in range(300)] + [(98, 1, "user", "same.")] * 50
    return rows


def report(spark, rows, **options):
    frame = spark.createDataFrame([(*row, "clash", 1) for row in rows], SCHEMA)
    return {row[0]: tuple(row[1:]) for row in repair.repair_report(frame, **options).collect()}


@pytest.mark.parametrize("block_bits", [12, 2])
def test_repair_against_brute_force(spark, block_bits):
    rows = some_rows()
    expected = brute(rows)
    assert report(spark, rows, block_bits=block_bits) == expected
    assert {"D", "K", "R"} <= set("".join(row[6] for row in expected.values()))


def test_repaired_turns_alternate(spark):
    turns = [(1, 0, "system", "s."), (1, 1, "assistant", "hello."), (1, 2, "user", "q?"), (1, 3, "user", ""), (1, 4, "tool", "cut")]
    frame = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    found = repair.repair(frame)
    rows = repair.repaired_turns(found).orderBy("at", "step").collect()
    assert [(row.role, row.text) for row in rows] == [("system", "s."), ("user", "hello."), ("assistant", "q?")]
    assert [row.edit for row in found.edits.orderBy("at").collect()] == ["K", "Ru", "Ra", "D", "D "]


def test_long_runs_take_binary_powers():
    symbols = [3] * 1000 + [0] * 37 + [5] * 3
    runs = tuple(repair._runs(symbols, [1] * len(symbols)))
    assert runs == ((3, 1000), (0, 37), (5, 3))
    one_by_one = repair._unit()
    for symbol in symbols:
        one_by_one = repair._times(one_by_one, repair._power(symbol, 0))
    assert (repair._transition(runs) == one_by_one).all()


def test_cheap_inserts(monkeypatch):
    monkeypatch.setattr(repair, "INSERT", 1)
    repair._power.cache_clear()
    edits, ends = repair._unrolled((5, 3), tuple(repair._final().tolist()))
    assert edits[0] == ["IuK", "K"] and repair._closing(ends[0]) == "Ia"
    repair._power.cache_clear()


def test_repair_of_nothing(spark):
    assert report(spark, []) == {}
    gone = next(conv for conv in range(1000) if zlib.crc32(f"{conv}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert report(spark, [(gone, 0, "user", "x.")]) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
