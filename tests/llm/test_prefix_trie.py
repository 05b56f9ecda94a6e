import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tokenloom.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest int, place string"


def brute(rows):
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {conv: [row[2:] for row in sorted(turns)] for conv, turns in found.items()}
    paths = {}
    for conv, turns in own.items():
        first = zlib.crc32(str(conv).encode()) % 9
        donor = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        paths[conv] = tuple(own.get(donor, [])[:first] + turns[first:])
    members = collections.defaultdict(list)
    for conv, path in paths.items():
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv)
    children = collections.Counter(node[:-1] for node in members if node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, convs in members.items():
        for depth in range(len(node) + 1):
            saved[node[:depth]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:depth]] += node not in children
    rows = []
    for node, convs in members.items():
        ends = ",".join(str(conv) for conv in sorted(convs) if paths[conv] == node)
        above = min(members[node[:-1]]) if node else None
        sums = (len(convs), children[node], leaves[node], saved[node])
        rows.append((min(convs), len(node), above, *sums, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def some_rows(seed=1):
    chance = random.Random(seed)
    rows = []
    for conv in [*range(-7, 90), *range(10**17, 10**17 + 12), None]:
        for _ in range(chance.randint(1, 14) if conv not in (20, 35) else 0):
            turn = None if chance.random() < 0.05 else chance.randint(0, 12)
            rows.append((conv, turn, chance.choice(["user", "assistant", None]), chance.choice(["a", "b", "é", None, ""])))
    return rows + [(200 + copy, turn, "user", f"m{turn}") for copy in range(60) for turn in range(6)]


def trie(spark, rows, **options):
    frame = spark.createDataFrame([(*row, 1, "clash") for row in rows], SCHEMA)
    turns = prefix_trie.rebuilt(prefix_trie.numbered_turns(frame))
    return sorted((tuple(row) for row in prefix_trie.prefix_trie(turns, **options).collect()), key=str)


@pytest.mark.parametrize("shard_rows", [1 << 16, 40, 1])
def test_trie_against_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(prefix_trie.math, "isqrt", lambda total: 1)
    rows = some_rows()
    assert trie(spark, rows, shard_rows=shard_rows) == brute(rows)


def test_trie_of_nothing(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "a")]) == []


def test_node_table():
    generator = np.random.default_rng(3)
    keys = np.unique(generator.integers(0, 1 << 62, (5000, 2)).astype(np.uint64), axis=0)
    table = prefix_trie.NodeTable(keys[:4000])
    assert sorted(table.find(keys[:4000])) == list(range(4000))
    assert (table.find(keys[4000:]) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.NodeTable(keys[[0, 1, 0]])
    assert len(prefix_trie.NodeTable(keys[:0]).find(keys[:3])) == 3
