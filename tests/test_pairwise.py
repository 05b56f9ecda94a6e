import numpy as np
import pandas as pd

from tokenloom.operators.pairwise import distances, least_trees, over_block_pairs

SCHEMA = "id bigint, vector array<double>"


def listing():
    """The ids of both sides; made anew, as tasks cannot import this file."""
    return lambda one, other, same: pd.DataFrame({"one": [one[0].tolist()], "other": [other[0].tolist()], "same": [same]})


def pairs(found):
    """How often each unordered pair of rows is met."""
    seen = {}
    for row in found.collect():
        for a in row["one"]:
            for b in row["other"]:
                if not row["same"] or a < b:
                    key = frozenset((a, b))
                    seen[key] = seen.get(key, 0) + 1
    return seen


def test_every_pair_once_and_no_more_groups_for_more_partitions(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(at, rng.normal(size=4).tolist()) for at in range(60)], SCHEMA)
    wanted = {frozenset((a, b)) for a in range(60) for b in range(a)}
    groups = {}
    for partitions in (2, 30):
        found = over_block_pairs(rows.repartition(partitions), listing(), "one array<bigint>, other array<bigint>, same boolean", block_bytes=20 * 32)
        seen = pairs(found)
        assert set(seen) == wanted and set(seen.values()) == {1}
        groups[partitions] = found.count()
    assert groups[30] <= 10 and groups[2] <= 15


def test_rows_wider_than_a_block_and_no_rows(spark):
    rows = spark.createDataFrame([(at, [float(at)] * 9) for at in range(5)], SCHEMA)
    schema = "one array<bigint>, other array<bigint>, same boolean"
    assert len(pairs(over_block_pairs(rows, listing(), schema, block_bytes=16))) == 10
    assert over_block_pairs(rows.limit(0), listing(), schema).count() == 0


def test_least_trees_hold_the_tree_of_all_pairs_and_little_else(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(0, 3, (90, 3)).astype(float)  # copies and many equal distances
    floors = rng.integers(0, 2, 90).astype(float)
    apart = np.maximum(distances(vectors, vectors, "euclidean"), np.maximum(floors[:, None], floors[None]))
    wanted, part = set(), list(range(90))
    for d, a, b in sorted((apart[a, b], a, b) for a in range(90) for b in range(a + 1, 90)):
        if part[a] != part[b]:
            wanted.add((a, b))
            part = [part[a] if at == part[b] else at for at in part]
    rows = spark.createDataFrame([(at, v.tolist(), float(f)) for at, (v, f) in enumerate(zip(vectors, floors, strict=True))], f"{SCHEMA}, core double")
    found = least_trees(rows.repartition(3), metric="euclidean", floor="core", block_bytes=20 * 24).collect()
    assert wanted <= {(row["a"], row["b"]) for row in found}
    assert all(row["d"] == apart[row["a"], row["b"]] for row in found)
    assert len(found) < 90 * 10  # of 4,005 pairs
