import random

import numpy as np
import xxhash

from tokenloom.llm import fingerprints, simhash

SCHEMA = "doc_id bigint, text string, simhash string, node int, component_id string"
WORDS = [f"word{at}" for at in range(900)] + ["Été", "STRASSE", "x"]


def some_documents(count=120, seed=3):
    chance = random.Random(seed)
    texts = []
    for _ in range(count):
        words = chance.choices(WORDS, k=chance.choice((0, 1, 3, 4, 5, 40, 200)))
        if texts and chance.random() < 0.5:
            words = (texts[chance.randrange(len(texts))] or "").split()
            for _ in range(chance.randint(0, 2)):
                if words:
                    words[chance.randrange(len(words))] = chance.choice(WORDS)
        texts.append(chance.choice((" ", "\n", "\t ")).join(words))
    texts += [None, "", " \t\n", texts[-1], "The THE the the the"]
    return [(at, text, "clash", 1, "clash") for at, text in enumerate(texts)]


def brute_fingerprint(text):
    lowered = "".join(chr(ord(char) + 32) if "A" <= char <= "Z" else char for char in text or "")
    words = [word for word in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if word]
    if not words:
        return 0
    shingles = [" ".join(words[at : at + 4]) for at in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in hashes) > len(hashes))


def brute_components(prints, radius=4):
    ids, parent = sorted(prints), {at: at for at in prints}

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    for at in ids:
        for other in ids:
            if at < other and (prints[at] ^ prints[other]).bit_count() <= radius:
                a, b = sorted((root(at), root(other)))
                parent[b] = a
    return {at: root(at) for at in ids}


def test_simhash_against_brute_force(spark):
    rows = some_documents()
    found = simhash.near_copies(spark.createDataFrame(rows, SCHEMA))
    found = {row.doc_id: row for row in found.select("doc_id", simhash.fingerprint_text().alias("f"), "component_id").collect()}
    prints = {row[0]: brute_fingerprint(row[1]) for row in rows}
    assert {at: int(row.f, 16) for at, row in found.items()} == prints
    assert {at: row.component_id for at, row in found.items()} == brute_components(prints)


def test_range_join_finds_every_link(spark):
    generator = np.random.default_rng(5)
    base = generator.integers(-(1 << 62), 1 << 62, 12)
    values = set()
    for value in base.tolist():
        for _ in range(25):
            changed = value
            for bit in generator.choice(63, generator.integers(0, 7), replace=False).tolist():
                changed ^= 1 << bit
            values.add(changed)
    nodes = spark.createDataFrame([(value, value) for value in values], "simhash bigint, component bigint")
    links = {tuple(row) for row in simhash._range_join(nodes, 4).collect()}
    every = sorted(values)
    brute = {
        (a, b) for at, a in enumerate(every) for b in every[at + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    }
    assert links == brute and len(brute) > 100


def test_connected_follows_a_long_path(spark):
    links = spark.range(2100).selectExpr("(id * 7919) % 2100 AS x").selectExpr("x AS a", "x + 1 AS b")
    found = simhash.connected(links)
    assert found.count() == 2101 and [tuple(row) for row in found.select("component").distinct().collect()] == [(0,)]


def test_keep_one_of_each_group(spark):
    chance = random.Random(1)
    base = [" ".join(chance.choices(WORDS, k=150)) for _ in range(30)]
    rows = [(at, text) for at, text in enumerate(base)]
    rows += [(100 + at, text) for at, text in enumerate(base[:5])]  # equal
    for at, text in enumerate(base[5:10]):  # one word of 150 changed: 290 of 302 shingles stay
        words = text.split()
        words[70] = "changed"
        rows.append((200 + at, " ".join(words)))
    rows += [(300, None), (301, ""), (None, " "), (0, base[0])]
    documents = spark.createDataFrame([(*row, "s", 5) for row in rows], "doc_id bigint, text string, node string, copy_group int")
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(row.doc_id for row in kept.collect()) == [*range(30), 300]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_copies(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    assert fingerprints.edited_fingerprints(empty).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_estimate_likeness(spark):
    rows = some_documents(150, seed=8)
    found = {row.doc_id: row for row in fingerprints.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    texts = [row[1] or "" for row in rows]
    gaps, seen = [], {}
    for at, text in enumerate(texts):
        after, moved, row = texts[(at + 1) % len(texts)], len(text) // 4, found[at]
        edited = text[: len(text) - moved] + after[:moved]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == __import__("hashlib").sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, row.fingerprint) == row.fingerprint
        assert seen.setdefault(edited, row.edited_fingerprint) == row.edited_fingerprint
        for near, other in ((row.near_edited, edited), (row.near_next, after)):
            a, b = shingles(text), shingles(other)
            assert 0 <= near <= 1
            if text == other:
                assert near == 1
            gaps.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.sqrt(np.mean(np.square(gaps))) < 0.06 and abs(np.mean(gaps)) < 0.02


def test_next_document_wraps_and_orders_nulls_first(spark):
    rows = [(5, "five"), (None, "none"), (9, "nine"), (7, "seven"), (7, "seven")]
    found = fingerprints.with_next(spark.createDataFrame(rows, "doc_id bigint, text string"), ["text"], buckets=3)
    after = sorted((row.doc_id if row.doc_id is not None else -1, row.next_text) for row in found.collect())
    assert after == [(-1, "five"), (5, "seven"), (7, "nine"), (7, "seven"), (9, "none")]
