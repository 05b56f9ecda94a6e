import random

import corpus_pipeline
from test_near_copies import shingles

from tokenloom.llm import simhash

WORDS = [f"word{at}" for at in range(4000)]


def likeness(a, b):
    return (len(a & b), len(a | b)) if a | b else (1, 1)


def edited(chance, words):
    """A copy with a block replaced, text appended, text cut off or single words changed, around a likeness of 0.8."""
    words, share = list(words), chance.uniform(0.05, 0.3)
    size = max(1, int(len(words) * share))
    kind = chance.choice("block more less words none".split())
    if kind == "block":
        at = chance.randrange(max(1, len(words) - size))
        words[at : at + size] = chance.choices(WORDS, k=size)
    elif kind == "more":
        words += chance.choices(WORDS, k=size)
    elif kind == "less":
        words = words[:-size]
    elif kind == "words":
        for _ in range(max(1, size // 6)):
            words[chance.randrange(len(words))] = chance.choice(WORDS)
    return words


def test_copies_are_those_of_brute_force(spark):
    chance = random.Random(21)
    texts = []
    for _ in range(60):
        base = chance.choices(WORDS, k=chance.choice((3, 6, 9, 14, 30, 60, 150, 400)))
        texts += [base, *(edited(chance, base) for _ in range(5))]
    line = chance.choices(WORDS, k=12)
    texts += [[*line, *chance.choices(WORDS, k=chance.choice((0, 1, 2, 3, 30)))] for _ in range(40)]
    texts = [" ".join(words) for words in texts] + [None, "", " "]
    sets = [shingles(text) for text in texts]
    parts = {at: 1 << at for at in range(len(texts))}
    near = sum(0.74 <= len(a & b) / max(1, len(a | b)) < 0.8 for at, a in enumerate(sets) for b in sets[:at])
    links = {(at, to) for at, a in enumerate(sets) for to in range(at) for o, u in [likeness(a, sets[to])] if 5 * o >= 4 * u}
    for at, to in links:  # groups as sets of bits
        both = parts[at] | parts[to]
        parts |= {one: both for one in range(len(texts)) if both >> one & 1}
    assert near > 30 and len(links) > 100
    found = simhash.loose_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    groups = {}
    for row in found.collect():
        groups.setdefault(row.copy_group, set()).add(row.row.doc_id)
    assert {frozenset(x) for x in groups.values()} == {
        frozenset(one for one in range(len(texts)) if part >> one & 1) for part in parts.values()
    }


def test_stage_joins_what_the_fingerprints_link(spark):
    chance = random.Random(5)
    phrase, tails = chance.choices(WORDS, k=11), [chance.choices(WORDS, k=25) for _ in range(3)]
    rows = [(at, " ".join(phrase * 60 + tail)) for at, tail in enumerate(tails)]  # repeats weigh in a fingerprint only
    words = chance.choices(WORDS, k=200)
    rows += [(10, " ".join(words)), (11, " ".join(words[:100] + chance.choices(WORDS, k=8) + words[108:]))]
    rows += [(20, " ".join(chance.choices(WORDS, k=200)))]
    documents = spark.createDataFrame([(*row, "clash") for row in rows], "doc_id bigint, text string, simhash string")
    prints = [simhash.fingerprint(text) & ((1 << 64) - 1) for _, text in rows]
    assert max((prints[0] ^ prints[at]).bit_count() for at in (1, 2)) <= 4 < (prints[3] ^ prints[4]).bit_count()
    assert len(shingles(rows[0][1]) & shingles(rows[1][1])) < 0.8 * len(shingles(rows[0][1]))
    kept = corpus_pipeline.keep_one_copy(spark, documents, "")
    assert kept.columns == documents.columns and sorted(row.doc_id for row in kept.collect()) == [0, 10, 20]
