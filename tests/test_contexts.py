import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.text import casefold, is_word, tokenize
from tokenloom.operators.contexts import (
    check_target_count,
    chunk_raw_text,
    first_documents,
    split_by_pieces,
    take_target_budget,
)
from tokenloom.operators.skew import lookup_join, running_total


def test_tokens_and_words(spark):
    row = spark.range(1).select(
        tokenize(F.lit("Кошка спит, банк-онлайн открыт. a_b ½")).alias("t"), casefold(F.lit("STRASSE Straße ΟΔΟΣ")).alias("c")
    ).first()
    assert row["t"] == ["Кошка", "спит", ",", "банк-онлайн", "открыт", ".", "a", "b", "½"]
    assert row["c"] == "strasse strasse οδοσ"
    flags = spark.range(1).select(F.transform(tokenize(F.lit("Кошка спит, банк-онлайн .")), is_word).alias("f")).first()["f"]
    assert flags == [True, True, False, True, False]


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, text string")


def test_budget_trims_the_last_chunk(spark):
    documents = texts(spark, "кошка спит. банк открыт.", "кот играет. деньги лежат.")
    chunks = chunk_raw_text(documents, document_index="id", max_context_word_tokens=2)
    kept = take_target_budget(chunks, 5).orderBy("document_index", "chunk_index").collect()
    assert sum(len(r["target_indices"]) for r in kept) == 5
    assert kept[-1]["tokens"] == ["кот"]
    with pytest.raises(ValueError, match="no word-like"):
        take_target_budget(chunk_raw_text(texts(spark, "", "... !"), document_index="id"), 5)


def fold(tokens, max_tokens, max_words):
    """Chunks by direct reading of the rule, to compare with."""
    chunks, current, words = [], [], 0
    for token in tokens:
        word = any(ch.isalnum() for ch in token)
        if current and (len(current) >= max_tokens or (word and words >= max_words)):
            chunks.append(current)
            current, words = [], 0
        current.append(token)
        words += word
    return [*chunks, current] if current else chunks


def test_chunks_match_the_rule_on_random_texts(spark):
    rng = random.Random(5)
    values = [" ".join(rng.choice(["a", "bb", ",", ".", "!"]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    found = chunk_raw_text(texts(spark, *values), document_index="id", max_context_tokens=7, max_context_word_tokens=4)
    got = {(r["document_index"], r["chunk_index"]): r["tokens"] for r in found.collect()}
    expected = {
        (index, place): chunk
        for index, value in enumerate(values)
        for place, chunk in enumerate(fold(value.split(), 7, 4))
        if any(token.isalnum() for token in chunk)
    }
    assert got == expected


def test_budget_is_exact_on_random_chunks(spark):
    rng = random.Random(6)
    values = [" ".join("w" for _ in range(rng.randrange(0, 30))) for _ in range(50)]
    chunks = chunk_raw_text(texts(spark, *values), document_index="id", max_context_word_tokens=3)
    total = sum(value.count("w") for value in values)
    for budget in (1, 2, total // 2, total, total + 10):
        kept = take_target_budget(chunks, budget)
        assert kept.agg(F.sum(F.size("target_indices"))).first()[0] == min(budget, total)


def test_piece_safe_split(spark):
    lengths = {"кошка": 1, "длинный": 4, "банк": 1, "кот": 1}
    chunks = spark.createDataFrame(
        [(0, 0, ["кошка", "длинный", "банк", "кот"], [0, 1, 2, 3])],
        "document_index bigint, chunk_index bigint, tokens array<string>, target_indices array<int>",
    )
    pieces = lambda words: [lengths.get(word, 9) for word in words]
    parts = split_by_pieces(chunks, pieces, max_length=6, special_tokens=2)
    assert [r["tokens"] for r in parts.orderBy("part_index").collect()] == [["кошка"], ["длинный"], ["банк", "кот"]]
    check_target_count(chunks, parts)
    with pytest.raises(Exception, match="budget of 2"):
        split_by_pieces(chunks, pieces, max_length=4, special_tokens=2).collect()
    mixed = chunks.withColumns({"tokens": F.array(*map(F.lit, ["кошка", "~~~~", "банк"])), "target_indices": F.array(F.lit(0), F.lit(2))})
    split = split_by_pieces(mixed, pieces, max_length=6, special_tokens=2).orderBy("part_index").collect()
    assert [r["tokens"] for r in split] == [["кошка"], ["банк"]]


def test_split_against_filling_by_hand(spark):
    chance = random.Random(3)
    rows = [
        (at, 0, [f"t{at}_{i}" for i in range(n)], sorted(chance.sample(range(n), min(n, 3))))
        for at, n in enumerate([1, 2, 5, 9, 30, 30, 30])
    ]
    sizes = {token: chance.choice((1, 1, 2, 3)) for _, _, tokens, _ in rows for token in tokens}
    for _, _, tokens, targets in rows:
        for i, token in enumerate(tokens):
            if i not in targets and chance.random() < 0.15:
                sizes[token] = chance.choice((0, 9))
    frame = spark.createDataFrame(
        rows, "document_index bigint, chunk_index bigint, tokens array<string>, target_indices array<int>"
    )
    found = split_by_pieces(frame, lambda words: [sizes[word] for word in words], max_length=7, special_tokens=2)
    got = sorted((r.document_index, r.part_index, r.tokens, r.target_indices) for r in found.collect())
    wanted = []
    for at, _, tokens, targets in rows:
        whole = sum(sizes[token] for token in tokens) <= 5
        parts, room = [[]], 5
        for i, token in enumerate(tokens):
            if not whole and sizes[token] > 5:
                parts, room = [*parts, []], 5
            elif not whole and sizes[token] > room:
                parts, room = [*parts, [i]], 5 - sizes[token]
            else:
                parts[-1].append(i)
                room -= sizes[token]
        kept = [part for part in parts if set(part) & set(targets)]
        wanted += [
            (at, number, [tokens[i] for i in part], [part.index(i) for i in targets if i in part])
            for number, part in enumerate(kept)
        ]
    assert got == sorted(wanted)


def test_first_documents_count_blank_ones(spark):
    documents = texts(spark, "a", "", "b", "c")
    assert {r["id"] for r in first_documents(documents, ["id"], 3).collect()} == {0, 1, 2}


def test_running_total_and_lookup_join_with_a_hot_key(spark):
    rows = spark.range(3000).withColumn("key", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")))
    totals = {r["id"]: r["running_total"] for r in running_total(rows, F.col("id"), ["id"]).collect()}
    assert totals == {n: n * (n - 1) // 2 for n in range(3000)}
    lookup = rows.groupBy("key").agg(F.count("*").alias("n")).filter("key % 5 <> 4")
    found = lookup_join(rows, lookup, {"key": "key"}, weight="n")
    counts = {r["key"]: r["n"] for r in lookup.collect()}
    assert found.count() == 3000
    assert all(r["n"] == counts.get(r["key"]) for r in found.collect())
    inner = lookup_join(rows, lookup, {"key": "key"}, weight="n", how="inner")
    assert inner.count() == sum(counts.values())
    small = lookup_join(rows, lookup, {"key": "key"}, weight="n", how="inner", lookup_rows=lookup.count())
    assert small.count() == sum(counts.values())


def test_sentences_and_chunks_are_numbered_in_one_pass(spark, monkeypatch):
    from tokenloom.operators import contexts, skew

    stored = []
    keep = skew.materialize
    monkeypatch.setattr(skew, "materialize", lambda df, name="table", **how: stored.append(df.columns) or keep(df, name, **how))
    token = "struct<ID:string,FORM:string,LEMMA:string,UPOS:string,SEMCLASS:string>"
    words = lambda n, kind: [("1", f"w{i}", f"l{i}", kind, "wide") for i in range(n)]
    given = [(3, words(5, "X")), (1, words(2, "PUNCT")), (2, []), (0, words(3, "X"))]
    sentences = spark.createDataFrame(given, f"at bigint, tokens array<{token}>")
    found = contexts.chunk_sentences(sentences, order=["at"], max_context_tokens=2, max_context_word_tokens=2)
    rows = sorted((r["document_index"], r["chunk_index"], r["tokens"], r["target_indices"], r["lemmas"]) for r in found.collect())
    assert [row[:2] for row in rows] == [(0, 0), (0, 1), (2, 2), (2, 3), (2, 4)]
    assert rows[1] == (0, 1, ["w2"], [0], ["l2"]) and rows[3] == (2, 3, ["w2", "w3"], [0, 1], ["l2", "l3"])
    assert len(stored) == 1 and "_kept" not in stored[0]
