from pyspark.sql import functions as F

from tokenloom.operators import collocate, occurrences, skew


def corpus(spark):
    lines = [(i, ["a", "b", f"r{i}", "a", "b", "c"][: 3 + i % 4]) for i in range(60)]
    return spark.createDataFrame(lines, "id bigint, terms array<string>").withColumn("token_basis", F.lit("lemma"))


def test_frequent_counts_are_those_of_the_whole_table(spark):
    documents = corpus(spark)
    every = collocate.gram_counts(documents, by=("token_basis",))
    found = collocate.frequent_counts(documents, by=("token_basis",), min_freq=4)
    wanted = every.filter("kind = '1' OR n >= 4")
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.select(*found.columns).collect()))
    assert every.count() > found.count()


def test_stored_counts_leave_rare_grams_out(spark):
    stored = collocate.stored_counts(corpus(spark), min_freq=4)
    assert stored.filter("kind <> '1' AND n < 4").isEmpty()


def test_bits_lose_no_key(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("_hash"))
    bits = skew.key_bits(rows.filter("id % 7 = 0"))
    kept = {r["id"] for r in skew.likely_in(rows, bits).collect()}
    assert {i for i in range(5000) if i % 7 == 0} <= kept
    assert len(kept) < 1000


def test_occurrences_of_many_grams_equal_those_of_few(spark, monkeypatch):
    documents = corpus(spark).withColumn(
        "term_tokens", F.transform("terms", lambda term, at: F.struct(at.alias("token_index")))
    )
    chosen = collocate.collocation_tables(documents, token_bases=("lemma",), min_freq=4)
    few = occurrences.occurrences(documents, chosen, sentence_key=["id"], selected_rows=chosen.count())
    many = occurrences.occurrences(documents, chosen, sentence_key=["id"])
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert "_words" not in many.columns and many.count() > 0
