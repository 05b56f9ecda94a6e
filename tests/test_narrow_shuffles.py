import contextlib
import io

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tokenloom.operators import collocate, embed, occurrences, skew
from tokenloom.plans import experiments
from tokenloom.sources.tables import run_table
from tokenloom.functions.naming import with_run_names

TOKEN = "array<struct<ID:string,FORM:string,LEMMA:string,UPOS:string,SEMCLASS:string,token_index:int>>"


def corpus(spark):
    lines = [(i, ["a", "b", f"r{i}", "a", "b", "c"][: 3 + i % 4]) for i in range(60)]
    return spark.createDataFrame(lines, "id bigint, terms array<string>").withColumn("token_basis", F.lit("lemma"))


def plan(rows):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        rows.explain()
    return text.getvalue()


def same(one, other):
    names = sorted(one.columns)
    return sorted(map(str, one.select(*names).collect())) == sorted(map(str, other.select(*names).collect()))


def test_only_pairs_are_counted_by_hash(spark, monkeypatch):
    documents, asked = corpus(spark), []
    bits = collocate.key_bits
    monkeypatch.setattr(collocate, "key_bits", lambda rows: asked.append(rows.count()) or bits(rows))
    found = collocate.frequent_counts(documents, min_freq=4)
    every = collocate.gram_counts(documents).filter("kind = '1' OR n >= 4")
    assert asked == [every.filter("kind IN ('2', 's')").count()]
    assert same(found, every)


def test_frequent_trigrams_with_a_null_word(spark):
    rows = [(i, ["a", None, "c", "d"]) for i in range(5)]
    documents = spark.createDataFrame(rows, "id bigint, terms array<string>")
    every = collocate.gram_counts(documents)
    found = collocate.frequent_counts(documents, min_freq=2)
    assert same(found.filter("kind = '3'"), every.filter("kind = '3'"))


def test_lookup_keys_travel_once(spark):
    facts = spark.range(400).select("id", F.when(F.col("id") % 50 > 0, F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9))).alias("word"))
    lookup = spark.createDataFrame([("hot", 10**6, 1)] + [(f"k{i}", 1, i) for i in range(7)], "word string, n bigint, value int")
    for how in ("left", "inner"):
        found = skew.lookup_join(facts, lookup, {"word": "word"}, weight="n", how=how)
        assert same(found, facts.join(lookup, "word", how))
        assert "_key_word" not in plan(found)


def parts(spark):
    tokens = [(run, place, at, f"L{at % 2}", (at + number) % 3) for number, run in enumerate(("r1", "r2", "r3")) for place in range(4) for at in range(5) if (place + at) % 4]
    schema = "run_id string, line int, token_index int, SEMCLASS string, cluster bigint"
    annotated = spark.createDataFrame(tokens, schema).withColumns({"FORM": F.lit("F"), "LEMMA": F.lit("l")})
    found = [("lemma", 2, "x y", place, place * 10 + at, [(at,), (at + 1,)], at) for place in range(4) for at in range(4)]
    schema = "token_basis string, ngram_size int, ngram string, line int, occurrence_id bigint, part_tokens array<struct<token_index:int>>, start int"
    return spark.createDataFrame(found, schema), annotated, spark.createDataFrame([("r1",), ("r2",), ("r4",)], "run_id string")


def test_matched_parts_only(spark):
    found, annotated, runs = parts(spark)
    settings = {"sentence_key": ["line"], "by": ["run_id"], "runs": runs}
    whole = occurrences.matched_parts(found, annotated, **settings)
    assert {row["run_id"] for row in whole.select("run_id").distinct().collect()} == {"r1", "r2", "r4"}
    assert same(occurrences.matched_parts(found, annotated, **settings, unmatched=False), whole.filter("matched"))


def test_exact_metrics_need_no_words(spark):
    found, annotated, runs = parts(spark)
    matched = occurrences.matched_parts(found, annotated, sentence_key=["line"], by=["run_id"], runs=runs)
    settings = {"sentence_key": ["line"], "by": ["run_id"]}
    narrow = occurrences.exact_metrics(occurrences.occurrence_matches(matched, **settings, carried=()), by=["run_id"])
    assert same(narrow, occurrences.exact_metrics(occurrences.occurrence_matches(matched, **settings), by=["run_id"]))
    assert "LEMMA" not in plan(narrow)


def test_cluster_experiment_stores_no_occurrences(spark, monkeypatch):
    words = [[(str(at + 1), form, form, "X", "A", at) for at, form in enumerate(["a", "b", "c"])] for _ in range(6)]
    rows = [("train", "f", index, tokens) for index, tokens in enumerate(words)]
    sentences = spark.createDataFrame(rows, f"split string, source_file string, sentence_index bigint, tokens {TOKEN}")
    sentences = sentences.withColumn("metadata", F.create_map().cast("map<string,string>"))
    annotated = sentences.select(F.lit("run_1").alias("run_id"), "split", "source_file", "sentence_index", F.inline("tokens"))
    annotated = annotated.withColumn("cluster", F.col("token_index").cast("bigint"))
    runs = with_run_names(run_table(spark, [{"algorithm": "kmeans", "n_clusters": 3}]))
    stored, store = [], experiments.materialize
    monkeypatch.setattr(experiments, "materialize", lambda df, name="table", **more: stored.append(name) or store(df, name, **more))
    found = experiments.collocation_cluster_experiment(sentences, annotated, runs, min_freq=5)
    assert "occurrences" not in stored
    assert found["overview"].first()["collocation_count"] == 1
    assert found["occurrences"].select("context_text").first()[0] == "a b c" and found["occurrences"].count() == 18


def test_features_are_written_small(spark, tmp_path):
    words = [[float((at * 7919 + i * 104729) % 10007) for i in range(16)] for at in range(200)]
    rows = spark.createDataFrame([(at, words[at * at % 200]) for at in range(5000)], "id bigint, embedding array<float>").coalesce(1)
    found = embed.write_features(rows, str(tmp_path / "features"), expected_rows=5000)
    assert same(found, rows)
    codecs = {pq.ParquetFile(file).metadata.row_group(0).column(0).compression for file in (tmp_path / "features").glob("*.parquet")}
    assert codecs == {"ZSTD"}
