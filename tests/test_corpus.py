import math

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import collocate, embed, occurrences
from tokenloom.operators.tokens import sentence_terms
from tokenloom.plans import experiments
from tokenloom.sources.tables import run_table
from tokenloom.functions.naming import with_run_names

TOKEN = (
    "array<struct<ID:string,FORM:string,LEMMA:string,UPOS:string,SEMCLASS:string,token_index:int>>"
)


def documents(spark, *lists):
    return spark.createDataFrame([(i, list(terms)) for i, terms in enumerate(lists)], "id int, terms array<string>")


def corpus(spark, sentences):
    """Sentence table from lists of (form, lemma, upos, label)."""
    data = []
    for index, words in enumerate(sentences):
        tokens = [(str(i + 1), form, lemma, upos, label, i) for i, (form, lemma, upos, label) in enumerate(words)]
        data.append(("train", "f", index, f"s{index}", tokens))
    schema = f"split string, source_file string, sentence_index bigint, sentence_id string, tokens {TOKEN}"
    return spark.createDataFrame(data, schema).withColumn("metadata", F.create_map().cast("map<string,string>"))


def test_bigram_scores_by_hand(spark):
    docs = documents(spark, "ab", "ab", "ac", "xy", "xy", "xy")
    table = collocate.collocation_table(docs, ngram_size=2, min_freq=2).collect()
    assert [(r["ngram"], r["frequency"]) for r in table] == [("x y", 3), ("a b", 2)]
    assert [r["pmi"] for r in table] == pytest.approx([2.0, 2.0])
    ab = table[1]
    assert ab["raw_freq"] == pytest.approx(2 / 12)
    assert ab["student_t"] == pytest.approx((2 - 3 * 2 / 12) / math.sqrt(2))
    cells = [(2, 6 / 12), (1, 30 / 12), (0, 18 / 12), (9, 90 / 12)]
    assert ab["likelihood_ratio"] == pytest.approx(2 * sum(o * math.log(o / e) for o, e in cells if o))
    assert ab["chi_sq"] == pytest.approx(12 * (2 * 9 - 1 * 0) ** 2 / (3 * 2 * 10 * 9))


def test_trigram_scores_by_hand(spark):
    docs = documents(spark, "abc", "abc", "abd", "cab", "b")
    row = collocate.collocation_table(docs, ngram_size=3, min_freq=2).first()
    n, f = 13, 2
    c = {"a": 4, "b": 5, "c": 3}
    pairs = {"12": 4, "23": 2, "13": 2}
    assert (row["ngram"], row["frequency"]) == ("a b c", 2)
    assert row["pmi"] == pytest.approx(math.log2(f * n * n) - math.log2(c["a"] * c["b"] * c["c"]))
    iii, iio, oii, ioi = f, pairs["12"] - f, pairs["23"] - f, pairs["13"] - f
    ooi, oio, ioo = c["c"] - iii - oii - ioi, c["b"] - iii - oii - iio, c["a"] - iii - ioi - iio
    ooo = n - (iii + iio + oii + ioi + ooi + oio + ioo)
    seen = {(1, 1, 1): iii, (1, 1, 0): iio, (0, 1, 1): oii, (1, 0, 1): ioi, (0, 0, 1): ooi, (0, 1, 0): oio, (1, 0, 0): ioo, (0, 0, 0): ooo}
    due = {
        key: math.prod(c[w] if hit else n - c[w] for hit, w in zip(key, "abc", strict=True)) / n**2 for key in seen
    }
    assert row["chi_sq"] == pytest.approx(sum((seen[k] - due[k]) ** 2 / due[k] for k in seen))
    assert row["likelihood_ratio"] == pytest.approx(2 * sum(v * math.log(v / due[k]) for k, v in seen.items() if v))


def test_sentences_bound_the_grams_and_lemmas_join_forms(spark):
    docs = documents(spark, ["нью", "йорк"], ["сити", "холл"])
    found = {r["ngram"] for r in collocate.collocation_table(docs, ngram_size=2, min_freq=1).collect()}
    assert found == {"нью йорк", "сити холл"}
    sentences = corpus(
        spark,
        [
            [("Белые", "белый", "ADJ", "_"), (",", ",", "PUNCT", "_"), ("дома", "дом", "NOUN", "_")],
            [("белого", "белый", "ADJ", "_"), ("x", "_", "X", "_"), ("дома", "дом", "NOUN", "_")],
        ],
    )
    tables = collocate.collocation_tables(sentence_terms(sentences, bases=["lemma", "form"]), min_freq=2)
    assert [(r["table_name"], r["ngram"], r["frequency"]) for r in tables.collect()] == [("lemma_bigrams", "белый дом", 2)]


def test_settings_and_empty_results(spark):
    docs = documents(spark, "ab")
    for bad in ({"sort_by": "nope"}, {"min_freq": 0}, {"max_rows": 0}):
        with pytest.raises(ValueError):
            collocate.collocation_table(docs, ngram_size=2, **bad)
    with pytest.raises(ValueError):
        collocate.collocation_table(docs, ngram_size=4)
    empty = collocate.collocation_table(docs, ngram_size=2, min_freq=5)
    assert empty.columns[-5:] == collocate.MEASURES and empty.count() == 0


def danger_corpus(spark):
    first = [("Грозит", "грозить", "VERB", "ACTION"), ("смертельная", "смертельный", "ADJ", "QUALITY"), ("опасность", "опасность", "NOUN", "DANGER"), (".", ".", "PUNCT", "_")]
    second = [("Скорая", "скорый", "ADJ", "QUALITY"), ("помощь", "помощь", "NOUN", "HELP"), (".", ".", "PUNCT", "_")]
    return corpus(spark, [first] * 5 + [second] * 5)


def test_collocations_against_clusters(spark):
    sentences = danger_corpus(spark)
    rows = []
    for run, (long, short) in {"run_1": ([0, 0, 1], [2, 2]), "run_2": ([0, 1, 1], [2, 3])}.items():
        for index in range(10):
            for place, cluster in enumerate(long if index < 5 else short):
                rows.append((run, "train", "f", index, place, cluster))
    assigned = spark.createDataFrame(rows, "run_id string, split string, source_file string, sentence_index bigint, token_index int, cluster bigint")
    tokens = sentences.select("split", "source_file", "sentence_index", F.inline("tokens"))
    key = ["split", "source_file", "sentence_index", "token_index"]
    annotated = tokens.join(assigned, key)
    runs = with_run_names(run_table(spark, [{"algorithm": "kmeans", "n_clusters": 100}, {"algorithm": "kmeans", "n_clusters": 200}]))
    found = experiments.collocation_cluster_experiment(sentences, annotated, runs, min_freq=1)
    table = {(r["run_id"], r["collocation"]): r for r in found["collocations"].collect()}
    assert set(table) == {(run, gram) for run in ("run_1", "run_2") for gram in ("грозить смертельный опасность", "скорый помощь")}
    long = table[("run_1", "грозить смертельный опасность")]
    assert long["frequency"] == 5 and long["intersecting_cluster_count"] == 0
    assert long["part_1_semclasses"] == "dominant in collocation: ACTION\nall: ACTION"
    assert long["cluster_counts"] == "грозить: 1\nсмертельный: 1\nопасность: 1"
    assert table[("run_1", "скорый помощь")]["intersecting_cluster_count"] == 1
    assert table[("run_2", "скорый помощь")]["intersecting_cluster_count"] == 0
    assert table[("run_1", "скорый помощь")]["part_3"] == ""
    overview = {r["run_id"]: (r["run_label"], r["collocation_count"]) for r in found["overview"].collect()}
    assert overview == {"run_1": ("k100", 2), "run_2": ("k200", 2)}
    place = ["split", "source_file", "sentence_index"]
    matched = occurrences.matched_parts(found["occurrences"], annotated, sentence_key=place, by=["run_id"])
    exact = occurrences.exact_metrics(occurrences.occurrence_matches(matched, sentence_key=place, by=["run_id"]), by=["run_id"])
    rates = {(r["run_id"], r["ngram"]): r["exact_same_cluster_pair_rate"] for r in exact.collect()}
    assert rates[("run_1", "грозить смертельный опасность")] == pytest.approx(1 / 3)
    assert rates[("run_1", "скорый помощь")] == 1.0 and rates[("run_2", "скорый помощь")] == 0.0
    index = occurrences.occurrence_index(found["occurrences"], segment=2)
    assert index.filter("ngram = 'скорый помощь'").agg(F.sum(F.size("occurrence_ids"))).first()[0] == 5


def test_collocation_experiment_metadata(spark):
    found = experiments.collocation_experiment(danger_corpus(spark), min_freq=5)
    values = {r["key"]: r["value"] for r in found["metadata"].collect()}
    assert values["sentence_count"] == "10" and values["lemma_token_count"] == "25"
    assert values["lemma_bigrams_rows"] == "3" and values["lemma_trigrams_rows"] == "1"


SAME = [
    ("Идет", "MOVE", 0, [1.0, 0.0], 0),
    ("идет", "MOVE", 1, [1.0, 0.0], 1),
    ("идет", "RAIN", 2, [0.0, 1.0], 0),
    ("идет", "RAIN", 3, [0.0, 1.0], 0),
    ("дом", "BUILDING", 4, [0.0, 1.0], 2),
]


def test_same_form_similarity(spark):
    rows = spark.createDataFrame(SAME, "FORM string, SEMCLASS string, sentence_index int, embedding array<float>, cluster int")
    annotated = rows.drop("embedding").withColumn("run_id", F.lit("run_1"))
    vectors = rows.select("sentence_index", "FORM", "SEMCLASS", "embedding")
    found = experiments.similarity_experiment(vectors, annotated, key=["sentence_index"])
    form = found["forms"].first()
    assert found["forms"].count() == 1 and form["form_lower"] == "идет"
    assert (form["diff_semclass_pair_count"], form["diff_semclass_mean_cosine"], form["diff_semclass_same_cluster_rate"]) == (4, 0.0, 0.5)
    assert (form["same_semclass_pair_count"], form["same_semclass_mean_cosine"], form["same_semclass_different_cluster_rate"]) == (2, 1.0, 0.5)
    assert form["same_minus_diff_cosine"] == 1.0
    pair = found["classpairs"].first()
    assert (pair["semclass_a"], pair["semclass_b"], pair["pair_count"], pair["same_cluster_pair_count"]) == ("MOVE", "RAIN", 4, 2)
    assert [(r["semclass"], r["different_cluster_rate"]) for r in found["within"].collect()] == [("MOVE", 1.0), ("RAIN", 0.0)]
    overview = found["overview"].first()
    assert overview["ambiguous_form_count"] == 1 and overview["same_minus_diff_cosine"] == 1.0
    changed = annotated.withColumn("FORM", F.when(F.col("sentence_index") == 0, F.lit("иная")).otherwise(F.col("FORM")))
    with pytest.raises(ValueError, match="FORM"):
        experiments.similarity_experiment(vectors, changed, key=["sentence_index"])


def test_embedding_pools_pieces(spark):
    def factory():
        import numpy as np

        known = {"кошка": [1.0, 0.0], "кот": [1.0, 0.0], "банк": [0.0, 1.0], "деньги": [0.0, 1.0]}

        def run(contexts):
            out = []
            for words in contexts:
                rows = [(known.get(word, [0.5, 0.5]), i) for i, word in enumerate(words)]
                rows += [([0.0, 0.0], i) for i, word in enumerate(words) if word == "кот"]
                out.append((np.array([r for r, _ in rows]), [i for _, i in rows]))
            return out

        return run

    contexts = spark.createDataFrame(
        [(0, ["кошка", ",", "кот"], [0, 2]), (1, ["банк"], [0])], "doc int, tokens array<string>, target_indices array<int>"
    )
    found = {(r["doc"], r["word_index"]): r["embedding"] for r in embed.embed_contexts(contexts, factory, passed=["doc"]).collect()}
    assert found == {(0, 0): [1.0, 0.0], (0, 2): [0.5, 0.0], (1, 0): [0.0, 1.0]}
    sentences = danger_corpus(spark)
    vectors = embed.embed_sentences(sentences, embed.hash_embedder())
    assert vectors.count() == 25 and {len(r["embedding"]) for r in vectors.select("embedding").collect()} == {16}
    assert vectors.filter("sentence_index = 0").first()["embedding_context_text"] == "Грозит смертельная опасность ."


def test_projection(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(7)], "id int, embedding array<double>")
    reduced = embed.reduce_vectors(rows, 2).collect()
    assert all(len(r["embedding"]) == 2 and math.isclose(math.hypot(*r["embedding"]), 1.0, rel_tol=1e-9) for r in reduced)
    with pytest.raises(ValueError, match="n_components"):
        embed.reduce_vectors(rows, 9)
    merged = embed.merge_vectors({"a": rows, "b": rows}, key=["id"])
    assert merged.count() == 14
    with pytest.raises(ValueError):
        embed.merge_vectors({"a": rows, "b": rows.drop("embedding")}, key=["id"])


def test_embedding_does_not_depend_on_batches(spark):
    """Rows without targets, targets out of order and batches of any size give the same vectors."""
    rows = [(0, ["abcde", "x", "fghij"], [2, 0]), (1, ["y"], []), (2, ["abcde"], [0])]
    contexts = spark.createDataFrame(rows, "doc int, tokens array<string>, target_indices array<int>")
    found = [
        {
            (r["doc"], r["word_index"]): r["embedding"]
            for r in embed.embed_contexts(contexts, embed.hash_embedder(), passed=["doc"], batch_size=size).collect()
        }
        for size in (1, 64)
    ]
    assert found[0] == found[1]
    assert set(found[0]) == {(0, 0), (0, 2), (2, 0)} and found[0][0, 0] == found[0][2, 0] != found[0][0, 2]
    lost = contexts.withColumn("tokens", F.transform("tokens", lambda _: F.lit("")))
    with pytest.raises(Exception, match="no pieces left for target token '' at word index"):
        embed.embed_contexts(lost, embed.hash_embedder(), passed=["doc"]).collect()
