import random

import corpus_pipeline
from pyspark.sql import functions as F

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score string"


def test_pipeline_on_a_small_corpus(spark, tables):
    chance = random.Random(12)
    words = [f"word{at}" for at in range(300)]
    rows, labels = [], []
    for at in range(240):
        text = chance.choices(words, k=60)
        junk, vile = at % 4 == 1, at % 4 == 2
        if junk:
            text = [f"{word}!!!" for word in text]
        if vile:
            text[5:9] = ["vile", "rotten", "vile", "rotten"]
        rows.append((at, " ".join(text)))
        labels.append((at, int(not junk), int(vile)))
    passage = " ".join(chance.choices(words, k=15))
    rows += [(1000, rows[0][1]), (1001, rows[4][1] + " "), (1002, f"{rows[8][1]} {passage}"), (1003, None), (1004, "")]
    folder = tables(
        documents=(DOCUMENT, [(*row, "en", "s", 0, "r", "s") for row in rows]),
        labels=("doc_id bigint, quality int, toxic int", labels),
        benchmark=("item_id bigint, text string", [(1, passage), (2, None)]),
    )
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        docs = corpus_pipeline.stored(kept, name)
        counts.append(docs.count())
    ids = {row.doc_id for row in docs.collect()}
    clean = {at for at in range(240) if at % 4 in (0, 3)}
    assert ids - {1003, 1004} == clean and {1003} == ids & {1003, 1004}
    final = corpus_pipeline.run(spark, folder)
    assert {row.doc_id for row in final.where(F.col("round_trip")).collect()} == ids


def test_stages_of_empty_tables(spark, tables):
    folder = tables(
        documents=(DOCUMENT, []),
        labels=("doc_id bigint, quality int, toxic int", []),
        benchmark=("item_id bigint, text string", []),
    )
    assert corpus_pipeline.run(spark, folder).count() == 0
