import pytest
from pyspark.sql import functions as F

from tokenloom.operators.contexts import chunk_sentences
from tokenloom.operators.tokens import context_text, explode_sentences, keep_tokens, sentence_text
from tokenloom.sources.annotated import read_corpus, read_sentences, read_short_corpus, write_annotated
from tokenloom.sources.tables import read_artifact, read_hierarchy, run_table, seeded_order, unique_labels, write_artifact

ROWS = [
    ["1", "А", "а", "NOUN", "Noun", "_", "0", "root", "0:root", "_", "Object", "LETTER"],
    ["2", ",", ",", "PUNCT", "PUNCT", "_", "1", "punct", "1:punct", "_", "_", "_"],
    ["2.1", "#NULL", "быть", "VERB", "Verb", "_", "_", "_", "0:root", "ellipsis", "Predicate", "BE"],
    ["3", "тест", "тест", "NOUN", "Noun", "_", "1", "conj", "1:conj", "SpaceAfter=No", "Object", "EVENT"],
    ["4", ".", ".", "PUNCT", "PUNCT", "_", "1", "punct", "1:punct", "_", "_", "_"],
]
BLOCK = "# sent_id = s1\n# text = А, тест.\n" + "\n".join("\t".join(row) for row in ROWS) + "\n"


def write(path, text, **options):
    with open(path, "w", encoding=options.get("encoding", "utf-8"), newline="") as handle:
        handle.write(text)
    return str(path)


def test_parse_flags_and_texts(spark, tmp_path):
    path = write(tmp_path / "a.conllu", BLOCK, encoding="utf-8-sig")
    sentences = read_sentences(spark, [("train", path)])
    row = sentences.select(
        sentence_text(sentences).alias("text"), context_text(sentences, include_punctuation=False).alias("targets")
    ).first()
    assert (row["text"], row["targets"]) == ("А, тест.", "А тест")
    tokens = explode_sentences(sentences)
    assert tokens.count() == 5
    assert [r["FORM"] for r in keep_tokens(tokens, include_punctuation=True).orderBy("token_index").collect()] == [
        "А",
        ",",
        "тест",
        ".",
    ]
    assert [r["FORM"] for r in keep_tokens(tokens).orderBy("token_index").collect()] == ["А", "тест"]
    empty = tokens.filter("is_empty_node").collect()
    assert [(r["ID"], r["SEMCLASS"]) for r in empty] == [("2.1", "BE")]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_sentence_numbers_over_blank_runs_and_line_endings(spark, tmp_path, ending):
    short = "\t".join(ROWS[0])
    text = f"\n\n{BLOCK}\n\n\n# newpar\n\n{short}\n   \n".replace("   \n", "") + "\n# sent_id = last\n# sent_id = z\n" + short
    path = write(tmp_path / "b.conllu", text.replace("\n", ending))
    found = read_sentences(spark, [("dev", path)]).orderBy("sentence_index").collect()
    # A block of comments alone is a sentence without tokens and takes a number.
    assert [(r["sentence_index"], r["sentence_id"], len(r["tokens"])) for r in found] == [
        (0, "s1", 5),
        (1, None, 0),
        (2, None, 1),
        (3, "z", 1),
    ]


def test_wrong_column_count_is_an_error(spark, tmp_path):
    path = write(tmp_path / "bad.conllu", "1\ttoo\tfew\n")
    with pytest.raises(Exception, match="expected 12 columns"):
        read_sentences(spark, [("train", path)]).collect()
    blank = write(tmp_path / "blank.conllu", "\t".join(ROWS[0]) + "\n  \n")
    with pytest.raises(Exception, match="expected 12 columns"):
        read_sentences(spark, [("train", blank)]).collect()


def test_splits_keep_their_order(spark, tmp_path):
    for name in ("train", "dev"):
        write(tmp_path / f"{name}.conllu", BLOCK + "\n" + BLOCK)
    found = read_corpus(spark, str(tmp_path)).orderBy("split_index", "sentence_index").collect()
    assert [(r["split"], r["sentence_index"]) for r in found] == [("train", 0), ("train", 1), ("dev", 0), ("dev", 1)]


def test_small_file_blocks_number_sentences_the_same(spark, tmp_path):
    text = "\n".join(f"# sent_id = s{i}\n" + "\t".join(ROWS[i % 5]) + "\n" for i in range(400))
    path = write(tmp_path / "many.conllu", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        frame = read_sentences(spark, [("x", path)], line_ending="lf")
        found = frame.orderBy("sentence_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["sentence_index"], r["sentence_id"]) for r in found] == [(i, f"s{i}") for i in range(400)]


def test_ten_column_files_and_their_chunks(spark, tmp_path):
    def ud(*cells):
        return "\t".join([*cells, *["_"] * (10 - len(cells))])

    first = [
        ud("1", "Кошка", "кошка", "NOUN"), ud("2", "спит", "спать", "VERB"), ud("3", ",", ",", "PUNCT"),
        ud("4", "банк", "банк", "NOUN"), ud("5", "открыт", "открытый", "ADJ"), ud("6", ".", ".", "PUNCT"),
    ]
    second = [
        ud("1-2", "Кот-и", "_", "_"), ud("1", "Кот", "кот", "NOUN"), ud("2", "и", "и", "CCONJ"),
        ud("3", "деньги", "деньга", "NOUN"), ud("4", ".", ".", "PUNCT"),
    ]
    path = write(tmp_path / "ud.conllu", "\n".join(first) + "\n\n" + "\n".join(second) + "\n")
    sentences = read_short_corpus(spark, [path], split="external")
    assert {r["SEMCLASS"] for r in explode_sentences(sentences).collect()} == {"_"}
    chunks = chunk_sentences(
        sentences, order=["split_index", "source_file", "sentence_index"], max_context_tokens=4, max_context_word_tokens=3
    ).orderBy("chunk_index").collect()
    assert [r["tokens"] for r in chunks] == [["Кошка", "спит", ",", "банк"], ["открыт", "."], ["Кот", "и", "деньги", "."]]
    assert [(r["document_index"], r["chunk_index"]) for r in chunks] == [(0, 0), (0, 1), (1, 2)]
    assert chunks[0]["target_indices"] == [0, 1, 3]
    assert chunks[0]["lemmas"] == ["кошка", "спать", ",", "банк"]


def test_annotated_sink(spark, tmp_path):
    rows = [
        ("train", 0, "s1", 0, "кошка", "ANIMAL", "cluster_0:кошка"),
        ("train", 0, "s1", 1, "кот\tx", None, "cluster_0:кошка"),
        ("dev", 1, None, 0, "банк", "MONEY", "cluster_1:банк"),
    ]
    names = ["split", "sentence_index", "sentence_id", "token_index", "FORM", "SEMCLASS", "AUTO_SEMCLASS"]
    tokens = spark.createDataFrame(rows, ", ".join(
        f"{name} {'int' if name.endswith('index') else 'string'}" for name in names
    )).withColumn("split_index", F.when(F.col("split") == "train", 0).otherwise(1))
    path = str(tmp_path / "out")
    write_annotated(tokens, path, order=["split_index", "sentence_index"])
    import glob

    text = "".join(open(part, encoding="utf-8").read() for part in sorted(glob.glob(path + "/part-*")))
    blank = "\t".join(["_"] * 9)
    expected = [
        "# global.columns = ID FORM LEMMA UPOS XPOS FEATS HEAD DEPREL DEPS MISC DEEPSLOT SEMCLASS AUTO_SEMCLASS",
        "# sent_id = s1",
        "# split = train",
        f"1\tкошка\t{blank}\tANIMAL\tcluster_0:кошка",
        f"2\tкот x\t{blank}\t_\tcluster_0:кошка",
        "",
        "# split = dev",
        f"1\tбанк\t{blank}\tMONEY\tcluster_1:банк",
    ]
    assert text.rstrip().split("\n") == [line.replace(blank, blank) for line in expected]


def test_hierarchy_file(spark, tmp_path):
    folder = tmp_path / "nested" / "deep"
    folder.mkdir(parents=True)
    text = "1,,0,ROOT,x\n2,1,1,ENTITY\n\n3,NULL,1,\"A, B\"\n"
    write(folder / "label_hierarchy.csv", text)
    rows = read_hierarchy(spark, str(tmp_path)).orderBy("class_id").collect()
    assert [tuple(r) for r in rows] == [("1", None, 0, "ROOT"), ("2", "1", 1, "ENTITY"), ("3", None, 1, "A, B")]
    short = write(tmp_path / "short.csv", "1,2\n")
    with pytest.raises(Exception, match="at least 4"):
        read_hierarchy(spark, short).collect()


def test_artifact_needs_runs(spark, tmp_path):
    runs = run_table(spark, [{"algorithm": "kmeans", "n_clusters": 2}])
    path = write_artifact({"runs": runs}, str(tmp_path / "artifact"))
    assert read_artifact(spark, path)["runs"].first()["config"] == {"algorithm": "kmeans", "n_clusters": "2"}
    with pytest.raises(ValueError, match="no runs"):
        read_artifact(spark, str(tmp_path / "nothing"))


def test_sheet_labels_are_unique_and_short(spark):
    runs = spark.createDataFrame([(0, "k" * 40), (1, "k" * 40), (2, "k" * 40), (3, "other")], "run_index int, run_label string")
    found = {r["run_index"]: r["sheet_label"] for r in unique_labels(runs).collect()}
    assert found == {0: "k" * 31, 1: "k" * 29 + "_2", 2: "k" * 29 + "_3", 3: "other"}


def test_seeded_order_is_stable_and_whole(spark):
    rows = spark.range(100).withColumn("text", F.col("id").cast("string"))
    one = [r["id"] for r in seeded_order(rows, ["id"], seed=1).collect()]
    two = [r["id"] for r in seeded_order(rows.repartition(7), ["id"], seed=1).collect()]
    assert one == two and sorted(one) == list(range(100)) and one != list(range(100))


def test_annotated_file_in_compressed_parts_reads_back(spark, tmp_path):
    rows = [(s, i, str(i + 1), f"w{s}-{i}") for s in range(40) for i in range(s % 5 + 1)]
    tokens = spark.createDataFrame(rows, "sentence_index int, token_index int, ID string, FORM string")
    path = str(tmp_path / "annotated")
    write_annotated(tokens, path, order=["sentence_index"], compression="gzip")
    parts = list((tmp_path / "annotated").glob("part-*"))
    assert parts and all(part.name.endswith(".txt.gz") for part in parts)
    read = read_sentences(spark, [("all", path)], n_columns=13, line_ending="lf")
    forms = [[token["FORM"] for token in r["tokens"]] for r in read.orderBy("source_file", "sentence_index").collect()]
    assert forms == [[f"w{s}-{i}" for i in range(s % 5 + 1)] for s in range(40)]


def test_annotated_tokens_travel_as_one_line(spark):
    from tokenloom.sources.annotated import annotated_lines

    tokens = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "sentence_index int, token_index int, FORM string")
    found = annotated_lines(tokens, order=["sentence_index"])
    assert found.first()["block"].split("\n") == ["1\ta" + "\t_" * 11, "2\tb" + "\t_" * 11]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_row" in plan and "_line" in plan


def test_assembled_sentences_gather_what_the_report_reads(spark, tmp_path):
    from tokenloom.plans.catalog import QUERIES

    rows = [(1, "en", "web", "A b, c.\nd e", 11)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string, n_chars int").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    found = QUERIES["assembled_sentences"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 0, 5, "A b , c ."), (1, 1, 2, "d e")]
    gathered = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LEMMA" not in gathered and "SEMCLASS" not in gathered
