from tokenloom.llm import ngram_lm


def test_shards_do_not_follow_the_partitions(spark):
    """Every shard sends arrays to all others, so their number may follow the text alone."""
    texts = spark.createDataFrame([("a b c a b",), ("b c a",)], "text string")
    setting = "spark.sql.shuffle.partitions"
    before, found = spark.conf.get(setting), []
    try:
        for partitions in ("4", "211"):
            spark.conf.set(setting, partitions)
            found.append(ngram_lm.train(texts, order=2).bits)
    finally:
        spark.conf.set(setting, before)
    assert found[0] == found[1]
