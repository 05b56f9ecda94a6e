import sys

from pyspark.sql import functions as F

from tokenloom.functions.text import casefold


def test_every_character_folds_as_the_standard_says(spark):
    chars = [chr(at) for at in range(1, sys.maxunicode + 1) if not 0xD800 <= at < 0xE000]
    cased = [char for char in chars if char.casefold() != char or char.lower() != char]
    found = spark.createDataFrame([(char,) for char in cased], "c string").select("c", casefold("c").alias("f")).collect()
    assert [(hex(ord(r["c"])), r["f"]) for r in found if r["f"] != r["c"].casefold()] == []


def test_words_nulls_and_line_breaks(spark):
    words = ["ﬁn", "ŉ", "µ", "ſo", "ᾳ", "և", "ΟΔΟΣ οδος", "GROẞE Straße\nİ", "plain WORDS", "", None, "Σ" * 3000]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i")
    found = [r["f"] for r in rows.select("i", casefold(F.col("w")).alias("f")).orderBy("i").collect()]
    assert found == [None if word is None else word.casefold() for word in words]
