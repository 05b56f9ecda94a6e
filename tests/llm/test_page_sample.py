from pyspark.sql import functions as F

from tokenloom.llm import html_crf

PAGE = "<html><body><nav><a>Menu {0}</a></nav><article><p>Some plain text of page {0}, long enough.</p></article></body></html>"


def test_training_pages_are_taken_from_labelled_ones(spark):
    rows = [(at, f"<p>no mark {at}</p>") for at in range(60)]
    ids = [row.id for row in spark.range(60).orderBy(F.xxhash64("id"), "id").collect()]
    for at in ids[-3:]:  # the last by hash order
        rows[at] = (at, PAGE.format(at))
    rows[ids[-4]] = (ids[-4], "<article></article><p>outside</p>")
    rows += [(ids[-3], "<p>other version</p>"), (None, PAGE.format(0))]
    pages = spark.createDataFrame(rows, "page_id bigint, html string")
    model = html_crf.train_extractor(pages, max_pages=3)
    alone = html_crf.train_extractor(pages.where(F.col("page_id").isin(ids[-3:]) & F.col("html").contains("nav")), max_pages=3)
    assert model and model == alone
    assert html_crf.main_text(PAGE.format(7), model) == "Some plain text of page 7, long enough."
