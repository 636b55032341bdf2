"""read_pages in SQL."""

import pytest

from tallyrook.sources import readers, table_functions


@pytest.fixture
def pages(spark):
    table_functions.install(spark)
    rows = [(d, p, f"doc {d} page {p}".encode() if p else None) for d in ("a", "b", "c") for p in (2, 0, 1)]
    df = spark.createDataFrame(rows, "doc_id string, page int, content binary").repartition(4)
    df.createOrReplaceTempView("pages")
    return df


def test_columns_follow_from_the_table(spark, pages):
    got = spark.sql("SELECT * FROM read_pages(TABLE(pages) PARTITION BY (doc_id) ORDER BY (page), 'text')")
    assert got.dtypes == [("doc_id", "string"), ("page", "int"), ("text", "string"), ("confidence", "double"), ("source", "string"), ("error", "string")]
    want = sorted((r.doc_id, r.page, r.text, r.confidence, r.source) for r in readers.evaluation_reader("text")(pages.fillna({}).na.fill("")).collect())
    assert sorted((r.doc_id, r.page, r.text, r.confidence, r.source) for r in got.collect()) == [(d, p, t or "", c, s) for d, p, t, c, s in want]
    spark.createDataFrame([(1, 5, b"x")], "doc_id long, page long, content binary").createOrReplaceTempView("wide")
    assert spark.sql("SELECT * FROM read_pages(TABLE(wide) PARTITION BY (doc_id) ORDER BY (page), 'mock')").dtypes[:2] == [("doc_id", "bigint"), ("page", "bigint")]


def test_what_is_refused(spark, pages):
    for sql, why in (
        ("SELECT * FROM read_pages(TABLE(pages) PARTITION BY (doc_id), 'none')", "unknown reader none"), ("SELECT * FROM read_pages(TABLE(SELECT doc_id FROM pages) PARTITION BY (doc_id), 'text')", "lack page, content"), ("SELECT * FROM read_pages(1, 'text')", "TABLE"),
    ):
        with pytest.raises(Exception, match=why):
            spark.sql(sql).collect()


def test_deadline_of_a_document(spark, pages, monkeypatch):
    def slow(content, deadline):
        import time

        time.sleep(min(0.4, deadline.remaining()))
        deadline.remaining()
        return content.decode().upper(), 0.5, "slow", None

    monkeypatch.setattr(table_functions, "_PAGES", dict(table_functions._PAGES))
    table_functions.register("slow", slow)
    table_functions.install(spark)
    spark.createDataFrame([(d, p, b"x") for d in range(3) for p in range(6)], "doc_id int, page int, content binary").createOrReplaceTempView("many")
    rows = spark.sql("SELECT * FROM read_pages(TABLE(many) PARTITION BY (doc_id) ORDER BY (page), 'slow', 1.0D)").collect()
    assert len(rows) == 18
    for d in range(3):
        errors = [r.error for r in sorted(rows, key=lambda r: r.page) if r.doc_id == d]
        # the first pages are read, the rest is marked, in order
        assert errors[0] is None and errors[-1] == table_functions.DEADLINE and errors == sorted(errors, key=lambda e: e is not None)
    assert all(r.text == "X" for r in rows if r.error is None)
