"""A job's deadline: in time, with every page read or marked."""

import time

import pytest
from pyspark.sql import functions as F

from tallyrook.sources import deadlines, readers
from tallyrook.sources.table_functions import DEADLINE


def pages(spark, n=40):
    return spark.range(n).selectExpr("id AS doc_id", "explode(sequence(0, 1)) AS page").withColumn("content", F.concat(F.lit("p"), "page").cast("binary"))


def slow(found):
    def work(batches):
        import time

        for batch in batches:
            time.sleep(0.25 * batch.num_rows)
            yield batch

    return readers.evaluation_reader("text")(found.mapInArrow(work, found.schema))


def test_all_in_time(spark):
    got = deadlines.read_within(pages(spark), readers.evaluation_reader("text"), 120, buckets=4)
    assert sorted((r.doc_id, r.page, r.text, r.error) for r in got.collect()) == sorted((d, p, f"p{p}", None) for d in range(40) for p in (0, 1))
    assert deadlines.read_within(pages(spark).limit(0), readers.evaluation_reader("text"), 60).count() == 0


def test_ends_in_time_with_every_page(spark):
    began = time.monotonic()
    got = deadlines.read_within(pages(spark, 200), slow, 9, buckets=16, at_a_time=2)
    took = time.monotonic() - began
    rows = got.collect()
    assert took < 25 and len({(r.doc_id, r.page) for r in rows}) == len(rows) == 400
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, set()).add(r.error)
        assert (r.text == f"p{r.page}") if r.error is None else (r.text, r.error) == ("", DEADLINE)
    # a document is read or it is not; reading all would take some fifty seconds
    assert all(len(e) == 1 for e in by_doc.values()) and {DEADLINE} in by_doc.values()
    # without any time each page has its row all the same; a bucket that ends before the interrupt reaches it is read
    assert deadlines.read_within(pages(spark, 3), slow, 0).count() == 6


def test_a_reader_that_fails_is_an_error(spark):
    def broken(found):
        return readers.evaluation_reader("text")(found).withColumn("text", F.raise_error(F.lit("broken reader")).cast("string"))

    with pytest.raises(Exception, match="broken reader"):
        deadlines.read_within(pages(spark), broken, 60, buckets=3)
