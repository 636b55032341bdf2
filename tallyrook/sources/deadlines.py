"""Reading under a deadline of the whole job: what was read in time is kept, the rest is marked, and every page has its row.

Pages are dealt to buckets of documents, written once; a bucket is a job of its own under the run's tag. At the deadline Spark interrupts
what still runs under the tag. A bucket counts if its job ended, so a page is never half read, and a page that waits is marked as one
whose time is over.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import Reader
from .shared import root
from .table_functions import DEADLINE

#: Jobs that a run is cut into, and those that run at a time.
BUCKETS, AT_A_TIME = 32, 4
OUT = ("doc_id", "page", "text", "confidence", "source", "error")


def read_within(pages: DataFrame, reader: Reader, seconds: float, buckets: int = BUCKETS, at_a_time: int = AT_A_TIME) -> DataFrame:
    """doc_id, page, text, confidence, source, error: one row for each page, read within the seconds or marked with DEADLINE. A reader that
    fails otherwise is an error, after the others were stopped. A document's pages lie in one bucket. The time counts from the call and
    includes dealing the pages; the result is read from what was written."""
    began, spark = time.monotonic(), pages.sparkSession
    path, tag = f"{root(spark)}/read-{uuid.uuid4().hex}", f"read-{uuid.uuid4().hex}"
    kinds = {f.name: f.dataType.simpleString() for f in pages.select("doc_id", "page", "content").schema.fields}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    dealt = pages.select(*kinds).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/pages")
    asked = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/pages")
    names = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # at most buckets numbers

    def columns(found: DataFrame) -> DataFrame:
        return found.withColumn("error", F.lit(None).cast("string")) if "error" not in found.columns else found

    def one(bucket: int) -> None:
        spark.addTag(tag)
        try:
            found = columns(reader(asked.where(F.col("bucket") == bucket).drop("bucket"))).select(*OUT)
            found.write.parquet(f"{path}/read/bucket={bucket}")
        finally:
            spark.removeTag(tag)

    done, over = [], False
    with ThreadPoolExecutor(at_a_time) as pool:
        jobs = {pool.submit(one, b): b for b in names}
        waiting = set(jobs)
        while waiting and not over:
            ended, waiting = wait(waiting, timeout=max(0.0, seconds - (time.monotonic() - began)), return_when="FIRST_EXCEPTION")
            over = bool(waiting) and not any(j.exception() for j in ended)
            done += [jobs[j] for j in ended if not j.exception()]
            if failed := next((j.exception() for j in ended if j.exception()), None):
                for j in waiting:
                    j.cancel()
                spark.interruptTag(tag)
                raise failed
        for j in waiting:
            j.cancel()
        while any(j.running() for j in waiting):
            # a job may have begun between two interrupts
            spark.interruptTag(tag)
            time.sleep(0.05)
        done += [jobs[j] for j in waiting if not j.cancelled() and not j.exception()]
    late = asked.where(~F.col("bucket").isin(done)) if done else asked
    marked = late.select("doc_id", "page", F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.lit("").alias("source"), F.lit(DEADLINE).alias("error"))
    if not done:
        return marked
    read = spark.read.schema(f"doc_id {kinds['doc_id']}, page {kinds['page']}, text string, confidence double, source string, error string")
    return read.parquet(*(f"{path}/read/bucket={b}" for b in done)).unionByName(marked)
