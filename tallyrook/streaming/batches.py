"""Sinks that keep each micro-batch once, and what builds on them: the recorder of simulations, and ingestion of a growing folder.

A batch's rows are written aside and moved to a folder named by the batch's number. A batch that is run again, as it is after a
stop between the write and Spark's own commit, makes the same rows of the same offsets and state, and takes the place of the
first run's; so every row is kept once, whatever stops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import critic


def _paths(spark: SparkSession, *names: str) -> tuple:
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *paths


def put(rows: DataFrame, batch: int, path: str) -> None:
    """Keep a batch's rows in path under its number, in place of those of an earlier run of the batch."""
    spark = rows.sparkSession
    aside, there = f"{path}/_aside-{uuid.uuid4().hex}", f"{path}/batch={batch:019d}"
    rows.write.parquet(aside)
    system, source, target = _paths(spark, aside, there)
    system.delete(target, True)
    if not system.rename(source, target):
        raise OSError(f"{there} can't be put in place")


def kept(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All batches' rows, with batch; none where nothing was kept yet."""
    system, where = _paths(spark, path)
    whole = T.StructType([*(T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields, T.StructField("batch", T.LongType())])
    if not system.exists(where):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(path)


RECORDED = "draft_id long, event_id long, revision long, detail string"


def record(outcomes: DataFrame, path: str, checkpoint: str, put=put) -> StreamingQuery:
    """Starts the recorder: each simulation that a stream of outcomes completes is kept once. It handles what is there and ends."""

    def one(rows: DataFrame, batch: int) -> None:
        put(rows.where("outcome = 'simulation_completed'").select("draft_id", "event_id", "revision", "detail"), batch, path)

    return outcomes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recorded(spark: SparkSession, path: str) -> DataFrame:
    return kept(spark, path, RECORDED)


SUMMARY = "file string, sheet_id string, disposition string, quality string, occurrences long, pending array<string>, reason string"


def summaries(texts: DataFrame) -> DataFrame:
    """From file, sheet_id and text: what the stages make of each sheet."""
    return critic.states(texts).select("file", "sheet_id", "disposition", "quality", "occurrences", "pending", "reason")


def ingest(spark: SparkSession, folder: str, path: str, checkpoint: str, files_a_batch: int = 1_000) -> StreamingQuery:
    """Starts a run over the files of a folder that no earlier run with this checkpoint has read: each is one sheet's text, named by its
    file. It handles what is there and ends."""
    texts = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:@[^@]*)?\.txt$", 1)
    sheets = texts.select(F.col("_metadata.file_path").alias("file"), name.alias("sheet_id"), F.col("value").alias("text"))
    return sheets.writeStream.foreachBatch(lambda rows, batch: put(summaries(rows), batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(spark: SparkSession, path: str) -> DataFrame:
    """One row a sheet: of the files that name it (sheet.txt, sheet@2.txt), the one of the latest batch, and the last by name in that."""
    rows = kept(spark, path, SUMMARY)
    last = F.max_by(F.struct(*rows.columns), F.struct("batch", "file"))
    return rows.groupBy("sheet_id").agg(last.alias("x")).select("x.*")
