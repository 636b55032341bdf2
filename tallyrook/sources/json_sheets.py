"""Truth sheets and manifests as JSON, with explicit schemas and without tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRUTH = (
    "schema_version string, document_id string, source_file string, review_status string, truth_source string, "
    "cabecalho struct<data:string,turno:string,vigilantes:array<string>,unidade:string>, sem_alteracao boolean, riscado boolean, "
    "ocorrencias array<struct<item:string,hora_entrada:string,hora_saida:string,descricao:string,acao:string,resolvido:string>>"
)


def parsed(files: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Truth sheets of texts (file, text), those of the review statuses asked for, in the order of their files' names; a text that isn't JSON
    is an error."""
    rows = files.select("file", F.from_json("text", TRUTH, {"mode": "FAILFAST"}).alias("x")).select("file", "x.*")
    return rows.where(F.col("review_status").isin(*statuses)).orderBy("file").drop("file")


def truth_sheets(spark: SparkSession, path: str, statuses: Sequence[str]) -> DataFrame:
    """parsed() of the *.json files of a folder."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return parsed(files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), statuses)


def manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A JSONL manifest with its faults in the column error: operators.contracts.entry_errors() of its lines. An empty manifest is an error."""
    from ..operators.contracts import entry_errors

    # one file is one manifest, which a driver wrote; lines are numbered in reading order
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_number"), F.col("value").alias("text"))
    if not lines.limit(1).count():
        raise ValueError("the manifest is empty")
    return entry_errors(lines, split)
