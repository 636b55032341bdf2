"""Reading by a report's configuration: header fields by its labels, their types and requirements by the critic, recipients by its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HEADER_CONFIDENCE
from ..functions.arrays import spread
from ..sources.report_files import Report
from . import critic, extract


def values(sheets: DataFrame, report: Report) -> DataFrame:
    """doc_id, name, value, confidence: what was found of the report's scalar fields, in the order of its labels. Fields without labels
    aren't found, nor is anything in a null text."""
    found = F.array(*(F.struct(F.lit(f.name).alias("name"), extract.header_value(f.labels).alias("x")) for f in report.scalars if f.labels))
    rows = spread(extract.with_lines(extract.parsed(sheets)), found, F.col("sheet_id").alias("doc_id")).where("x is not null")
    return rows.select("doc_id", "name", F.col("x.value").alias("value"), F.lit(HEADER_CONFIDENCE).alias("confidence"))


def checked(sheets: DataFrame, report: Report) -> DataFrame:
    """doc_id, name, value, confidence, must_review, status, error: every scalar field of every sheet, found or not. A value of the wrong
    type or outside the field's values is an error, so is a required field that is missing; an optional one that is missing isn't."""
    found = values(sheets, report)
    # every sheet has its row, so that one of which nothing was found has its fields too
    given = sheets.select(F.col("sheet_id").alias("doc_id"), F.lit("").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"))
    return critic.scalar_fields(given.unionByName(found), report.spec(sheets.sparkSession))


def recipients(report: Report, given: dict[str, Column]) -> Column:
    """The recipients of the first rule whose conditions all hold."""
    out: Column | None = None
    for when, to in report.routing[:-1]:
        holds = F.lit(True)
        for dimension, label in ((k, v) for k, v in when.items() if k):
            holds &= F.coalesce(given[dimension] == label, F.lit(False))
        out = (F if out is None else out).when(holds, F.array(*map(F.lit, to)))
    last = F.array(*map(F.lit, report.routing[-1][1]))
    return last if out is None else out.otherwise(last)
