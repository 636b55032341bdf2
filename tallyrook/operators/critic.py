"""Critics and gates: field types, the long table of fields, reading quality, blockers, review, approval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COLUMN_LABELS, FORM_WORDS, GOOD_WORDS, HEADER_CONFIDENCE, HEADER_FIELDS, LEAST_CHARS, LEAST_WORDS, REVIEW_BELOW, ROW_CONFIDENCE
from ..functions.arrays import spread
from ..functions.text import blank, strip
from .extract import models, occurrences

# Letters of a word, and how truth values are written.
WORD = r"[a-zA-ZáéíóúâêôãõçÁÉÍÓÚÂÊÔÃÕÇ]{3,}"
# the same letters in lower case, each by itself, as a set of bits
LOW_WORD = "[abcdefghijklmnopqrstuvwxyzáéíóúâêôãõç]{3,}"
ROW_CELLS = ("objeto", "hora", "descricao", "acao", "resolvido")
BOOLEANS = ("sim", "nao", "não", "true", "false", "yes", "no", "s", "n", "1", "0")


def label_words() -> list[str]:
    """Words printed on the form and in its labels."""
    printed = " ".join([FORM_WORDS, *(x for names in (*HEADER_FIELDS.values(), *COLUMN_LABELS.values()) for x in names)]).lower()
    return sorted(set(re.findall(WORD, printed)))


def parsed_date(c: Column) -> Column:
    return F.coalesce(
        F.when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.expr("try_to_date(value, 'yyyy-M-d')")),
        F.when(c.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.expr("try_to_date(value, 'd/M/yyyy')")),
    )


def type_error(kind: Column, value: Column, allowed: Column) -> Column:
    """What is wrong with a value of a kind (date, bool, enum; others accept all); null if nothing. The value's column is named value."""
    return (
        F.when((kind == "date") & parsed_date(value).isNull(), "not a date")
        .when((kind == "bool") & ~F.lower(strip(value)).isin(*BOOLEANS), "not a boolean")
        .when((kind == "enum") & ~F.array_contains(allowed, value), "not an allowed value")
    )


def _field(ord_: Column, name: Column, value: Column, confidence: Column, status: Column, must_review: Column) -> Column:
    return F.struct(
        ord_.cast("int").alias("ord"), name.alias("name"), value.alias("value"), confidence.alias("confidence"), status.alias("status"), must_review.alias("must_review")
    )


def _read(ord_: Column, name: Column, shown: Column, cell: Column, confidence: float) -> Column:
    """A cell read by rule: it is missing or waits for review."""
    empty = blank(cell)
    return _field(ord_, name, shown, F.when(empty, 0.0).otherwise(confidence), F.when(empty, "missing").otherwise("must_review"), F.lit(True))


def field_list(models: DataFrame) -> Column:
    """Of extract.models(): header fields, then five cells of each occurrence, or one field that says why there is none."""
    heads = F.array(*(_read(F.lit(i), F.lit(n), F.col(n), F.col(n), HEADER_CONFIDENCE) for i, n in enumerate(HEADER_FIELDS)))
    nothing = F.lit(None).cast("string")

    def cells(row: Column, i: Column) -> Column:
        specs = [("objeto", F.lit("(revisar)"), nothing), ("hora", row["hora"], row["hora"]), ("descricao", row["content"], row["content"]), ("acao", nothing, nothing), ("resolvido", nothing, nothing)]
        name = F.concat(F.lit("ocorrencia_"), (i + 1).cast("string"))
        return F.array(*(_read(3 + 5 * i + k, F.concat(name, F.lit(f"_{n}")), shown, cell, ROW_CONFIDENCE) for k, (n, shown, cell) in enumerate(specs)))

    none = F.col("disposition") == "none"
    reason = F.when(none, "(sem alteração)").when(F.col("table_found"), "(nenhuma linha legível)").otherwise("(tabela não encontrada no OCR)")
    single = _field(F.lit(3), F.lit("ocorrencias"), reason, F.when(none, 1.0).otherwise(0.0), F.when(none, "accepted").otherwise("must_review"), ~none)
    rows = F.flatten(F.transform(occurrences(models), cells))
    return F.concat(heads, F.when(F.col("disposition") == "present", rows).otherwise(F.array(single)))


def fields(sheets: DataFrame) -> DataFrame:
    """sheet_id, ord, name, value, confidence, status, must_review: field_list(), one row a field."""
    found = models(sheets)
    return spread(found, field_list(found), "sheet_id")


assert HEADER_CONFIDENCE < REVIEW_BELOW and ROW_CONFIDENCE < REVIEW_BELOW  # rule-read cells always go to review


def row_needs_review(row: Column) -> Column:
    """Of a row of extract.models(): whether any of its five cells isn't accepted. Item, action and resolved are never read by rule."""
    cells = [F.lit("missing"), *(F.when(blank(row[c]), "missing").otherwise("must_review") for c in ("hora", "content")), F.lit("missing"), F.lit("missing")]
    return F.exists(F.array(*cells), lambda status: status != "accepted")


def scalar_fields(given: DataFrame, spec: DataFrame) -> DataFrame:
    """doc_id, name, value, confidence, must_review, status, error: each wanted field (name, kind, required, allowed) of each document of
    given (doc_id, name, value, confidence), whether it was found or not.

    A required blank is an error; a value of the wrong type too, with what it should be; a value of little confidence waits for review
    without an error; an optional blank is fine. spec is the configuration: a few rows.
    """
    wanted = given.select("doc_id").distinct().crossJoin(F.broadcast(spec))
    rows = wanted.join(given, ["doc_id", "name"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    empty = blank(F.col("value"))
    wrong = type_error(F.col("kind"), F.col("value"), F.col("allowed"))
    error = F.when(empty & F.col("required"), "required field is missing").when(~empty, wrong)
    rows = rows.withColumn("error", F.when(error.isNotNull(), F.concat_ws(": ", "name", error)))
    rows = rows.withColumn("must_review", F.col("error").isNotNull() | (~empty & (F.col("confidence") < REVIEW_BELOW)))
    status = F.when(empty, "missing").when(F.col("must_review"), "must_review").otherwise("accepted")
    return rows.select("doc_id", "name", "value", "confidence", "must_review", status.alias("status"), "error")


def quality(text: Column, disposition: Column) -> Column:
    """failed, low or good, by the number of words that aren't printed on the form."""
    printed = label_words()

    def judged(n: Column) -> Column:
        return (
            F.when(F.length(strip(text)) < LEAST_CHARS, "failed")
            .when((disposition != "none") & (n < LEAST_WORDS), "failed")
            .when(n < GOOD_WORDS, "low")
            .otherwise("good")
        )

    # words are counted once
    words = F.regexp_extract_all(F.lower(text), F.lit(LOW_WORD), F.lit(0))
    return F.get(F.transform(F.array(F.size(F.filter(words, lambda w: ~w.isin(*printed)))), judged), F.lit(0))


def pending(models: DataFrame) -> Column:
    """The names of field_list() that must be reviewed: all but the one of a sheet without changes. Values aren't looked at."""
    heads = F.array(*map(F.lit, HEADER_FIELDS))
    cells = lambda i: F.array(*(F.concat(F.lit("ocorrencia_"), i.cast("string"), F.lit(f"_{n}")) for n in ROW_CELLS))
    rows = F.flatten(F.transform(F.sequence(F.lit(1), F.size(occurrences(models))), cells))
    empty = F.array().cast("array<string>")
    return F.concat(heads, F.when(F.col("disposition") == "present", rows).when(F.col("disposition") == "none", empty).otherwise(F.array(F.lit("ocorrencias"))))


def states(sheets: DataFrame) -> DataFrame:
    """models() with quality, pending (fields to review, in order), blockers and reason (why it can't be approved; null if it can). No
    shuffle: all of it follows from a sheet's own row."""
    found = models(sheets).withColumn("quality", quality(F.col("text"), F.col("disposition")))
    found = found.withColumn("pending", pending(found))
    empty = F.array().cast("array<string>")
    extra = F.when((F.col("disposition") == "unknown") & ~F.array_contains("pending", "ocorrencias"), F.array(F.lit("ocorrencias"))).otherwise(empty)
    front = F.array_compact(F.array(F.when(F.col("pages") > 1, "multipage"), F.when(F.col("quality") == "failed", "ocr_failed")))
    reason = (
        F.when(F.col("pages") > 1, "multipage").when(F.col("quality") == "failed", "ocr_failed").when(F.col("text").isNull(), "no_model")
        .when(F.size("pending") > 0, "pending").when(F.col("disposition") == "unknown", "unknown")
    )
    return found.withColumn("blockers", F.concat(front, "pending", extra)).withColumn("reason", reason)
