"""Queries over sheets: extraction, critics, classification, routing, outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import csv_safe
from ..operators import classify, configured, critic, extract, outputs
from ..sources import report_files
from ..sources.sheets import sheets
from . import base_sql as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {B.SHEETS} SELECT sheet_id, sha256(text) AS text_sha, truth_date, truth_guards, truth_unit, truth_n, difficulty, template, split FROM sheets")
def sheet_texts(spark, d):
    return sheets(spark, d).select("sheet_id", F.sha2("text", 256).alias("text_sha"), "truth_date", "truth_guards", "truth_unit", F.col("truth_n").cast("long").alias("truth_n"), "difficulty", "template", "split")


_PLACES = ["FRANCE", "BRAZIL", "CHINA", "INDIA", "JAPAN"]
_REPORT = {
    "report_type": "visit", "classification": {"type": {"labels": ["other"]}, "urgency": {"labels": ["low"]}, "sector": {"labels": ["all"]}}, "routing": [{"recipients": ["all"]}],
    "fields": [
        {"name": "when", "type": "string", "ocr_aliases": ["Data e Turno", "Data"]}, {"name": "where", "type": "enum", "required": False, "values": _PLACES, "ocr_aliases": ["Unidade"]},
        {"name": "note", "type": "text"}, {"name": "rows", "type": "table", "columns": [{"name": "item", "type": "string"}]},
    ],
}


@query(
    f"""WITH {B.STATES}, f AS (SELECT sheet_id, 'when' AS name, data_turno AS value FROM states UNION ALL SELECT sheet_id, 'where', unidade FROM states UNION ALL SELECT sheet_id, 'note', NULL FROM states),
e AS (SELECT *, CASE WHEN value IS NULL AND name <> 'where' THEN 'required field is missing' WHEN name = 'where' AND value NOT IN ({", ".join(f"'{p}'" for p in _PLACES)}) THEN 'not an allowed value' END AS error FROM f)
SELECT name, CASE WHEN value IS NULL THEN 'missing' ELSE 'must_review' END AS status, name || ': ' || error AS error, count(*) AS n FROM e GROUP BY ALL"""
)
def configured_fields(spark, d):
    """Sheets read by another report's configuration: its fields, labels, types and requirements."""
    rows = configured.checked(sheets(spark, d), report_files.parsed(_REPORT))
    return rows.groupBy("name", "status", "error").agg(F.count("*").alias("n"))


@query(f"WITH {B.LINES} SELECT sheet_id, page::BIGINT AS page, count(*) AS n_lines, min(head)::BIGINT AS head, min(foot)::BIGINT AS foot FROM regions GROUP BY ALL")
def sheet_region_bounds(spark, d):
    long = lambda c: F.min(c).cast("long").alias(c)
    return extract.regions(sheets(spark, d)).groupBy("sheet_id", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n_lines"), long("head"), long("foot"))


@query(f"WITH {B.SEGMENTS} SELECT sheet_id, pos::BIGINT AS pos, page::BIGINT AS page, no_change, content, hora FROM segments")
def sheet_row_segments(spark, d):
    return extract.segments(sheets(spark, d)).withColumns({"pos": F.col("pos").cast("long"), "page": F.col("page").cast("long")})


@query(f"WITH {B.MODELS} SELECT disposition, table_found, count(*) AS n_sheets, sum(occurrences)::BIGINT AS n_occurrences FROM models GROUP BY ALL")
def sheet_disposition(spark, d):
    return extract.models(sheets(spark, d)).groupBy("disposition", "table_found").agg(F.count("*").alias("n_sheets"), F.sum("occurrences").alias("n_occurrences"))


@query(f"WITH {B.HEADER} SELECT sheet_id, field, value, evidence, page::BIGINT AS page FROM header")
def sheet_header_anchor(spark, d):
    return extract.header(sheets(spark, d)).withColumn("page", F.col("page").cast("long"))


@query(f"WITH {B.SPREADSHEET} SELECT sheet_id, pos::BIGINT AS pos, entry_time, exit_time FROM timed")
def sheet_times(spark, d):
    rows = extract.segments(sheets(spark, d)).where("not no_change")
    return rows.select("sheet_id", F.col("pos").cast("long").alias("pos"), extract.entry_time(F.col("hora")).alias("entry_time"), extract.exit_time(F.col("hora")).alias("exit_time"))


@query(f"WITH {B.MODELS} SELECT sheet_id, len(guards)::BIGINT AS n_guards, array_to_string(guards, '|') AS guards FROM models")
def sheet_guards(spark, d):
    return extract.models(sheets(spark, d)).select("sheet_id", F.size("guards").cast("long").alias("n_guards"), F.array_join("guards", "|").alias("guards"))


@query(f"WITH {B.FIELDS} SELECT sheet_id, ord::BIGINT AS ord, name, value, confidence::DOUBLE AS confidence, status, must_review FROM fields")
def sheet_fields_critic(spark, d):
    return critic.fields(sheets(spark, d)).withColumn("ord", F.col("ord").cast("long"))


@query(f"WITH {B.FIELDS} SELECT sheet_id, status, count(*) AS n, count_if(must_review) AS pending FROM fields GROUP BY ALL")
def sheet_pending_counts(spark, d):
    return critic.fields(sheets(spark, d)).groupBy("sheet_id", "status").agg(F.count("*").alias("n"), F.count_if("must_review").alias("pending"))


@query(f"WITH {B.STATES} SELECT quality, disposition, count(*) AS n FROM states GROUP BY ALL")
def sheet_quality_gate(spark, d):
    return critic.states(sheets(spark, d)).groupBy("quality", "disposition").agg(F.count("*").alias("n"))


@query(f"WITH {B.STATES} SELECT sheet_id, len(blockers)::BIGINT AS n_blockers, array_to_string(blockers, ',') AS blockers, reason FROM states")
def sheet_blockers(spark, d):
    return critic.states(sheets(spark, d)).select("sheet_id", F.size("blockers").cast("long").alias("n_blockers"), F.array_join("blockers", ",").alias("blockers"), "reason")


@query(f"WITH {B.STATES} SELECT coalesce(reason, 'reviewable') AS reason, pages > 1 AS beyond_one_page, count(*) AS n FROM states GROUP BY ALL")
def sheet_reviewable_reason(spark, d):
    return critic.states(sheets(spark, d)).groupBy(F.coalesce("reason", F.lit("reviewable")).alias("reason"), (F.col("pages") > 1).alias("beyond_one_page")).agg(F.count("*").alias("n"))


@query(f"WITH {B.CLASSIFIED} SELECT sheet_id, incident_type, urgency, sector, class_confidence::DOUBLE AS class_confidence FROM classified")
def sheet_classify(spark, d):
    return classify.classified(critic.states(sheets(spark, d))).select("sheet_id", "incident_type", "urgency", "sector", F.col("class_confidence").cast("double").alias("class_confidence"))


@query(f"WITH {B.CLASSIFIED} SELECT recipients, incident_type, count(*) AS n FROM classified GROUP BY ALL")
def sheet_route(spark, d):
    return classify.classified(critic.states(sheets(spark, d))).groupBy(F.array_join("recipients", ",").alias("recipients"), "incident_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {B.CLASSIFIED} SELECT sheet_id, array_to_string(list_filter([CASE WHEN incident_type NOT IN ('routine', 'access_violation', 'equipment', 'safety', 'theft', 'other') THEN 'type' END,
  CASE WHEN urgency NOT IN ('low', 'medium', 'high', 'critical') THEN 'urgency' END, CASE WHEN sector NOT IN ('tech_security', 'general_support', 'facilities') THEN 'sector' END],
  lambda x: x IS NOT NULL), ',') AS outside FROM classified"""
)
def sheet_taxonomy_check(spark, d):
    rows = classify.classified(critic.states(sheets(spark, d)))
    return rows.select("sheet_id", F.array_join(classify.outside_taxonomy(F.col("incident_type"), F.col("urgency"), F.col("sector")), ",").alias("outside"))


@query(f"WITH {B.SPREADSHEET} SELECT sheet_id, pos::BIGINT AS pos, dia, unidade, objeto, descricao FROM spreadsheet")
def sheet_spreadsheet(spark, d):
    base = sheets(spark, d)
    return outputs.spreadsheet(critic.states(base)).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""WITH {B.SPREADSHEET}, bodies2 AS (SELECT sheet_id, string_agg(rtrim(concat_ws(' | ', dia, unidade, objeto, descricao), ' '), chr(10) ORDER BY pos) AS body FROM spreadsheet GROUP BY 1),
tails AS (SELECT s.*, 'DIA | UNIDADE | OBJETO | DESCRIÇÃO' || chr(10) || body || chr(10) || chr(10) || 'Vigilantes: ' || CASE WHEN len(guards) > 0 THEN array_to_string(guards, ', ') ELSE '(revisar)' END AS tail
  FROM states s JOIN bodies2 USING (sheet_id))
SELECT sheet_id, CASE WHEN len(blockers) > 0 THEN 'RASCUNHO INCOMPLETO: corrija os campos pendentes.' || chr(10) || 'Pendências: ' || array_to_string(blockers, ', ') || chr(10) || chr(10) || tail
  ELSE 'Bom dia,' || chr(10) || chr(10) || tail END AS message FROM tails"""
)
def sheet_message(spark, d):
    base = sheets(spark, d)
    return outputs.messages(critic.states(base))


@query(
    rf"""WITH {B.SPREADSHEET}, cells AS (SELECT unnest([dia, unidade, objeto, descricao, '=1+' || dia, '@' || unidade, chr(9) || objeto, '-' || descricao]) AS cell FROM spreadsheet)
SELECT CASE WHEN regexp_matches(cell, '^[=+\-@\p{{Cc}}\p{{Cf}}\p{{Z}}\s]') THEN '''' || cell ELSE cell END AS safe, count(*) AS n FROM cells GROUP BY 1"""
)
def csv_safe_cells(spark, d):
    base = sheets(spark, d)
    rows = outputs.spreadsheet(critic.states(base))
    made = [F.concat(F.lit("=1+"), "dia"), F.concat(F.lit("@"), "unidade"), F.concat(F.lit("\t"), "objeto"), F.concat(F.lit("-"), "descricao")]
    return rows.select(F.explode(F.array("dia", "unidade", "objeto", "descricao", *made)).alias("cell")).groupBy(csv_safe(F.col("cell")).alias("safe")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {B.CLASSIFIED} SELECT disposition, quality, incident_type, recipients, coalesce(reason, 'reviewable') AS reason, count(*) AS n_sheets, sum(occurrences)::BIGINT AS n_occurrences,
  sum(len(blockers))::BIGINT AS n_blockers FROM classified GROUP BY ALL"""
)
def pipeline_summary(spark, d):
    """The flagship: text to model, critic, gate, class and route of every sheet, counted by outcome."""
    rows = classify.classified(critic.states(sheets(spark, d)))
    return rows.groupBy("disposition", "quality", "incident_type", F.array_join("recipients", ",").alias("recipients"), F.coalesce("reason", F.lit("reviewable")).alias("reason")).agg(
        F.count("*").alias("n_sheets"), F.sum("occurrences").alias("n_occurrences"), F.sum(F.size("blockers")).alias("n_blockers")
    )


@query(
    """WITH given(kind, value) AS (VALUES ('date', '2026-01-31'), ('date', '31/02/2026'), ('date', '01/02/26'), ('date', '5/7/2026'), ('bool', 'Sim'), ('bool', 'talvez'), ('enum', 'sim'), ('enum', 'x'), ('string', 'x')),
judged AS (SELECT *, CASE WHEN kind = 'date' AND coalesce(CASE WHEN regexp_matches(value, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') THEN try_strptime(value, '%Y-%m-%d') END,
   CASE WHEN regexp_matches(value, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN try_strptime(value, '%d/%m/%Y') END) IS NULL THEN 'not a date'
  WHEN kind = 'bool' AND lower(value) NOT IN ('sim', 'nao', 'não', 'true', 'false', 'yes', 'no', 's', 'n', '1', '0') THEN 'not a boolean' WHEN kind = 'enum' AND value NOT IN ('sim', 'nao') THEN 'not an allowed value' END AS error FROM given)
SELECT * FROM judged"""
)
def field_type_errors(spark, d):
    given = [("date", "2026-01-31"), ("date", "31/02/2026"), ("date", "01/02/26"), ("date", "5/7/2026"), ("bool", "Sim"), ("bool", "talvez"), ("enum", "sim"), ("enum", "x"), ("string", "x")]
    rows = spark.createDataFrame(given, "kind string, value string")
    return rows.withColumn("error", critic.type_error(F.col("kind"), F.col("value"), F.array(F.lit("sim"), F.lit("nao"))))
