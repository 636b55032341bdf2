"""Queries on human review: edits of sheets, forms, screens, and readings that came too late."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import compatible, fingerprint
from ..functions.arrays import spread
from ..operators import classify, contracts, critic, edits, extract, forms, ledger as L
from ..sources.sheets import sheets, table
from . import base_sql as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Seconds that a sheet may take in these queries; a sheet's own seconds follow from its number.
BUDGET = 4.5


def made_edits(base):
    """One edit a sheet, of its truth: blank headers, choices that fit, contradict or are missing, and rows with and without faults."""
    k = F.col("sheet_id")

    def row(r, i):
        fault = (k + i) % 53
        hora = F.when(fault == 0, "7:30").when(fault == 1, F.replace(r["truth_hora"], F.lit(" "), F.lit(" – "))).otherwise(r["truth_hora"])
        return F.struct(
            F.when(fault == 2, " ").otherwise(r["truth_item"]).alias("item"), hora.alias("hora"), F.when(fault == 3, "").otherwise(r["truth_desc"]).alias("descricao"),
            r["truth_action"].alias("acao"), F.when(fault == 4, "talvez").otherwise(r["truth_resolved"]).alias("resolvido"),
        )

    with_rows = (k % 4).isin(1, 2) | (k % 8 == 0) | (k % 12 == 3)
    rows = F.when(with_rows, F.transform("truth", row)).otherwise(F.array().cast(edits.EDIT_ROWS))
    return base.select(
        "sheet_id", F.when(k % 6 == 0, " ").otherwise(F.col("truth_date")).alias("data_turno"), F.col("truth_guards").alias("vigilantes"), F.when(k % 10 == 0, "").otherwise(F.col("truth_unit")).alias("unidade"),
        F.when(k % 4 == 0, "sem_alteracao").when(k % 4 < 3, "com_ocorrencias").alias("radio"), rows.alias("rows"),
    )


_TIME = f"regexp_matches(hora, '{forms.TIME}')"
_KINDS = B._kinds.replace("lower(text)", "lower(content)")
EDITED = B.CLASSIFIED + f""",
edit_rows AS (SELECT sheet_id, pos, CASE WHEN (sheet_id + pos - 1) % 53 = 2 THEN '' ELSE truth_item END AS item, CASE (sheet_id + pos - 1) % 53 WHEN 0 THEN '7:30' WHEN 1 THEN replace(truth_hora, ' ', ' – ') ELSE truth_hora END AS hora,
  CASE WHEN (sheet_id + pos - 1) % 53 = 3 THEN '' ELSE truth_desc END AS descricao, truth_action AS acao, CASE WHEN (sheet_id + pos - 1) % 53 = 4 THEN 'talvez' ELSE truth_resolved END AS resolvido
  FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY l_linenumber, line, truth_desc, noise, quantity, truth_hora, merged) AS pos FROM sheet_rows)
  WHERE sheet_id % 4 IN (1, 2) OR sheet_id % 8 = 0 OR sheet_id % 12 = 3),
judged AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY sheet_id) > 10 THEN 'too many rows' WHEN item = '' THEN 'item missing' WHEN hora <> '' AND NOT {_TIME} THEN 'bad time' WHEN descricao = '' THEN 'description missing'
  WHEN resolvido <> '' AND resolvido NOT IN ('sim', 'nao') THEN 'bad choice' END AS fault FROM edit_rows),
per AS (SELECT sheet_id, count(*) AS n, arg_min(fault, pos) FILTER (fault IS NOT NULL) AS fault, string_agg(concat_ws(' ', nullif(item, ''), nullif(descricao, ''), nullif(acao, '')), chr(10) ORDER BY pos) AS lines FROM judged GROUP BY 1),
choices AS (SELECT c.*, coalesce(n, 0) AS n, fault, coalesce(lines, '') AS lines, CASE WHEN sheet_id % 4 = 0 THEN 'sem_alteracao' WHEN sheet_id % 4 < 3 THEN 'com_ocorrencias' ELSE '' END AS radio FROM classified c LEFT JOIN per USING (sheet_id)),
resolved AS (SELECT *, CASE WHEN radio = 'sem_alteracao' AND n = 0 THEN 'none' WHEN radio = 'sem_alteracao' THEN 'error:rows with no change' WHEN radio = 'com_ocorrencias' AND n > 0 THEN 'present' WHEN radio = 'com_ocorrencias' THEN 'error:no rows'
  WHEN n > 0 THEN 'error:rows without choice' WHEN disposition = 'present' THEN 'error:no choice' ELSE disposition END AS now FROM choices),
fates AS (SELECT *, coalesce(fault, CASE WHEN starts_with(now, 'error:') THEN substr(now, 7) END) AS error, CASE WHEN sheet_id % 6 = 0 THEN NULL ELSE truth_date END AS new_date, CASE WHEN sheet_id % 10 = 0 THEN NULL ELSE truth_unit END AS new_unit,
  CASE WHEN now = 'none' THEN 'sem alteração' ELSE lines END AS content FROM resolved),
waiting2 AS (SELECT *, CASE WHEN error IS NOT NULL THEN pending ELSE list_filter([CASE WHEN new_date IS NULL THEN 'data_turno' END, CASE WHEN new_unit IS NULL THEN 'unidade' END, CASE WHEN now = 'unknown' THEN 'ocorrencias' END], lambda x: x IS NOT NULL) END AS waits,
  CASE WHEN error IS NULL AND quality = 'failed' THEN 'low' ELSE quality END AS quality2, CASE WHEN error IS NULL THEN now ELSE disposition END AS disposition2,
  CASE WHEN error IS NULL AND now <> 'unknown' THEN CASE WHEN {B.strip('content')} = '' THEN 'routine' {_KINDS} ELSE 'other' END ELSE incident_type END AS kind2 FROM fates),
reviewed AS (SELECT *, CASE WHEN error IS NULL AND now <> 'unknown' THEN CASE WHEN kind2 = 'theft' THEN 'tech_security,general_support' WHEN kind2 = 'equipment' THEN 'facilities' WHEN kind2 = 'access_violation' THEN 'tech_security' ELSE 'general_support' END ELSE recipients END AS recipients2,
  CASE WHEN quality2 = 'failed' THEN 'OCR FAILED — transcrição manual necessária' WHEN disposition2 = 'unknown' THEN 'Em revisão — ocorrências não confirmadas' WHEN len(waits) > 0 THEN 'Em revisão — ' || len(waits) || ' campo(s) pendente(s)' ELSE 'Pronto para gerar/aprovar' END AS status FROM waiting2)"""


def reviewed(spark, d):
    base = sheets(spark, d, truth=True)
    return edits.edited(classify.classified(critic.states(base)), made_edits(base))


@query(f"WITH {EDITED} SELECT sheet_id, error, disposition2 AS disposition, array_to_string(waits, ',') AS pending, quality2 AS quality, kind2 AS incident_type, recipients2 AS recipients, status FROM reviewed")
def edited_sheets(spark, d):
    return reviewed(spark, d).select("sheet_id", "error", "disposition", F.array_join("pending", ",").alias("pending"), "quality", "incident_type", F.array_join("recipients", ",").alias("recipients"), "status")


@query(
    f"""WITH {EDITED}, timed2 AS (SELECT *, regexp_extract_all(hora, '{forms.CLOCK}') AS t FROM edit_rows),
described2 AS (SELECT sheet_id, pos, item, CASE WHEN len(t) = 0 THEN descricao ELSE array_to_string(t[1:2], '-') || ' - ' || descricao END AS text FROM timed2)
SELECT r.sheet_id, CASE WHEN now = 'present' THEN pos ELSE 0 END AS pos, coalesce(new_date, '(revisar)') AS dia, coalesce(new_unit, '(revisar)') AS unidade, CASE now WHEN 'present' THEN item WHEN 'unknown' THEN '(ocorrências não confirmadas)' ELSE 'Sem alteração' END AS objeto,
  CASE WHEN now = 'present' THEN d.text ELSE '' END AS descricao FROM reviewed r LEFT JOIN described2 d ON d.sheet_id = r.sheet_id AND now = 'present' WHERE error IS NULL"""
)
def edited_spreadsheet(spark, d):
    return spread(edits.with_spreadsheet(reviewed(spark, d)), "shown", "sheet_id").withColumn("pos", F.col("pos").cast("long"))


EXPORTS = EDITED + f""",
timed2 AS (SELECT *, regexp_extract_all(hora, '{forms.CLOCK}') AS t FROM edit_rows),
described2 AS (SELECT sheet_id, pos, item, CASE WHEN len(t) = 0 THEN descricao ELSE array_to_string(t[1:2], '-') || ' - ' || descricao END AS text FROM timed2),
shown AS (SELECT r.sheet_id, len(waits) AS n_waits, pages, waits, CASE WHEN now = 'present' THEN pos ELSE 0 END AS pos, coalesce(new_date, '(revisar)') AS dia, coalesce(new_unit, '(revisar)') AS unidade, CASE now WHEN 'present' THEN item WHEN 'unknown' THEN '(ocorrências não confirmadas)' ELSE 'Sem alteração' END AS objeto,
  CASE WHEN now = 'present' THEN d.text ELSE '' END AS descricao FROM reviewed r LEFT JOIN described2 d ON d.sheet_id = r.sheet_id AND now = 'present' WHERE error IS NULL)"""


def _safe(c: str) -> str:
    return rf"CASE WHEN regexp_matches({c}, '^[=+\-@\p{{Cc}}\p{{Cf}}\p{{Z}}\s]') THEN '''' || {c} ELSE {c} END"


def exported(spark, d):
    return contracts.export(edits.with_spreadsheet(reviewed(spark, d)).select("sheet_id", "blockers", "shown"))


@query(f'WITH {EXPORTS} SELECT sheet_id, pos, {_safe("dia")} AS "DIA", {_safe("unidade")} AS "UNIDADE", {_safe("objeto")} AS "OBJETO", {_safe("descricao")} AS "DESCRICAO" FROM shown WHERE n_waits = 0 AND pages = 1')
def csv_export_rows(spark, d):
    """Rows of reviewed sheets that nothing blocks, as they go to a CSV file."""
    return exported(spark, d)[0].withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""WITH {EXPORTS} SELECT sheet_id, 'export_csv' AS action, 'rows=' || count(*) AS detail FROM shown WHERE n_waits = 0 AND pages = 1 GROUP BY 1
UNION ALL SELECT DISTINCT sheet_id, 'export_blocked', 'pending: ' || array_to_string(CASE WHEN pages > 1 THEN ['multipage'] ELSE [] END || waits, ', ') FROM shown WHERE n_waits > 0 OR pages > 1"""
)
def csv_export_audit(spark, d):
    return exported(spark, d)[1]


@query(f"WITH {EDITED} SELECT status, coalesce(error, 'accepted') AS error, count(*) AS n FROM reviewed GROUP BY ALL")
def edited_status(spark, d):
    return reviewed(spark, d).groupBy("status", F.coalesce("error", F.lit("accepted")).alias("error")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {B.STATES} SELECT sheet_id, CASE WHEN quality = 'failed' THEN 'OCR FAILED — transcrição manual necessária' WHEN disposition = 'unknown' THEN 'Em revisão — ocorrências não confirmadas'
  WHEN len(pending) > 0 THEN 'Em revisão — ' || len(pending) || ' campo(s) pendente(s)' ELSE 'Pronto para gerar/aprovar' END AS status FROM states"""
)
def document_status(spark, d):
    s = critic.states(sheets(spark, d))
    return s.select("sheet_id", edits.document_status(F.col("quality"), F.col("disposition"), F.col("pending")).alias("status"))


LATE = B.CLASSIFIED.replace("FROM drawn)", "FROM drawn), read_sheets AS (SELECT * REPLACE (CASE WHEN (sheet_id % 500) / 100 > " + str(BUDGET) + " THEN '' ELSE text END AS text) FROM sheets)", 1).replace("FROM sheets)),\nlines", "FROM read_sheets)),\nlines", 1).replace("FROM sheets s LEFT JOIN (SELECT sheet_id, bool_and", "FROM read_sheets s LEFT JOIN (SELECT sheet_id, bool_and", 1)
_BLOCKED = edits.BLOCKED.replace("\n", "' || chr(10) || '").replace("{}", "' || reason2 || '")


@query(
    f"""WITH {LATE}, fates AS (SELECT *, (sheet_id % 500) / 100 > {BUDGET} AS late, CASE WHEN (sheet_id % 500) / 100 > {BUDGET} THEN 'processing deadline exceeded' WHEN quality = 'failed' THEN 'too few words were read' END AS reason2 FROM classified)
SELECT sheet_id, late, greatest(0.0, {BUDGET} - (sheet_id % 500) / 100)::DOUBLE AS remaining, disposition, quality, incident_type, sector, '{_BLOCKED}' AS draft FROM fates WHERE reason2 IS NOT NULL"""
)
def blocked_drafts(spark, d):
    """Sheets that were read too late, or of which too little was read: they go through all stages and end with a message that says why."""
    base = sheets(spark, d)
    late = edits.timed_out(base, (F.col("sheet_id") % 500) / 100, BUDGET)
    rows = edits.quarantined(critic.states(late)).where("blocked_reason is not null")
    return rows.select("sheet_id", "late", F.col("remaining").cast("double").alias("remaining"), "disposition", "quality", "incident_type", "sector", "draft")


@query(
    """WITH posted AS (SELECT l_orderkey, list('occ__' || (l_linenumber % 12) || '__' || CASE l_suppkey % 9 WHEN 0 THEN 'hora' WHEN 1 THEN 'itens' ELSE 'item' END ORDER BY l_linenumber, l_suppkey) AS keys FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce(CASE WHEN len(list_filter(keys, lambda k: NOT regexp_matches(k, '^occ__([0-9]+)__(?:item|hora|descricao|acao|resolvido)$'))) > 0 THEN 'unknown key' WHEN len(list_distinct(keys)) < len(keys) THEN 'repeated key'
  WHEN len(list_filter(keys, lambda k: regexp_extract(k, '([0-9]+)')::INT NOT BETWEEN 1 AND 10)) > 0 THEN 'number out of range' END, 'ok') AS error FROM posted"""
)
def form_keys(spark, d):
    field = F.when(F.col("l_suppkey") % 9 == 0, "hora").when(F.col("l_suppkey") % 9 == 1, "itens").otherwise("item")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.concat(F.lit("occ__"), (F.col("l_linenumber") % 12).cast("string"), F.lit("__"), field).alias("key"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "key"))), lambda x: x["key"])
    return rows.groupBy("l_orderkey").agg(keys.alias("keys")).select("l_orderkey", F.coalesce(forms.key_error(F.col("keys")), F.lit("ok")).alias("error"))


@query(
    f"""WITH given AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'other_report' ELSE 'controle_ocorrencias' END AS report_type, CASE WHEN o_orderkey % 5 = 0 THEN sha256(o_orderstatus) ELSE '{fingerprint()}' END AS config_sha FROM orders)
SELECT o_orderkey, report_type = 'controle_ocorrencias' AND config_sha = '{fingerprint()}' AS compatible FROM given"""
)
def config_compatible(spark, d):
    """Drafts made under another report or another configuration aren't touched."""
    k = F.col("o_orderkey")
    given = table(spark, d, "orders").select(
        k, F.when(k % 3 == 0, "other_report").otherwise("controle_ocorrencias").alias("report_type"), F.when(k % 5 == 0, F.sha2("o_orderstatus", 256)).otherwise(fingerprint()).alias("config_sha")
    )
    return given.select("o_orderkey", compatible(F.col("report_type"), F.col("config_sha")).alias("compatible"))


@query(
    """WITH fields AS (SELECT o_orderkey AS doc_id, unnest([{'name': 'date', 'value': CASE WHEN o_orderkey % 7 = 0 THEN '31/02/2026' WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%d/%m/%Y') END, 'confidence': (o_orderkey % 10) / 10},
  {'name': 'done', 'value': CASE o_orderstatus WHEN 'O' THEN 'sim' WHEN 'P' THEN 'maybe' ELSE ' ' END, 'confidence': 0.9}, {'name': 'priority', 'value': o_orderpriority, 'confidence': 0.9}], recursive := true) FROM orders),
spec(name, kind, required, allowed) AS (VALUES ('date', 'date', true, []), ('done', 'bool', false, []), ('priority', 'enum', true, ['1-URGENT', '2-HIGH']), ('note', 'text', true, [])),
wanted AS (SELECT doc_id, spec.* FROM (SELECT DISTINCT doc_id FROM fields), spec),
j AS (SELECT w.*, value, coalesce(confidence, 0.0)::DOUBLE AS confidence, coalesce(trim(value), '') = '' AS empty FROM wanted w LEFT JOIN fields f USING (doc_id, name)),
e AS (SELECT *, CASE WHEN empty AND required THEN 'required field is missing' WHEN empty THEN NULL WHEN kind = 'date' AND try_strptime(value, '%d/%m/%Y') IS NULL THEN 'not a date'
  WHEN kind = 'bool' AND lower(value) NOT IN ('sim', 'nao', 'não', 'true', 'false', 'yes', 'no', 's', 'n', '1', '0') THEN 'not a boolean' WHEN kind = 'enum' AND NOT list_contains(allowed, value) THEN 'not an allowed value' END AS error FROM j)
SELECT doc_id, name, value, confidence, error IS NOT NULL OR (NOT empty AND confidence < 0.7) AS must_review, CASE WHEN empty THEN 'missing' WHEN error IS NOT NULL OR confidence < 0.7 THEN 'must_review' ELSE 'accepted' END AS status, CASE WHEN error IS NOT NULL THEN name || ': ' || error END AS error FROM e"""
)
def scalar_critic(spark, d):
    """Fields of a report without a table, and one that is never found."""
    k = F.col("o_orderkey")
    date = F.when(k % 7 == 0, "31/02/2026").when(k % 11 == 0, F.lit(None)).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    done = F.when(F.col("o_orderstatus") == "O", "sim").when(F.col("o_orderstatus") == "P", "maybe").otherwise(" ")
    each = [("date", date, (k % 10) / 10), ("done", done, F.lit(0.9)), ("priority", F.col("o_orderpriority"), F.lit(0.9))]
    given = table(spark, d, "orders").select(k.alias("doc_id"), F.inline(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value"), c.alias("confidence")) for n, v, c in each))))
    spec = [("date", "date", True, []), ("done", "bool", False, []), ("priority", "enum", True, ["1-URGENT", "2-HIGH"]), ("note", "text", True, [])]
    return critic.scalar_fields(given, spark.createDataFrame(spec, "name string, kind string, required boolean, allowed array<string>"))


@query(f"WITH {B.SEGMENTS} SELECT sheet_id, pos::BIGINT AS pos, true AS needs_review FROM segments WHERE NOT no_change")
def rows_need_review(spark, d):
    """Item, action and choice of a row are never read by rule, so every row waits."""
    rows = extract.segments(sheets(spark, d)).where("not no_change")
    return rows.select("sheet_id", F.col("pos").cast("long").alias("pos"), critic.row_needs_review(F.struct("hora", "content")).alias("needs_review"))


@query("SELECT event_id % 100 AS bucket, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 10")
def first_buckets(spark, d):
    """The first n after a total order; the limit is the feature."""
    return L.first_n(table(spark, d, "events").groupBy((F.col("event_id") % 100).alias("bucket")).agg(F.count("*").alias("n")), 10, "bucket")
