"""What a human's review does to a sheet: rows checked, disposition resolved, fields rebuilt, class, route and outputs derived again; and
the branch of sheets that couldn't be read in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.text import as_text
from . import classify, extract, forms, outputs

# Texts of the review.
NO_CHANGE_TEXT, NO_CHANGE_SHOWN, NO_DESCRIPTION = "sem alteração", "(sem alteração)", "(sem descrição)"
STATUS_FAILED, STATUS_UNKNOWN = "OCR FAILED — transcrição manual necessária", "Em revisão — ocorrências não confirmadas"
STATUS_PENDING, STATUS_READY = "Em revisão — {} campo(s) pendente(s)", "Pronto para gerar/aprovar"
BLOCKED = (
    "RASCUNHO BLOQUEADO — qualidade do OCR insuficiente.\n"
    "Motivo: {}\n"
    "Faça a transcrição/correção manual dos campos obrigatórios na revisão; "
    "o rascunho operacional só é gerado quando os dados estiverem confirmados."
)
EDIT_ROWS = "array<struct<item:string,hora:string,descricao:string,acao:string,resolvido:string>>"


def _formatted(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def document_status(quality: Column, disposition: Column, pending: Column) -> Column:
    """What the review screen says of a sheet."""
    n = F.size(pending)
    return F.when(quality == "failed", STATUS_FAILED).when(disposition == "unknown", STATUS_UNKNOWN).when(n > 0, _formatted(STATUS_PENDING, n)).otherwise(STATUS_READY)


def blocked_message(reason: Column) -> Column:
    """The only output of a sheet that gave nothing to review."""
    return _formatted(BLOCKED, reason)


def timed_out(sheets: DataFrame, elapsed: Column, budget: float) -> DataFrame:
    """The sheets with remaining (seconds) and late; what was read too late counts as nothing read, and goes on through all stages."""
    late = elapsed > budget
    return sheets.withColumn("remaining", F.greatest(F.lit(0.0), F.lit(budget) - elapsed)).withColumn("late", late).withColumn("text", F.when(~late, F.col("text")).otherwise(""))


def quarantined(states: DataFrame) -> DataFrame:
    """classify.classified() of states, with draft: the message, or for failed readings why there is none. No sheet is lost."""
    found = classify.classified(states)
    reason = F.when(F.col("late"), "processing deadline exceeded").when(F.col("quality") == "failed", "too few words were read")
    drafts = outputs.messages(found).withColumnRenamed("message", "_message")
    return found.withColumn("blocked_reason", reason).join(drafts, "sheet_id").withColumn("draft", F.coalesce(blocked_message(F.col("blocked_reason")), F.col("_message"))).drop("_message")


def occurrence(row: Column) -> Column:
    """A checked row, its values trimmed, as an occurrence: category, entry_time, exit_time, description, action, resolved."""
    times = F.regexp_extract_all(F.coalesce(row["hora"], F.lit("")), F.lit(forms.CLOCK), F.lit(0))
    return bound(
        times,
        lambda t: F.struct(
            row["item"].alias("category"), F.get(t, F.lit(0)).alias("entry_time"), F.get(t, F.lit(1)).alias("exit_time"), row["descricao"].alias("description"),
            row["acao"].alias("action"), (row["resolvido"] == "sim").alias("resolved"),
        ),
    )


def revised_content(disposition: Column, occurrences: Column) -> Column:
    """The reviewed content as text, which classes and routes derive from."""
    lines = F.transform(occurrences, lambda o: F.concat_ws(" ", o["category"], o["description"], o["action"]))
    return F.when(disposition == "none", NO_CHANGE_TEXT).otherwise(F.array_join(lines, "\n"))


def _field(name, value: Column, missing: Column, source: Column, shown: Column) -> Column:
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("name"), F.coalesce(value, shown).alias("value"), F.when(missing, 0.0).otherwise(1.0).alias("confidence"),
        F.when(missing, F.lit(None)).otherwise(source).alias("source"), F.when(missing, "missing").otherwise("accepted").alias("status"), missing.alias("must_review"),
    )


def reviewed_fields(disposition: Column) -> Column:
    """Inside edited(): three header fields, then five cells an occurrence, or one field for none and unknown; a human's values are accepted, and
    of the blanks only the required ones wait."""
    human, none = F.lit("human"), F.lit(None).cast("string")
    heads = [_field(n, v, v.isNull(), human, none) for n, v in (("data_turno", F.col("new_date")), ("vigilantes", F.nullif(F.array_join("new_guards", ", "), F.lit(""))), ("unidade", F.col("new_unit")))]

    def cells(o: Column, i: Column) -> Column:
        name = F.concat(F.lit("ocorrencia_"), (i + 1).cast("string"))
        time = F.nullif(F.concat_ws(" ", o["entry_time"], o["exit_time"]), F.lit(""))
        resolved = F.when(o["resolved"], "sim").when(~o["resolved"], "nao")
        never = F.lit(False)
        specs = [
            ("objeto", o["category"], o["category"].isNull(), F.lit(outputs.PENDING)), ("hora", time, never, none), ("descricao", o["description"], o["description"].isNull(), F.lit(NO_DESCRIPTION)),
            ("acao", o["action"], never, none), ("resolvido", resolved, never, none),
        ]
        return F.array(*(_field(F.concat(name, F.lit(f"_{n}")), v, m, human, shown) for n, v, m, shown in specs))

    reason = F.when(F.col("table_found"), "(nenhuma linha legível)").otherwise("(tabela não encontrada no OCR)")
    none_field = _field("ocorrencias", F.lit(NO_CHANGE_SHOWN), F.lit(False), human, none)
    unknown = F.struct(F.lit("ocorrencias").alias("name"), reason.alias("value"), F.lit(0.0).alias("confidence"), F.lit("rule").alias("source"), F.lit("must_review").alias("status"), F.lit(True).alias("must_review"))
    rest = F.when(disposition == "none", F.array(none_field)).when(disposition == "unknown", F.array(unknown)).otherwise(F.flatten(F.transform("edited_rows", cells)))
    return F.concat(F.array(*heads), rest)


def reviewed_pending(disposition: Column) -> Column:
    """The names of reviewed_fields() that wait: blank dates and units, sheets without guards, and what an occurrence needs."""
    heads = (("data_turno", F.col("new_date").isNull()), ("vigilantes", F.array_join("new_guards", ", ") == ""), ("unidade", F.col("new_unit").isNull()))
    pairs = F.transform("edited_rows", lambda o, i: F.struct(i.alias("i"), o["category"].isNull().alias("objeto"), o["description"].isNull().alias("descricao")))
    open_rows = F.filter(pairs, lambda x: x["objeto"] | x["descricao"])
    name = lambda x, c: F.when(x[c], F.concat(F.lit("ocorrencia_"), (x["i"] + 1).cast("string"), F.lit(f"_{c}")))
    cells = F.flatten(F.transform(open_rows, lambda x: F.array_compact(F.array(name(x, "objeto"), name(x, "descricao")))))
    empty = F.array().cast("array<string>")
    rest = F.when(disposition == "none", empty).when(disposition == "unknown", F.array(F.lit("ocorrencias"))).otherwise(cells)
    return F.concat(F.array_compact(F.array(*(F.when(waits, n) for n, waits in heads))), rest)


def edited(states: DataFrame, edits: DataFrame) -> DataFrame:
    """Reviewed sheets: classify.classified() of states, with edits (sheet_id, data_turno, vigilantes, unidade, radio, rows) applied.

    Each edit replaces all rows. error says what is wrong with one: a row's fault, too many rows, a conflict of choice and rows; such an edit
    changes nothing. Otherwise: disposition, edited_rows (occurrences), fields and pending are those of the human; a failed reading
    counts as low from now on; class and recipients follow from the reviewed content unless the disposition stays unknown; reason and
    blockers are judged again. One join on sheet_id; all else happens in the row.
    """
    kept = ["sheet_id", "disposition", "pending", "blockers", "quality", "incident_type", "urgency", "sector", "recipients", "pages", "table_found"]
    e = edits.select("sheet_id", *(F.col(c).alias(f"e_{c}") for c in ("data_turno", "vigilantes", "unidade", "radio", "rows")))
    s = states.select(*kept).join(e, "sheet_id")
    n = F.size("e_rows")
    # every value is trimmed once
    s = s.withColumn("e_rows", F.transform("e_rows", lambda r: F.struct(*(as_text(r[c]).alias(c) for c in ("item", "hora", "descricao", "acao", "resolvido")))))
    faults = F.filter(F.transform("e_rows", lambda r: forms.trimmed_row_error(n, r)), lambda x: x.isNotNull())
    judged = F.struct(F.get(faults, F.lit(0)).alias("fault"), forms.disposition(F.col("e_radio"), n, F.col("disposition")).alias("now"))
    s = s.withColumn("j", bound(judged, lambda j: F.struct(F.coalesce(j["fault"], F.when(j["now"].startswith("error:"), F.substring(j["now"], 7, 1000))).alias("error"), j["now"].alias("now"))))
    ok, now, failed = F.col("j.error").isNull(), F.col("j.now"), F.col("quality") == "failed"
    none = F.lit(None)
    s = s.select(
        "*", F.when(ok, as_text(F.col("e_data_turno"))).alias("new_date"), F.when(ok, as_text(F.col("e_unidade"))).alias("new_unit"), F.when(ok, extract.guards(F.col("e_vigilantes"))).alias("new_guards"),
        F.when(ok, F.transform(F.when(now == "present", F.col("e_rows")).otherwise(F.slice("e_rows", 1, 0)), occurrence)).alias("edited_rows"),
    )
    waiting = reviewed_pending(now)
    known = ok & (now != "unknown")
    content = revised_content(now, F.col("edited_rows"))

    def classed(kind: Column) -> Column:
        return F.struct(kind.alias("type"), classify.urgency_of(kind).alias("urgency"), classify.sector_of(kind).alias("sector"))

    s = s.withColumn("waits", F.when(ok, waiting).otherwise(F.col("pending"))).withColumn("c", F.when(known, bound(bound(content, classify.incident_type), classed)))
    routed = bound(F.col("c"), lambda c: classify.recipients(c["type"], c["urgency"], c["sector"]))
    multi = F.when(F.col("pages") > 1, F.array(F.lit("multipage"))).otherwise(F.array().cast("array<string>"))
    quality, disposition = F.when(ok & failed, "low").otherwise(F.col("quality")), F.when(ok, now).otherwise(F.col("disposition"))
    return s.select(
        "sheet_id", F.col("j.error").alias("error"), disposition.alias("disposition"), F.col("waits").alias("pending"), F.when(ok, F.concat(multi, "waits")).otherwise(F.col("blockers")).alias("blockers"),
        quality.alias("quality"), *(F.when(known, F.col(f"c.{a}")).otherwise(F.col(b)).alias(b) for a, b in (("type", "incident_type"), ("urgency", "urgency"), ("sector", "sector"))),
        F.when(known, routed).otherwise(F.col("recipients")).alias("recipients"), F.when(known, "reclassificado a partir da revisão humana").otherwise(none).alias("class_reason"),
        document_status(quality, disposition, F.col("waits")).alias("status"), "new_date", "new_unit", "new_guards", "edited_rows",
    )


def with_spreadsheet(reviewed: DataFrame) -> DataFrame:
    """edited() with shown: the sheet's spreadsheet as an array of pos, dia, unidade, objeto, descricao; none for an edit that was refused."""
    day, unit = (F.coalesce(F.col(c), F.lit(outputs.PENDING)) for c in ("new_date", "new_unit"))

    def row(pos: Column, what: Column, text: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), day.alias("dia"), unit.alias("unidade"), what.alias("objeto"), text.alias("descricao"))

    rows = F.transform("edited_rows", lambda o, i: row(i + 1, F.coalesce(o["category"], F.lit(outputs.PENDING)), outputs.description(o["entry_time"], o["exit_time"], o["description"])))
    single = F.array(row(F.lit(0), F.when(F.col("disposition") == "unknown", outputs.NOT_CONFIRMED).otherwise(outputs.NO_CHANGE), F.lit("")))
    accepted = F.when(F.col("disposition") == "present", rows).otherwise(single)
    return reviewed.withColumn("shown", F.when(F.col("error").isNull(), accepted).otherwise(F.filter(single, lambda _: F.lit(False))))
