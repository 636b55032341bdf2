"""The two outputs of a sheet: spreadsheet rows and the message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, spread
from ..functions.text import as_text, blank, strip
from .extract import entry_time, exit_time

# Texts that outputs show.
PENDING, NOT_CONFIRMED, NO_CHANGE = "(revisar)", "(ocorrências não confirmadas)", "Sem alteração"
TABLE_HEAD = "DIA | UNIDADE | OBJETO | DESCRIÇÃO"
GREETING, INCOMPLETE, WAITING = "Bom dia,", "RASCUNHO INCOMPLETO: corrija os campos pendentes.", "Pendências: "


def description(entry: Column, exit_: Column, text: Column) -> Column:
    """HH:MM - text, HH:MM-HH:MM - text, or what there is of it; an exit needs an entry."""
    hour = bound(F.struct(entry.alias("entry"), exit_.alias("exit")), lambda x: F.when(~blank(x["entry"]), F.concat_ws("-", x["entry"], x["exit"])).otherwise(F.lit("")))
    both = F.struct(hour.alias("hour"), F.coalesce(strip(text), F.lit("")).alias("words"))
    return bound(both, lambda x: F.when((x["hour"] != "") & (x["words"] != ""), F.concat(x["hour"], F.lit(" - "), x["words"])).otherwise(F.concat(x["hour"], x["words"])))


def _headed(states: DataFrame) -> DataFrame:
    """The states with what each row of the spreadsheet repeats."""
    return states.withColumns({n: F.coalesce(as_text(F.col(c)), F.lit(PENDING)) for n, c in (("_day", "data_turno"), ("_unit", "unidade"))})


def _rows(states: DataFrame) -> Column:
    """Of _headed() states: the spreadsheet's rows as an array of pos, dia, unidade, objeto, descricao."""
    day, unit = F.col("_day"), F.col("_unit")

    def row(pos: Column, what: Column, text: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), day.alias("dia"), unit.alias("unidade"), what.alias("objeto"), text.alias("descricao"))

    # places among all rows of the sheet
    placed = F.transform(states["rows"], lambda r, i: F.struct((i + 1).alias("pos"), r.alias("r")))
    timed = F.transform(
        F.filter(placed, lambda x: ~x["r"]["no_change"]),
        lambda x: F.struct(x["pos"], x["r"]["content"], entry_time(x["r"]["hora"]).alias("entry"), exit_time(x["r"]["hora"]).alias("exit")),
    )
    read = F.transform(timed, lambda x: row(x["pos"], F.lit(PENDING), description(x["entry"], x["exit"], x["content"])))
    single = row(F.lit(0), F.when(F.col("disposition") == "unknown", NOT_CONFIRMED).otherwise(NO_CHANGE), F.lit(""))
    return F.when(F.col("disposition") == "present", read).otherwise(F.array(single))


def spreadsheet(states: DataFrame) -> DataFrame:
    """sheet_id, pos, dia, unidade, objeto, descricao: a row for each occurrence, or one that says that there is none."""
    states = _headed(states)
    return spread(states, _rows(states), "sheet_id")


def messages(states: DataFrame) -> DataFrame:
    """sheet_id, message: greeting and table, or what is pending and the table."""
    states = _headed(states)
    lines = F.transform(_rows(states), lambda r: F.rtrim(F.concat_ws(" | ", r["dia"], r["unidade"], r["objeto"], r["descricao"])))
    guards = F.when(F.size("guards") > 0, F.array_join("guards", ", ")).otherwise(F.lit(PENDING))
    tail = F.concat(F.lit(TABLE_HEAD + "\n"), F.array_join(lines, "\n"), F.lit("\n\nVigilantes: "), guards)
    blocked = F.concat(F.lit(INCOMPLETE + "\n" + WAITING), F.array_join("blockers", ", "), F.lit("\n\n"))
    message = F.concat(F.when(F.size("blockers") > 0, blocked).otherwise(GREETING + "\n\n"), tail)
    return states.select("sheet_id", message.alias("message"))
