"""From the reader's text to the sheet's model: lines, table region, rows, header, disposition."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HEADER_FIELDS
from ..functions.arrays import bound, spread
from ..functions.text import WHITE, as_text, strip

# The patterns of the form. A table's header line, its footer, an explicit "no change", clock times, separators of names.
TABLE_HEADER = rf"(?i)^{WHITE}*[il]tem\b.*\bhora\b.*(?:descri|ocorr)"
FOOTER = rf"(?i)^{WHITE}*ronda(?:{WHITE}*[:\-]?{WHITE}*(?:x|ok))?{WHITE}*$"
NO_CHANGE = rf"(?i)^[S5]{WHITE}*[/|1lI]{WHITE}*A$"
CLOCK = r"[0-9]{1,2}:[0-9]{2}"
GUARD_SEPARATOR = rf"{WHITE}*(?:,|;|\be\b|/){WHITE}*"
# line ends as Python's splitlines() has them
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
PAGE_END = rf"(?:{LINE_END})\z"
# the same within a page, and those that few texts have
LINE_END_IN_PAGE, OTHER_END = r"\r\n|[\r\x0B\x1C-\x1E\x85\x{2028}\x{2029}]", r"[\r\x0B\x1C-\x1E\x85\x{2028}\x{2029}]"
# white space that ends no line
BLANK = r"[\t\x{1f}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
# the same patterns for pages whose lines end in \n: a page from its table's header on, its footer and what follows, the header line and white
# space at the ends of lines, a whole line
FROM_HEADER = rf"(?im)^{BLANK}*[il]tem\b.*\bhora\b.*(?:descri|ocorr)(?s:.*)"
TO_FOOTER = rf"(?im)\n{BLANK}*ronda(?:{BLANK}*[:\-]?{BLANK}*(?:x|ok))?{BLANK}*$(?s:.*)"
ROW_ENDS = rf"\A[^\n]*\n?|(?<=\n){BLANK}++|(?<!{BLANK}){BLANK}++(?=\n|\z)"
NO_CHANGE_LINE = rf"(?im)^[S5]{BLANK}*[/|1lI]{BLANK}*A$"
YES, NO = ("sim", "s", "resolvido", "yes", "y"), ("nao", "não", "n", "no")


def lines(sheets: DataFrame) -> DataFrame:
    """sheet_id, page, ln, line; a line end at the end of a page begins no further line."""
    pages = sheets.select("sheet_id", F.posexplode(F.split("text", "\f")).alias("page", "page_text"))
    pages = pages.withColumn("page_text", F.regexp_replace("page_text", PAGE_END, ""))
    return pages.select("sheet_id", "page", F.posexplode(F.split("page_text", LINE_END, -1)).alias("ln", "line"))


def regions(sheets: DataFrame) -> DataFrame:
    """The lines with head and foot, the places of the page's table header and of the footer after it; null where there is
    none. One shuffle, by sheet and page, serves both."""
    page = Window.partitionBy("sheet_id", "page")
    found = lines(sheets).withColumn("head", F.min(F.when(F.col("line").rlike(TABLE_HEADER), F.col("ln"))).over(page))
    return found.withColumn("foot", F.min(F.when(F.col("line").rlike(FOOTER) & (F.col("ln") > F.col("head")), F.col("ln"))).over(page))


def _whole(text: Column) -> Column:
    """The text with every line end as \\n, and none at the end of a page."""
    ends = F.when(text.rlike(OTHER_END), F.regexp_replace(text, LINE_END_IN_PAGE, "\n")).otherwise(text)
    return F.regexp_replace(ends, r"\n(?=\f|\z)", "")


def _page_rows(page: Column) -> Column:
    """The rows of one page's table: lines of its region that follow each other, joined; a no-change is a row of one page end, which no line holds.
    Every pattern works on the whole page, and each is applied once."""
    region = F.regexp_replace(F.regexp_replace(page, TO_FOOTER, ""), ROW_ENDS, "")
    marked = F.regexp_replace(F.regexp_replace(region, NO_CHANGE_LINE, "\n\n\f\n\n"), r"(?<=[^\n])\n(?=[^\n])", " ")
    return F.filter(F.split(marked, "\n"), lambda row: row != "")


def parsed(sheets: DataFrame) -> DataFrame:
    """The sheets with whole (the text with plain line ends), page_rows (null for a page without a table) and rows: an array of page,
    no_change, content, hora.

    All of a sheet is read inside its row, without a shuffle: lines that follow each other are one row; empty lines and explicit
    no-changes part them.
    """
    found = sheets.withColumn("whole", _whole(F.col("text")))
    # from the table's header line on; empty without one
    tables = F.transform(F.split("whole", "\f"), lambda page: F.regexp_extract(page, FROM_HEADER, 0))
    found = found.withColumn("page_rows", F.transform(tables, lambda page: F.when(page != "", _page_rows(page))))

    def read(row: Column, page: Column) -> Column:
        return F.struct(page.alias("page"), (row == "\f").alias("no_change"), row.alias("row"), F.array_join(F.regexp_extract_all(row, F.lit(CLOCK), F.lit(0)), " ").alias("times"))

    def cells(x: Column) -> Column:
        return F.struct(x["page"], x["no_change"], F.when(~x["no_change"], x["row"]).alias("content"), F.when(x["times"] != "", x["times"]).alias("hora"))

    rows = F.transform("page_rows", lambda page, i: F.transform(F.coalesce(page, F.array().cast("array<string>")), lambda row: read(row, i)))
    return found.withColumn("rows", F.transform(F.flatten(rows), cells))


def with_lines(parsed: DataFrame) -> DataFrame:
    """parsed() with low_lines: an array of page, line, low (in lower case)."""
    low = F.transform(F.split("whole", "\f"), lambda page, i: F.transform(F.split(page, "\n"), lambda line: F.struct(i.alias("page"), line.alias("line"), F.lower(line).alias("low"))))
    return parsed.withColumn("low_lines", F.flatten(low))


def segments(sheets: DataFrame) -> DataFrame:
    """sheet_id, pos, page, no_change, content, hora: the rows of the tables, one each."""
    return spread(parsed(sheets), "rows", "sheet_id", place="pos").withColumn("pos", F.col("pos") + 1)


def header_value(labels: tuple[str, ...]) -> Column:
    """struct(page, evidence, value) of a field: the text after its label. Labels in order of preference, then pages, then lines;
    a label stands anywhere in its line, in any case, and counts only with a value after it."""

    def after(x: Column, label: str) -> Column:
        at = F.instr(x["low"], label)
        return strip(F.regexp_replace(F.substring(x["line"], at + len(label), F.length(x["line"])), r"^[ :\t]+", ""))

    def hits(label: str) -> Column:
        # only lines that hold the label are worked on
        lines = F.filter("low_lines", lambda x: F.contains(x["low"], F.lit(label)))
        return F.filter(F.transform(lines, lambda x: F.struct(x["page"].alias("page"), strip(x["line"]).alias("evidence"), after(x, label).alias("value"))), lambda x: x["value"] != "")

    return F.get(F.concat(*map(hits, _sought(labels))), F.lit(0))


def _sought(labels: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys(label.rstrip(":").lower() for label in labels))


@cache
def _letter(c: str) -> str:
    """A pattern of the characters that are c in lower case."""
    return "[" + "".join(rf"\x{{{ord(x):x}}}" for x in map(chr, range(0x10000)) if x == c or x.lower() == c) + "]"


def header_text(labels: tuple[str, ...]) -> Column:
    """The value of header_value() alone, from parsed()'s text by one pattern a label; labels after one that was found aren't looked for."""

    def found(label: str) -> Column:
        value = strip(F.regexp_extract("whole", rf"{''.join(map(_letter, label))}[ :\t]*+{BLANK}*+([^\n\f]+)", 1))
        return F.get(F.filter(F.array(value), lambda v: v != ""), F.lit(0))

    return F.coalesce(*map(found, _sought(labels)))


def header(sheets: DataFrame) -> DataFrame:
    """sheet_id, field, value, evidence, page: the header fields that were found."""
    fields = F.array(*(F.struct(F.lit(name).alias("field"), header_value(labels).alias("x")) for name, labels in HEADER_FIELDS.items()))
    return spread(with_lines(parsed(sheets)), fields, "sheet_id").where("x is not null").select("sheet_id", "field", "x.value", "x.evidence", "x.page")


def entry_time(hora: Column) -> Column:
    """The first clock time, else the text as it is."""
    return bound(as_text(hora), lambda x: F.coalesce(F.get(F.regexp_extract_all(x, F.lit(CLOCK), F.lit(0)), F.lit(0)), x))


def exit_time(hora: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(as_text(hora), F.lit(CLOCK), F.lit(0)), F.lit(2))


def resolved(c: Column) -> Column:
    low = F.lower(as_text(c))
    return F.when(low.isin(*YES), True).when(low.isin(*NO), False)


def guards(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(as_text(c), F.lit("")), GUARD_SEPARATOR), strip)
    return F.filter(parts, lambda x: x != "")


def models(sheets: DataFrame) -> DataFrame:
    """The sheets with rows, header values, whether every page has a table, and the disposition: present if there is any occurrence;
    else unknown if a table is missing, none on an explicit no-change, unknown otherwise. No shuffle."""
    whole = parsed(sheets)
    whole = whole.withColumns({name: header_text(labels) for name, labels in HEADER_FIELDS.items()})
    whole = whole.withColumns(
        {
            "pages": F.size("page_rows"),
            "table_found": F.forall("page_rows", lambda page: page.isNotNull()),
            "occurrences": F.size(F.filter("rows", lambda r: ~r["no_change"])).cast("long"),
            "no_changes": F.size(F.filter("rows", lambda r: r["no_change"])).cast("long"),
            "guards": guards(F.col("vigilantes")),
        }
    )
    disposition = F.when(F.col("occurrences") > 0, "present").when(~F.col("table_found"), "unknown").when(F.col("no_changes") > 0, "none").otherwise("unknown")
    return whole.withColumn("disposition", disposition).drop("whole", "page_rows")


def occurrences(models: DataFrame) -> Column:
    """Of models(): the rows that are occurrences, in order."""
    return F.filter(models["rows"], lambda r: ~r["no_change"])
