"""Human edits: row checks, the conflict of radio and rows, budgets, small formulas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.text import WHITE, as_text

# Limits of the form and of page images; how a row's key and its time are written.
MOST_ROWS, ITEM_LIMIT, TIME_LIMIT, TEXT_LIMIT = 10, 200, 32, 4000
LONGEST_SIDE, MOST_BYTES, LEAST_DPI, MOST_DPI = 1800, 50 << 20, 50, 300
PAGE_PIXELS, ALL_PIXELS, MOST_PAGES = 25_000_000, 75_000_000, 1
CLOCK = "(?:[01][0-9]|2[0-3]):[0-5][0-9]"
TIME = f"^{CLOCK}(?:(?:{WHITE}*(?:-|–|a){WHITE}*|{WHITE}+){CLOCK})?$"
ROW_KEY = "^occ__([0-9]+)__(?:item|hora|descricao|acao|resolvido)$"
TIERS = ("ok", "warn", "fail")


def row_error(n: Column, item: Column, hora: Column, text: Column, action: Column, resolved: Column) -> Column:
    """What is wrong with a row of a form of n rows; null if nothing. Values count without white space at their ends."""
    values = zip(("item", "hora", "descricao", "acao", "resolvido"), (item, hora, text, action, resolved), strict=True)
    return bound(F.struct(*(as_text(v).alias(name) for name, v in values)), lambda r: trimmed_row_error(n, r))


def trimmed_row_error(n: Column, r: Column) -> Column:
    """The same of a row whose values are trimmed already, null where nothing is left."""
    return (
        F.when(n > MOST_ROWS, "too many rows").when(r["item"].isNull(), "item missing").when(F.length(r["item"]) > ITEM_LIMIT, "item too long")
        .when(F.length(r["hora"]) > TIME_LIMIT, "time too long").when(r["hora"].isNotNull() & ~r["hora"].rlike(TIME), "bad time")
        .when(r["descricao"].isNull(), "description missing").when(F.length(r["descricao"]) > TEXT_LIMIT, "description too long").when(F.length(r["acao"]) > TEXT_LIMIT, "action too long")
        .when(r["resolvido"].isNotNull() & ~r["resolvido"].isin("sim", "nao"), "bad choice")
    )


def key_error(keys: Column) -> Column:
    """What is wrong with the row keys of a posted form, an array in the order posted: an unknown one, one given twice, a number out of range;
    the first fault in this order. Keys of other parts of the form don't count."""
    own = F.filter(keys, lambda k: k.startswith("occ__"))
    number = lambda k: F.regexp_extract(k, ROW_KEY, 1).cast("decimal(38,0)")
    return (
        F.when(F.exists(own, lambda k: ~k.rlike(ROW_KEY)), "unknown key").when(F.size(F.array_distinct(own)) < F.size(own), "repeated key")
        .when(F.exists(own, lambda k: ~number(k).between(1, MOST_ROWS)), "number out of range")
    )


def disposition(radio: Column, rows: Column, current: Column | None = None) -> Column:
    """What a human's choice and rows mean together; error names the conflict. Without choice and rows what was there stays, but not if that
    was occurrences: then nobody knows whether they were taken back."""
    chosen = F.coalesce(radio, F.lit(""))
    stays = F.lit("error:no choice") if current is None else F.when(current == "present", "error:no choice").otherwise(current)
    return (
        F.when((chosen == "sem_alteracao") & (rows == 0), "none").when(chosen == "sem_alteracao", "error:rows with no change")
        .when((chosen == "com_ocorrencias") & (rows > 0), "present").when(chosen == "com_ocorrencias", "error:no rows")
        .when(rows > 0, "error:rows without choice").otherwise(stays)
    )


def downscaled(width: Column, height: Column) -> Column:
    """Dimensions with the longest side at most LONGEST_SIDE, none below 1; halves go to the even number."""
    scale = F.least(F.lit(1.0), F.lit(float(LONGEST_SIDE)) / F.greatest(width, height))
    return F.struct(*(F.greatest(F.lit(1), F.bround(side * scale).cast("long")).alias(n) for side, n in ((width, "w"), (height, "h"))))


def reject_reason(size: Column, dpi: Column, width: Column | None = None, height: Column | None = None, pages: Column | None = None) -> Column:
    """Why a file isn't decoded: bytes, resolution, pages, the pixels of its page and of all its pages; null if within the budget."""
    out = F.when(size > MOST_BYTES, "too many bytes").when((dpi < LEAST_DPI) | (dpi > MOST_DPI), "dpi out of range")
    if pages is not None:
        out = out.when(pages != MOST_PAGES, "not one page")
    if width is not None and height is not None:
        pixels = width.cast("long") * height.cast("long")
        out = out.when(pixels > PAGE_PIXELS, "too many pixels").when(pixels * (F.lit(1) if pages is None else pages) > ALL_PIXELS, "too many pixels in all")
    return out


def logprob_confidence(values: Column) -> Column:
    """The mean of exp, within [0, 1]; null without values."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x))
    return F.when(F.size(values) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / F.size(values))))


def occurrences_of(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def rate(n: Column, of: Column) -> Column:
    """With four places, null over 0."""
    return F.round(n / F.nullif(of, F.lit(0)), 4)


def wrapped(words: Column, width: int, measure: Callable[[Column], Column] = F.length) -> Column:
    """Lines of at most `width`: a word that overflows begins a line, one that is too long stands alone. measure gives the width of a line,
    its characters unless told otherwise. A fold over the words, for texts of form fields."""
    none = F.array().cast("array<string>")

    def add(out: Column, w: Column) -> Column:
        line = F.concat(F.element_at(out, -1), F.lit(" "), w)
        fits = (F.size(out) > 0) & (measure(line) <= width)
        return F.when(fits, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(line))).otherwise(F.concat(out, F.array(w)))

    return F.when(F.size(words) > 0, F.aggregate(words, none, add)).otherwise(none)
