"""Words of a reader: boxes, lines, pages, and where on the page a value was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, strip, token, tokens

#: Overshoot of a box over the page that is cut off; more makes the box invalid.
OVERSHOOT = 0.01


def synthetic(docs: DataFrame) -> DataFrame:
    """doc_id, page, line, pos, word, conf, left, top, width, height: words of texts as a reader would give them, on pages of 1000
    by 1000 with a line a text line. Every 17th word is unreadable (-1), every 29th has no width, every 31st hangs over."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("doc_id", "line", F.posexplode(F.filter(F.split(strip(F.col("t")), f"{WHITE}+"), lambda w: w != "")).alias("pos", "word"))
    return words.selectExpr(
        "doc_id", "line % 3 AS page", "line", "pos", "word",
        "CASE WHEN (doc_id + pos) % 17 = 0 THEN -1 ELSE (doc_id * 7 + pos * 13 + line) % 101 END AS conf",
        "(pos * 37) % 950 AS `left`", "(line * 53) % 970 AS top",
        "CASE WHEN (doc_id + pos) % 29 = 0 THEN 0 WHEN (doc_id + pos) % 31 = 0 THEN 1005 - (pos * 37) % 950 ELSE 40 END AS width", "20 AS height",
    )


def of_lines(docs: DataFrame) -> DataFrame:
    """doc_id, page, line, pos, word, line_key, x0, y0, x1, y1: words of whole texts (doc_id, text), pages parted by form feeds, each word in
    a box of its place in its line."""
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "t"))
    lines = pages.select("doc_id", "page", F.posexplode(F.split("t", "\n")).alias("line", "t"))
    words = lines.select("doc_id", "page", "line", F.posexplode(F.filter(F.split(strip(F.col("t")), f"{WHITE}+"), lambda w: w != "")).alias("pos", "word"))
    x, y = (F.col("pos") % 19) * 0.05, (F.col("line") % 49) * 0.02
    return words.select("*", F.concat_ws(":", F.lit("1"), "page", "line").alias("line_key"), x.alias("x0"), y.alias("y0"), (x + 0.04).alias("x1"), (y + 0.015).alias("y1"))


def attach_evidence(fields: DataFrame, words: DataFrame | None) -> DataFrame:
    """The fields (doc_id, ord, value, ...; page and source if there are such) with page, x0, y0, x1, y1, evidence_method, evidence_score: where
    each was read. Nothing else of a field changes. A field without a page is looked for on the first; one that a human wrote gets no
    place; without words nothing is located."""
    if words is None:
        return fields
    page = F.coalesce("page", F.lit(0)) if "page" in fields.columns else F.lit(0)
    human = F.coalesce(F.col("source") == "human", F.lit(False)) if "source" in fields.columns else F.lit(False)
    rows = fields.withColumn("page", page.cast("int"))
    asked = rows.where(~human).select("doc_id", "page", F.col("ord").alias("value_id"), "value")
    found = located(words, asked).select("doc_id", F.col("value_id").alias("ord"), F.col("method").alias("evidence_method"), F.col("score").alias("evidence_score"), "x0", "y0", "x1", "y1")
    return rows.join(found, ["doc_id", "ord"], "left")


def clamp(x: Column) -> Column:
    """Into [0, 1]; null beyond the overshoot."""
    return F.when((x >= -OVERSHOOT) & (x <= 1 + OVERSHOOT), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def boxes(words: DataFrame, page_width: float = 1000.0, page_height: float = 1000.0) -> DataFrame:
    """Readable words with fractions of the page as boxes and a line key; what lies outside or has no area goes."""
    out = words.where("conf >= 0 and width > 0 and height > 0 and trim(word) <> ''").select(
        "doc_id", "page", "line", "pos", "word", F.least(F.lit(1.0), F.col("conf") / 100.0).alias("conf"), F.concat_ws(":", F.lit("1"), "page", "line").alias("line_key"),
        clamp(F.col("left") / page_width).alias("x0"), clamp(F.col("top") / page_height).alias("y0"),
        clamp((F.col("left") + F.col("width")) / page_width).alias("x1"), clamp((F.col("top") + F.col("height")) / page_height).alias("y1"),
    )
    return out.where("x0 < x1 and y0 < y1")


def reconstructed(words: DataFrame) -> DataFrame:
    """doc_id, page, text, confidence: words joined to lines and lines to text; unreadable words stay in the text but not in the mean."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    good = F.when(F.col("conf") >= 0, F.col("conf"))
    lines = words.groupBy("doc_id", "page", "line").agg(line.alias("t"), F.sum(good).alias("s"), F.count(good).alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")
    mean = F.coalesce(F.try_divide(F.sum("s"), F.sum("n")) / 100, F.lit(0.0))
    return lines.groupBy("doc_id", "page").agg(text.alias("text"), mean.alias("confidence"))


def transcribed(pages: DataFrame) -> DataFrame:
    """doc_id, text, confidence, source: pages joined in order; the confidence of the worst page, 0 without pages; what read the first page.
    Each page's words carry its number already."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\f\n")
    source = F.min_by("source", "page") if "source" in pages.columns else F.lit(None).cast("string")
    return pages.groupBy("doc_id").agg(text.alias("text"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"), source.alias("source"))


def located(words: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, value_id, method, score, x0, y0, x1, y1, n_words: where each value (doc_id, value_id, value) was most likely read on its page.

    exact: the first run of words equal to the value's tokens; token_window: the line with most different tokens of it, the
    earlier of equals; none otherwise. Words are looked up by equal tokens, so nothing is compared with everything.
    """
    w = words.select("doc_id", "page", "line_key", "x0", "y0", "x1", "y1", F.row_number().over(_order()).alias("at"), token(F.col("word")).alias("t"))
    v = values.withColumn("wanted", tokens(F.col("value"))).where(F.size("wanted") > 0).withColumn("n", F.size("wanted"))
    spread = v.select("doc_id", "page", "value_id", "n", F.posexplode("wanted").alias("k", "t"))
    hits = w.join(spread, ["doc_id", "page", "t"])
    key = ["doc_id", "page", "value_id"]
    # a run that begins at word b has token k at b + k
    runs = hits.groupBy(*key, "n", (F.col("at") - F.col("k")).alias("b")).agg(F.count("*").alias("m"), *_union()).where("m = n")
    exact = runs.groupBy(*key).agg(F.min_by(F.struct("x0", "y0", "x1", "y1", "n"), "b").alias("e"))
    lines = hits.groupBy(*key, "line_key").agg(F.countDistinct("t").alias("c"), F.min("at").alias("first"), F.countDistinct("at").alias("n"), *_union())
    best = lines.groupBy(*key).agg(F.min_by(F.struct("c", "x0", "y0", "x1", "y1", "n"), F.struct(-F.col("c"), F.col("first"))).alias("l"))
    out = values.select(*key, "value").join(exact, key, "left").join(best, key, "left")
    method = F.when(F.col("e").isNotNull(), "exact").when(F.col("l").isNotNull(), "token_window").otherwise("none")
    score = F.when(F.col("e").isNotNull(), 1.0).when(F.col("l").isNotNull(), F.col("l.c") / F.size(F.array_distinct(tokens(F.col("value"))))).otherwise(0.0)
    pick = lambda x: F.coalesce(F.col(f"e.{x}"), F.col(f"l.{x}")).alias(x)
    return out.select("doc_id", "value_id", method.alias("method"), score.alias("score"), *map(pick, ("x0", "y0", "x1", "y1")), F.coalesce("e.n", "l.n").cast("long").alias("n_words"))


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "page").orderBy("line", "pos")


def _union() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
