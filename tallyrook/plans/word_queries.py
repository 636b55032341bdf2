"""Queries over a reader's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import words as W
from ..sources.sheets import table
from . import base_sql as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WORDS = rf"""split AS (SELECT doc_id, i - 1 AS line, list_filter(string_split_regex({B.strip('string_split(text, chr(10))[i]')}, '{B.WHITE}+'), lambda w: w <> '') AS ws FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
flat AS (SELECT doc_id, line, k - 1 AS pos, ws[k] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM split)),
words AS (SELECT doc_id, line % 3 AS page, line, pos, word, CASE WHEN (doc_id + pos) % 17 = 0 THEN -1 ELSE (doc_id * 7 + pos * 13 + line) % 101 END AS conf, (pos * 37) % 950 AS l, (line * 53) % 970 AS top,
  CASE WHEN (doc_id + pos) % 29 = 0 THEN 0 WHEN (doc_id + pos) % 31 = 0 THEN 1005 - (pos * 37) % 950 ELSE 40 END AS width, 20 AS height FROM flat),
cut AS (SELECT doc_id, page, line, pos, word, least(1.0, conf / 100.0) AS conf, concat_ws(':', '1', page, line) AS line_key, least(1.0, l / 1000.0) AS x0, least(1.0, top / 1000.0) AS y0, least(1.0, CASE WHEN (l + width) / 1000.0 <= 1.01 THEN (l + width) / 1000.0 END) AS x1x, (l + width) / 1000.0 AS raw, least(1.0, (top + height) / 1000.0) AS y1 FROM words WHERE conf >= 0 AND width > 0),
boxes AS (SELECT doc_id, page, line, pos, word, conf::DOUBLE AS conf, line_key, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1x::DOUBLE AS x1, y1::DOUBLE AS y1 FROM cut WHERE raw <= 1.01 AND x0 < x1x AND y0 < y1)"""


@query(f"WITH {WORDS} SELECT doc_id, page::BIGINT AS page, count(*) AS n, min(conf) AS least_conf, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY ALL")
def word_box_filter(spark, d):
    rows = W.boxes(W.synthetic(table(spark, d, "documents")))
    return rows.groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n"), F.min("conf").alias("least_conf"), *W._union())


PAGES = WORDS + """,
text_lines AS (SELECT doc_id, page, line, string_agg(word, ' ' ORDER BY pos) AS t, sum(CASE WHEN conf >= 0 THEN conf END) AS s, count(CASE WHEN conf >= 0 THEN 1 END) AS n FROM words GROUP BY ALL),
pages_read AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY line) AS text, coalesce(sum(s) / nullif(sum(n), 0) / 100, 0.0) AS confidence FROM text_lines GROUP BY ALL)"""


@query(f"WITH {PAGES} SELECT doc_id, page::BIGINT AS page, sha256(text) AS text_sha, confidence FROM pages_read")
def ocr_reconstruct_lines(spark, d):
    rows = W.reconstructed(W.synthetic(table(spark, d, "documents")))
    return rows.select("doc_id", F.col("page").cast("long").alias("page"), F.sha2("text", 256).alias("text_sha"), "confidence")


@query(f"WITH {PAGES} SELECT doc_id, sha256(string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY page)) AS text_sha, min(confidence) AS confidence FROM pages_read GROUP BY 1")
def page_confidence_min(spark, d):
    rows = W.transcribed(W.reconstructed(W.synthetic(table(spark, d, "documents"))))
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha"), "confidence")


def _values(spark, d):
    """A value cut from each document's first page, one that is spread over a line, and one that is nowhere."""
    first = F.filter(F.split(W.strip(F.split("text", "\n")[0]), f"{W.WHITE}+"), lambda w: w != "")
    docs = table(spark, d, "documents").withColumn("w", first).where(F.size("w") > 0)
    made = F.array(
        F.struct(F.lit(1).alias("value_id"), F.concat_ws(" ", F.slice("w", F.pmod("doc_id", F.size("w")).cast("int") + 1, 3)).alias("value")),
        F.struct(F.lit(2).alias("value_id"), F.concat_ws(" ", F.reverse(F.slice("w", 1, 4))).alias("value")),
        F.struct(F.lit(3).alias("value_id"), F.lit("qqzzq xxjjx").alias("value")),
    )
    return docs.select("doc_id", F.lit(0).cast("long").alias("page"), F.inline(made))


VALUES = WORDS + rf""",
first_words AS (SELECT doc_id, list_filter(string_split_regex({B.strip('string_split(text, chr(10))[1]')}, '{B.WHITE}+'), lambda w: w <> '') AS w FROM documents),
given AS (SELECT doc_id, 0 AS page, 1 AS value_id, array_to_string(w[(doc_id % len(w)) + 1 : (doc_id % len(w)) + 3], ' ') AS value FROM first_words WHERE len(w) > 0
  UNION ALL SELECT doc_id, 0, 2, array_to_string(list_reverse(w[1:4]), ' ') FROM first_words WHERE len(w) > 0 UNION ALL SELECT doc_id, 0, 3, 'qqzzq xxjjx' FROM first_words WHERE len(w) > 0),
wanted AS (SELECT *, list_filter(list_transform(string_split_regex({B.strip('value')}, '{B.WHITE}+'), lambda x: regexp_replace({B.fold('x')}, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda t: t <> '') AS q FROM given),
placed AS (SELECT *, regexp_replace({B.fold('word')}, '[^\p{{L}}\p{{N}}]', '', 'g') AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY line, pos) AS spot FROM boxes),
listed AS (SELECT doc_id, page, list(t ORDER BY spot) AS ts FROM placed GROUP BY ALL),
found AS (SELECT w.doc_id, w.page, w.value_id, w.q, CASE WHEN len(q) > 0 THEN list_filter(range(1, len(ts) - len(q) + 2), lambda i: ts[i : i + len(q) - 1] = q)[1] END AS b FROM wanted w LEFT JOIN listed USING (doc_id, page)),
exact AS (SELECT f.doc_id, f.value_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM found f JOIN placed p ON p.doc_id = f.doc_id AND p.page = f.page AND p.spot BETWEEN f.b AND f.b + len(q) - 1 GROUP BY ALL),
by_line AS (SELECT w.doc_id, w.value_id, line_key, count(DISTINCT t) AS c, min(spot) AS first, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM wanted w JOIN placed p ON p.doc_id = w.doc_id AND p.page = w.page AND list_contains(q, t) GROUP BY ALL),
best AS (SELECT * FROM by_line QUALIFY row_number() OVER (PARTITION BY doc_id, value_id ORDER BY c DESC, first) = 1)"""


@query(
    f"""WITH {VALUES} SELECT w.doc_id, w.value_id, CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN b.n IS NOT NULL THEN 'token_window' ELSE 'none' END AS method,
  CASE WHEN e.n IS NOT NULL THEN 1.0 WHEN b.n IS NOT NULL THEN b.c / len(list_distinct(q)) ELSE 0.0 END AS score, coalesce(e.x0, b.x0) AS x0, coalesce(e.y0, b.y0) AS y0, coalesce(e.x1, b.x1) AS x1, coalesce(e.y1, b.y1) AS y1, coalesce(e.n, b.n) AS n_words
  FROM wanted w LEFT JOIN exact e USING (doc_id, value_id) LEFT JOIN best b USING (doc_id, value_id)"""
)
def locate_values(spark, d):
    return W.located(W.boxes(W.synthetic(table(spark, d, "documents"))), _values(spark, d))


@query(f"WITH {VALUES} SELECT w.value_id, count(*) AS n, count(e.n) AS n_exact, count(*) FILTER (e.n IS NULL AND b.n IS NOT NULL) AS n_window FROM wanted w LEFT JOIN exact e USING (doc_id, value_id) LEFT JOIN best b USING (doc_id, value_id) GROUP BY 1")
def locate_methods(spark, d):
    rows = W.located(W.boxes(W.synthetic(table(spark, d, "documents"))), _values(spark, d))
    return rows.groupBy("value_id").agg(F.count("*").alias("n"), F.count_if(F.col("method") == "exact").alias("n_exact"), F.count_if(F.col("method") == "token_window").alias("n_window"))
