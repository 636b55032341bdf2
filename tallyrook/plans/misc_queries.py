"""Queries on privacy, manifests, generation, forms and small formulas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import forms, manifest, merkle, privacy, terms
from ..sources import shared
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


#: Names that a scan of made texts finds.
ORGANIZATIONS = ("apache", "tion de")


def _tests(terms=("the heon",)) -> str:
    each = [f"CASE WHEN regexp_matches(t, '{p}') THEN '{c}' END" for c, p in privacy.patterns(ORGANIZATIONS)]
    each += [f"CASE WHEN contains(lower(t), '{x.lower()}') THEN 'private-term' END" for x in terms]
    return "list_filter([" + ", ".join(each) + "], lambda x: x IS NOT NULL)"


FINDINGS = f"""split AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS t FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
findings AS (SELECT doc_id AS id, line, unnest({_tests()}) AS category FROM split)"""


_TERM_LINES = f"""WITH l AS (SELECT doc_id, lower(unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x{{85}}\\x{{2028}}\\x{{2029}}]'))) AS t FROM documents),
terms AS (SELECT DISTINCT {B.strip("lower(substr(text, 1, 14))")} AS term FROM documents WHERE doc_id % 20 = 3)
SELECT term, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM l, terms WHERE term <> '' AND contains(t, term) GROUP BY 1"""


def _term_lines(spark, d, sent_bytes):
    """The beginnings of every twentieth document as a table of terms, and the lines of all documents that hold them."""
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.explode_outer(F.split("text", r"\R", -1)).alias("t"))
    names = docs.where("doc_id % 20 = 3").select(F.substring("text", 1, 14).alias("term"))
    return terms.found(lines, names, sent_bytes, ("doc_id",)).groupBy("term").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


@query(_TERM_LINES)
def term_lines(spark, d):
    return _term_lines(spark, d, terms.SENT_BYTES)


@query(_TERM_LINES)
def term_lines_joined(spark, d):
    """The same where the table of terms is taken for too large to be sent."""
    return _term_lines(spark, d, -1)


@query(f"WITH {FINDINGS} SELECT id, line, category FROM findings")
def pii_lines(spark, d):
    return privacy.findings(table(spark, d, "documents"), ("the heon",), ORGANIZATIONS)


@query(f"WITH {FINDINGS} SELECT category, count(*) AS n, count(DISTINCT id) AS n_docs FROM findings GROUP BY 1")
def pii_by_category(spark, d):
    return privacy.findings(table(spark, d, "documents"), ("the heon",), ORGANIZATIONS).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_docs"))


@query(f"WITH {B.SHEETS}, cut AS (SELECT sheet_id, unnest(string_split(text, chr(10))) AS t FROM sheets) SELECT sheet_id, count(*) AS n_lines FROM cut WHERE regexp_matches(t, '{privacy.CLOCK[1]}') GROUP BY 1")
def sheet_clock_lines(spark, d):
    rows = privacy.findings(sheets(spark, d), id_col="sheet_id").where("category = 'clock-time'")
    return rows.groupBy(F.col("id").alias("sheet_id")).agg(F.count("*").alias("n_lines"))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_and_anti(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    docs = docs.join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    return docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, sha256(text) AS sha, regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS sha_valid, 'tc-' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') AS name FROM documents")
def snapshot_hashes(spark, d):
    sha = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", sha.alias("sha"), sha.rlike(manifest.SHA256).alias("sha_valid"), manifest.doc_name(F.col("doc_id")).alias("name"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def manifest_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(
    """WITH frozen AS (SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 0), current AS (SELECT doc_id, CASE WHEN doc_id % 25 = 1 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 0)
SELECT 'missing' AS change, * FROM (SELECT * FROM frozen EXCEPT ALL SELECT * FROM current) UNION ALL SELECT 'added', * FROM (SELECT * FROM current EXCEPT ALL SELECT * FROM frozen)"""
)
def manifest_diff(spark, d):
    """Two made manifests that differ by design in which rows they hold."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    current = docs.where("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 25 == 1, "xx").otherwise(F.col("lang")))
    return manifest.difference(docs.where("doc_id % 10 <> 0"), current)


@query(ORACLES["manifest_diff"])
def manifest_tree_diff(spark, d):
    """The same difference between two stored hash trees: only what differs is read."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    current = docs.where("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 25 == 1, "xx").otherwise(F.col("lang")))
    line, depth = F.to_json(F.struct("doc_id", "lang")), merkle.depth_of(docs.count())
    paths = [f"{shared.root(spark)}/manifest-{uuid.uuid4().hex}" for _ in range(2)]
    for path, rows in zip(paths, (docs.where("doc_id % 10 <> 0"), current), strict=True):
        merkle.store(rows, line, path, depth)
    return merkle.difference(spark, *paths, depth)


@query(
    r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pngs/tc-' || lpad(page_id::VARCHAR, 6, '0') || '.png' WHEN 1 THEN '../up/' || page_id WHEN 2 THEN '/abs/' || page_id WHEN 3 THEN 'c:\x' || page_id ELSE 'a/../b' END AS path FROM pages)
SELECT page_id, path, path <> '' AND NOT regexp_matches(path, '^/|(^|/)\.\.(/|$)|[\\:]') AS portable FROM p"""
)
def portable_paths(spark, d):
    k = F.col("page_id")
    path = (
        F.when(k % 5 == 0, F.concat(F.lit("pngs/tc-"), F.lpad(k.cast("string"), 6, "0"), F.lit(".png"))).when(k % 5 == 1, F.concat(F.lit("../up/"), k.cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("/abs/"), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit("c:\\x"), k.cast("string"))).otherwise("a/../b")
    )
    return table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("portable", manifest.portable(F.col("path")))


@query("WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'tc-' || lpad(doc_id::VARCHAR, 6, '0') WHEN 1 THEN 'tc-' || doc_id WHEN 2 THEN substr(sha256(text), 1, 12) ELSE upper(sha256(text)) END AS name FROM documents) SELECT doc_id, regexp_matches(name, '^tc-[0-9]{6}$') AS is_id, regexp_matches(name, '^[0-9a-f]{7,40}$') AS is_commit, regexp_matches(name, '^[0-9a-f]{64}$') AS is_sha FROM n")
def id_regex(spark, d):
    k = F.col("doc_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("tc-"), F.lpad(k.cast("string"), 6, "0"))).when(k % 4 == 1, F.concat(F.lit("tc-"), k.cast("string"))).when(k % 4 == 2, F.substring(F.sha2("text", 256), 1, 12)).otherwise(F.upper(F.sha2("text", 256)))
    rows = table(spark, d, "documents").select("doc_id", name.alias("name"))
    return rows.select("doc_id", F.col("name").rlike(manifest.DOC_ID).alias("is_id"), F.col("name").rlike(manifest.COMMIT).alias("is_commit"), F.col("name").rlike(manifest.SHA256).alias("is_sha"))


@query(
    """WITH ids AS (SELECT DISTINCT 'w' || o_orderkey // 10 AS id FROM orders), files AS (SELECT 'w' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_' || o_orderpriority END AS file FROM orders WHERE o_orderkey % 4 <> 0),
j AS (SELECT id, file FROM ids LEFT JOIN files ON starts_with(file, id)) SELECT id, file FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY file <> id, file) = 1"""
)
def prefix_join_manifest(spark, d):
    orders = table(spark, d, "orders")
    ids = orders.select(F.concat(F.lit("w"), F.expr("o_orderkey div 10").cast("string")).alias("id")).distinct()
    tail = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("_"), "o_orderpriority"))
    files = orders.where("o_orderkey % 4 <> 0").select(F.concat(F.lit("w"), F.col("o_orderkey").cast("string"), tail).alias("file"))
    return manifest.prefix_lookup(ids, files)


@query("WITH old AS (SELECT lang, 'a' AS run, count(*) AS n FROM documents GROUP BY 1), new AS (SELECT lang, 'b' AS run, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1) SELECT * FROM old WHERE lang NOT IN (SELECT lang FROM new) UNION ALL SELECT * FROM new")
def summary_upsert(spark, d):
    docs = table(spark, d, "documents")
    old = docs.groupBy("lang").agg(F.lit("a").alias("run"), F.count("*").alias("n"))
    new = docs.where("lang in ('en', 'fr')").groupBy("lang").agg(F.lit("b").alias("run"), F.count("*").alias("n"))
    return manifest.upsert(old, new, ["lang"])


@query("SELECT user_id, max(page) + 1 AS n_pages, bool_and(page = i) AS contiguous FROM (SELECT user_id, event_id % 7 AS page, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7) - 1 AS i FROM (SELECT DISTINCT user_id, event_id % 7 AS event_id FROM events WHERE event_id % 3 <> 0)) GROUP BY 1")
def contiguous_pages(spark, d):
    pages = table(spark, d, "events").where("event_id % 3 <> 0").select("user_id", (F.col("event_id") % 7).alias("page")).distinct()
    n = pages.groupBy("user_id").agg((F.max("page") + 1).alias("n_pages"))
    return n.join(manifest.contiguous(pages, "user_id", "page"), "user_id")


_ROWS = [
    ("item", "CASE WHEN l_partkey % 11 = 0 THEN ' ' WHEN l_partkey % 37 = 0 THEN repeat('x', 201) ELSE l_returnflag END"),
    ("hora", "CASE l_suppkey % 8 WHEN 0 THEN '07:30' WHEN 1 THEN '7:30' WHEN 2 THEN '22:00-23:15' WHEN 3 THEN ' 22:00 – 23:15 ' WHEN 4 THEN '22:00 a 23:15' WHEN 5 THEN '22:00 23:15' WHEN 6 THEN '24:00' ELSE '' END"),
    ("descricao", "CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 41 = 0 THEN repeat('y', 4001) ELSE l_linestatus END"),
    ("acao", "CASE WHEN l_partkey % 43 = 0 THEN repeat('z', 4001) ELSE '' END"),
    ("resolvido", "CASE l_partkey % 3 WHEN 0 THEN 'sim' WHEN 1 THEN 'talvez' ELSE '' END"),
]


@query(
    f"""WITH r AS (SELECT count(*) OVER (PARTITION BY l_orderkey) AS n, {', '.join(f"trim({x}) AS {n}" for n, x in _ROWS)} FROM lineitem),
e AS (SELECT CASE WHEN n > 10 THEN 'too many rows' WHEN item = '' THEN 'item missing' WHEN length(item) > 200 THEN 'item too long' WHEN length(hora) > 32 THEN 'time too long' WHEN hora <> '' AND NOT regexp_matches(hora, '{forms.TIME}') THEN 'bad time'
  WHEN descricao = '' THEN 'description missing' WHEN length(descricao) > 4000 THEN 'description too long' WHEN length(acao) > 4000 THEN 'action too long' WHEN resolvido <> '' AND resolvido NOT IN ('sim', 'nao') THEN 'bad choice' END AS error FROM r)
SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM e GROUP BY 1"""
)
def form_row_validation(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("count(*) over (partition by l_orderkey) AS n", *(f"{x} AS {n}" for n, x in _ROWS))
    error = forms.row_error(F.col("n"), *(F.col(n) for n, _ in _ROWS))
    return rows.groupBy(F.coalesce(error, F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT CASE event_id % 3 WHEN 0 THEN 'sem_alteracao' WHEN 1 THEN 'com_ocorrencias' END AS radio, event_id % 4 AS n, CASE event_id % 5 WHEN 0 THEN 'present' WHEN 1 THEN 'none' ELSE 'unknown' END AS was FROM events)
SELECT CASE WHEN radio = 'sem_alteracao' AND n = 0 THEN 'none' WHEN radio = 'sem_alteracao' THEN 'error:rows with no change' WHEN radio = 'com_ocorrencias' AND n > 0 THEN 'present' WHEN radio = 'com_ocorrencias' THEN 'error:no rows' WHEN n > 0 THEN 'error:rows without choice' WHEN was = 'present' THEN 'error:no choice' ELSE was END AS disposition, count(*) AS c FROM e GROUP BY 1"""
)
def disposition_conflicts(spark, d):
    k = F.col("event_id")
    radio = F.when(k % 3 == 0, "sem_alteracao").when(k % 3 == 1, "com_ocorrencias")
    was = F.when(k % 5 == 0, "present").when(k % 5 == 1, "none").otherwise("unknown")
    return table(spark, d, "events").groupBy(forms.disposition(radio, k % 4, was).alias("disposition")).agg(F.count("*").alias("c"))


@query("SELECT vec_id, least(1.0, greatest(0.0, list_avg(list_transform(embedding, lambda x: exp(x::DOUBLE))))) AS confidence FROM embeddings")
def logprob_confidence(spark, d):
    return table(spark, d, "embeddings").select("vec_id", forms.logprob_confidence(F.col("embedding").cast("array<double>")).alias("confidence"))


@query(f"WITH {B.SHEETS} SELECT sheet_id, ((length(text) - length(replace(text, '[ilegivel]', ''))) // 10)::BIGINT AS n FROM sheets")
def mark_count(spark, d):
    """How often a reader gave up on a word."""
    from ..operators.evaluate import ILLEGIBLE

    return sheets(spark, d).select("sheet_id", forms.occurrences_of(F.col("text"), ILLEGIBLE).alias("n"))


@query("SELECT lang, count_if(source = 'src1') AS n, count_if(source = 'src2') AS of, round(count_if(source = 'src1') / nullif(count_if(source = 'src2' AND n_chars > 3000), 0), 4) AS rate FROM documents GROUP BY 1")
def rate_null_on_zero(spark, d):
    one, two = F.count_if(F.col("source") == "src1"), F.count_if(F.col("source") == "src2")
    return table(spark, d, "documents").groupBy("lang").agg(one.alias("n"), two.alias("of"), forms.rate(one, F.count_if((F.col("source") == "src2") & (F.col("n_chars") > 3000))).alias("rate"))


@query("WITH s AS (SELECT doc_id, n_chars AS w, doc_id % 900 + 1 AS h, least(1.0, 1800.0::DOUBLE / greatest(n_chars, doc_id % 900 + 1)) AS f FROM documents) SELECT doc_id, greatest(1, round_even(w * f, 0))::BIGINT AS w, greatest(1, round_even(h * f, 0))::BIGINT AS h FROM s")
def downscale_dims(spark, d):
    rows = table(spark, d, "documents").select("doc_id", forms.downscaled(F.col("n_chars"), F.col("doc_id") % 900 + 1).alias("x"))
    return rows.select("doc_id", F.col("x.w").cast("long").alias("w"), F.col("x.h").cast("long").alias("h"))


@query(
    """WITH f AS (SELECT doc_id, n_chars * 4096 AS size, doc_id % 400 AS dpi, n_chars AS w, doc_id % 9000 + 1 AS h, CASE WHEN doc_id % 50 = 7 THEN 2 ELSE 1 END AS pages FROM documents)
SELECT coalesce(CASE WHEN size > 52428800 THEN 'too many bytes' WHEN dpi < 50 OR dpi > 300 THEN 'dpi out of range' WHEN pages <> 1 THEN 'not one page' WHEN w * h > 25000000 THEN 'too many pixels' END, 'ok') AS reason, count(*) AS n FROM f GROUP BY 1"""
)
def resource_budget(spark, d):
    k = F.col("doc_id")
    reason = forms.reject_reason(F.col("n_chars") * 4096, k % 400, F.col("n_chars"), k % 9000 + 1, F.when(k % 50 == 7, 2).otherwise(1))
    return table(spark, d, "documents").groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))
