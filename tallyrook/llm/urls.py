"""URL filter (operator 9), in DataFrame functions only: domain rules, and for the rest a character language-model ratio.

Two variable-order Markov models over characters, one of URLs that the rules allow and one of those they block, are
smoothed by Witten-Bell interpolation from order 3 down to a uniform one. A URL's score is the difference of its two
log-likelihoods, divided by its length; a threshold decides that is calibrated on ruled URLs which the models haven't seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stash, table

#: Rules of the query: (block or allow, host/path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
ORDER = 3
#: URLs of one task; places where a frequent window, and pages without a URL, are dealt to.
ROWS_A_TASK, SALTS, EMPTY_KEYS = 50_000, 8, 4_096
#: Windows up to which the model, some 60 bytes each, is sent to all tasks, so that no window is shuffled; beyond, windows meet it salted.
SENT_WINDOWS = 1_000_000
#: Ruled URLs whose hash begins below this digit, a quarter, calibrate the threshold; the models learn from the others.
HELD_BELOW = "4"
PAD = "\u0002"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Without :// both are empty, and so for null."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(raw), path


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits; null where none does. Equal lengths: the later one."""
    fits = []
    for i, (verdict, rule) in enumerate(rules):
        rule_host, slash, rest = rule.partition("/")
        fit = (host == rule_host) | host.endswith("." + rule_host)
        fit &= path.startswith(slash + rest)
        fits.append(
            F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(i).alias("i"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
        )
    none = F.lit(None).cast("struct<length:int,i:int,rule:string,verdict:string>")
    return F.greatest(none, none, *fits)


def grams(shown: Column, order: int = ORDER) -> Column:
    """For each character, itself after the `order` characters before it; starts are padded."""
    chars = F.regexp_extract_all(F.concat(F.lit(PAD * order), shown), F.lit("(?s)."), F.lit(0))
    # zip the characters with themselves shifted, so that no step walks the text from its start
    out = chars
    for k in range(1, order + 1):
        shifted = F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0)))
        out = F.zip_with(out, shifted, lambda a, b: F.concat(a, b))
    return F.filter(out, lambda gram: gram.isNotNull())


def ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """From (gram, allow, block), counts of windows of order + 1 characters: (gram, ratio) with ratio the difference
    of the two models' natural logarithms of the last character's probability after the others.

    With n(c|x) the count of c after context x, n(x) their sum and t(x) the number of different c seen there, order k gives
    (n(c|x) + t(x) * lower(c)) / (n(x) + t(x)), or lower(c) where x was not seen; below order 0 all characters, and one
    not seen, are equally likely.
    """
    kinds = ("allow", "block")
    last = counts.select(F.substring("gram", -1, 1).alias("char")).distinct().agg(F.count("*").alias("alphabet"))
    lower = None
    for k in range(order + 1):
        level = counts.groupBy(F.substring(F.col("gram"), order - k + 1, k + 1).alias("gram")).agg(*(F.sum(x).alias(x) for x in kinds))
        level = level.withColumn("context", F.substring("gram", 1, k))
        contexts = level.groupBy("context").agg(
            *(F.sum(x).alias(f"n_{x}") for x in kinds), *(F.count_if(F.col(x) > 0).alias(f"t_{x}") for x in kinds)
        )
        level = level.join(contexts, "context")
        if lower is None:
            level = level.crossJoin(F.broadcast(last))  # one row
            for x in kinds:
                level = level.withColumn(f"lower_{x}", 1 / (F.col("alphabet") + 1))
        else:
            level = level.withColumn("shorter", F.substring("gram", 2, k)).join(lower, "shorter")
        p = {
            x: (F.col(x) + F.col(f"t_{x}") * F.col(f"lower_{x}")) / F.nullif(F.col(f"n_{x}") + F.col(f"t_{x}"), F.lit(0))
            for x in kinds
        }
        p = {x: F.coalesce(p[x], F.col(f"lower_{x}")) for x in kinds}
        lower = level.select(F.col("gram").alias("shorter"), *(p[x].alias(f"lower_{x}") for x in kinds))
    return lower.select(F.col("shorter").alias("gram"), (F.ln("lower_allow") - F.ln("lower_block")).alias("ratio"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row for each input row.

    Rules decide where one fits. The other URLs are allowed if their score, the length-normalised difference of
    log-likelihoods, is at least the threshold. The threshold lies between the mean scores of allowed and blocked URLs, nearer to
    the class that varies less: of ruled URLs that a hash keeps from the models, or of those the models learned from where the
    former lack a class. If the rules allow nothing or block nothing, there is nothing to compare with and all others are allowed. Null URLs and such without :// have empty host and path, no characters, and score 0.
    Equal host and path are scored once however many pages share them; for training each counts as often as it occurs. A very
    long URL is one row of its windows, which no task gathers: they are counted and summed as they come.
    """
    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    split = split.withColumn("fit", ruled(F.col("host"), F.col("path"), rules)).withColumn("shown", F.concat("host", "path"))
    counted = split.where("shown <> ''").groupBy("shown").agg(
        F.count_if(F.col("fit.verdict") == "allow").alias("allow"), F.count_if(F.col("fit.verdict") == "block").alias("block")
    )
    # URLs are short rows with many windows each, so they are dealt to a number of tasks, whatever their bytes
    parts_ = max(pages.sparkSession.sparkContext.defaultParallelism, pages.count() // ROWS_A_TASK)
    held = F.md5("shown") < HELD_BELOW
    urls = stash(counted.repartition(int(parts_), "shown").withColumn("held", held), "url-counts")
    kinds = ("allow", "block")
    windows = urls.select("shown", *kinds, "held", F.explode(grams(F.col("shown"), order)).alias("gram"))
    learned = (F.sum(F.when(F.col("held"), 0).otherwise(F.col(x))).alias(x) for x in kinds)
    model = stash(ratios(stash(windows.groupBy("gram").agg(*learned), "url-grams"), order), "url-model")
    if model.count() <= SENT_WINDOWS:
        met = windows.join(F.broadcast(model), "gram")
    else:
        # a frequent window meets its ratio in SALTS places
        salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = windows.withColumn("salt", F.pmod(F.xxhash64("shown"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    scored = stash(met.groupBy("shown", *kinds, "held").agg((F.sum("ratio") / F.count("*")).alias("score")), "url-scores")
    limit = scored.agg(F.coalesce(_threshold("held"), _threshold("not held"), F.lit(float("-inf"))).alias("threshold"))
    # pages without a URL have no partner; they are spread by their id
    apart = F.when(F.col("shown") == "", 1 + F.pmod(F.xxhash64("page_id"), F.lit(EMPTY_KEYS))).otherwise(0).cast("long")
    named = scored.select("shown", F.lit(0).cast("long").alias("apart"), "score")
    rated = split.withColumn("apart", apart).join(named, ["shown", "apart"], "left").crossJoin(F.broadcast(limit))  # one row
    score = F.coalesce("score", F.lit(0.0))
    return rated.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(score >= F.col("threshold"), "allow").otherwise("block")).alias("verdict"),
        score.alias("score"),
    )


def _threshold(part: str) -> Column:
    """Aggregate over (allow, block, score): between the mean scores of the two, in parts of their standard deviations; null without both."""
    mean, spread = {}, {}
    for x in ("allow", "block"):
        n, score = F.expr(f"CASE WHEN {part} THEN {x} ELSE 0 END"), F.col("score")
        total = F.nullif(F.sum(n), F.lit(0))
        mean[x] = F.sum(n * score) / total
        spread[x] = F.sqrt(F.greatest(F.lit(0.0), F.sum(n * score * score) / total - mean[x] * mean[x])) + 1e-9
    return (mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / (spread["allow"] + spread["block"])


def op9_url_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("score")


def _oracle() -> str:
    fits = " UNION ALL ".join(
        f"SELECT {i} AS i, '{v}' AS verdict, '{r}' AS rule, '{r.partition('/')[0]}' AS rule_host, '/{r.partition('/')[2]}' AS rule_path"
        for i, (v, r) in enumerate(RULES)
    )
    levels = []
    for k in range(ORDER + 1):
        if k:
            below = ", ".join(f"p{k - 1}.{x} AS lower_{x}" for x in ("a", "b"))
            join = f"JOIN p{k - 1} ON p{k - 1}.gram = substr(l.gram, 2)"
        else:
            below = "1.0 / (alphabet + 1) AS lower_a, 1.0 / (alphabet + 1) AS lower_b"
            join = "CROSS JOIN (SELECT count(DISTINCT right(gram, 1)) AS alphabet FROM counted)"
        levels.append(f"""
n{k} AS (SELECT right(gram, {k + 1}) AS gram, left(right(gram, {k + 1}), {k}) AS ctx, sum(a) AS a, sum(b) AS b FROM counted GROUP BY 1, 2),
c{k} AS (SELECT ctx, sum(a) AS na, sum(b) AS nb, count_if(a > 0) AS ta, count_if(b > 0) AS tb FROM n{k} GROUP BY 1),
p{k} AS (SELECT gram, CASE WHEN na + ta = 0 THEN lower_a ELSE (a + ta * lower_a) / (na + ta) END AS a,
  CASE WHEN nb + tb = 0 THEN lower_b ELSE (b + tb * lower_b) / (nb + tb) END AS b
  FROM (SELECT l.*, na, nb, ta, tb, {below} FROM n{k} l JOIN c{k} ON l.ctx = c{k}.ctx {join}))""")
    return f"""WITH cut AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
named AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
split AS (SELECT page_id, row_number() OVER () AS r, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named),
rules AS ({fits}),
fits AS (SELECT r, arg_max(rule, length(rule) * 1000 + i) AS rule, arg_max(verdict, length(rule) * 1000 + i) AS verdict
  FROM split JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r),
ruled AS (SELECT split.*, rule, verdict, host || path AS shown FROM split LEFT JOIN fits USING (r)),
windows AS (SELECT r, (verdict = 'allow' AND md5(shown) >= '{HELD_BELOW}')::INT AS a, (verdict = 'block' AND md5(shown) >= '{HELD_BELOW}')::INT AS b, substr(repeat(chr(2), {ORDER}) || shown, unnest(range(1, length(shown) + 1)), {ORDER + 1}) AS gram FROM ruled),
counted AS (SELECT gram, sum(coalesce(a, 0)) AS a, sum(coalesce(b, 0)) AS b FROM windows GROUP BY 1),{",".join(levels)},
scores AS (SELECT r, avg(ln(p.a) - ln(p.b)) AS score FROM windows JOIN p{ORDER} p USING (gram) GROUP BY r),
rated AS (SELECT ruled.*, coalesce(score, 0) AS score FROM ruled LEFT JOIN scores USING (r)),
stats AS (SELECT (ma * sb + mb * sa) / (sa + sb) AS threshold, held FROM (SELECT md5(shown) < '{HELD_BELOW}' AS held, avg(score) FILTER (verdict = 'allow') AS ma, avg(score) FILTER (verdict = 'block') AS mb,
  stddev_pop(score) FILTER (verdict = 'allow') + 1e-9 AS sa, stddev_pop(score) FILTER (verdict = 'block') + 1e-9 AS sb FROM rated WHERE shown <> '' GROUP BY 1)),
chosen AS (SELECT coalesce(max(threshold) FILTER (held), max(threshold) FILTER (NOT held), -1e300) AS threshold FROM stats)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict FROM rated CROSS JOIN chosen"""


QUERIES = {"op9_url_model_ratio": op9_url_model_ratio}
ORACLES = {"op9_url_model_ratio": _oracle()}
