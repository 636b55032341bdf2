"""Quality rules as a bitmask ledger (operator 8), in DataFrame functions only.

Every rule is evaluated once for a document. The ledger keeps the measurements and one long with a bit for each rule
that failed. Policies are versioned masks over those bits: applying another version, or asking what a rule alone costs,
reads the ledger and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, let, table

#: The rules: name and when it fails, on the measurements. A rule's bit is its place here; new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > word_chars"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("too_many_words", "n_words > 100000"),
    ("no_words", "n_words = 0"),
)
#: Each version's rules. A version is never changed once it was used; a new one is added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "short_words", "long_words"),
    # short texts may be good ones; only those without any word go
    "v2": ("no_words", "repeated_windows", "many_symbols", "repeated_lines", "short_words", "long_words"),
}
POLICY = "v1"


def mask(policy: str) -> int:
    places = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << places[name] for name in POLICIES[policy])


def repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more, its first place included.

    Windows are hashed to 64 bits together with where they stand, sorted, and equal neighbours are the repeats; the
    covered words are the union of [place, place + 3), counted from the gaps between sorted places. n log n in the words
    of one text, no row leaves its document.
    """

    def covered(places: Column) -> Column:
        following = F.concat(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.array(F.lit(2147483647)))
        gaps = F.zip_with(places, following, lambda here, there: F.least(there - here, F.lit(3)))
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap))

    def repeated(ordered: Column) -> Column:
        n = F.size(ordered)
        return F.filter(
            F.transform(
                ordered,
                lambda here, i: F.when(
                    ((i > 0) & (F.get(ordered, i - 1)["window"] == here["window"]))
                    | ((i + 1 < n) & (F.get(ordered, i + 1)["window"] == here["window"])),
                    here["place"],
                ),
            ),
            lambda place: place.isNotNull(),
        )

    def windows(hashes: Column) -> Column:
        at = lambda i: F.get(hashes, i)
        return F.array_sort(
            F.transform(
                F.slice(hashes, 3, F.greatest(F.size(hashes) - 2, F.lit(0))),
                lambda third, i: F.struct(F.xxhash64(at(i), at(i + 1), third).alias("window"), i.alias("place")),
            )
        )

    hashes = F.transform(words, lambda word: F.xxhash64(word))
    return let(hashes, lambda h: let(windows(h), lambda ordered: let(F.array_sort(repeated(ordered)), covered)))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows in the column row, beside the measurements.

    A null text counts as an empty one: no words, no lines. Repeated rows are measured each for themselves. A very long text is
    one row, measured in n log n of its words; no row leaves its document. All columns of the input stay inside row, so none
    can clash. An empty table gives no rows.
    """
    texts = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = texts.select(
        "row", "t",
        F.filter(F.split("t", "[" + BLANKS + "]+"), lambda word: word != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    long = lambda c: c.cast("long")
    return split.select(
        "row",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.translate("t", BLANKS, ""))).alias("word_chars"),
        long(F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(repeat_words(F.col("words"))).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """measure() and failed: bit i says that rule i failed."""
    bits = [F.when(F.expr(when), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, when) in enumerate(RULES)]
    return measure(docs, text_col).withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def passes(policy: str = POLICY, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of the policy: rule, failing (documents that fail it), alone (documents that only it rejects), kept
    (documents that the policy without it keeps). One aggregation over the ledger's bits; texts are not read."""
    whole = mask(policy)
    places = {name: i for i, (name, _) in enumerate(RULES)}
    own = F.col("failed").bitwiseAND(F.lit(whole))
    sums = []
    for name in POLICIES[policy]:
        bit = 1 << places[name]
        sums += [
            F.count_if(own.bitwiseAND(F.lit(bit)) != 0).alias(f"{name}_failing"),
            F.count_if(own == bit).alias(f"{name}_alone"),
            F.count_if(own.bitwiseAND(F.lit(whole & ~bit)) == 0).alias(f"{name}_kept"),
        ]
    each = [
        F.struct(F.lit(name).alias("rule"), *(F.col(f"{name}_{what}").alias(what) for what in ("failing", "alone", "kept")))
        for name in POLICIES[policy]
    ]
    return rows.agg(*sums).select(F.inline(F.array(*each)))


def keep(docs: DataFrame, policy: str = POLICY, text_col: str = "text") -> DataFrame:
    """The input's rows that the policy keeps, with the input's columns."""
    return ledger(docs, text_col).where(passes(policy)).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ledger(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes(POLICY).alias("kept"), "failed",
    )


ORACLE_CTE = r"""
texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
word_lists AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM word_lists)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
measured AS (SELECT t.r, t.doc_id, len(words)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM texts t JOIN word_lists USING (r) LEFT JOIN repeats USING (r)),
judged AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
  + 4 * (10 * n_symbols > word_chars)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
  + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (n_words > 100000)::BIGINT + 128 * (n_words = 0)::BIGINT)::BIGINT AS failed FROM measured)
"""
ORACLES = {
    "op8_quality_rules": f"""WITH {ORACLE_CTE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
  (failed & 63) = 0 AS kept, failed FROM judged"""
}
QUERIES = {"op8_quality_rules": op8_quality_rules}
