"""From documents to token ids: rules, near duplicates, repeated passages, the mix of sources, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyrook.llm import bpe, mixing, ordered_minhash, passages, rules
from tallyrook.llm.common import delete_path, drop_stash, stash, stashes, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' policy for corpora rejects go; short ones may stay."""
    return rules.keep(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return ordered_minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that other places hold too go from the texts; all documents stay."""
    return passages.remove(docs, passages.PASSAGE)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: some not, some up to three times, as repeated rows."""
    return mixing.mixed(docs, mixing.label_quality(spark, sf_dir))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's text, encoded and decoded again."""
    # workers go on to hold this while other stages run, so they keep less than the operator's own query does
    return bpe.digests(docs.select("doc_id", "text"), kept=100_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Near duplicates, passages, sampling keys and ids can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage's rows are written, what its operators wrote on the way and the rows of the stage before
    are removed, so the shared folder never holds more than two stages; after a failure it holds none of the stage that failed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = None
        with stashes() as made:
            try:
                docs = after = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
            finally:
                for path in made:
                    if after is None or path != after._stash_path:
                        delete_path(spark, path)
        if before is not None:
            drop_stash(before)
        before = after
    return docs
