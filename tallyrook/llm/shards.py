"""Sharding by weighted rendezvous hashing (operator 5).

Every shard draws a score from the record's key; the highest score wins the record. A shard that is added can only
win records for itself, and a shard that goes gives up only its own, so few records move when the count changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

SHARDS = 16
#: Rows that one slot bucket holds on average.
BUCKET_ROWS = 5_000


def rendezvous(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, that wins the key. Shares follow the weights.

    A shard's score is -weight / ln(u) with u drawn from the key and the shard's number; equal scores go to the lower
    number. A null key is a key like any other. Weights have to be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights have to be positive, one a shard")

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(shard)), 11) + 1) / F.lit(float(2**53 + 2))
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("lower"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["lower"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each input row.

    The record key is the id, so equal ids share a shard; a null id is one more key. A null text has no bytes (size 1,
    checksum 0). Slots number a shard's rows from 0 without gaps: rows are counted by bucket first and numbered inside
    their bucket, so no task holds a whole shard; repeated rows get a slot each. A row's bucket is drawn from its id and from
    where it lies, so that one id with very many rows spreads too; sizes and buckets are written once before anything is
    counted, since another run of the same plan may deal rows to other places. An empty table gives no rows; columns of other
    names are ignored.
    """
    key = [F.col(id_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
        F.xxhash64(F.col(id_col), F.spark_partition_id()).alias("drawn"),
    )
    small = stash(small, "shard-sizes")
    buckets = max(1, small.count() // (BUCKET_ROWS * len(weights)))
    placed = small.withColumn("bucket", F.pmod("drawn", F.lit(buckets))).drop("drawn")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    rows = placed.withColumn("place", F.row_number().over(inside) - 1)
    return rows.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard",
    )


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


QUERIES = {"op5_rendezvous_shards": op5_rendezvous_shards}
ORACLES: dict[str, str] = {}
