"""Mixing sources to target weights (operator 3): whole epochs first, then Efraimidis-Spirakis sampling to the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stash, table, unit_hash

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Rows that one bucket of sampling keys holds on average.
BUCKET_ROWS = 2_000


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """From (source, source_size, n) with one row a source: adds target.

    Sources in code point order, null last, take the weights in turn. All words together are shared by weight; a source
    takes at most `most` times its size, and the excess goes to the others by weight until none is above. With the
    sources in the order of most * size / weight, the shared level is the first that the next source is not above. This
    works on one row a source, not on documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "place")
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))),
    )
    ranked = ranked.withColumn("nth", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everything)
    ranked = ranked.withColumn("shared", first["level"])
    return ranked.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), F.col("shared") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_EPOCHS,
    quality: DataFrame | None = None,
    carry: Sequence[Column] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, the carried columns, size, source_size, target, copies, taken: one row for each input row.

    A source's target is whole epochs of it plus a rest. Every document is taken once an epoch. For the rest each
    document draws the key -ln(u) / quality with u from its id, so better documents come earlier more often; in key order
    documents are taken while the words before them stay under the rest, and the document at the limit where that comes
    nearer to it. Documents are taken whole. quality is a table (label_id, label_quality), one row an id, joined to the
    counted rows, not to the texts; it has to be positive, and documents without one count as 1. Null and empty texts have no
    words; a null source is a source, the last. Repeated rows are documents of their own. An empty table gives no rows.

    No window holds a whole source: the keys are cut in buckets of about BUCKET_ROWS rows, a source's buckets are
    summed first and documents are added up inside their bucket.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stash(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.struct(*carry, F.lit(0).alias("_")).alias("carried"),
            F.col(source_col).alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            (-F.ln(unit_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))).alias("key"),
        ),
        "mix-sized",
    )
    if quality is not None:
        sized = sized.join(quality, sized["doc_id"] == quality["label_id"], "left")
        sized = sized.withColumn("key", F.col("key") / F.coalesce("label_quality", F.lit(1.0))).drop("label_id", "label_quality")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    sources = sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sources = sources.withColumn("buckets", F.greatest(F.lit(1), F.floor(F.col("n") / BUCKET_ROWS))).withColumnRenamed("source", "s")
    keyed = sized.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(by_bucket), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    left = F.col("rest") - F.col("start") - F.col("inside")
    copies = (F.col("epochs") + F.when(2 * left > F.col("size"), 1).otherwise(0)).cast("int")
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.least(F.lit(1), copies)))
    return placed.select("doc_id", "carried", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label_id, quality): 2 for documents that the labels call good, 0.5 for bad, between for mixed labels."""
    labels = table(spark, sf_dir, "labels").where("quality is not null and doc_id is not null")
    return labels.groupBy(F.col("doc_id").alias("label_id")).agg((0.5 + 1.5 * F.avg("quality")).alias("label_quality"))


def mixed(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The input's rows and columns, each row as often as the mix takes it; rows that it doesn't take go.

    Decisions are made on ids and text hashes; the texts are dealt once. Rows of one id, text and source are alike: together they are
    taken as often as mix() takes them. Where it takes some of them once more than others, their places among each other decide;
    only such rows, those at a source's limit, are numbered.
    """
    key = ["_id", "_tid", "_source"]
    name = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("text"))
    tid = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("_tid")
    source = name(F.col(source_col)).alias("_source")
    taken = mix(docs, quality=quality, carry=[tid, source], id_col=id_col, text_col=text_col, source_col=source_col, **how)
    taken = taken.select(name(F.col("doc_id")).alias("_id"), "carried._tid", "carried._source", "copies")
    sums = [F.min("copies").alias("_low"), F.max("copies").alias("_high"), F.sum("copies").alias("_sum"), F.count("*").alias("_n")]
    taken = taken.groupBy(*key).agg(*sums).where("_high > 0")
    packed = docs.select(F.struct("*").alias("row"), name(F.col(id_col)).alias("_id"), tid, source)
    joined = packed.join(taken, key)
    alike = joined.where("_low = _high").select("row", F.col("_low").alias("_copies"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    more = F.when(place <= F.col("_sum") % F.col("_n"), 1).otherwise(0)
    parted = joined.where("_low < _high").select("row", (F.floor(F.col("_sum") / F.col("_n")) + more).cast("int").alias("_copies"))
    return alike.unionByName(parted).where("_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), quality=label_quality(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLES: dict[str, str] = {}
