"""Manifests: identity, duplicates, differences, canonical hashes, portable paths, prefix lookup, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms of identifiers.
DOC_ID, SHA256, COMMIT = r"^tc-[0-9]{6}$", r"^[0-9a-f]{64}$", r"^[0-9a-f]{7,40}$"


def doc_name(c: Column) -> Column:
    return F.concat(F.lit("tc-"), F.lpad((c % 1_000_000).cast("string"), 6, "0"))


def portable(path: Column) -> Column:
    """A relative POSIX path without steps upward."""
    return (path != "") & ~path.rlike(r"^/|(^|/)\.\.(/|$)|[\\:]")


def difference(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """change and rows: what one has more often than the other."""
    gone, new = frozen.exceptAll(current), current.exceptAll(frozen)
    return gone.withColumn("change", F.lit("missing")).unionByName(new.withColumn("change", F.lit("added")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def prefix_lookup(ids: DataFrame, files: DataFrame) -> DataFrame:
    """id, file: the file of exactly the id's name, else the first whose name begins with it. Every id is cut into the files' own
    prefixes, so it is an equal join: name[:n] for the lengths n that ids have."""
    lengths = ids.agg(F.array_sort(F.collect_set(F.length("id"))).alias("ns"))  # one row: the lengths that ids have
    cut = files.crossJoin(F.broadcast(lengths)).select("file", F.explode("ns").alias("n")).where(F.length("file") >= F.col("n")).select("file", F.expr("substring(file, 1, n)").alias("id"))
    found = ids.join(cut, "id", "left")
    best = F.min(F.struct((F.col("file") != F.col("id")).alias("longer"), "file"))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.file")


def contiguous(pages: DataFrame, key: str, index: str) -> DataFrame:
    """Whether a document's pages are numbered 0, 1, 2 and so on."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(index)) - 1
    return pages.select(key, (place == F.col(index)).alias("ok")).groupBy(key).agg(F.bool_and("ok").alias("contiguous"))
