"""Manifests as hash trees: one hash for any number of lines, and comparison that reads only what differs.

A line's place in the tree is its own SHA-256: the first hexadecimal digits name the leaf, each digit less its parent, so the fan-out is
sixteen and nothing depends on the order of lines. A leaf is the hash of its different lines' hashes, each with how often the line
occurs; a node is the hash of its children's. Levels are built by grouped aggregation, and no group holds more than a leaf or
sixteen hashes, however many lines there are and whatever repeats. Of few lines the tree is a single leaf: one hash of one string.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Lines of a leaf on average at most, and hexadecimal digits by which a comparison chooses what it reads of the lines.
LEAF, CHOSEN = 64, 2


def depth_of(n: int, leaf: int = LEAF) -> int:
    """Digits that name a leaf of a tree of n lines."""
    depth = 0
    while leaf * 16**depth < n:
        depth += 1
    return depth


def leaves(lines: DataFrame, line: Column, depth: int) -> DataFrame:
    """node, sha, n: the leaves. Equal lines are counted before anything is gathered."""
    each = lines.select(F.sha2(line, 256).alias("line_sha")).groupBy("line_sha").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat(F.col("line_sha"), F.lit(":"), F.col("n").cast("string"))))
    return each.groupBy(F.substring("line_sha", 1, depth).alias("node")).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("sha"), F.sum("n").alias("n"))


def parents(nodes: DataFrame, depth: int) -> DataFrame:
    """node, sha, n: the level above; depth is that of the given one."""
    parts = F.array_sort(F.collect_list(F.concat(F.col("node"), F.lit(":"), F.col("sha"))))
    return nodes.groupBy(F.substring("node", 1, depth - 1).alias("node")).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("sha"), F.sum("n").alias("n"))


def root(lines: DataFrame, line: Column, depth: int | None = None, leaf: int = LEAF) -> DataFrame:
    """n_rows, sha: one row. Without lines, the hash of nothing. The depth follows from the number of lines where none is given."""
    if depth is None:
        depth = depth_of(lines.count(), leaf)
    level = leaves(lines, line, depth)
    for d in range(depth, 0, -1):
        level = parents(level, d)
    # the only node, or none
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("sha"))


def store(lines: DataFrame, line: Column, path: str, depth: int) -> None:
    """The manifest's lines in the order of their hashes, and the nodes of all levels; a path that exists is an error. Trees that are to
    be compared have one depth."""
    placed = lines.withColumn("line_sha", F.sha2(line, 256))
    placed.repartitionByRange("line_sha").sortWithinPartitions("line_sha").write.mode("errorifexists").parquet(f"{path}/lines")
    level = leaves(lines, line, depth)
    for d in range(depth, -1, -1):
        # each level is written before the next is built from it
        level.write.mode("errorifexists").parquet(f"{path}/nodes/level={d}")
        level = parents(lines.sparkSession.read.schema(level.schema).parquet(f"{path}/nodes/level={d}"), d) if d else level


def _level(spark: SparkSession, path: str, d: int) -> DataFrame:
    return spark.read.schema("node string, sha string, n long").parquet(f"{path}/nodes/level={d}")


def differing(spark: SparkSession, a: str, b: str, depth: int) -> list[DataFrame]:
    """For each level, the nodes whose hashes differ or that one tree has only: node, n (lines of both below it). Of a level only children of
    differing nodes are compared; where nothing differs, further levels aren't read."""
    found: list[DataFrame] = []
    for d in range(depth + 1):
        both = [_level(spark, p, d) for p in (a, b)]
        if d:
            above = found[-1].select(F.col("node").alias("parent"))
            both = [x.join(above, F.substring("node", 1, d - 1) == F.col("parent"), "left_semi") for x in both]
        sides = [x.select("node", F.col("sha").alias(f"sha_{i}"), F.col("n").alias(f"n_{i}")) for i, x in enumerate(both)]
        level = sides[0].join(sides[1], "node", "full").where(~F.col("sha_0").eqNullSafe(F.col("sha_1")))
        found.append(kept(level.select("node", (F.coalesce("n_0", F.lit(0)) + F.coalesce("n_1", F.lit(0))).alias("n")), "differing"))
        if not found[-1].limit(1).count():
            break
    return found


def difference(spark: SparkSession, frozen: str, current: str, depth: int) -> DataFrame:
    """The lines that one stored manifest has more often than the other, as often as it does, with change: missing or added. The beginnings
    of differing leaves, at most 16 ** CHOSEN, are pushed down to the files' statistics; of what is read, only those leaves are compared."""
    last = differing(spark, frozen, current, depth)[-1]
    begins = [r[0] for r in last.select(F.substring("node", 1, min(CHOSEN, depth))).distinct().collect()]
    chosen = reduce(or_, (F.col("line_sha").startswith(b) for b in begins), F.lit(False))

    def few(path: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/lines").where(chosen)
        return rows.join(last.select("node"), F.substring("line_sha", 1, depth) == F.col("node"), "left_semi").drop("line_sha")

    old, new = few(frozen), few(current)
    gone, more = old.exceptAll(new), new.exceptAll(old)
    return gone.withColumn("change", F.lit("missing")).unionByName(more.withColumn("change", F.lit("added")))
