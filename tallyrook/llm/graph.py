"""Connected components of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

#: Links that one task of a round holds, about.
LINKS_A_TASK = 100_000


def components(edges: DataFrame, write: Callable[[DataFrame, str], DataFrame] = stash) -> DataFrame:
    """(node, component) of all nodes of the links (a, b): component is the smallest node of the connected part.

    Every round each node takes the smallest label of its neighbours, then the label of its label, until nothing changes;
    so labels travel along a path in a number of rounds that grows with the logarithm of its length in practice. Each
    round is written to the shared folder. Only counts come to the driver. Loops and repeated links are harmless; without
    links the result is empty. write makes the tables, links and labels, that the result reads.
    """
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = write(links, "links")
    # rounds over few links are many short steps: they take as many tasks, and files, as the links need
    parts = 1 + links.count() // LINKS_A_TASK
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    labels = write(labels.coalesce(parts), "labels")
    changed = links.limit(1).count()
    while changed:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after = nearer.join(jump, "near").select("node", F.least("near", "far").alias("component"), (F.least("near", "far") != F.col("component")).alias("moved"))
        after = write(after.coalesce(parts), "labels")
        changed = after.where("moved").limit(1).count()
        drop_stash(labels)
        labels = after
    return labels.select("node", "component")
