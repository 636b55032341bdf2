"""Near-duplicate embeddings (operator 1): an exact range join in a metric space.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c), which obeys the triangle inequality. Pivots part the vectors:
each belongs to the cell of its nearest pivot. A vector within the radius of another cell's vectors cannot be further from
the border between the two pivots than the radius, so exactly the vectors near a border are copied over it, from the cell of the
lower number to that of the higher, where the pair counts for both; then every cell is joined by itself. Large cells are cut in
blocks, and pairs of blocks are joined by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table
from .graph import components

COSINE = 0.98
#: Vectors for one pivot; the most pivots, whose distances among each other every task holds; and the most bytes of them.
VECTORS_A_PIVOT, MOST_PIVOTS, PIVOT_BYTES = 4_096, 2_048, 32 << 20
#: Distances to pivots that a task holds at a time.
SLICE = 1 << 22
#: Rows of a block on average; a task holds two blocks and their products.
BLOCK = 1_024


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """By powers of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = _scaled(vectors)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cells(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own cell, and a table of all cells that it has to be in: its own, and those of higher numbers over a border near it."""
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    far = np.sqrt(np.maximum(0, 2 - 2 * unit @ pivots.T))
    own = far.argmin(axis=1)
    nearest = far[np.arange(len(unit)), own][:, None]
    apart = between[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        border = (far * far - nearest * nearest) / (2 * apart)
    slack = 1e-6  # rounding
    inside = (far - nearest <= 2 * radius + slack) & ((border <= radius + slack) | (apart <= slack))
    inside &= np.arange(len(pivots))[None, :] >= own[:, None]
    inside[np.arange(len(unit)), own] = True
    return own, inside


def range_links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """From (label, size, h, node, n, embedding), one row for different vectors, n the rows that have it: (label, size, h,
    near), the number of rows within reach, and links (a, b) that connect all nodes within reach of each other.

    A block pair gives a row for each vector and one link for each vector, to the smallest node connected to it in that pair,
    so the output grows with the vectors and not with the pairs.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    total, widest = vectors.agg(F.count("*"), F.max("size")).first()
    wanted = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * (widest or 1)), total // VECTORS_A_PIVOT))
    # a sample of bounded size by the hash of the vector
    chosen = vectors.select("size", "embedding").orderBy("h").limit(wanted).collect()
    pivots: dict[int, np.ndarray] = {}
    for size in {row["size"] for row in chosen}:
        pivots[size] = np.unique(_unit(np.array([row["embedding"] for row in chosen if row["size"] == size], np.float64)), axis=0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                step = max(1, SLICE // len(pivots[size])) if size in pivots else len(part)
                for at in range(0, len(part), step):
                    yield dealt(part.slice(at, step), pivots.get(size))

    def dealt(part: pa.RecordBatch, own_pivots: np.ndarray | None) -> pa.RecordBatch:
        if own_pivots is not None:
            own, inside = cells(_unit(_matrix(part.column("embedding"))), own_pivots, radius)
            row, cell = np.nonzero(inside)
        else:
            own, row = np.zeros(part.num_rows, np.int64), np.arange(part.num_rows)
            cell = own
        taken = part.take(pa.array(row))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell), pa.array(cell == own[row])], names=[*taken.schema.names, "cell", "home"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    placed = stash(vectors.mapInArrow(place, f"{schema}, cell long, home boolean"), "cells")
    sizes = placed.groupBy("label", "size", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("members"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    placed = placed.join(sizes.where("homes > 0"), ["label", "size", "cell"])
    placed = placed.withColumn("mine", F.pmod("h", blocks("homes"))).withColumn("theirs", F.pmod(F.xxhash64("h"), blocks("members")))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n).cast("long") - 1))
    keep = ["label", "size", "cell", "h", "node", "n", "embedding", "home"]
    left = placed.where("home").select(*keep, F.col("mine").cast("long").alias("i"), up_to("members").alias("j"), F.lit(True).alias("asks"))
    right = placed.select(*keep, up_to("homes").alias("i"), F.col("theirs").cast("long").alias("j"), F.lit(False).alias("asks"))

    def join(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        copies = ~group.column("home").to_numpy(zero_copy_only=False).astype(bool)
        vectors, nodes = _scaled(_matrix(group.column("embedding"))), group.column("node").to_numpy()
        counts, hashes = group.column("n").to_numpy(), group.column("h").to_numpy()
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        near, root = np.zeros(len(a), np.int64), nodes[a].copy()
        if len(a) and len(b):
            close = vectors[a] @ vectors[b].T >= cosine * norms[a][:, None] * norms[b][None, :]
            near = close @ counts[b]
            # the cell's own members ask for themselves, copies are told here
            far = np.where(copies[b], counts[a] @ close, 0)
            # the smallest node within reach, over and over: components of this pair of blocks
            x, y = np.nonzero(close)
            seen = nodes[b].copy()
            while True:
                low = root.copy()
                np.minimum.at(low, x, seen[y])
                back = seen.copy()
                np.minimum.at(back, y, low[x])
                if (low == root).all() and (back == seen).all():
                    break
                root, seen = low, back
            nodes, root, hashes = np.concatenate([nodes[a], nodes[b]]), np.concatenate([root, seen]), np.concatenate([hashes[a], hashes[b]])
            near = np.concatenate([near, far])
        else:
            nodes, hashes = nodes[a], hashes[a]
        use = (near > 0) | (root != nodes)
        one = lambda name: [group.column(name)[0].as_py()] * int(use.sum())
        return pa.table(
            {"label": pa.array(one("label"), pa.int64()), "size": pa.array(one("size"), pa.int32()), "h": hashes[use], "near": near[use], "a": nodes[use], "b": root[use]}
        )

    pairs = left.unionByName(right).groupBy("label", "size", "cell", "i", "j").applyInArrow(join, "label long, size int, h long, near long, a long, b long")
    pairs = stash(pairs, "vector-links")
    return pairs.groupBy("label", "size", "h").agg(F.sum("near").alias("near")), pairs.select("a", "b")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each input row.

    Rows are linked if their labels and dimensions are equal and their cosine is at least the given one. Rows whose label,
    id or vector is null, whose vector is empty or zero or has null or non-finite components link with nothing (component:
    their own id; null for a null id, which is not kept). Equal vectors of a label are one node with a count, so any
    number of copies costs one. An id that several rows have names one vector: its rows share their component. Two equal
    labelled vectors are told apart from others by 64 bits of hash together with label and dimension.
    """
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)
    plain = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.size(vector).alias("size"), F.xxhash64(vector).alias("h"), vector.alias("embedding"), F.coalesce(good, F.lit(False)).alias("good"),
    )
    usable = plain.where("good")
    vectors = usable.groupBy("label", "size", "h").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    vectors = stash(vectors, "vectors")
    near, links = range_links(vectors, cosine)
    named = vectors.select("label", "size", "h", "node").join(near, ["label", "size", "h"], "left")
    named = stash(named, "near")
    # rows of one id in several vectors belong together
    extra = usable.select("vec_id", "label", "size", "h").join(named, ["label", "size", "h"])
    links = links.unionByName(extra.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    parts = components(links)
    linked = extra.join(parts, F.col("vec_id") == parts["node"], "left").select(
        "vec_id", (F.col("near") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    alone = plain.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embedding_range_join": op1_embedding_range_join}
ORACLES = {
    "op1_embedding_range_join": """WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM embeddings LEFT JOIN parts ON parts.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""
}
