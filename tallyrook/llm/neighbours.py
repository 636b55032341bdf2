"""Nearest neighbours by inner product (operator 11): randomly rotated one-bit codes with error bounds, and reranking.

A vector's residual from its cell's centre is rotated at random and kept as the signs of its coordinates: a packed code, with two
correction scalars, the residual's length and the cosine of code and residual. The code's inner product with a rotated query, put
right by the scalars, estimates the true one without bias, and its error has a known spread; so each estimate has an upper bound
that fails once in some ten thousand times. A task holds a block of codes and a block of queries. It scores the best estimates
exactly, which gives a score to beat, then every vector whose upper bound reaches it, and returns the best of the block.

Cells (k-means over a bounded sample) only order the index: every vector is indexed, a query leaves out a cell only if the triangle
inequality proves that nothing in it beats what the sample has. Blocks follow from the data's size, so no task grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stash, table

NEAREST, QUERY_EVERY = 20, 20
#: Bits of a code at least: vectors of fewer dimensions are filled with zeros before they are rotated, which narrows the errors.
CODE_BITS = 256
#: Standard errors that a bound allows.
SPREAD = 4.0
#: Vectors and bytes of the sample that cells are fitted on, rounds of fitting, vectors of a cell on average, and the most cells.
SAMPLE, SAMPLE_BYTES, ROUNDS, CELL, MOST_CELLS = 4_096, 32 << 20, 8, 65_536, 256
#: Bytes of the vectors of one block, and queries of one block; estimates that a task holds at a time, and exact products.
BLOCK_BYTES, QUERY_BLOCK, ESTIMATES, PRODUCTS = 8 << 20, 1_024, 1 << 22, 1 << 18
#: Lengths between which bounds are used; vectors beyond are always scored exactly.
TAME = (1e-100, 1e100)


def matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def lengths(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((vectors * vectors).sum(axis=1))


def bits_of(size: int) -> int:
    return max(CODE_BITS, 1 << (size - 1).bit_length())


def rotate(vectors: np.ndarray) -> np.ndarray:
    """Filled with zeros to a power of two, then three times: random signs, and the Hadamard transform. Keeps inner products."""
    n, size = vectors.shape
    bits = bits_of(size)
    out = np.zeros((n, bits))
    out[:, :size] = vectors
    signs = np.random.default_rng(bits).choice([-1.0, 1.0], (3, bits))
    for k in range(3):
        out *= signs[k]
        half = 1
        while half < bits:
            pairs = out.reshape(n, bits // (2 * half), 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
            half *= 2
        out = out.reshape(n, bits) / np.sqrt(bits)
    return out


def encode(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: its cell, the packed signs of its rotated residual, the residual's length, and the cosine of both."""
    with np.errstate(over="ignore", invalid="ignore"):
        cell = (2 * vectors @ centres.T - (centres * centres).sum(axis=1)).argmax(axis=1)
        residuals = vectors - centres[cell]
        length = lengths(residuals)
        tame = (length > TAME[0]) & (length < TAME[1])
        turned = rotate(np.where(tame[:, None], residuals / np.where(tame, length, 1.0)[:, None], 0.0))
    # a residual of no length has any code; one out of bounds is told by its length
    length = np.where(tame | (length == 0), length, np.inf)
    return cell, np.packbits(turned >= 0, axis=1), length, np.where(tame, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]), 1.0)


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by k-means, begun with the sample's first vectors; a centre that loses all its vectors stays where it was."""
    centres = sample[:cells].copy() if cells > 1 else sample.mean(axis=0, keepdims=True)
    for _ in range(ROUNDS if cells > 1 else 0):
        own = (2 * sample @ centres.T - (centres * centres).sum(axis=1)).argmax(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=cells)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def in_order(columns: np.ndarray, i: np.ndarray, others: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the vectors columns[:, i] and others[:, j] in double precision, summed from the first component to the last."""
    out = np.empty(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(i), PRODUCTS):
            a, b = i[at : at + PRODUCTS], j[at : at + PRODUCTS]
            total = np.zeros(len(a))
            for x, y in zip(columns, others, strict=True):
                total += x[a] * y[b]
            out[at : at + PRODUCTS] = total
    return out


def best_of_block(
    vectors: np.ndarray, names: np.ndarray, codes: np.ndarray, length: np.ndarray, cosine: np.ndarray, centre: np.ndarray, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of queries and vectors, and scores, of each query's k best (ties to the smaller name); and how many were scored."""
    n, bits = len(vectors), codes.shape[1] * 8
    signs = (np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1) / np.sqrt(np.float32(bits))
    size = lengths(queries)
    tame = (size > TAME[0]) & (size < TAME[1])
    turned = rotate(np.where(tame[:, None], queries / np.where(tame, size, 1.0)[:, None], 0.0)).astype(np.float32)
    # of unit queries: single precision adds less than the last term
    error = length * (SPREAD * np.sqrt(np.maximum(0.0, 1 - cosine * cosine) / (bits - 1)) / cosine + 1e-5) + 1e-12 * lengths(centre[None])
    columns, others = np.ascontiguousarray(vectors.T), np.ascontiguousarray(queries.T)
    places, found, scores, scored = [], [], [], 0
    step = max(1, ESTIMATES // n)
    for at in range(0, len(queries), step):
        some = slice(at, min(len(queries), at + step))
        with np.errstate(over="ignore", invalid="ignore"):
            base = np.where(tame[some], queries[some] @ centre / np.where(tame[some], size[some], 1.0), np.inf)
            guess = base[:, None] + turned[some] @ signs.T * (length / cosine)
            upper = guess + error
        upper[np.isnan(upper)] = np.inf
        m = len(base)
        if n > 3 * k:
            guess[np.isnan(guess)] = np.inf
            first = np.argpartition(guess, n - 3 * k, axis=1)[:, n - 3 * k :]
            own, near = np.repeat(np.arange(m), 3 * k), first.ravel()
            beat = np.sort(in_order(columns, near, others[:, some], own).reshape(m, 3 * k), axis=1)[:, -k] / np.where(tame[some], size[some], 1.0)
            own, near = np.nonzero(~(upper < beat[:, None]))
        else:
            own, near = np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
        exact = in_order(columns, near, others[:, some], own)
        scored += len(near)
        # NaN comes first, as in SQL
        order = np.lexsort((names[near], -exact, ~np.isnan(exact), own))
        own, near, exact = own[order], near[order], exact[order]
        keep = np.arange(len(own)) - np.searchsorted(own, own) < k
        places.append(own[keep] + at)
        found.append(near[keep])
        scores.append(exact[keep])
    return np.concatenate(places), np.concatenate(found), np.concatenate(scores), scored


KEY = ("size", "h", "g")


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, the vector and its key: two 64-bit hashes and the dimension."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)
    plain = rows.where(good).select(F.col(id_col).alias("id"), vector.alias("vector"))
    return plain.select("id", F.size("vector").alias("size"), F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g"), "vector")


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        yield size, batch.filter(pa.array(sizes == size))


def _blocks(count: Column, a_block: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / a_block)).cast("int")


def search(queries: DataFrame, rows: DataFrame, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest rows, largest inner product first, ties to the smaller id.

    Rows of a query's own id aren't its candidates, nor are vectors of another dimension; with fewer candidates all are returned.
    Vectors that are null, empty or zero or have null or non-finite components, and rows without an id, take no part. Equal
    rows count once; an id with several vectors is a candidate with each, and asks with each. Equal vectors are one entry of the
    index, with the k + 1 smallest of their ids, as no further one can be among the k nearest, and are asked for once. Empty
    tables give no rows; other columns are ignored. A score is the sum of products in double precision, first component first.
    """
    small_batches(rows.sparkSession, rows=10_000)
    good = _usable(rows, id_col, vector_col)
    smallest = Window.partitionBy(*KEY).orderBy("id")
    few = good.select(*KEY, "id", "vector").dropDuplicates([*KEY, "id"]).withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    entries = few.groupBy(*KEY).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector"))
    entries = stash(entries, "neighbour-entries")
    totals = {r["size"]: (r["n"], max(1, BLOCK_BYTES // (8 * r["size"]))) for r in entries.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row a dimension
    members = _usable(queries, id_col, vector_col)
    asked = stash(members.groupBy(*KEY).agg(F.first("vector").alias("vector")), "neighbour-queries")
    asks = asked.count()
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(totals, default=1))))
    chosen: dict[int, list] = {}
    for row in entries.select("size", "vector").orderBy("h", "g", "size").limit(wanted).collect():
        chosen.setdefault(row["size"], []).append(row["vector"])
    samples = {size: np.array(vectors) for size, vectors in chosen.items()}
    centres: dict[int, np.ndarray] = {}
    for size, sample in samples.items():
        usable = sample[(lengths(sample) < TAME[1])]
        cells = min(MOST_CELLS, len(usable), 1 + totals[size][0] // CELL)
        centres[size] = fitted(usable, cells) if cells else np.zeros((1, size))
    centre_of = lambda size: centres.get(size, np.zeros((1, size)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                cell, code, length, cosine = encode(matrix(part.column("vector")), centre_of(size))
                more = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(cosine)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "cell", "code", "length", "cosine"])

    id_kind = entries.schema["ids"].dataType.elementType.simpleString()
    key_schema = "size int, h long, g long"
    coded = entries.mapInArrow(index, f"{key_schema}, ids array<{id_kind}>, vector array<double>, cell int, code binary, length double, cosine double")
    coded = stash(coded, "neighbour-codes")
    # one row a cell
    cells = {(r["size"], r["cell"]): (r["n"], r["reach"]) for r in coded.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("length").alias("reach")).collect()}
    parts = {key: -(-n // totals[key[0]][1]) for key, (n, _) in cells.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                own = [cell for s, cell in cells if s == size]
                if not own:
                    continue
                asking = matrix(part.column("vector"))
                norm, sample = lengths(asking), samples.get(size, np.empty((0, size)))
                with np.errstate(over="ignore", invalid="ignore"):
                    # k + 1 of the sample are candidates, or k and the query's own row
                    beat = np.sort(asking @ sample.T, axis=1)[:, -k - 1] if len(sample) > k else np.full(len(asking), -np.inf)
                    most = asking @ centre_of(size)[own].T + np.array([cells[size, c][1] for c in own]) * norm[:, None]
                    slack = 1e-9 * (norm * (1 + max((lengths(sample).max(initial=0.0), 0.0)))) + 1e-300
                    row, at = np.nonzero(~(most < (beat - slack)[:, None]))
                taken = part.take(pa.array(row))
                cell = np.array(own, np.int32)[at]
                more = [pa.array(cell), pa.array(np.array([parts[size, c] for c in own], np.int32)[at])]
                yield pa.RecordBatch.from_arrays([*taken.columns, *more], names=[*taken.schema.names, "cell", "parts"])

    blocks_of_queries = max(1, -(-asks // QUERY_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.mapInArrow(route, f"{key_schema}, vector array<double>, cell int, parts int")
    left = left.select(*KEY, "vector", "cell", numbers(F.col("parts")).alias("i"), F.pmod("h", F.lit(blocks_of_queries)).cast("int").alias("j"))
    known = rows.sparkSession.createDataFrame([(s, c, p) for (s, c), p in parts.items()], "size int, cell int, parts int")
    right = coded.join(F.broadcast(known), ["size", "cell"]).select(
        *KEY, F.get("ids", F.lit(0)).alias("name"), "ids", "vector", "cell", "code", "length", "cosine", F.pmod("g", "parts").cast("int").alias("i"),
        numbers(F.lit(blocks_of_queries)).alias("j"),
    )

    def nearest(asking: pa.Table, block: pa.Table) -> pa.Table:
        if not asking.num_rows or not block.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(out_names, (pa.int32(), pa.int64(), pa.int64(), block.schema.field("ids").type, pa.float64()), strict=True)})
        size = block.column("size")[0].as_py()
        names = np.argsort(np.argsort(np.array(block.column("name").to_pylist()), kind="stable"), kind="stable")
        codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(block.num_rows, -1)
        numbers = [block.column(c).to_numpy() for c in ("length", "cosine")]
        place, found, score, _ = best_of_block(
            matrix(block.column("vector")), names, codes, *numbers, centre_of(size)[block.column("cell")[0].as_py()], matrix(asking.column("vector")), k + 1
        )
        keys, ids = asking.select(list(KEY)).take(pa.array(place)), block.column("ids").take(pa.array(found))
        return pa.table([*keys.columns, ids, pa.array(score)], names=out_names)

    out_names = [*KEY, "ids", "score"]
    deal = ["size", "cell", "i", "j"]
    met = left.groupBy(*deal).cogroup(right.groupBy(*deal)).applyInArrow(nearest, f"{key_schema}, ids array<{id_kind}>, score double")
    met = met.select(*KEY, F.explode("ids").alias("id"), "score")
    best = Window.partitionBy(*KEY).orderBy(F.col("score").desc(), "id")
    # a list of k + 1 for each vector that is asked for
    top = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = top.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    answers = members.select("id", *KEY).dropDuplicates().join(stash(lists, "neighbour-lists"), list(KEY))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    each = answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "one"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.id").alias("vec_id"), F.col("one.score").alias("score"))


def op11_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)


QUERIES = {"op11_one_bit_neighbours": op11_one_bit_neighbours}
ORACLES = {
    "op11_one_bit_neighbours": """WITH good AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM good q JOIN good c
  ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM near)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM ranked WHERE k <= 20"""
}
