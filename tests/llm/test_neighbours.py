"""Nearest neighbours by one-bit codes: SQL, and a brute force over all vectors."""

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tallyrook.llm import neighbours

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def test_same_as_sql(spark):
    assert_same(neighbours.op11_one_bit_neighbours(spark, SF), neighbours.ORACLES["op11_one_bit_neighbours"], SF)


def made(seed=4, n=400, size=12):
    """Clusters, loose vectors, a vector that a third of the rows have, vectors of two lengths, nulls, zeros and wild numbers."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, size)) * 3
    rows = [(i, (centres[i % 6] + rnd.normal(size=size) * 0.3 if i % 2 else rnd.normal(size=size) * 2).tolist(), i % 3) for i in range(n)]
    hot = rows[0][1]
    rows += [(n + i, hot, 1) for i in range(n // 2)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * size, [nan] * size, [inf, *[1.0] * (size - 1)], [None, *[1.0] * (size - 1)], [1e200] * size, [1e-200] * size, [2.0], [3.0], [-1.0]]
    rows += [(10_000 + 20 * i, v, 1) for i, v in enumerate(odd)]
    # a repeated row, one id with two vectors, a row without an id
    return [*rows, rows[3], (20, rows[7][1], 1), (None, rows[3][1], 1)]


def brute(rows, k=20, every=20):
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in good:
        if q % every == 0:
            scores = []
            for c, w in good:
                if c != q and len(w) == len(v):
                    total = 0.0
                    for x, y in zip(v, w, strict=True):
                        total += x * y
                    scores.append((-total, c))
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def asked(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit("clash")).withColumn("ids", F.lit(1))
    return neighbours.search(df.where("vec_id % 20 = 0"), df, **more)


@pytest.mark.parametrize("block, queries, cell", [(8 << 20, 1024, 65_536), (12 * 8 * 90, 7, 60)])
def test_same_as_brute_force(spark, monkeypatch, block, queries, cell):
    """Also cut in many blocks and cells."""
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", queries)
    monkeypatch.setattr(neighbours, "CELL", cell)
    rows = made()
    assert found(asked(spark, rows)) == brute(rows)


def test_few_candidates_and_empty_tables(spark):
    rows = made()[:8]
    assert found(asked(spark, rows)) == brute(rows)
    assert found(asked(spark, rows, k=2)) == brute(rows, k=2)
    assert asked(spark, []).count() == 0
    assert asked(spark, rows[1:3]).count() == 0
    text = spark.createDataFrame([(f"v{i}", v) for i, v, _ in rows], "vec_id string, embedding array<double>")
    assert neighbours.search(text.where("vec_id = 'v3'"), text, k=3).count() == 3


def test_rotation_keeps_inner_products():
    x = np.random.default_rng(1).normal(size=(20, 70))
    assert np.allclose(neighbours.rotate(x) @ neighbours.rotate(x).T, x @ x.T)
    assert neighbours.rotate(x).shape == (20, 256) and neighbours.bits_of(257) == 512


def test_bounds_hold_and_leave_most_out():
    """Of unit vectors without any order: nothing of the nearest is lost, and few are scored."""
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centre = x.mean(axis=0)
    cell, codes, length, cosine = neighbours.encode(x, centre[None])
    q = x[:100]
    place, near, score, scored = neighbours.best_of_block(x, np.arange(len(x)), codes, length, cosine, centre, q, 21)
    exact = q @ x.T
    best = np.argsort(-exact, axis=1)[:, :21]
    recall = np.mean([len(set(best[i]) & set(near[place == i])) / 21 for i in range(100)])
    assert recall > 0.999
    assert scored < 0.12 * exact.size
    signs = (np.unpackbits(codes, axis=1) * 2.0 - 1) / 16
    guess = q @ centre + (signs @ neighbours.rotate(q).T * (length / cosine)[:, None])
    error = guess - x @ q.T
    bound = length * neighbours.SPREAD * np.sqrt((1 - cosine**2) / 255) / cosine
    assert np.mean(np.abs(error) > bound[:, None]) < 2e-4 and abs(error.mean()) < 1e-3


def test_cells_far_off_are_left_out(spark, monkeypatch):
    """Centres of clusters come with the sample; routes that the bound rules out aren't taken, and the result is whole."""
    monkeypatch.setattr(neighbours, "CELL", 100)
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(5, 16)) * 5
    rows = [(i, (centres[i % 5] + rnd.normal(size=16) * 0.1).tolist(), 0) for i in range(500)]
    assert found(asked(spark, rows)) == brute(rows)
