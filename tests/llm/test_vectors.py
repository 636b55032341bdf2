"""Embedding range join and components."""

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tallyrook.llm import graph, vectors

SF = "/root/testdata/sf0.001"


def test_same_as_sql(spark):
    assert_same(vectors.op1_embedding_range_join(spark, SF), vectors.ORACLES["op1_embedding_range_join"], SF)


def made(seed=3):
    rnd = np.random.default_rng(seed)
    rows = []
    for label in (1, 2, None):
        for _ in range(25):
            centre = rnd.normal(size=8)
            for _ in range(int(rnd.integers(1, 6))):
                rows.append((len(rows), (centre + rnd.normal(size=8) * rnd.choice([0, 0.02, 0.06])).tolist(), label))
    nan, inf = float("nan"), float("inf")
    odd = [[nan] * 8, [inf, *[1.0] * 7], [0.0] * 8, [], None, [None, *[1.0] * 7], [1e200] * 8, [1e200] * 8, [2.0], [3.0]]
    return rows + [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(3, rows[3][1], 1), (None, rows[3][1], 1)]


def brute(rows):
    good = [i for i, (k, v, lab) in enumerate(rows) if k is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    part, n = {i: i for i in good}, dict.fromkeys(good, 0)

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    def unit(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.sqrt(v @ v)

    for a in good:
        for b in good:
            linked = a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and unit(rows[a][1]) @ unit(rows[b][1]) >= 0.98
            n[a] += linked
            if linked or rows[a][0] == rows[b][0]:
                part[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i in good:
        least[root(i)] = min(rows[i][0], least.get(root(i), rows[i][0]))
    return sorted((str(k), n.get(i, 0), str(least[root(i)] if i in part else k)) for i, (k, *_) in enumerate(rows))


@pytest.mark.parametrize("a_pivot, block", [(4096, 1024), (10, 4)])
def test_range_join(spark, monkeypatch, a_pivot, block):
    monkeypatch.setattr(vectors, "VECTORS_A_PIVOT", a_pivot)
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "SLICE", 40 * block)
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash")).withColumn("h", F.lit(1))
    got = vectors.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_cells_lose_no_pair():
    rnd = np.random.default_rng(5)
    x = vectors._unit(rnd.normal(size=(400, 5)))
    own, inside = vectors.cells(x, vectors._unit(rnd.normal(size=(20, 5))), 0.2)
    close = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) <= 0.2
    for i, j in zip(*np.nonzero(close), strict=True):
        met = max(own[i], own[j])
        assert inside[i, met] and inside[j, met]
    assert inside.mean() < 0.4 and all(inside[i, : own[i]].sum() == 0 for i in range(len(x)))


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (5, 5), (200, 200), (100, 102)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
