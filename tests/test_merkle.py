"""Hash trees of manifests against one-string hashes and plain differences."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyrook.operators import contracts, merkle


def tree(lines, depth, node=""):
    """The definition, on the driver: a leaf's different lines with their counts, a node's children."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = [x for x in lines if sha(x).startswith(node)]
    if len(node) == depth:
        return sha("\n".join(sorted(f"{sha(x)}:{own.count(x)}" for x in set(own)))) if own else None
    children = [(node + d, tree(own, depth, node + d)) for d in "0123456789abcdef"]
    children = [f"{n}:{s}" for n, s in children if s]
    return sha("\n".join(children)) if children else None


LINES = [f"line {i % 90}" for i in range(130)] + ["hot"] * 70 + ["", "é"]


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_root_by_the_definition(spark, depth):
    df = spark.createDataFrame([(x,) for x in LINES], "x string").repartition(5)
    r = merkle.root(df, F.col("x"), depth).first()
    assert (r.n_rows, r.sha) == (len(LINES), tree(LINES, depth))
    assert merkle.root(df.orderBy(F.desc("x")), F.col("x"), depth).first().sha == r.sha
    assert merkle.root(df.where("x <> 'line 7'"), F.col("x"), depth).first().sha != r.sha


def test_one_leaf_is_one_string(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "x string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert merkle.root(df, F.col("x")).first().sha == sha("\n".join(sorted([sha("a") + ":2", sha("b") + ":1"])))
    empty = merkle.root(df.limit(0), F.col("x")).first()
    assert (empty.n_rows, empty.sha) == (0, sha(""))
    assert [merkle.depth_of(n) for n in (0, 64, 65, 1024, 1025)] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_differences_read_only_what_differs(spark, tmp_path, depth):
    df = spark.range(3000).selectExpr("id AS k", "concat('v', id % 50) AS v").unionAll(spark.createDataFrame([(1, "v1")] * 5, "k long, v string"))
    changed = df.where("k <> 77").withColumn("v", F.when(F.col("k") == 500, "new").otherwise(F.col("v"))).unionAll(spark.createDataFrame([(1, "v1"), (9000, "x")], "k long, v string"))
    line = F.to_json(F.struct("k", "v"))
    for name, rows in (("a", df), ("b", changed), ("c", df.repartition(3)), ("none", df.limit(0))):
        merkle.store(rows, line, str(tmp_path / name), depth)
    path = lambda n: str(tmp_path / n)
    got = sorted((r.change, r.k, r.v) for r in merkle.difference(spark, path("a"), path("b"), depth).collect())
    assert got == [("added", 1, "v1"), ("added", 500, "new"), ("added", 9000, "x"), ("missing", 77, "v27"), ("missing", 500, "v0")]
    levels = merkle.differing(spark, path("a"), path("b"), depth)
    assert len(levels) == depth + 1 and all(level.count() <= 5 for level in levels)
    if depth == 3:
        assert levels[-1].agg(F.sum("n")).first()[0] < 60
    # equal trees are told apart from their roots alone
    assert [x.count() for x in merkle.differing(spark, path("a"), path("c"), depth)] == [0] and merkle.difference(spark, path("a"), path("c"), depth).count() == 0
    assert merkle.difference(spark, path("a"), path("none"), depth).count() == 3005
    with pytest.raises(Exception, match="exist"):
        merkle.store(df, line, path("a"), depth)


def test_public_numbers_of_a_hot_key(spark, monkeypatch):
    """Rows of one key lie in several ranges, and each has a place of its own."""
    monkeypatch.setattr(contracts, "ROWS_A_BUCKET", 50)
    rows = spark.range(900).selectExpr("CASE WHEN id < 600 THEN 5 ELSE id END AS k", "id AS v")
    got = {r.v: int(r.sheet[6:]) for r in contracts.public(rows, ["v"], "k").collect()}
    assert sorted(got.values()) == list(range(1, 901)) and all(got[i] == i + 1 for i in range(600, 900))
    assert contracts.public(rows.limit(0), ["v"], "k").count() == 0
