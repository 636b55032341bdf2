"""Edit distances by bit vectors, and trimming without patterns, against plain forms."""

import random

from pyspark.sql import functions as F

from tallyrook.functions import distance, text


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_distances_are_those_of_the_plain_table(monkeypatch):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdé🙂 z") for _ in range(rnd.choice([0, 1, 2, 63, 64, 65, 127, 128, 129, 150])))
    a, b = ([word() for _ in range(300)] for _ in range(2))
    b[:100] = [x[:5] + "q" + x[9:] for x in a[:100]]
    want = [plain(x, y) for x, y in zip(a, b, strict=True)]
    assert distance.distances(a, b).tolist() == want
    monkeypatch.setattr(distance, "TABLE_BYTES", 1 << 14)
    monkeypatch.setattr(distance, "FEW", 0)
    assert distance.distances(a, b).tolist() == want
    assert distance.distances([], []).tolist() == [] and distance.distances(["", "a"], ["", ""]).tolist() == [0, 1]
    assert distance.distances(["x" * 3000 + "y"], ["x" * 3000]).tolist() == [1]


def test_distance_in_a_query_is_the_built_in_one(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("", ""), ("kitten", "sitting"), ("", "abc"), ("é🙂x" * 50, "e🙂" * 70)], "a string, b string")
    assert df.where(~distance.distance(F.col("a"), F.col("b")).eqNullSafe(F.levenshtein("a", "b").cast("long"))).count() == 0


def test_trimmed_as_by_the_patterns(spark):
    rnd = random.Random(2)
    rows = ["".join(rnd.choice([*text.WHITES, "a", "É", "́", " ", " "]) for _ in range(rnd.randrange(12))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in [*rows, None]], "t string")
    by_pattern = F.regexp_replace("t", f"^{text.WHITE}+|{text.WHITE}+$", "")
    one_space = F.regexp_replace(text.fold(F.col("t")), f"{text.WHITE}+", " ")
    normed = F.regexp_replace(one_space, f"^{text.WHITE}+|{text.WHITE}+$", "")
    assert df.where(~text.strip(F.col("t")).eqNullSafe(by_pattern) | ~text.norm(F.col("t")).eqNullSafe(normed)).count() == 0
