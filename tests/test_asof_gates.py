"""State at a time, and output behind observed gates."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyrook.operators import contracts, evaluate, gates
from tallyrook.operators.asof import as_of


def made(seed=3):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", "c", None])
    states = [(key(), rnd.choice([None, *range(0, 400, 4)]) if rnd.random() < 0.1 else rnd.randrange(400), i, f"v{i}" if i % 7 else None) for i in range(500)]
    requests = [(i, key(), rnd.randrange(-20, 420) if i % 31 else None) for i in range(300)] + [(7, "hot", 200)] * 2
    return requests, states


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_same_as_a_plain_search(spark, slices):
    requests, states = made()
    r = spark.createDataFrame(requests, "id int, k string, t int")
    s = spark.createDataFrame(states, "k string, t int, n int, v string")
    got = sorted(str((x.id, x.k, x.t, x.n, x.v)) for x in as_of(r, s, "k", "t", ["n", "v"], tie="n", slices=slices).collect())
    want = []
    for i, k, t in requests:
        held = max(((u, n, v) for key, u, n, v in states if k is not None and key == k and t is not None and u is not None and u <= t), default=(None, None, None), key=lambda x: x[:2])
        want.append(str((i, k, t, held[1], held[2])))
    assert got == sorted(want)


def test_no_rows_and_one_time(spark):
    r = spark.createDataFrame([(1, "a", 5)], "id int, k string, t int")
    s = spark.createDataFrame([("a", 5, "x")], "k string, t int, v string")
    assert as_of(r, s, "k", "t", ["v"]).first().v == "x" and as_of(r, s.limit(0), "k", "t", ["v"]).first().v is None
    assert as_of(r.limit(0), s, "k", "t", ["v"]).count() == 0 and as_of(r.limit(0), s.limit(0), "k", "t", ["v"]).count() == 0
    with pytest.raises(ValueError):
        as_of(r.withColumn("v", F.lit(1)), s, "k", "t", ["v"])


def test_gates_in_the_pass_that_writes(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = spark.range(100).mapInArrow(counted, "id long")
    checks = {"negative": F.col("id") < 0, "none": F.lit(None).cast("boolean"), "large": F.col("id") > 97}
    with pytest.raises(gates.Refused) as e:
        gates.write_if(rows, str(tmp_path / "no"), checks)
    assert e.value.failed == ["large"] and os.listdir(tmp_path) == [] and runs.value == 100
    assert gates.write_if(rows, str(tmp_path / "yes"), {"negative": F.col("id") < 0}) == 100
    assert runs.value == 200 and spark.read.parquet(str(tmp_path / "yes")).count() == 100 and os.listdir(tmp_path) == ["yes"]
    with pytest.raises(FileExistsError):
        gates.write_if(rows, str(tmp_path / "yes"), {})
    assert gates.write_if(rows.limit(0), str(tmp_path / "empty"), checks) == 0

    def broken(batches):
        raise RuntimeError("lost")
        yield

    with pytest.raises(Exception, match="lost"):
        gates.write_if(spark.range(3).mapInArrow(broken, "id long"), str(tmp_path / "lost"), {})
    assert sorted(os.listdir(tmp_path)) == ["empty", "yes"]


def test_metrics_are_published_behind_their_gates(spark, sf, tmp_path):
    good = {f"{c}_count": 0 for c in evaluate.FLAGS} | {"signal_complete_count": 4, "approvable_count": 4, "exportable_count": 4}
    row = good | {"level": 3, "n_ran": 4, "parse_success_count": 4, "parse_success_rate": 1.0, "safe_review_recall": 1.0, "structural_disposition_recall": 1.0}
    frame = lambda **more: spark.createDataFrame([row | more])
    contracts.publish_buckets(frame(), 4, str(tmp_path / "ok"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "ok").glob("part-*")))["n_ran"] == 4
    for more, n, failed in (({}, 5, ["release gate"]), ({"unsafe_clean_count": 1}, 4, ["inconsistent metrics", "release gate"]), ({"parse_success_rate": 0.5}, 4, ["inconsistent metrics"]), ({"level": 1, "signal_complete_count": 4}, 5, [])):
        if failed:
            with pytest.raises(gates.Refused) as e:
                contracts.publish_buckets(frame(**more), n, str(tmp_path / "no"))
            assert e.value.failed == failed and not (tmp_path / "no").exists()
        else:
            contracts.publish_buckets(frame(**more), n, str(tmp_path / "part"))
