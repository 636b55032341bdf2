"""The evidence source: created once, verified, refused; nothing visible of what didn't end."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tallyrook.sources import evidence


def files(spark, n=60, parts=4):
    return spark.range(n).select(F.format_string("d%02d/page_%d.png", F.col("id") % 7, "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content")).repartition(parts, "name")


def test_created_verified_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evidence, "FILES_A_TASK", 10)
    path = str(tmp_path / "v1")
    assert evidence.persist(files(spark), path) == "created" and evidence.persist(files(spark, parts=1), path) == "verified"
    got = {r.name: (bytes(r.content), r.sha256) for r in evidence.read(spark, path).collect()}
    assert got == {f"d{i % 7:02d}/page_{i}.png": (str(i).encode(), hashlib.sha256(str(i).encode()).hexdigest()) for i in range(60)}
    for other in (files(spark, 61), files(spark, 59), files(spark).withColumn("content", F.lit(b"x"))):
        with pytest.raises(Exception, match="another version"):
            evidence.persist(other, path)
    assert sorted(os.listdir(path)) == [evidence.ROOT, "parts"] and len(evidence.read(spark, path).collect()) == 60
    assert evidence.read(spark, path).rdd.getNumPartitions() >= 4


def test_lost_tasks_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    bad = files(spark, 40).withColumn("content", F.when(F.col("name").endswith("_33.png"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        evidence.persist(bad, path)
    assert evidence.root(path) is None and not [x for x in os.listdir(path) if not x.startswith("_aside")]
    with pytest.raises(Exception, match="no evidence"):
        evidence.read(spark, path).collect()
    assert evidence.persist(files(spark, 40), path) == "created" and evidence.read(spark, path).count() == 40


def test_damage_and_odd_files(spark, tmp_path):
    path = str(tmp_path / "v")
    odd = spark.createDataFrame([("a", b""), ("b", None), ("é/ü", b"\x00\xff"), ("a", b"")], "name string, content binary")
    assert evidence.persist(odd, path) == "created"
    assert sorted((r.name, bytes(r.content)) for r in evidence.read(spark, path).collect()) == [("a", b""), ("a", b""), ("b", b""), ("é/ü", b"\x00\xff")]
    for name in ("/etc/x", "../x", ""):
        with pytest.raises(Exception, match="relative paths"):
            evidence.persist(spark.createDataFrame([(name, b"x")], "name string, content binary"), str(tmp_path / "bad"))
    part = next(f for f in os.listdir(f"{path}/parts") if f.endswith(".bytes") and os.path.getsize(f"{path}/parts/{f}"))
    with open(f"{path}/parts/{part}", "r+b") as f:
        f.write(b"\x01")
    with pytest.raises(Exception, match="damaged"):
        evidence.read(spark, path).collect()
    assert evidence.persist(odd.limit(0), str(tmp_path / "none")) == "created" and evidence.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="never overwritten"):
        odd.write.format("evidence").mode("overwrite").save(path)
