"""Streams: events in any order, a recorder that is stopped, a folder that grows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallyrook.operators import ledger
from tallyrook.streaming import batches, ordered_ledger

LOG = "draft_id long, ts timestamp, event_id long, action string, sha string, reviewable boolean, expected long"


def shuffled(spark, sf, path, n=160, files=4):
    """Events of a few drafts, one a minute, dealt to files so that each is up to eight minutes early or late; and one event an hour on,
    which lets the watermark pass all others."""
    rows = ledger.of(spark, sf).where("draft_id % 3 = 0").orderBy("event_id").limit(n).collect()
    rnd = random.Random(6)
    rows = [(r.draft_id % 5, 10**9 + i * 60, r.event_id, r.action, r.sha, r.reviewable, r.expected) for i, r in enumerate(rows)]
    rows = [(*r[:1], r[1] - (60 if r[2] % 9 == 0 else 0), *r[2:]) for r in rows]
    arriving = sorted(rows, key=lambda r: r[1] + rnd.randrange(0, 480))
    kinds = LOG.replace("ts timestamp", "ts long")
    log = lambda part: spark.createDataFrame(part, kinds).withColumn("ts", F.timestamp_seconds("ts"))
    size = -(-len(rows) // files)
    parts = [arriving[i : i + size] for i in range(0, len(arriving), size)] + [[(99, 10**9 + n * 60 + 7200, 10**9, "submit", "x", True, None)]]
    for i, part in enumerate(parts):
        log(part).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if os.path.getmtime(full) > 10**9 and not f.startswith("seen"):
                os.utime(full, (10**6 * (i + 1), 10**6 * (i + 1)))
    assert arriving != sorted(rows, key=lambda r: r[1])
    return log(rows)


def stream(spark, path):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part-*").parquet(path)


@pytest.fixture
def few_states(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    store = spark.conf.get(ordered_ledger.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set(ordered_ledger.STORE, store)


def test_any_order_within_the_watermark_is_the_batch(spark, sf, tmp_path, few_states):
    log = shuffled(spark, sf, str(tmp_path / "in"))
    query = ordered_ledger.outcomes(stream(spark, str(tmp_path / "in")), "10 minutes").writeStream.format("memory").queryName("ordered_out").outputMode("append")
    query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.sql("select draft_id, event_id, outcome, detail, revision from ordered_out where draft_id <> 99")
    want = ledger.outcomes(log).select("draft_id", "event_id", "outcome", "detail", "revision")
    assert got.count() == want.count() == 160 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert want.where("outcome = 'simulation_completed'").count() > 0


def test_recorder_stopped_between_write_and_commit(spark, sf, tmp_path, few_states):
    log = shuffled(spark, sf, str(tmp_path / "in"))
    outcomes = ordered_ledger.outcomes(stream(spark, str(tmp_path / "in")), "10 minutes")
    path, calls = str(tmp_path / "out"), []

    def stopping(rows, batch, where):
        batches.put(rows, batch, where)
        calls.append(batch)
        if len(calls) in (2, 5):
            raise RuntimeError("stopped behind the write")

    for _ in range(3):
        query = batches.record(outcomes, path, str(tmp_path / "cp"), stopping)
        try:
            query.awaitTermination()
        except Exception as e:
            assert "stopped behind the write" in str(e)
    assert len(calls) > len(set(calls))  # a batch ran again
    got = batches.recorded(spark, path)
    want = ledger.outcomes(log).where("outcome = 'simulation_completed'").select("draft_id", "event_id", "revision", "detail")
    assert want.count() > 0 and got.drop("batch").exceptAll(want).count() == 0 and want.exceptAll(got.drop("batch")).count() == 0
    assert not [x for x in os.listdir(path) if x.startswith("_aside")]
    assert batches.recorded(spark, str(tmp_path / "none")).count() == 0


HEAD = "Controle\nData e Turno: 01/02/2026 - Dia\nVigilantes: Ana e Bruno\nUnidade: Norte\nItem Hora Descrição Ação Resolvido\n"


def test_two_runs_over_a_growing_folder_are_one(spark, tmp_path):
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()

    def add(name, body):
        (folder / name).write_text(HEAD + body)

    def run(to=out, checkpoint=cp):
        query = batches.ingest(spark, str(folder), to, checkpoint, files_a_batch=2)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    for i in range(5):
        add(f"s{i}.txt", f"07:3{i} porta aberta\n" if i % 2 else "S/A\n")
    (folder / "notes.md").write_text("no sheet")
    assert run() == 5 and run() == 0
    first = {r.sheet_id: r.disposition for r in batches.summary(spark, out).collect()}
    assert first == {"s0": "none", "s1": "present", "s2": "none", "s3": "present", "s4": "none"}
    add("s0@2.txt", "08:00 portao aberto\n\n09:00 fechado\n")
    add("s5.txt", "curto\n")
    assert run() == 2
    two = {r.sheet_id: (r.disposition, r.occurrences) for r in batches.summary(spark, out).collect()}
    assert two["s0"] == ("present", 2) and len(two) == 6
    assert run(str(tmp_path / "out1"), str(tmp_path / "cp1")) == 7
    columns = ["sheet_id", "quality", "pending", "reason"]
    same = lambda path: sorted(map(str, batches.summary(spark, path).where("sheet_id <> 's0'").select(*columns, "disposition").collect()))
    assert same(out) == same(str(tmp_path / "out1"))
