"""The corpus pipeline, stage by stage, against brute force on a small table."""

import hashlib
import os

import numpy as np
import pytest
from cases import documents, frame
from test_text_operators import REFERENCE, classes_by_brute_force, removed

import corpus_pipeline
from tallyrook.llm import common, mixing, passages, rules
from tallyrook.llm.common import stash, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, columns = frame(spark), frame(spark).columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "token_ids"]

    out = stash(stages["quality_rules"](spark, docs, SF), "t")
    assert out.columns == columns and out.count() == rules.ledger(docs).where(rules.passes("v2")).count() > 10
    rows = [tuple(r) for r in out.collect()]

    docs = stash(stages["near_duplicates"](spark, out, SF), "t")
    groups = classes_by_brute_force(rows)
    assert docs.columns == columns and docs.count() == len(groups)
    kept = {str(r.doc_id) for r in docs.collect()}
    assert all(sum(i in kept for i in set(g)) == 1 for g in groups)
    rows = [tuple(r) for r in docs.collect()]

    docs = stash(stages["repeated_passages"](spark, docs, SF), "t")
    assert docs.columns == columns
    want = {i: n - gone for i, n, gone, *_ in removed(rows, *passages.PASSAGE)}
    for r in docs.collect():
        assert want[str(r.doc_id)] - 6 <= len((r.text or "").encode()) <= want[str(r.doc_id)]

    mixed = stash(stages["source_mix"](spark, docs, SF), "t")
    taken = {str(r.doc_id): r.copies for r in mixing.mix(docs, quality=mixing.label_quality(spark, SF)).collect()}
    got = {}
    for r in mixed.collect():
        got[str(r.doc_id)] = got.get(str(r.doc_id), 0) + 1
    assert mixed.columns == columns and got == {i: n for i, n in taken.items() if n}

    ids = stages["token_ids"](spark, mixed, SF).collect()
    text = {str(r.doc_id): r.text for r in mixed.collect()}
    assert len(ids) == mixed.count()
    for r in ids:
        expected = np.array(REFERENCE.encode_ordinary(text[str(r.doc_id)] or ""), "<u4")
        assert r.n_tokens == len(expected) and r.ids_sha256 == hashlib.sha256(expected.tobytes()).hexdigest()


@pytest.fixture
def folder(tmp_path, monkeypatch):
    """A shared folder that no other process writes to."""
    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}")
    return tmp_path


def test_run_is_its_stages_and_leaves_one_table(spark, folder):
    ran = corpus_pipeline.run(spark, SF)
    left = os.listdir(folder)
    assert len(left) == 1 and left[0].startswith("pipeline-token_ids")
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF), name)
    rows = sorted(map(tuple, ran.collect()))
    assert rows == sorted(map(tuple, docs.collect())) and rows


def test_failed_stage_leaves_nothing(spark, monkeypatch, folder):
    def bad(spark, docs, sf_dir):
        stash(docs, "on-the-way")
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("bad", bad)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF)
    assert [x.split("-")[1] for x in os.listdir(folder)] == ["quality_rules"]


def test_empty_documents(spark):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert documents()
