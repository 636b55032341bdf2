"""Importance resampling: SQL, and a plain brute force of the definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, frame
from compare import assert_same

from tallyrook.llm import importance

SF = "/root/testdata/sf0.001"


def runs(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def brute(docs, target):
    buckets = lambda found: [zlib.crc32(f.encode()) % 10_000 for f in found]
    each = [(doc_id, *runs(text)) for doc_id, text in docs]
    s, t = Counter(b for *_, f in each for b in buckets(f)), Counter(b for text in target for b in buckets(runs(text)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)}
    rows = []
    for doc_id, n, f in each:
        weight = math.floor(sum(gain[b] for b in buckets(f)) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted(map(str, (r[:5] for r in rows)))


def got(df):
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r.rank]) for r in df.collect())


def test_same_as_sql(spark):
    assert_same(importance.op12_importance_resampling(spark, SF), importance.ORACLES["op12_importance_resampling"], SF)


@pytest.mark.parametrize("size, ranks", [(1 << 20, 50_000), (40, 7)])
def test_same_as_brute_force(spark, monkeypatch, size, ranks):
    """Also with texts cut in many parts and rows numbered in many ranges; nulls, blanks, repeated rows and clashing columns are in."""
    monkeypatch.setattr(importance, "SLICE", size)
    monkeypatch.setattr(importance, "RANKS_A_TASK", ranks)
    target = ["the porta of ação w1 w2", None, "", "THE end, W7"]
    # of repeated rows that tie, any may have the lower rank: both rows are the same
    want = brute([d[:2] for d in documents()], target)
    assert got(importance.resample(frame(spark), spark.createDataFrame([(t,) for t in target], "text string"))) == want


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert importance.resample(empty, empty).count() == 0
    assert got(importance.resample(frame(spark), empty)) == brute([d[:2] for d in documents()], [])


def test_long_words_and_cuts(monkeypatch):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["a", "B", " ", "é", "x" * 30, "\n", " ", "z9"]) for _ in range(3000)) + "y" * 500
    others = ["", "word", None, "-- --", text[:100], text]
    want = [Counter(zlib.crc32(f.encode()) % 10_000 for f in runs(t)[1]) for t in others]
    for size in (1 << 20, 1000, 64, 3):
        monkeypatch.setattr(importance, "SLICE", size)
        found, words = [Counter() for _ in others], [0] * len(others)
        for at, bucket, owner, n in importance.sliced(pa.array(others, pa.string())):
            for i, k in enumerate(n.tolist()):
                words[at + i] += k
                found[at + i].update(bucket[owner == i].tolist())
        assert found == want and words == [runs(t)[0] for t in others]


def test_gains_of_nothing():
    none = np.zeros(importance.BUCKETS, np.int64)
    assert not importance.gains(none, none).any()
