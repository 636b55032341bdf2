"""Alignment of tokenizers against the libraries and a plain brute force of the definition."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from cases import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyrook.llm import alignment

ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b   c ", "\n\n a\tb \r\n", "<|endoftext|>", "x<|endoftext|>y <s></s><unk> <0x41>", "▁a", "a ▁ b", "naïve ação “x” – …",
    "漢字かな交じり文 テスト 🙂🙃 ", "\x00\x01 a", "ﬁ Å é", "　x y", "a" * 3000, " " * 500, "1234567 89,5", "don't I'll WE'VE", "​‍ x", "Ω≈ç√∫",
]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(alignment.BYTE_VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_VOCABULARY)


def shown():
    """Bytes of the letters that byte-level vocabularies are written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts, sides):
    a, b = sides
    back, found = shown(), []
    piece = lambda i: (bytes([int(p[3:5], 16)]) if (p := b.id_to_piece(i)).startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
        links = [(x, y) for x, e in zip(ids_a, ends[0], strict=True) for y in (ids_b[j] for j, f in enumerate(ends[1]) if e == f)] if len(text) < 5000 else None
        cuts = sorted(set(ends[0]) & set(ends[1]))
        if links is None:
            links = [(ids_a[ends[0].index(c)], ids_b[ends[1].index(c)]) for c in cuts]
        parts, begin = [], 0
        for c in cuts:
            parts.append("|".join(",".join(str(i) for i, e in zip(ids, es, strict=True) if begin < e <= c) for ids, es in zip((ids_a, ids_b), ends, strict=True)))
            begin = c
        found.append((ids_a, ids_b, parts, links))
    counts = Counter(x for *_, links in found for x in links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (
            len(x), len(y), len(parts), len(links), sum(counts[z] == best[z[1]] for z in links), sum(counts[z] for z in links),
            hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "",
        )
        for x, y, parts, links in found
    ]


def got(df):
    return sorted(str((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256))) for r in df.collect())


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_same_as_brute_force(spark, sides, monkeypatch, sent):
    """Also where counts are shuffled to, not sent."""
    monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
    docs = [d[:2] for d in documents() if d[0] != 904] + [(904, "ab " * 900)] * 2 + [(2000 + i, t) for i, t in enumerate(ODD)]
    docs += [(2**53 + 1, "the id is exact"), (5, "the id is exact")]
    rows = [(i, t, None, None, None, None, None, None, None, None) for i, t in docs]
    want = brute([t for _, t in docs], sides)
    df = alignment.align(frame(spark, rows).withColumnRenamed("row", "a_id").withColumnRenamed("size", "times"))
    assert got(df) == sorted(str((d[0], w)) for d, w in zip(docs, want, strict=True))
    best_a = {r.doc_id: (r.n_best_a, r.n_links) for r in df.collect()}
    assert all(0 <= n <= links for n, links in best_a.values())


def ids_of(got):
    """The ids of both sides that the groups of a text's words spell."""
    sides = [g.split("|") for m in got for g in m.groups.decode()[:-1].split(";")]
    return [[int(i) for side in both for i in side.split(",")] for both in zip(*sides, strict=True)]


def test_ids_are_the_libraries(sides, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 50)
    a, b = sides
    ours = alignment.Aligner(alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY)
    assert ours.b.apart

    def same(texts):
        for text, got in zip(texts, ours(texts), strict=True):
            if got is not None:
                assert ids_of(got) == [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            else:
                assert not text or "▁" in text or b"".join(ours.b.entries[i] for i in b.encode(text)) != (" " + text).encode()

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet=" a▁b\n1é.,'<|>\t漢\r\x1c\xa0", max_size=60)), max_size=4))
    def check(texts):
        same(texts)

    check()
    same(ODD)


def test_merge():
    rnd = random.Random(2)
    for _ in range(200):
        x, y = (np.array(sorted(rnd.sample(range(60), rnd.randrange(1, 50)))) for _ in range(2))
        i, j = alignment.merge(x, y)
        assert x[i].tolist() == y[j].tolist() == sorted(set(x.tolist()) & set(y.tolist()))


def test_groups_spell_the_text(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id here")]
    rows = alignment.groups(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "place").collect()
    ours = alignment._aligner(alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY)
    for doc_id, text in docs:
        own = [r for r in rows if r.doc_id == doc_id]
        content = (" " + (text or "")).encode()
        assert all(b"".join(ours.a.entries[i] for i in r.a_ids) == b"".join(ours.b.entries[i] for i in r.b_ids) == content[r.start : r.end] for r in own)
        assert not own or [r.start for r in own] == [0, *(r.end for r in own[:-1])]


def test_pair_counts(spark):
    merged = spark.createDataFrame([([1, 1, 2], [5, 6, 5], [4, 1, 2]), ([1], [5], [3]), ([], [], [])], "a_id array<int>, b_id array<int>, times array<int>")
    assert sorted(map(tuple, alignment.pair_counts(merged).collect())) == [(1, 5, 7, 7, 7), (1, 6, 1, 7, 1), (2, 5, 2, 2, 7)]


def test_empty(spark):
    assert alignment.align(frame(spark, [])).count() == 0
