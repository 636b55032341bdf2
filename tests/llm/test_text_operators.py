"""BPE, token files, near duplicates, passages, language model."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from cases import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrook.llm import binary, bpe, katz, ordered_minhash, passages, suffix_order, words

SF = "/root/testdata/sf0.001"
BPE = bpe.ByteBPE.load(bpe.VOCABULARY)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
ENCODER = binary.Encoder(binary.VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cdeéß'sTtlL  \n\t\r\x1c\x1d\x85\xa0\u2003\u2028ж中12٣²!?#😀\u0301\x00"), max_size=60))
def test_bpe_is_the_library(text):
    ids = BPE.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text) and BPE.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cd'sé<|endoftext|>  \n\x1c\x85\u2028ж9²"), max_size=60))
def test_token_encoder_is_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ENCODER.library.encode(text, add_special_tokens=False).ids


def test_bpe_long_pre_token():
    for text in ("the" * 20_000, "a" * 50_000, "".join(random.Random(1).choice("abcdeth") for _ in range(30_000))):
        assert np.frombuffer(BPE.encode(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert not BPE.queue.top and not any(BPE.queue.buckets.values())


def test_bpe_rows(spark):
    rows = bpe.digests(frame(spark).select("doc_id", "text", "size")).collect()
    want = []
    for i, t, *_ in documents():
        ids = REFERENCE.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert bpe.digests(frame(spark, []).select("doc_id", "text")).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(frame(spark).withColumnRenamed("size", "ids"))


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "t")
    binary.write(frame(spark), path)
    docs = documents()
    ids = sorted((-(2**63) if i is None else i, [*ENCODER.library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in docs)
    rows = sorted(binary.placed(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None if i == -(2**63) else i for i, _ in ids]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((len(x), crc(x)) for _, x in ids)
    # what Spark's writer left is the format, byte for byte, and any reader of the compression reads it whole
    files = sorted((tmp_path / "t").glob("part-*"))
    whole = []
    for f in files:
        content = zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read()
        frames = [binary.unpack_frame(part) for part in _frames(f)]
        assert b"".join(binary.pack_frame([(i, ids.tobytes()) for i, ids in x]) for x in frames) == content
        whole += [d for x in frames for d, _ in x]
    assert sorted(whole) == [i for i, _ in ids]
    found = binary.find(spark, path, [904, 5, 12345])
    assert len(found[904]) == 2 and found[12345] == [] and found[5][0].tolist() == dict(ids)[5]
    binary.write(frame(spark, []), str(tmp_path / "e"))
    assert binary.placed(spark, str(tmp_path / "e")).count() == 0


def test_token_files_are_ordered_by_number(spark, tmp_path):
    names = [f"part-{i}-aa" for i in ("00007", "99999", "100000")]
    for i, name in enumerate(names):
        content = b"".join(r + binary.SEPARATOR for r in binary.records(iter([(i, np.arange(10 * (i + 1), dtype="<u4").tobytes())])))
        (tmp_path / name).write_bytes(content)
    rows = sorted((r.doc_id, r.start, r.n_tokens) for r in binary.placed(spark, str(tmp_path)).collect())
    assert rows == [(0, 0, 10), (1, 10, 20), (2, 30, 30)]
    assert [len(x) for x in binary.find(spark, str(tmp_path), [2])[2]] == [30]


def _frames(path):
    f = binary.open_file(str(path))
    return [zstandard.ZstdDecompressor().decompress(f.fetch(f.starts[i], f.frames[i][0]), max_output_size=f.frames[i][1]) for i in range(len(f.frames))]


def test_token_file_reads_only_what_it_needs_and_sees_damage():
    docs = [(i, np.arange(i, i + 500, dtype=np.uint32).tobytes()) for i in range(200)]
    data = bytearray(b"".join(r + binary.SEPARATOR for r in binary.records(iter(docs), frame_ids=5000)))
    f = binary.TokenFile(len(data), lambda at, n: bytes(data[at : at + n]))
    assert len(f.frames) == 20 and f.find(57)[0].tolist() == list(range(57, 557)) and f.decompressed == 1
    data[f.starts[3] + 40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        f.frame(3)


def labelled_shingles(text):
    """Five-word shingles, or all words where there are fewer, each with how many equal ones came before it."""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    k = min(5, len(words))
    seen, out = collections.Counter(), []
    for i in range(len(words) - k + 1 if words else 0):
        shingle = tuple(words[i : i + k])
        out.append((shingle, seen[shingle]))
        seen[shingle] += 1
    return out


def similar(a, b):
    """m / (a + b - m) >= 0.8 with m the longest common subsequence of labelled shingles."""
    if not a or not b or 10 * min(len(a), len(b)) < 8 * max(len(a), len(b)):
        return False
    place, tails = {x: i for i, x in enumerate(b)}, []
    for at in (place[x] for x in a if x in place):
        i = bisect.bisect_left(tails, at)
        tails[i : i + 1] = [at]
    m = len(tails)
    return 10 * m >= 8 * (len(a) + len(b) - m)


def classes_by_brute_force(docs):
    shingles = [labelled_shingles(t) for _, t, *_ in docs]
    part = list(range(len(docs)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or "") or similar(shingles[i], shingles[j]):
                part[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def grouped(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r.class_id, r.tid if r.class_id is None else 0), []).append(str(r.doc_id))
    return sorted(map(sorted, groups.values()))


def edited(rnd, words, percent):
    """A copy with this share of words changed at places drawn one by one: replaced, left out or put in."""
    out = []
    for w in words:
        kind = rnd.randrange(3) if rnd.random() < percent / 100 else -1
        out += [f"n{rnd.randrange(10**6)}"] if kind == 0 else [] if kind == 1 else [w, f"n{rnd.randrange(10**6)}"] if kind == 2 else [w]
    return out


def test_recall_by_edit_rate(spark):
    """Of originals of 300 words and copies of them: every pair of similarity 0.8 or more is found at any edit rate and no other, so what
    is lost at a rate lies below the similarity. One changed word breaks five shingles, which ends it between two and three percent."""
    rnd, rates, each = random.Random(12), (0, 1, 2, 3, 5, 10), 30
    rows, pairs = [], []
    for rate in rates:
        for _ in range(each):
            words_ = [f"w{rnd.randrange(5000)}" for _ in range(300)]
            pairs.append((rate, len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(words_)), (len(rows) + 1, " ".join(edited(rnd, words_, rate)))]
    df = spark.createDataFrame([(i, t, *[None] * 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, size long, _id string, tid string, words long")
    group = {}
    for g in grouped(ordered_minhash.near_duplicates(df).collect()):
        group |= dict.fromkeys(g, g[0])
    found = {rate: [group[str(a)] == group[str(b)] for r, a, b in pairs if r == rate] for rate in rates}
    true = {rate: [rows[a][1] == rows[b][1] or similar(labelled_shingles(rows[a][1]), labelled_shingles(rows[b][1])) for r, a, b in pairs if r == rate] for rate in rates}
    assert found == true
    share = {rate: sum(x) / each for rate, x in found.items()}
    assert share[0] == share[1] == 1.0 and share[2] > 0.6 and share[3] < 0.6 and share[5] < 0.2 and share[10] == 0.0
    print("recall by percent of words changed:", share)


def test_near_duplicates(spark):
    rows = ordered_minhash.near_duplicates(frame(spark)).collect()
    assert len(rows) == len(documents())
    assert grouped(rows) == classes_by_brute_force(documents())
    kept = ordered_minhash.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == len(classes_by_brute_force(documents()))
    assert ordered_minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = ordered_minhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert grouped(rows) == classes_by_brute_force(docs)


def family(n=400, length=200, seed=11):
    """Different near copies of one text: most pairs are too far apart, few links hold a class together."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    docs = []
    for i in range(n):
        copy = list(base)
        for _ in range(rnd.randrange(3, 7)):
            copy[rnd.randrange(length)] = f"c{rnd.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    return docs


def test_near_duplicates_of_a_family(spark, monkeypatch):
    monkeypatch.setattr(ordered_minhash, "BLOCK", 40, raising=False)
    docs = family()
    want = classes_by_brute_force(docs)
    assert 1 < max(map(len, want)) < len(docs)
    assert grouped(ordered_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == want


def test_alignment_sees_order_and_band():
    a = np.arange(100, dtype=np.uint64)
    assert ordered_minhash.aligned(a, a) and not ordered_minhash.aligned(a, a[::-1].copy())
    moved = np.concatenate([a[50:], a[:50]])
    assert not ordered_minhash.aligned(a, moved)
    assert ordered_minhash.aligned(a, a[:80]) and not ordered_minhash.aligned(a, a[:79])
    keys = [ordered_minhash.sketch(x)[0] for x in (words.mix(a), words.mix(a)[::-1].copy())]
    assert not (keys[0] == keys[1]).any()


def windows(strings, length):
    count = collections.Counter(x[i : i + length] for x in strings for i in range(len(x) - length + 1))
    return [[i + length <= len(x) and count[x[i : i + length]] > 1 for i in range(len(x))] for x in strings]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_suffix_order_finds_repeats(seed):
    rnd = np.random.default_rng(seed)
    letters, length = int(rnd.integers(1, 6)), int(rnd.integers(14, 60))
    base = [bytes(rnd.integers(97, 97 + letters, int(rnd.integers(0, 300))).astype(np.uint8)) for _ in range(5)]
    strings = [base[int(rnd.integers(5))] + bytes([120] * int(rnd.integers(0, 3))) + base[int(rnd.integers(5))][: int(rnd.integers(0, 200))] for _ in range(10)]
    text = np.frombuffer(b"".join(strings), np.uint8)
    got = suffix_order.repeated(text, np.concatenate([[0], np.cumsum([len(s) for s in strings])]), length)
    assert got.tolist() == sum(windows(strings, length), [])


def removed(docs, length, words=0):
    strings = [(t or "").encode() for _, t, *_ in docs]
    out = []
    for (i, *_), x, starts in zip(docs, strings, windows(strings, length), strict=True):
        gone = bytearray(len(x))
        for k, s in enumerate(starts):
            if s:
                gone[k : k + length] = b"\1" * length
        if words:
            for run in re.finditer(rb"\x01+", bytes(gone)):
                if len(touched(x, *run.span())) < words:
                    gone[run.start() : run.end()] = bytes(run.end() - run.start())
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((str(i), len(x), len(x) - len(kept), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def touched(text, begin, end):
    return [w for w in re.finditer(rb"[^\x20\x09-\x0D]+", text) if w.start() < end and w.end() > begin]


@pytest.mark.parametrize("chunk", [1 << 20, 5_000])
def test_passages_by_several_rules(spark, monkeypatch, chunk):
    monkeypatch.setattr(passages, "CHUNK_BYTES", chunk)
    rules = (passages.Rule(120, 30), passages.Rule(400), passages.Rule(200, 51))
    rows = passages.repeats(frame(spark), rules).collect()
    for i, rule in enumerate(rules):
        got = sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans[i]), len(r.spans[i])) for r in rows)
        assert got == [x[:4] for x in removed(documents(), *rule)]
    want = [x[4] for x in removed(documents(), 120, 30)]
    assert sorted(want) == sorted(hashlib.sha256(r.kept).hexdigest() for r in rows)
    assert any(x[2] for x in removed(documents(), 200, 51))


@pytest.mark.parametrize("chunk, common", [(1 << 20, 1000), (5_000, 2)])
def test_passages(spark, monkeypatch, chunk, common):
    monkeypatch.setattr(passages, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(passages, "COMMON", common)
    rows = passages.repeats(frame(spark)).selectExpr("doc_id", "n_bytes", "aggregate(spans[0], 0L, (a, s) -> a + s.end - s.start)", "size(spans[0])", "sha2(kept, 256)").collect()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == removed(documents(), passages.LENGTH)
    assert passages.repeats(frame(spark, [])).count() == 0


def test_passages_that_close_a_document(spark, monkeypatch):
    """Windows that end with a trigger have one key, whether their document goes on or not, and each key is compared alone."""
    monkeypatch.setattr(passages, "RANGE_BYTES", 2_000)
    monkeypatch.setattr(passages, "GROUP_BYTES", 1)
    rnd = random.Random(5)
    make = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    docs = []
    for i in range(60):
        text = make(900)
        end = int(suffix_order.cuts(suffix_order.Hashes(np.frombuffer(text.encode(), np.uint8)), np.array([0, len(text)]))[-1])
        passage = text[end - passages.LENGTH : end]
        docs += [(2 * i, make(300) + passage), (2 * i + 1, make(300) + passage + make(300))]
    rows = passages.repeats(spark.createDataFrame(docs, "doc_id long, text string")).selectExpr("doc_id", "n_bytes", "aggregate(spans[0], 0L, (a, s) -> a + s.end - s.start)", "size(spans[0])", "sha2(kept, 256)").collect()
    want = removed(docs, passages.LENGTH)
    assert all(x[2] >= passages.LENGTH for x in want)
    assert sorted((str(r[0]), *r[1:]) for r in rows) == want


def test_passages_leave_the_other_columns(spark):
    out = passages.remove(frame(spark))
    assert out.columns == frame(spark).columns
    rows = out.collect()
    want = {i: (n, gone) for i, n, gone, *_ in removed(documents(), passages.LENGTH)}
    assert len(rows) == len(documents()) and all(r.lang in ("en", None) for r in rows)
    texts = {i: t for i, t, *_ in documents() if i is not None}
    for r in rows:
        if r.doc_id is not None and not want[str(r.doc_id)][1]:
            assert r.text == texts[r.doc_id]
        assert "�" not in (r.text or "")


def test_passages_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = passages.op2_repeated_passages(spark, SF).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == removed(docs, passages.LENGTH)
    assert sorted((str(r.doc_id), r.n_passage_bytes, r.n_passages) for r in rows) == [(x[0], x[2], x[3]) for x in removed(docs, *passages.PASSAGE)]


def good_turing(counts):
    """Discounts by Katz's formula, for the largest limit where all lie between 0 and 1; else half a count off."""
    n = collections.Counter(counts)
    for limit in range(5, 0, -1):
        if all(n[c] for c in range(1, limit + 2)) and (limit + 1) * n[limit + 1] < n[1]:
            cut = (limit + 1) * n[limit + 1] / n[1]
            d = {c: ((c + 1) * n[c + 1] / n[c] / c - cut) / (1 - cut) for c in range(1, limit + 1)}
            if all(0 < x < 1 for x in d.values()):
                return d
    return {c: (c - 0.5) / c for c in range(1, 6)}


def tokens_of(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", low) if w] + ["</end>"]


def scores_by_brute_force(docs, order, train=None):
    """By the definition alone: counts in dictionaries, probabilities by recursion."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    learned = [t for i, t, *_ in docs if not held(i)] if train is None else [t for _, t, *_ in train]
    grams = [collections.Counter() for _ in range(order)]
    for t in learned:
        words = ["<start>"] * (order - 1) + tokens_of(t)
        for at in range(order - 1, len(words)):
            for k in range(order):
                grams[k][tuple(words[at - k : at + 1])] += 1
    d = [good_turing(g.values()) for g in grams]
    after = [collections.defaultdict(dict) for _ in range(order)]
    for k in range(1, order):
        for g, c in grams[k].items():
            after[k][g[:-1]][g[-1]] = c
    left = lambda k, c: d[k].get(c, 1) * c
    total, types = sum(grams[0].values()), len(grams[0])
    unknown = sum(c - left(0, c) for c in grams[0].values()) / total if total else 1.0

    def single(w):
        c = grams[0][w,]
        if not total or unknown < 1e-12:
            return (c + 0.1) / (total + 0.1 * (types + 1))
        return left(0, c) / total if c else unknown

    def whole(k, h):
        mass = sum(left(k, c) for c in after[k][h].values())
        n = sum(after[k][h].values())
        return mass, n + (0.5 if n - mass < 1e-9 else 0)

    weights = {}

    def p(h, w):
        if not h:
            return single(w)
        k = len(h)
        if h not in after[k]:
            return p(h[1:], w)
        mass, n = whole(k, h)
        if w in after[k][h]:
            return left(k, after[k][h][w]) / n
        if h not in weights:
            weights[h] = (1 - mass / n) / (1 - sum(p(h[1:], x) for x in after[k][h]))
        return weights[h] * p(h[1:], w)

    for k in range(1, order):
        for h in [*list(after[k])[:15], ("<never>",) * k]:
            assert sum(p(h, w) for (w,) in [*grams[0], ("<unknown>",)]) == pytest.approx(1)
    rows = []
    for i, t, *_ in docs:
        words = ["<start>"] * (order - 1) + tokens_of(t)
        own = words[order - 1 :]
        base = sum(math.log10((grams[0][w,] + 0.1) / (total + 0.1 * (types + 1))) for w in own)
        score = sum(math.log10(p(tuple(words[at - order + 1 : at]), words[at])) for at in range(order - 1, len(words)))
        rows.append((str(i), held(i), len(own), sum(grams[0][w,] > 0 for w in own), total, base, score))
    return sorted(rows)


def check_scores(rows, docs, order=katz.ORDER, train=None):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    want = scores_by_brute_force(docs, order, train)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("order, chunk, span", [(1, 500, 2000), (2, 10**6, 10**6), (3, 10**6, 10**6), (3, 500, 2000), (4, 700, 3000)])
def test_katz(spark, monkeypatch, order, chunk, span):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(katz, "RANGE_TOKENS", span)
    check_scores(katz.score(frame(spark), order=order).collect(), documents(), order)


def repetitive(seed=3):
    """Few words and many repeats, so that histories have large counts, and some no discounts."""
    rnd = random.Random(seed)
    line = [rnd.choice("abcdefgh") for _ in range(40)]
    return [(i, " ".join(rnd.choice([line, [rnd.choice("abcdefghijklmnop") for _ in range(30)], ["x", "y"] * 8])), *[None] * 8) for i in range(120)]


@pytest.mark.parametrize("chunk, span", [(10**6, 10**6), (300, 500)])
def test_katz_on_repetitive_texts(spark, monkeypatch, chunk, span):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(katz, "RANGE_TOKENS", span)
    check_scores(katz.score(frame(spark, repetitive())).collect(), repetitive())


def test_katz_on_tables_without_training_or_discounts(spark):
    for docs in ([(42, "a b")], [(1, "A b"), (1, "a b"), (None, "c")]):
        rows = [(i, t, *[None] * 8) for i, t in docs]
        check_scores(katz.score(frame(spark, rows)).collect(), rows)
    assert katz.score(frame(spark, [])).count() == 0


def test_katz_model_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 800)
    monkeypatch.setattr(katz, "RANGE_TOKENS", 3000)
    path = str(tmp_path / "model")
    katz.train(frame(spark, documents(seed=1)), path)
    model = katz.load(spark, path)
    assert model.order == 3 and model.ranges > 1
    other = documents(seed=2)[:12] + documents(seed=1)[:12]
    check_scores(katz.score(frame(spark, other), model=model).collect(), other, 3, documents(seed=1))


def test_ids_may_be_texts(spark):
    docs = spark.createDataFrame([("a", "eins zwei drei"), ("b", None), (None, "vier"), ("c", "x " * 300), ("d", "x " * 300)], "doc_id string, text string")
    assert {r.doc_id for r in katz.score(docs).collect()} == {"a", "b", None, "c", "d"}
    gone = {r.doc_id: r.n for r in passages.repeats(docs).selectExpr("doc_id", "size(spans[0]) AS n").collect()}
    assert gone == {"a": 0, "b": 0, None: 0, "c": 1, "d": 1}
    assert {r.doc_id: r.class_id for r in ordered_minhash.near_duplicates(docs).collect()}["d"] == "c"


def test_katz_beats_its_base_and_lower_orders_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = {}
    for order in (1, 2, 3):
        rows = [r for r in katz.score(docs, order=order).collect() if r.held_out]
        total[order], total[0] = sum(r.score for r in rows), sum(r.base_score for r in rows)
    assert total[0] < total[2] and total[1] < total[2] and total[1] < total[3]


def test_discounts_follow_katz():
    d = katz.discounts([0, 1000, 400, 200, 120, 80, 60])
    top = 6 * 60 / 1000
    assert d[1] == pytest.approx((2 * 400 / 1000 - top) / (1 - top)) and d[5] == pytest.approx((6 * 60 / (5 * 80) - top) / (1 - top))
    assert katz.discounts([0] * 7)[1] == 0.5


def test_clashes_of_one_hash_are_told_apart():
    """Sequences and windows whose first hashes are equal count apart where the second ones differ; in suffix order too."""
    from tallyrook.llm.blobs import pack, rows, unpack

    first, counts = np.array([5, 5, 9], np.uint64), np.array([1, 1, 1], np.uint32)
    one, two = (pack(first, np.array(second, np.int64), counts) for second in ([1, 2, 3], [2, 4, 3]))
    group = pa.Table.from_batches([rows(["a", "b"], ["sequences0"] * 2, [0, 0], [one, two])])
    answers = {r["chunk"]: [x.tolist() for x in unpack(r["data"])] for r in passages._count("sequences0", group).to_pylist()}
    assert answers == {"a": [[1, 2, 2], [1, 1, 1]], "b": [[2, 1, 2], [0, 1, 0]]}
    a, b, which = suffix_order.pairs(np.array([3, 1, 3, 1], np.uint64), np.array([7, 7, 8, 7], np.uint64))
    assert (a.tolist(), b.tolist(), which.tolist()) == ([1, 3, 3], [7, 7, 8], [1, 0, 2, 0])
    data = np.frombuffer(b"abcabcabd", np.uint8)
    one, two = (suffix_order.Hashes(data, family)(np.array([0, 3, 6]), np.array([3, 6, 9])) for family in (0, 1))
    assert one[0] == one[1] != one[2] and two[0] == two[1] != two[2] and one[0] != two[0]


def test_windows_without_a_cut_are_compared_by_both_hashes(monkeypatch):
    """A first hash that clashes for every window leaves the second to decide."""
    real = suffix_order.Hashes.__call__
    first = suffix_order.Hashes(np.arange(9, dtype=np.uint8)).down[1]
    monkeypatch.setattr(suffix_order.Hashes, "__call__", lambda self, s, e: np.where((e - s == 40) & (self.down[1] == first), 7, real(self, s, e)).astype(np.uint64))
    text = np.frombuffer(b"a" * 50 + bytes(range(60, 120)) + b"a" * 45, np.uint8)
    offsets = np.array([0, 110, 155])
    got = suffix_order.repeated(text, offsets, 40)
    windows = {}
    for i in [*range(71), *range(110, 116)]:
        windows.setdefault(text[i : i + 40].tobytes(), []).append(i)
    assert sorted(np.flatnonzero(got).tolist()) == sorted(i for at in windows.values() if len(at) > 1 for i in at)
