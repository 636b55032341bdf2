"""Sharding, mixing, rules, URLs."""

import hashlib
import math
import random
import re
import statistics
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from cases import documents, frame
from compare import assert_same
from pyspark.sql import functions as F

from tallyrook.llm import mixing, rules, shards, urls

SF = "/root/testdata/sf0.001"


def test_shards(spark):
    rows = shards.shard(frame(spark), [1.0] * 16).collect()
    docs = documents()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    texts = {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in docs}
    assert {(r.doc_id, r.text_crc32, r.size) for r in rows} == texts
    assert len({r.shard for r in rows if r.doc_id == 904}) == 1
    assert shards.shard(frame(spark, []), [1.0] * 16).count() == 0


def test_weighted_shards_are_near_their_shares(spark):
    rows = spark.range(30_000).select(shards.rendezvous([F.col("id")], [1.0, 2.0, 5.0]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 30_000 for r in rows}
    assert share[0] == pytest.approx(1 / 8, abs=0.02) and share[2] == pytest.approx(5 / 8, abs=0.02)
    with pytest.raises(ValueError):
        shards.rendezvous([F.lit(1)], [1.0, 0.0])


def winner(key, weights):
    """By the definition: the shard with the highest weight / -ln(u), u from the key's and the shard's hash."""
    own = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    scores = []
    for i, weight in enumerate(weights):
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", i), own) >> 11) + 1) / (2**53 + 2)
        scores.append((-weight / math.log(u), -i))
    return -max(scores)[1]


@pytest.mark.parametrize("weights", [[1.0] * 16, [1.0, 2.0, 5.0, 0.25], [3.0]])
def test_shards_are_the_winners(spark, weights):
    grown = [*weights, sum(weights) / len(weights)]
    rows = shards.shard(frame(spark, documents() + [(10**6 + i, "x", *[None] * 8) for i in range(2000)]), weights).collect()
    assert all((r.shard, r.grown_shard) == (winner(r.doc_id, weights), winner(r.doc_id, grown)) for r in rows)


def test_slots_of_shuffled_rows(spark, monkeypatch):
    """Behind a shuffle that adaptive execution may deal anew each time; a third of the rows have one id."""
    monkeypatch.setattr(shards, "BUCKET_ROWS", 100)
    docs = spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "cast(id % 5 AS string) AS text").repartition("doc_id")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50k")
    try:
        rows = shards.shard(docs, [1.0] * 4).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert sum(r.n for r in rows) == 40_000 and all(r.slots == r.n == r.high + 1 and r.low == 0 for r in rows)


def level(sizes, weights, most):
    """Targets by resharing the excess, over and over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark):
    rows = mixing.mix(frame(spark)).collect()
    sizes, longest = {}, {}
    docs = documents()
    for _, t, _, s, *_ in docs:
        n = len((t or "").split())
        sizes[s] = sizes.get(s, 0) + n
        longest[s] = max(longest.get(s, 0), n)
    want, taken = level(sizes, mixing.WEIGHTS, 3), {}
    source = {(i, len((t or "").split())): s for i, t, _, s, *_ in docs}
    for r in rows:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(frame(spark)).collect()))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mix_prefers_quality_and_levels_sources(spark):
    docs = [(i, "a b c d", "en", "s", 0, "", 0, "", "", 0) for i in range(4000)] + [(9999, "a " * 8000, "en", "t", 0, "", 0, "", "", 0)]
    labels = spark.range(4000).selectExpr("id AS label_id", "CASE WHEN id % 2 = 0 THEN 8.0D ELSE 0.5D END AS label_quality")
    rows = mixing.mix(frame(spark, docs), weights=(1.0, 9.0), quality=labels).where("size = 4 and copies > 0").select((F.col("doc_id") % 2).alias("odd")).groupBy("odd").count().collect()
    n = {r.odd: r["count"] for r in rows}
    assert n[0] > 3 * n[1]


def test_mixed_rows_keep_their_columns(spark):
    repeated = [(77, "one two three", "en", "s1", 0, "", 0, "", "", 0)] * 7
    docs = documents() + repeated
    out = mixing.mixed(frame(spark, docs))
    assert out.columns == frame(spark).columns
    want, got = {}, {}
    for r in mixing.mix(frame(spark, docs)).collect():
        key = (r.doc_id, r.size)
        want[key] = want.get(key, 0) + r.copies
    for r in out.collect():
        key = (r.doc_id, len((r.text or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def chosen_by_brute_force(docs, weights, most, quality):
    """Copies of each document: whole epochs, then documents in key order while the words before them leave room."""
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    target, out = level(sizes, weights, most), []
    for source in sizes:
        rows = []
        for i, t, s in docs:
            if s == source:
                u = (int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:13], 16) + 1) / (2**52 + 2)
                rows.append((-math.log(u) / quality.get(i, 1.0), -1 if i is None else i, size(t)))
        epochs = int(target[source] // sizes[source]) if sizes[source] else 0
        left = target[source] - epochs * sizes[source]
        for _, i, n in sorted(rows):
            more = 2 * left > n
            out.append((i, n, (epochs + more) * n))
            left -= n
    return sorted(out)


@pytest.mark.parametrize("bucket", [2_000, 3])
def test_mix_takes_the_documents_of_smallest_keys(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    docs = [(i, t, s) for i, t, _, s, *_ in documents(n=150)]
    quality = {i: 0.5 + i % 3 for i, *_ in docs if i is not None and i < 100}
    labels = spark.createDataFrame(list(quality.items()), "label_id long, label_quality double")
    rows = mixing.mix(frame(spark, documents(n=150)), quality=labels).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.taken) for r in rows) == chosen_by_brute_force(docs, mixing.WEIGHTS, 3, quality)


def measures(text):
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_rules_measure(spark):
    odd = ["a b c a b c", "a a a a", "#x $y", "x\nx\n\nx", "a b c d a b c e b c d"]
    docs = documents() + [(700 + i, t, *[None] * 8) for i, t in enumerate(odd)]
    docs += [(800, "once " * 3 + " ".join(f"w{i}" for i in range(30_000)) + "\nonce once once", *[None] * 8), (801, "ab\n" * 40_000, *[None] * 8), (802, "long" * 100_000, *[None] * 8)]
    want = sorted((str(i), *measures(t)) for i, t, *_ in docs)
    got = [(str(r.row.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.measure(frame(spark, docs)).collect()]
    assert sorted(got) == want
    assert rules.measure(frame(spark, [])).count() == 0


def test_rules_ledger(spark):
    rows = rules.ledger(frame(spark))
    out = rules.keep(frame(spark))
    assert out.columns == frame(spark).columns and out.count() == rows.where(rules.passes()).count()
    for r in rules.ablations(rows).collect():
        i = [n for n, _ in rules.RULES].index(r.rule)
        failed = [x.failed & rules.mask(rules.POLICY) for x in rows.select("failed").collect()]
        assert r.failing == sum(bool(f >> i & 1) for f in failed) and r.alone == sum(f == 1 << i for f in failed) and r.kept == sum(not f & ~(1 << i) for f in failed)


def test_rules_keep_good_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = rules.op8_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed and toxic = 0")
    share = {r.quality: r.x for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("x")).collect()}
    assert share[1] > 0.99 and share[0] < 0.2


@pytest.mark.parametrize("name, module", [("op8_quality_rules", rules), ("op9_url_model_ratio", urls)])
def test_same_as_sql(spark, name, module):
    assert_same(module.QUERIES[name](spark, SF), module.ORACLES[name], SF)


def test_urls(spark):
    given = [None, "", "no scheme", "http://A.EXAMPLE.com/en/9?x#y", "https://x.org/es/1", "http://example.net/de/8x", "http://y.net/de/1", "http://example.com/en/75", "http://q.net?de/", "x://://a", "http://" + "z" * 5000 + "/fr/1", "http://x.org/es/1", "http://notexample.net/de/8"]
    rows = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("score", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: r for r in urls.judge(rows).collect()}
    assert len(got) == len(given) and (got[0].host, got[0].path, got[0].rule) == ("", "", None) and got[2].host == ""
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.com", "/en/9", "com/en/", "block")
    assert [got[i].rule for i in (4, 5, 6, 7, 8)] == ["org/es/", "example.net/de/8", "net/de/", "example.com/en/7", None] and got[8].host == "q.net" and got[8].path == ""
    assert got[9].host == "" and got[9].path == "//a" or got[9].host == ":" and got[12].rule == "net/de/"
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert urls.judge(rows.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(rows.where("page_id in (0, 8, 10)")).collect()} == {"allow"}


def test_url_model_tells_held_out_urls_apart(spark):
    """Rules decide a part of the hosts; the model has to agree with the same rules on URLs whose rule it wasn't shown."""
    words = ["shop", "news", "blog", "media", "data"]
    good = [f"http://{a}-{b}.good/read/{k}" for a in words for b in words for k in range(4)]
    bad = [f"http://x{k}q{a}zz.bad/win/cash{k}{b}" for a in words for b in words for k in range(4)]
    pages = [(i, u) for i, u in enumerate(good + bad)]
    rules_ = [("allow", f"{a}-{b}.good/") for a in words[:4] for b in words] + [("block", f"x{k}q{a}zz.bad/") for a in words[:4] for k in range(4)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules_).where("rule is null").collect()
    assert len(got) == 40 and sum((r.verdict == "allow") == (".good" in r.host) for r in got) >= 38


def brute_urls(pages, rules_, order=3):
    """The method spelt out: Witten-Bell from the longest context down, scores, the threshold of URLs that a hash kept from the models."""
    rows = []
    for page_id, url in pages:
        rest = url.partition("://")[2] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in raw)
        fit = [(len(r), i, v) for i, (v, r) in enumerate(rules_) if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rows.append((page_id, host + path, max(fit)[2] if fit else None))
    held = lambda shown: hashlib.md5(shown.encode()).hexdigest() < "4"
    windows = lambda shown: [("\x02" * order + shown)[i : i + order + 1] for i in range(len(shown))]
    seen = {x: Counter(w for _, shown, v in rows if v == x and not held(shown) for w in windows(shown)) for x in ("allow", "block")}
    alphabet = {w[-1] for _, shown, _ in rows for w in windows(shown)}

    def p(x, gram):
        if not gram:
            return 1 / (len(alphabet) + 1)
        k = len(gram)
        after = Counter()
        for w, n in seen[x].items():
            if w[order + 1 - k : order] == gram[:-1]:
                after[w[-1]] += n
        n, t = sum(after.values()), len(after)
        return (after[gram[-1]] + t * p(x, gram[1:])) / (n + t) if n + t else p(x, gram[1:])

    cache = {}
    ratio = lambda w: cache[w] if w in cache else cache.setdefault(w, math.log(p("allow", w)) - math.log(p("block", w)))
    score = {shown: sum(map(ratio, windows(shown))) / len(shown) for _, shown, _ in rows if shown}

    def threshold(part):
        own = {x: [score[s] for _, s, v in rows if s and v == x and held(s) == part] for x in ("allow", "block")}
        if not all(own.values()):
            return None
        m, d = ({x: f(v) for x, v in own.items()} for f in (statistics.fmean, lambda v: statistics.pstdev(v) + 1e-9))
        return (m["allow"] * d["block"] + m["block"] * d["allow"]) / (d["allow"] + d["block"])

    limit = next((t for t in (threshold(True), threshold(False)) if t is not None), -math.inf)
    return {page_id: (v or ("allow" if score.get(s, 0.0) >= limit else "block"), score.get(s, 0.0)) for page_id, s, v in rows}


@pytest.mark.parametrize("sent, salts", [(1_000_000, 8), (0, 3)])
def test_url_model_is_its_definition(spark, monkeypatch, sent, salts):
    """Sent to all tasks or met in salted places; with repeated, long, empty and null URLs, and characters beyond ASCII."""
    monkeypatch.setattr(urls, "SENT_WINDOWS", sent)
    monkeypatch.setattr(urls, "SALTS", salts)
    rnd = random.Random(9)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9)))
    pages = [f"http://{word('abcn')}.good/{word('abcn')}" for _ in range(40)] + [f"http://{word('xyz0')}.bad/{word('xyz0')}" for _ in range(40)]
    pages += [f"https://{word(letters)}.else/{word(letters)}" for letters in ("abcn", "xyz0", "axé") for _ in range(15)] + ["http://hot.else/é"] * 30 + [None, "", "none", "http://" + "ab" * 800]
    rules_ = [("allow", "good/"), ("block", "bad/")]
    want = brute_urls(list(enumerate(pages)), rules_)
    got = {r.page_id: (r.verdict, r.score) for r in urls.judge(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), rules_).collect()}
    assert {k: v for k, (v, _) in got.items()} == {k: v for k, (v, _) in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want) and {v for v, _ in want.values()} == {"allow", "block"}


def test_held_out_urls_dont_train(spark):
    """Windows that held-out URLs alone have count for neither model."""
    held = next(f"q{i}.good" for i in range(99) if hashlib.md5(f"q{i}.good/".encode()).hexdigest() < "4")
    pages = [(i, f"http://{n}/") for i, n in enumerate(["a.good", "b.bad", held])]
    scores = {r.page_id: r.score for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), [("allow", "good/"), ("block", "bad/")]).collect()}
    assert scores == {k: pytest.approx(s) for k, (_, s) in brute_urls(pages, [("allow", "good/"), ("block", "bad/")]).items()}
