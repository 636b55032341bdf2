"""Suffix-array deduplication (operator 2): bytes of passages that occur elsewhere in the corpus are removed.

A window of LENGTH bytes is repeated if it begins at another position of any document. Prefix-free parsing finds them all:

1. Rolling-hash triggers cut texts into phrases. The dictionary with the number of times that each phrase occurs is
   kept by hash ranges. A window with a whole phrase that occurs once can't be repeated, which ends most of the text here.
2. The parse: of each phrase still open, the sequence of phrases that covers all windows that begin in it. A sequence that
   occurs twice settles all those windows at once; one occurrence stays on as what others are compared with.
3. What is left lies within a phrase or two of the ends of repeats. Such windows go, with their text, to the range of
   their rarest whole phrase; there the suffix arrays of dictionary and parse give the order of all suffixes, in
   which equal windows are neighbours. Windows without a whole phrase, or with common ones only, so that no phrase gathers more
   than COMMON of them, are compared by their hash.

Documents are handled in chunks of about CHUNK_BYTES, which ask and get answers by hash range; copies of a text, however
many, are settled in step 2 with one row for each chunk that has some. Phrases are counted by 64 bits, where a clash only leaves a
window open; sequences, and windows compared by hash, are told apart by 128 bits of two hashes; step 3 compares bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import BLOB, batch, each, pack, pack_names, parts, range_starts, requests, rows, unpack, unpacked_names
from .common import BLANKS, drop_folders, drop_stash, small_batches, stash, table
from .suffix_order import WIDTH, Hashes, cuts, pairs, repeated
from .words import mix


class Rule(NamedTuple):
    """What a repeated passage is: runs of bytes covered by repeated strings of `length` bytes that hold, or touch, at least
    `words` words."""

    length: int
    words: int = 0


LENGTH = 400
#: Passages of over 50 words; in the shortest such, with words of three letters, a string of 200 bytes fits.
PASSAGE = Rule(200, 51)
CHUNK_BYTES = 1 << 20
#: Bytes of text for one range of hashes.
RANGE_BYTES = 16 << 20
#: A window is compared in the range of its rarest phrase if that occurs at most this often.
COMMON = 256
#: Bytes of runs put in order at a time, besides those of one phrase.
GROUP_BYTES = 1 << 19


class Texts:
    """A chunk: documents, one after the other, and their parse. Documents shorter than any window are left out of the parse."""

    def __init__(self, data: bytes, least: int, parse: bool = True):
        self.names, self.letters, self.sizes, self.tids, self.data, at = unpack(data)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        if not parse:
            return
        self.hashes, self.second = Hashes(self.data), Hashes(self.data, 1)
        bounds = np.unique(np.concatenate([at.astype(np.int64), self.offsets]))
        begin, end = bounds[:-1], bounds[1:]
        doc = np.searchsorted(self.offsets, begin, "right") - 1
        long = (self.sizes >= least)[doc] if len(doc) else np.zeros(0, bool)
        self.begin, self.end, self.doc = begin[long], end[long], doc[long]
        self.phrases = self.hashes(self.begin, self.end)
        #: Whether the phrase lies between two triggers, so that its place depends on the text around it alone. A trigger may
        #: end the document too.
        self.whole = (self.begin != self.offsets[self.doc]) & ((self.end != self.offsets[self.doc + 1]) | np.isin(self.end, at.astype(np.int64)))
        self.distinct, self.which = np.unique(self.phrases, return_inverse=True)

    @staticmethod
    def packed(docs: list[tuple[str | None, bytes, bytes]]) -> bytes:
        data = np.frombuffer(b"".join(t for _, _, t in docs), np.uint8)
        tids = np.frombuffer(b"".join(t for _, t, _ in docs), np.uint8)
        sizes = np.array([len(t) for _, _, t in docs], np.uint32)
        at = cuts(Hashes(data), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
        return pack(*pack_names([i for i, _, _ in docs]), sizes, tids, data, at.astype(np.uint64))

    def open(self, counts: np.ndarray, length: int) -> np.ndarray:
        """Windows that hold no whole phrase that occurs once; counts: of the distinct phrases."""
        single = self.whole & (counts[self.which] < 2)
        first, last = self.end[single] - length, self.begin[single] - WIDTH
        first = np.maximum(first, self.offsets[self.doc[single]])
        some = first <= last
        n = len(self.data)
        covered = np.bincount(first[some], minlength=n + 1).astype(np.int32) - np.bincount(last[some] + 1, minlength=n + 1)
        out = np.cumsum(covered[:-1], dtype=np.int32) == 0
        # windows that reach over the end of their document
        for end, size in zip(self.offsets[1:].tolist(), self.sizes.tolist(), strict=True):
            out[end - min(size, length - 1) : end] = False
        return out

    def sequences(self, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases in which windows begin, both hashes of the text that covers these, sorted and distinct, and each's place there."""
        if not len(self.begin):
            chosen = np.empty(0, np.int64)
        else:
            # the phrases' own parts of the text, and what lies between them
            edges = np.stack([self.begin, self.end], axis=1).reshape(-1)
            chosen = np.flatnonzero(np.logical_or.reduceat(np.append(windows, False), edges)[::2])
        cover = np.searchsorted(self.end, np.minimum(self.end[chosen] - 1 + length, self.offsets[self.doc[chosen] + 1]))
        begin, end = self.begin[chosen], self.end[cover]
        return chosen, *pairs(self.hashes(begin, end), self.second(begin, end))

    def spread(self, chosen: np.ndarray) -> np.ndarray:
        """Positions of the phrases chosen."""
        steps = np.zeros(len(self.data) + 1, np.int8)
        steps[self.begin[chosen]] += 1
        steps[self.end[chosen]] -= 1
        return np.cumsum(steps[:-1], dtype=np.int8).astype(bool)

    def rarest(self, windows: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
        """For each window, the whole phrase in it that occurs least, by hash among equals; -1: none, or all are common."""
        whole = np.flatnonzero(self.whole)
        if not len(whole):
            return np.full(len(windows), -1)
        count, name = counts[self.which[whole]], self.phrases[whole]
        order = np.lexsort((name, count))
        rank = np.empty(len(whole), np.int64)
        rank[order] = np.arange(len(whole))
        # equal phrases of one text get different ranks in place order, the earlier the lower, which windows see alike
        a = np.searchsorted(self.begin[whole], windows + WIDTH)
        b = np.searchsorted(self.end[whole], windows + length, "right") - 1
        levels, out = [rank], np.full(len(windows), -1)
        while len(levels[-1]) > (1 << (len(levels) - 1)):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        some = np.flatnonzero(a <= b)
        span = (b - a + 1)[some]
        level = np.frexp(span.astype(float))[1] - 1
        for k in np.unique(level).tolist():
            here = some[level == k]
            out[here] = np.minimum(levels[k][a[here]], levels[k][b[here] - (1 << k) + 1])
        found = out >= 0
        best = order[out[found]]
        out[found] = np.where(count[best] <= COMMON, whole[best], -1)
        return out


class Open:
    """What of a chunk is still to be compared once phrases and sequences are counted."""

    def __init__(self, texts: Texts, length: int, counts: np.ndarray, total: np.ndarray, owned: np.ndarray):
        windows = texts.open(counts, length)
        chosen, *_, which = texts.sequences(windows, length)
        twice = total[which] > 1
        self.settled = windows & texts.spread(chosen[twice])
        kept = np.zeros(len(chosen), bool)
        kept[np.unique(which, return_index=True)[1]] = True
        self.wanted = windows & ~self.settled
        position = np.flatnonzero(self.wanted | (windows & texts.spread(chosen[twice & kept & (owned[which] > 0)])))
        wanted = self.wanted[position]
        phrase = texts.rarest(position, counts, length)
        plain = phrase < 0
        # by hash
        self.plain = position[plain]
        self.plain_wanted = wanted[plain]
        self.hashes, self.checks, self.hash_which = pairs(texts.hashes(self.plain, self.plain + length), texts.second(self.plain, self.plain + length))
        # runs of windows that follow each other and have one phrase
        position, phrase, wanted = position[~plain], phrase[~plain], wanted[~plain]
        fresh = np.ones(len(position), bool)
        fresh[1:] = (position[1:] != position[:-1] + 1) | (phrase[1:] != phrase[:-1]) | (wanted[1:] != wanted[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(position)))
        # among equally rare phrases the one of the smallest hash was taken, so the hash is mixed again to deal keys evenly
        key = mix(texts.phrases[phrase[first]])
        order = np.argsort(key, kind="stable")
        self.key, self.first, self.size, self.asks = key[order], position[first][order], size[order], wanted[first][order]

    def packed(self) -> bytes:
        """What is needed to read the answers: settled windows, those compared by hash, and runs that ask."""
        asked = self.plain_wanted
        return pack(
            np.packbits(self.settled), self.plain[asked].astype(np.uint64), self.hash_which[asked].astype(np.uint32),
            self.first[self.asks].astype(np.int64), self.size[self.asks].astype(np.uint32),
        )


def _ask_runs(name: str, kind: str, texts: Texts, length: int, left: Open, n: int) -> list[tuple[str, str, int, bytes]]:
    at = range_starts(left.key, n)
    out = []
    for r in range(n):
        a, b = at[r], at[r + 1]
        if a < b:
            width = left.size[a:b] + length - 1
            places = np.repeat(left.first[a:b], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            out.append((name, kind, r, pack(left.key[a:b], left.size[a:b].astype(np.uint32), left.asks[a:b].astype(np.uint8), texts.data[places])))
    return out


def _count(kind: str, group: pa.Table) -> pa.Table:
    """Answers with the sums of the asked hashes, and whether the asking chunk is the first that has it."""
    names = group.column("chunk").to_pylist()
    blobs = [unpack(x) for x in group.column("data").to_pylist()]
    keys = np.concatenate([b[0] for b in blobs])
    which = pairs(keys, np.concatenate([b[1] for b in blobs]))[2] if len(blobs[0]) > 2 else np.unique(keys, return_inverse=True)[1]
    total = np.rint(np.bincount(which, np.concatenate([b[-1] for b in blobs]))).astype(np.uint32)
    free, at, out = np.ones(len(total), bool), 0, []
    for name, blob in zip(names, blobs, strict=True):
        w = which[at : at + len(blob[0])]
        at += len(w)
        out.append((name, kind, group.column("r")[0].as_py(), pack(total[w], free[w].astype(np.uint8))))
        free[w] = False
    return pa.Table.from_batches([batch(out)])


def _compare(length: int, kind: str, group: pa.Table) -> pa.Table:
    """Runs of windows by phrase: which windows that ask have an equal one."""
    names = group.column("chunk").to_pylist()
    blobs = [unpack(x) for x in group.column("data").to_pylist()]
    key, size, asks = (np.concatenate([b[i] for b in blobs]) for i in range(3))
    text = np.concatenate([b[3] for b in blobs])
    width = size.astype(np.int64) + length - 1
    ends = np.cumsum(width)
    # phrases that no window asks for need no comparison; the others are compared in groups of about GROUP_BYTES
    use = np.flatnonzero(np.isin(key, key[asks > 0]))
    use = use[np.argsort(key[use], kind="stable")]
    found = np.zeros(len(text), bool)
    whole = np.flatnonzero(np.append(key[use][1:] != key[use][:-1], True)) + 1  # behind the last run of a phrase
    total, at = np.cumsum(width[use]), 0
    while at < len(use):
        limit = (total[at - 1] if at else 0) + GROUP_BYTES
        to = int(whole[max(np.searchsorted(whole, at, "right"), np.searchsorted(total[whole - 1], limit, "right") - 1)])
        runs = use[at:to]
        w = width[runs]
        places = np.repeat(ends[runs] - w, w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        found[places] = repeated(text[places], np.concatenate([[0], np.cumsum(w)]), length)
        at = to
    out, run = [], 0
    for name, blob in zip(names, blobs, strict=True):
        mine = np.arange(run, run + len(blob[0]))
        run += len(blob[0])
        mine = mine[asks[mine] > 0]
        n = size[mine].astype(np.int64)
        at = np.repeat((ends - width)[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append((name, kind, group.column("r")[0].as_py(), pack(found[at].astype(np.uint8))))
    return pa.Table.from_batches([batch(out)])


def _words_touched(texts: Texts, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each range of bytes, how many words lie in it, in part or whole."""
    blank = np.isin(texts.data, np.frombuffer(BLANKS.encode(), np.uint8))
    fresh = ~blank
    fresh[1:] &= blank[:-1]
    fresh[texts.offsets[:-1][texts.sizes > 0]] = ~blank[texts.offsets[:-1][texts.sizes > 0]]
    before = np.concatenate([[0], np.cumsum(fresh)])
    return before[end] - before[begin] + (~blank[begin] & ~fresh[begin])


def _removed(texts: Texts, rule: Rule, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the starts of repeated strings: the bytes that go, and where maximal runs of them begin and end."""
    steps = np.zeros(len(starts) + rule.length + 1, np.int32)
    position = np.flatnonzero(starts)
    steps[position] += 1
    steps[position + rule.length] -= 1
    gone = np.cumsum(steps, dtype=np.int32)[: len(starts)] > 0
    edge = np.ones(len(gone), bool)
    edge[1:] = gone[1:] != gone[:-1]
    edge[texts.offsets[:-1][texts.sizes > 0]] = True
    bounds = np.append(np.flatnonzero(edge), len(gone))
    out = gone[bounds[:-1]]
    begin, end = bounds[:-1][out], bounds[1:][out]
    if rule.words and len(begin):
        few = _words_touched(texts, begin, end) < rule.words
        steps = np.zeros(len(gone) + 1, np.int8)
        steps[begin[few]] += 1
        steps[end[few]] -= 1
        gone &= np.cumsum(steps[:-1]) == 0
        begin, end = begin[~few], end[~few]
    return gone, begin, end


def repeats(docs: DataFrame, rules: Sequence[Rule] = (Rule(LENGTH),), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tid, n_bytes, spans, kept: one row for each input row.

    tid is the md5 of the text; spans holds, for each rule, the maximal removed runs as struct(start, end) in bytes; kept the
    bytes that the first rule leaves. A byte is removed if a string of `length` bytes that covers it also starts anywhere
    else, in this document or another, and its run touches as many words as the rule asks for; strings are judged on the
    input. Null texts are empty, and texts shorter than `length` lose nothing. Repeated rows are documents of their own, so
    all of a text of that length goes from each of them. The result is bytes: a cut may part a character. Ids of any plain type come
    back as they are, null as null. An empty table gives no rows. All rules are answered from one parse.
    """
    spark = docs.sparkSession
    small_batches(spark, size=1 << 20)
    least = min(rule.length for rule in rules)
    kinds = [f"{k}{i}" for k in ("hashes", "runs") for i in range(len(rules))]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    plain = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.unhex(F.md5(text)).alias("tid"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n = int(max(1, -(-total // RANGE_BYTES), min(spark.sparkContext.defaultParallelism, total // (1 << 20))))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for one in batches:
            for doc in zip(one.column("doc_id").to_pylist(), one.column("tid").to_pylist(), one.column("text").to_pylist(), strict=True):
                held.append(doc)
                size += len(doc[2])
                if size >= CHUNK_BYTES:
                    yield rows([uuid.uuid4().hex], ["chunk"], [0], [Texts.packed(held)])
                    held, size = [], 0
        if held:
            yield rows([uuid.uuid4().hex], ["chunk"], [0], [Texts.packed(held)])

    def ask_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data in each(batches):
            texts = Texts(data, least)
            counts = np.bincount(texts.which, minlength=len(texts.distinct)).astype(np.uint32)
            yield batch(requests(name, "phrases", texts.distinct, [counts], n))

    def ask_sequences(group: pa.Table) -> pa.Table:
        name, part = parts(group)
        texts, asked = Texts(part["chunk"], least), []
        if len(texts.distinct):
            for i, rule in enumerate(rules):
                _, distinct, second, which = texts.sequences(texts.open(part["phrases"][0], rule.length), rule.length)
                counts = np.bincount(which, minlength=len(distinct)).astype(np.uint32)
                asked += requests(name, f"sequences{i}", distinct, [second.view(np.int64), counts], n)
        return pa.Table.from_batches([batch(asked)])

    def ask_windows(group: pa.Table) -> pa.Table:
        name, part = parts(group)
        texts, asked = None, []
        for i, rule in enumerate(rules):
            if f"sequences{i}" in part:
                texts = texts or Texts(part["chunk"], least)
                left = Open(texts, rule.length, part["phrases"][0], *part[f"sequences{i}"])
                counts = np.bincount(left.hash_which, minlength=len(left.hashes)).astype(np.uint32)
                asked += requests(name, f"hashes{i}", left.hashes, [left.checks.view(np.int64), counts], n)
                asked += [*_ask_runs(name, f"runs{i}", texts, rule.length, left, n), (name, f"left{i}", 0, left.packed())]
        return pa.Table.from_batches([batch(asked)])

    def answer(group: pa.Table) -> pa.Table:
        """One kind of questions to one range."""
        kind = group.column("kind")[0].as_py()
        i = int(kind[-1])
        return _compare(rules[i].length, f"found{i}", group) if kind.startswith("runs") else _count(kind, group)

    def finish(group: pa.Table) -> pa.Table:
        _, part = parts(group)
        texts = Texts(part["chunk"], least, parse=False)
        lists, gone = [], np.zeros(0, bool)
        for i, rule in enumerate(rules):
            starts = np.zeros(len(texts.data), bool)
            if f"left{i}" in part:
                settled, plain, which, first, size = part[f"left{i}"]
                starts[:] = np.unpackbits(settled, count=len(starts))
                if len(plain):
                    starts[plain[part[f"hashes{i}"][0][which] > 1].astype(np.int64)] = True
                if len(first):
                    size = size.astype(np.int64)
                    position = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    starts[position[part[f"found{i}"][0] > 0]] = True
            cut, begin, end = _removed(texts, rule, starts)
            gone = gone if i else cut
            doc = np.searchsorted(texts.offsets, begin, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(begin - texts.offsets[doc]), pa.array(end - texts.offsets[doc])], names=["start", "end"])
            lists.append((np.searchsorted(doc, np.arange(len(texts.sizes) + 1)), spans))
        # the rules' lists of a document one after the other
        m, k = len(texts.sizes), len(rules)
        base = np.cumsum([0, *(len(spans) for _, spans in lists)])
        sizes = np.stack([np.diff(places) for places, _ in lists], 1) if m else np.zeros((0, k), np.int64)
        first = np.stack([base[i] + places[:-1] for i, (places, _) in enumerate(lists)], 1).reshape(-1)
        flat = sizes.reshape(-1)
        ends = np.cumsum(flat)
        order = np.repeat(first, flat) + np.arange(flat.sum()) - np.repeat(ends - flat, flat)
        spans = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.concat_arrays([x for _, x in lists]).take(pa.array(order)))
        left_sizes = np.concatenate([[0], np.cumsum(~gone)])[texts.offsets].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(left_sizes), pa.py_buffer(np.ascontiguousarray(texts.data[~gone]))])
        tids = pa.Array.from_buffers(pa.binary(16), m, [None, pa.py_buffer(np.ascontiguousarray(texts.tids))]).cast(pa.binary())
        return pa.table(
            {
                "doc_id": unpacked_names(texts.names, texts.letters), "tid": tids, "n_bytes": texts.sizes.astype(np.int64),
                "spans": pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * k, spans), "kept": kept,
            }
        )

    chunks = stash(plain.mapInArrow(chunked, BLOB), "texts")
    phrases = chunks.mapInArrow(ask_phrases, BLOB).groupBy("r").applyInArrow(lambda g: _count("phrases", g), BLOB)
    known = [chunks, stash(phrases, "phrases")]
    together = lambda: _union(known).groupBy("chunk")
    sequences = together().applyInArrow(ask_sequences, BLOB).groupBy("kind", "r").applyInArrow(answer, BLOB)
    known.append(stash(sequences, "sequences"))
    asked = stash(together().applyInArrow(ask_windows, BLOB), "windows", "kind")
    answers = asked.where(F.col("kind").isin(kinds)).groupBy("kind", "r").applyInArrow(answer, BLOB)
    for done in known[1:]:
        drop_stash(done)
    known = [chunks, asked.where("kind like 'left%'"), stash(answers, "answers")]
    drop_folders(asked, [f"kind={kind}" for kind in kinds])
    out = together().applyInArrow(finish, "doc_id string, tid binary, n_bytes long, spans array<array<struct<start:long,end:long>>>, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def remove(docs: DataFrame, rule: Rule = Rule(LENGTH), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, repeated passages removed from the text; characters of which only a part is left go
    too. Null texts stay null."""
    found = repeats(docs, (rule,), id_col, text_col).where("size(spans[0]) > 0")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("_id")
    changed = found.select(name(F.col("doc_id")), F.col("tid").alias("_tid"), F.col("kept").alias("_kept"))
    changed = changed.groupBy("_id", "_tid").agg(F.first("_kept").alias("_kept"))
    tid = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("_tid")
    packed = docs.select(F.struct("*").alias("row"), name(F.col(id_col)), tid)
    joined = packed.join(changed, ["_id", "_tid"], "left")
    # what is no valid UTF-8 becomes U+FFFD; those that the text didn't have go
    clean = F.make_valid_utf8(F.col("_kept").cast("string"))
    clean = F.when(F.contains(F.col(f"row.{text_col}"), F.lit("�")), clean).otherwise(F.replace(clean, F.lit("�"), F.lit("")))
    text = F.when(F.col("_kept").isNull(), F.col(f"row.{text_col}")).otherwise(clean)
    return joined.withColumn("row", F.col("row").withField(text_col, text)).select("row.*")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal by strings of 400 bytes; behind it, by the same parse, the passages of over 50 words that stand elsewhere too,
    most of which are shorter than 400 bytes."""
    found = repeats(table(spark, sf_dir, "documents"), (Rule(LENGTH), PASSAGE))
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    strings, passages = F.get("spans", F.lit(0)), F.get("spans", F.lit(1))
    return found.select(
        "doc_id", "n_bytes", size(strings).alias("n_removed"), F.size(strings).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.size(passages).cast("long").alias("n_passages"), size(passages).alias("n_passage_bytes"),
    )


QUERIES = {"op2_repeated_passages": op2_repeated_passages}
ORACLES: dict[str, str] = {}
