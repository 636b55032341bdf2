"""LM scoring (operator 10): an n-gram model with Katz backoff, trained on the corpus and evaluated on every text.

p(w|h) = d(c) c(h,w) / C(h) where the n-gram (h,w) was seen in training, else alpha(h) p(w|h') with h' the history without its first
token, and p(w|h') where h was not seen; at last p(w). d are the Good-Turing discounts of Katz, an order's own; p(w) is discounted
likewise and leaves its rest to all unknown words together; alpha(h) makes the probabilities after h sum to one exactly. C(h) is the
count of h, or half more where no n-gram of h is discounted, so that every history leaves something.

How it is spread. Texts are cut in chunks of about CHUNK_TOKENS tokens. A chunk stores its distinct words, as 64-bit hashes, and its
tokens as numbers into them; hashes of n-grams follow from these. Order by order it asks for its distinct n-grams by sending their
sorted hashes, with its own training counts, to reducers that each own a range of hashes; a reducer adds up, which is the model's
table for that range, and answers with one number for each hash asked, in the same order. For each n-gram one chunk is named its owner
and adds it to the sums of its history, which go to ranges likewise; only histories are sent that some held-out text has, or whose
denominator may need the half. So every n-gram crosses the network once for a chunk, however often it occurs, no key is hot, and
no task holds more than a chunk or a range.

train() keeps the tables, by order and hash range: n-gram counts, and for each history what alpha follows from. score() then reads them
for other texts; without a model it trains on the texts that it scores, and keeps no tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import BLOB, batch, each, pack, pack_names, parts, requests, rows, unpack, unpacked_names
from .common import drop_stash, small_batches, stash, table
from .words import U, mix, texts_hashed

ORDER = 3
CHUNK_TOKENS = 900_000
#: Tokens for one range of hashes.
RANGE_TOKENS = 2_500_000
#: Counts up to MOST are discounted.
MOST = 5
UNKNOWN_SHARE = 0.1
START, END = mix(np.array([0x5354415254, 0x454E44], np.uint64))
_NEXT = U(0x2545F4914F6CDD1D)
TABLE = "kind string, r int, data binary"


def joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from its history's and its last word's."""
    return mix(history * _NEXT + word)


def starts(order: int) -> list[np.uint64]:
    """The hashes of one, two and so on start marks: histories of first tokens."""
    out = [START]
    for _ in range(order - 1):
        out.append(joined(np.array([out[-1]]), np.array([START]))[0])
    return out


class Level(NamedTuple):
    """The n-grams of one order in a chunk: sorted distinct hashes (the start marks among them), each token's place there, and for each
    n-gram a token that ends it."""

    keys: np.ndarray
    which: np.ndarray
    sample: np.ndarray
    mark: int


class Chunk:
    """Documents as numbers into distinct words; frequent words have small numbers, which take less room."""

    def __init__(self, data: bytes):
        self.names, self.letters, self.held, self.lengths, self.words, self.tokens = unpack(data)
        self.first = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])[:-1]
        self.trained = np.repeat(self.held == 0, self.lengths)

    @staticmethod
    def packed(docs: list[tuple[str | None, bool, np.ndarray]]) -> bytes:
        lengths = np.array([len(w) for _, _, w in docs], np.uint32)
        words, tokens, counts = np.unique(np.concatenate([w for _, _, w in docs]), return_inverse=True, return_counts=True)
        # equally frequent words stay sorted
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words, tokens = words[order], rank[tokens]
        return pack(*pack_names([i for i, _, _ in docs]), np.array([h for _, h, _ in docs], np.uint8), lengths, words, tokens, level=3)

    def before(self, values: np.ndarray, mark) -> np.ndarray:
        """Each token's value of the token before it in its document; the mark for first tokens."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = mark
        return out

    def levels(self, top: int, only: int | None = None) -> list[Level | None]:
        """Orders 1 to top; or of these only one, the others None."""
        word = self.words[self.tokens]
        grams, out, marks = word, [], starts(top)
        for k in range(top):
            if k:
                grams = joined(self.before(grams, marks[k - 1]), word)
            if only is not None and k + 1 != only:
                out.append(None)
                continue
            keys, sample, which = np.unique(np.append(grams, marks[k]), return_index=True, return_inverse=True)
            mark = int(which[-1])
            sample[mark] = 0  # no token ends it
            out.append(Level(keys, which[:-1].astype(np.int32), sample.astype(np.int32), mark))
            del which, sample
        return out

    def counts(self, level: Level) -> tuple[np.ndarray, np.ndarray]:
        """Training occurrences of each n-gram, for the start marks training documents; and whether a held-out text has it."""
        n = len(level.keys)
        own = np.bincount(level.which[self.trained], minlength=n).astype(np.int64)
        held = np.bincount(level.which[~self.trained], minlength=n) > 0
        own[level.mark] = (self.held == 0).sum()
        held[level.mark] = (self.held == 1).any()
        return own, held


def discounts(n: list[int]) -> np.ndarray:
    """d(0..MOST) from n[c], the number of types seen c times, c up to MOST + 1. Katz's formula for the largest limit with
    which all discounts lie between 0 and 1; where none is, as for a tiny corpus, half a count is taken off."""
    for limit in range(MOST, 0, -1):
        if min(n[1 : limit + 2]) <= 0:
            continue
        top = (limit + 1) * n[limit + 1] / n[1]
        if top >= 1:
            continue
        d = [((c + 1) * n[c + 1] / (c * n[c]) - top) / (1 - top) for c in range(1, limit + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([0.0, *d, *[1.0] * (MOST - limit)])
    return np.array([0.0, *((c - 0.5) / c for c in range(1, MOST + 1))])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts > MOST, counts, d[np.minimum(counts, MOST)] * counts)


class Unigrams:
    """p(w) from training counts; unknown words together have the rest of the mass."""

    def __init__(self, tokens: int, types: int, n: list[int]):
        self.tokens, self.types, self.d = tokens, types, discounts(n)
        taken = sum(c * n[c] * (1 - self.d[c]) for c in range(1, MOST + 1))
        self.unknown = taken / tokens if tokens else 1.0
        self.added = tokens == 0 or self.unknown < 1e-12  # nothing discounted: add a share to all counts instead

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        if self.added:
            return self.base(counts)
        return np.where(counts > 0, discounted(counts, self.d) / self.tokens, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + UNKNOWN_SHARE) / (self.tokens + UNKNOWN_SHARE * (self.types + 1))


class Model(NamedTuple):
    """What is known of a model besides its tables: numbers of tokens, types and types by count, an order each, and the ranges."""

    order: int
    ranges: int
    statistics: list[list[int]]
    path: str | None = None

    @property
    def unigrams(self) -> Unigrams:
        total, types, *few = self.statistics[0]
        return Unigrams(total, types, [0, *few])

    def discounts(self, k: int) -> np.ndarray:
        return discounts([0, *self.statistics[k - 1][2:]])

    def surely_discounted(self, k: int) -> int:
        """Histories seen less often than this leave something: all counts below are discounted."""
        d = self.discounts(k)
        return next((c for c in range(1, MOST + 1) if d[c] >= 1), MOST + 1)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str | None, bool, np.ndarray]] = []
    tokens = 0
    for one in batches:
        for doc_id, out, words in zip(one.column("doc_id").to_pylist(), one.column("held").to_pylist(), texts_hashed(one.column("text"), lower=True), strict=True):
            held.append((doc_id, out, np.append(words, END)))
            tokens += len(words) + 1
            if tokens >= CHUNK_TOKENS:
                yield rows([uuid.uuid4().hex], ["chunk"], [0], [Chunk.packed(held)])
                held, tokens = [], 0
    if held:
        yield rows([uuid.uuid4().hex], ["chunk"], [0], [Chunk.packed(held)])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data in each(batches):
        yield pa.RecordBatch.from_arrays([pa.array([len(Chunk(data).tokens)], pa.int64())], names=["n"])


class _Merged:
    """What chunks and, if there is one, the kept table ask of a range: sorted distinct keys, and each chunk's places there."""

    def __init__(self, group: pa.Table):
        names = group.column("chunk").to_pylist()
        blobs = [unpack(x) for x in group.column("data").to_pylist()]
        self.keys, which = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        places = np.split(which, np.cumsum([len(b[0]) for b in blobs])[:-1])
        self.all = list(zip(names, blobs, places, strict=True))
        self.chunks = [x for x in self.all if x[0]]

    def total(self, i: int) -> np.ndarray:
        """Sums of a whole-numbered column."""
        out = np.zeros(len(self.keys))
        for _, blob, places in self.all:
            out[places] += blob[i]  # keys of one chunk are distinct
        return np.rint(out).astype(np.int64)


ANSWER = BLOB + ", numbers array<long>"


def _answers(answered: list[tuple[str, str, bytes]], r: int, statistics: np.ndarray | None = None) -> pa.Table:
    found = [(chunk, kind, r, data, None) for chunk, kind, data in answered]
    if statistics is not None:
        found.append(("", "statistics", r, b"", statistics.astype(np.int64).tolist()))
    chunk, kinds, ranges, data, numbers = zip(*found, strict=True) if found else ((),) * 5
    return pa.table({"chunk": pa.array(chunk, pa.string()), "kind": pa.array(kinds, pa.string()), "r": pa.array(ranges, pa.int32()), "data": pa.array(data, pa.binary()), "numbers": pa.array(numbers, pa.list_(pa.int64()))})


def _histogram(counts: np.ndarray) -> np.ndarray:
    """Sum, types seen, then the types seen once, twice and so on to MOST + 1."""
    seen = counts[counts > 0]
    few = np.bincount(seen[seen <= MOST + 1].astype(np.int64), minlength=MOST + 2)[1:]
    return np.concatenate([[seen.sum(), len(seen)], few])


def _count(k: int, keep: bool, group: pa.Table) -> pa.Table:
    """Answers with total counts, and for each whether the asking chunk is the first that has it in training (1) and whether any chunk has it
    in a held-out text (2)."""
    merged, r = _Merged(group), group.column("r")[0].as_py()
    totals, held = merged.total(1), np.zeros(len(merged.keys), bool)
    for _, blob, places in merged.chunks:
        held[places] |= blob[2] > 0
    free, answered = np.ones(len(merged.keys), bool), []
    for name, blob, places in merged.chunks:
        owner = free[places] & (blob[1] > 0)
        free[places[owner]] = False
        answered.append((name, f"count{k}", pack(totals[places], (owner + 2 * held[places]).astype(np.uint8))))
    if keep:
        answered.append(("", f"table{k}", pack(merged.keys, totals)))
    return _answers(answered, r, _histogram(totals[merged.keys != starts(k)[-1]]))


def _tally(which: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n: how many of the counts are 1, 2 and so on to MOST, how many are above, and the sum of those. Whole
    numbers, so that sums are exact whatever their order, and small ones, so that they compress."""
    small = [np.bincount(which[counts == c], minlength=n).astype(np.uint32) for c in range(1, MOST + 1)]
    above = counts > MOST
    return [*small, np.bincount(which[above], minlength=n).astype(np.uint32), np.rint(np.bincount(which[above], counts[above], n)).astype(np.int64)]


TALLY = MOST + 2


def _mass(tally: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    return sum(d[c] * c * tally[c - 1] for c in range(1, MOST + 1)) + tally[-1]


def _sums(k: int, keep: bool, model: Model, group: pa.Table) -> pa.Table:
    """Of a range's histories of order k, as asked: whether nothing of their n-grams is discounted (1), and the discounted mass of these and of
    the shorter n-grams behind them (2). In order 2 the latter is a probability, above the part of the shorter history's counts."""
    merged, r = _Merged(group), group.column("r")[0].as_py()
    tallies = [merged.total(i) for i in range(1, 1 + 2 * TALLY)]
    seen, below = tallies[:TALLY], tallies[TALLY:]
    mass, u = _mass(seen, model.discounts(k)), model.unigrams
    if k > 2:
        lower = _mass(below, model.discounts(k - 1))
    elif u.added:
        shares = sum((c + UNKNOWN_SHARE) * below[c - 1] for c in range(1, MOST + 1)) + below[-1] + UNKNOWN_SHARE * below[-2]
        lower = shares / (u.tokens + UNKNOWN_SHARE * (u.types + 1))
    else:
        lower = _mass(below, u.d) / u.tokens
    count = sum(c * seen[c - 1] for c in range(1, MOST + 1)) + seen[-1]
    half, answered = (count - mass < 1e-9).astype(np.uint8), []
    for name, blob, places in merged.chunks:
        first, second = places[blob[-1] & 1 > 0], places[blob[-1] & 2 > 0]
        answered.append((name, f"sums{k}", pack(half[first], mass[second], lower[second])))
    if keep:
        answered.append(("", f"history{k}", pack(merged.keys, *tallies)))
    return _answers(answered, r)


class _Counted:
    """A chunk with its orders and what is known of their n-grams."""

    def __init__(self, part: dict, model: Model):
        self.chunk, self.model = Chunk(part["chunk"]), model
        self.levels = self.chunk.levels(model.order)
        self.total = [part[f"count{k}"][0] for k in range(1, model.order + 1)]
        flags = [part[f"count{k}"][1] for k in range(1, model.order + 1)]
        self.owner, self.held = [f & 1 > 0 for f in flags], [f & 2 > 0 for f in flags]
        #: By order from 2: the places of each n-gram's history and of its end without the first token, in the order below.
        self.history, self.shorter = [], []
        for k in range(1, model.order):
            below, sample = self.levels[k - 1], self.levels[k].sample
            self.history.append(self.chunk.before(below.which, below.mark)[sample])
            shorter = below.which[sample]
            shorter[self.levels[k].mark] = below.mark
            self.shorter.append(shorter)

    def real(self, k: int) -> np.ndarray:
        """Places of order k + 1 that are n-grams, not start marks."""
        out = np.ones(len(self.levels[k].keys), bool)
        out[self.levels[k].mark] = False
        return out

    def asked(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the histories of order k: those whose denominator may need the half, and those whose alpha this chunk needs."""
        total = self.total[k - 2]
        half = total >= self.model.surely_discounted(k)
        alpha = np.zeros(len(total), bool)
        alpha[self.history[k - 2][self.real(k - 1) & (self.total[k - 1] == 0)]] = True
        return half, alpha & (total > 0)

    def told(self, k: int, half: np.ndarray) -> np.ndarray:
        """Histories of order k of whose n-grams someone may need to know: known ones that held-out texts have, or that may need the half."""
        return (self.total[k - 2] > 0) & (self.held[k - 2] | half)


def _run(chunks: DataFrame, order: int, ranges: int, model: Model | None, keep: str | None) -> tuple[Model, list[DataFrame]]:
    """Counts and sums of the chunks' n-grams: the model, and the answers to the chunks. model: one whose tables are read instead of the
    chunks' own counts. keep: a folder for the tables."""
    spark = chunks.sparkSession
    answers, statistics = [], []

    def tables(kind: str, asked_as: str) -> DataFrame:
        kept = spark.read.schema(TABLE).parquet(f"{model.path}/tables/{kind}")
        return kept.select(F.lit("").alias("chunk"), F.lit(asked_as).alias("kind"), "r", "data")

    def counts_asked(k: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, data in each(batches):
                chunk = Chunk(data)
                level = chunk.levels(k, only=k)[-1]
                own, held = chunk.counts(level)
                if model is not None:  # all texts are to be scored, none adds to the counts
                    own, held = np.zeros_like(own), np.ones_like(held)
                yield batch(requests(name, f"count{k}", level.keys, [own, held.astype(np.uint8)], ranges))

        return work

    def answered(asked: DataFrame, kinds: list[str], by: str | None, answer) -> DataFrame:
        """Answers of ranges to one question or several; kinds: those of the tables."""
        for kind in kinds if model is not None else ():
            asked = asked.unionByName(tables(kind, kind.replace("history", "sums").replace("table", "count")))
        out = stash(asked.groupBy(*filter(None, [by]), "r").applyInArrow(answer, ANSWER), "lm-answers")
        for kind in kinds if keep is not None else ():
            out.where(F.col("kind") == kind).select("kind", "r", "data").write.parquet(f"{keep}/tables/{kind}")
        return out

    def count_answered(k: int):
        return lambda group: _count(k, keep is not None, group)

    for k in range(1, order + 1):
        found = answered(chunks.mapInArrow(counts_asked(k), BLOB), [f"table{k}"], None, count_answered(k))
        sums = [F.coalesce(F.sum(F.get("numbers", F.lit(i))), F.lit(0)) for i in range(MOST + 3)]
        statistics.append(list(found.where("kind = 'statistics'").agg(*sums).first()))  # a few numbers
        answers.append(found.where("chunk <> ''").drop("numbers"))
    known = Model(order, ranges, statistics) if model is None else model
    together = _union([chunks, *answers])

    def sums_asked(group: pa.Table) -> pa.Table:
        name, part = parts(group)
        c, asked = _Counted(part, known), []
        for k in range(2, order + 1):
            half, alpha = c.asked(k)
            if model is not None:
                want, mine = half | alpha, np.zeros(len(c.owner[k - 1]), bool)
            else:
                want, mine = c.total[k - 2] > 0 if keep is not None else c.told(k, half), c.owner[k - 1] & c.real(k - 1)
            n, history = len(want), c.history[k - 2]
            columns = [*_tally(history[mine], c.total[k - 1][mine], n), *_tally(history[mine], c.total[k - 2][c.shorter[k - 2][mine]], n), (half + 2 * alpha).astype(np.uint8)]
            asked += requests(name, f"sums{k}", c.levels[k - 2].keys[want], [x[want] for x in columns], ranges)
            del columns
        return pa.Table.from_batches([batch(asked)])

    def sums_answered(group: pa.Table) -> pa.Table:
        return _sums(int(group.column("kind")[0].as_py()[len("sums") :]), keep is not None, known, group)

    if order > 1:
        asked = together.groupBy("chunk").applyInArrow(sums_asked, BLOB)
        histories = [f"history{k}" for k in range(2, order + 1)]
        answers.append(answered(asked, histories, "kind", sums_answered).where("chunk <> ''").drop("numbers"))
    return known, answers


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def probabilities(c: _Counted, sums: dict[int, list[np.ndarray]]) -> np.ndarray:
    """log10 of each token's probability, by recursion from single words up. sums: by order, the answers to _Counted.asked()."""
    model = c.model
    p = model.unigrams(c.total[0])
    whole_below = None
    for k in range(2, model.order + 1):
        d, counts, total = model.discounts(k), c.total[k - 1], c.total[k - 2].astype(float)
        half, wanted = c.asked(k)
        whole = total.copy()
        whole[half] += 0.5 * sums[k][0]
        mass, lower = sums[k][1:]
        if k > 2:  # the part of what the shorter history has
            lower = lower / whole_below[c.shorter[k - 3]][wanted]
        alpha = np.ones(len(total))
        alpha[wanted] = (1 - mass / whole[wanted]) / (1 - lower)
        history = c.history[k - 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(counts > 0, discounted(counts, d) / whole[history], alpha[history] * p[c.shorter[k - 2]])
        whole_below = whole
    return np.log10(p)[c.levels[-1].which]


def _prepared(docs: DataFrame, held: Column, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The texts in chunks, and the number of their tokens."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("string").alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))
    chunks = stash(plain.mapInArrow(_chunked, BLOB), "lm-chunks")
    return chunks, chunks.mapInArrow(_sized, "n long").agg(F.sum("n")).first()[0] or 0


def _ranges(spark: SparkSession, tokens: int) -> int:
    return int(max(1, -(-tokens // RANGE_TOKENS), min(spark.sparkContext.defaultParallelism, tokens // 100_000)))


def train(docs: DataFrame, path: str, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of all the texts, its tables kept in a new folder: tables/table<k> with the counts of order k and tables/history<k> with each
    history's tallies, a row a hash range (kind, r, data); model.json with the rest. Nulls, empty texts, repeats and empty tables as for
    score()."""
    spark = docs.sparkSession
    chunks, tokens = _prepared(docs, F.lit(False), id_col, text_col)
    model, _ = _run(chunks, order, _ranges(spark, tokens), None, path)
    drop_stash(chunks)
    text = json.dumps({"order": model.order, "ranges": model.ranges, "statistics": model.statistics})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/model.json")
    return model._replace(path=path)


def load(spark: SparkSession, path: str) -> Model:
    """A model that train() kept."""
    return Model(**json.loads(spark.read.text(f"{path}/model.json").first()[0]), path=path)


def score(docs: DataFrame, held: Column | None = None, order: int = ORDER, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each input row.

    held says which rows are kept out of training; without it those whose crc32 of the id's text is divisible by ten. With a model
    nothing is trained here and its order holds. Tokens are words in lower case (A to Z), then one end. base_score adds log10((c +
    0.1) / (N + 0.1 (V + 1))), score the model's log10 probabilities. Null and empty texts are just an end. Ties and repeated rows count
    as often as they occur. Ids may be of any plain type; a null id counts as an empty one and comes back as null. If nothing is for training, all counts are 0 and
    scores are those of one unknown word. An empty table gives no rows. n-grams are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    held = F.crc32(own.cast("binary")) % 10 == 0 if held is None else held
    chunks, tokens = _prepared(docs, held, id_col, text_col)
    order, ranges = (order, _ranges(spark, tokens)) if model is None else (model.order, model.ranges)
    known, answers = _run(chunks, order, ranges, model, None)
    unigrams = known.unigrams

    def evaluate(group: pa.Table) -> pa.Table:
        _, part = parts(group)
        c = _Counted(part, known)
        none = [np.zeros(0)] * 3
        scores = probabilities(c, {k: part.get(f"sums{k}", none) for k in range(2, order + 1)})
        chunk, words = c.chunk, c.levels[0]
        seen, base = c.total[0] > 0, np.log10(unigrams.base(c.total[0]))
        add = lambda x: np.add.reduceat(x, chunk.first)
        return pa.table(
            {
                "doc_id": unpacked_names(chunk.names, chunk.letters), "held_out": pa.array(chunk.held == 1), "n_tokens": chunk.lengths.astype(np.int64),
                "n_known": add(seen[words.which].astype(np.int64)), "train_tokens": np.full(len(chunk.first), unigrams.tokens, np.int64),
                "base_score": add(base[words.which]), "score": add(scores),
            }
        )

    out = _union([chunks, *answers]).groupBy("chunk").applyInArrow(
        evaluate, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op10_katz_scores": op10_katz_scores}
ORACLES: dict[str, str] = {}
